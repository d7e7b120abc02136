"""Reading stored tables, uploads, JSON reports and directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table with its explicit schema, so that columns and filters reach the scan; added nullable columns read as null."""
    return spark.read.schema(schema).parquet(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with size, SHA-256 of the content and the kind that the first bytes tell."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "modificationTime", "length", "content", F.sha2("content", 256).alias("file_sha256"), magic(F.col("content")).alias("kind"))


def magic(content: Column) -> Column:
    """File kind by leading bytes; null if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(head.startswith("25504446"), "pdf")
    )


def rejected(extension: Column, length: Column, kind: Column, max_bytes: int = 10 << 20) -> Column:
    """Why an upload is refused; null if it is accepted."""
    known = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "pdf": "pdf"}
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(extension))
    return F.when(wanted.isNull(), "extension").when(length == 0, "empty").when(length > max_bytes, "too large").when(kind.isNull() | (kind != wanted), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def report(json: Column) -> Column:
    """A stored report as VARIANT; an empty object if it cannot be read."""
    return F.coalesce(F.try_parse_json(json), F.parse_json(F.lit("{}")))


def expired(files: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Files that retention gives up."""
    return files.where(F.col("modificationTime") < as_of - F.make_dt_interval(F.lit(days)))


def sealed(text: Column, encrypted: Column, key: Column) -> Column:
    """What is stored of a report: its AES-GCM cipher text in hex where the row's flag is set, else the text."""
    return F.when(encrypted, F.hex(F.aes_encrypt(text.cast("binary"), key.cast("binary"), F.lit("GCM"), F.lit("DEFAULT")))).otherwise(text)


def opened(stored: Column, encrypted: Column, key: Column) -> Column:
    """The report of a stored value, by the row's flag; null where the cipher text was changed or the key is another."""
    plain = F.try_aes_decrypt(F.unhex(stored), key.cast("binary"), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    return F.when(encrypted, plain).otherwise(stored)
