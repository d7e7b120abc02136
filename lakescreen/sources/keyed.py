"""Tables by key that are changed in place: copy on write of the touched hash partitions, a manifest swapped last; columns that are added later.

A table is a folder with ``data/<version>/_part=<k>`` and ``manifest/<version>``, which names the folder of each partition. A change reads and
writes just the partitions that its keys fall into, then writes the next manifest. Readers take the highest manifest, so they see a change
whole or not at all; files of untouched partitions stay where they are. A second writer of the same version fails, and nothing of it is seen.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"


def _manifest(spark: SparkSession, folder: str) -> tuple[int, int, dict[int, str]]:
    """Version, number of partitions, and the folder of each that has rows: at most as many rows as partitions."""
    try:
        told = spark.read.schema("version long, parts int, part int, at string").json(f"{folder}/manifest/*")
    except AnalysisException:
        return 0, 0, {}
    rows = told.join(F.broadcast(told.agg(F.max("version").alias("version"))), "version").collect()
    return rows[0].version, rows[0].parts, {r.part: r["at"] for r in rows if r.part is not None}


def _placed(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def _rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*folders)


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table as its last manifest names it, with all columns that any of its files has; None while there is none."""
    version, _, places = _manifest(spark, folder)
    return _rows(spark, sorted(places.values())) if version and places else None


def upsert(df: DataFrame, folder: str, keys: list[str], parts: int = 64, unless: Column | None = None) -> int:
    """Put df's rows in place of those with equal keys, and add the others; returns how many partitions were written.

    Of rows of df with equal keys one stays, so give each key once. Stored rows where ``unless`` holds (a condition on the stored columns) stay
    as they are. New columns are null in stored rows, and missing ones in new rows. The number of partitions is that of the first call.
    Rows with a null in a key are rows of that key.
    """
    spark = df.sparkSession
    version, known, places = _manifest(spark, folder)
    parts = known or parts
    # told apart on driver as partition numbers: at most parts of them
    new = _placed(df.dropDuplicates(keys), keys, parts)
    touched = [r[PART] for r in new.select(PART).distinct().collect()]
    if not touched and version:
        return 0
    held = [places[p] for p in touched if p in places]
    if held:
        old = _rows(spark, held)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        if unless is not None:
            fixed = old.where(F.coalesce(unless, F.lit(False)))
            new = new.alias("n").join(fixed.alias("o"), same, "left_anti")
        rest = old.alias("o").join(new.select(*keys).alias("n"), same, "left_anti")
        new = new.unionByName(_placed(rest, keys, parts), allowMissingColumns=True)
    at = f"{folder}/data/{version + 1:08d}-{uuid.uuid4().hex}"
    new.repartition(max(1, len(touched)), PART).write.partitionBy(PART).parquet(at)
    places |= {p: f"{at}/{PART}={p}" for p in touched}
    told = [(version + 1, parts, p, a) for p, a in sorted(places.items())] or [(version + 1, parts, None, None)]
    spark.createDataFrame(told, "version long, parts int, part int, at string").coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest/{version + 1:08d}")
    return len(touched)


def columns(df: DataFrame) -> DataFrame:
    """The catalogue's view of a table: position, name, type, and whether nulls may stand there."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def added(df: DataFrame, wanted: str) -> tuple[DataFrame, list[str]]:
    """df with the columns of the DDL string wanted that it lacks, as nulls of their type; and their names. A column of another type is an error."""
    target = df.sparkSession.createDataFrame([], wanted).schema
    have = {f.name.lower(): f for f in df.schema.fields}
    clash = [f.name for f in target.fields if f.name.lower() in have and have[f.name.lower()].dataType != f.dataType]
    if clash:
        raise ValueError(f"columns of another type: {', '.join(clash)}")
    lacking = [f for f in target.fields if f.name.lower() not in have]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}), [f.name for f in lacking]


def for_lookups(df: DataFrame, folder: str, key: str, files: int = 16, rows_a_group: int = 100_000, distinct: int = 1_000_000) -> None:
    """Write df in ranges of key, sorted, in row groups of bounded size with a Bloom filter each: a lookup by key opens one file and reads one group."""
    ordered = df.repartitionByRange(files, key).sortWithinPartitions(key)
    writer = ordered.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
    writer.option("parquet.block.row.count.limit", str(rows_a_group)).parquet(folder)


def lookup(spark: SparkSession, folder: str, key: str, value: str) -> DataFrame:
    """The rows of one key; the condition reaches the scan, which leaves out files and row groups by their range and their filter."""
    return spark.read.parquet(folder).where(F.col(key) == F.lit(value))
