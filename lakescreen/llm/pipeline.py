"""A corpus in five stages: toxic documents out, near duplicates down to one, test leaks out, personal data masked, sources mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next stage's docs.
All but the last return the columns of docs, whatever they are called. The last returns one row for each time that the mix takes a
document: the columns of docs, and copy (the number of that copy), size and target (of its source), each with a "_" behind its name
where docs has such a column.

Defined cases: a null text is not toxic by itself (it has the score of the model's bias), not a duplicate and not a leak, and has size 0, so the
mix takes none of it; documents with a null doc_id stay, equal ones once; different texts under one doc_id are documents of their
own; rows that are equal in doc_id and text are one document once near duplicates are gone; tables without rows, labels or test items
give what is left without them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, mixing, near_dedup, pii, toxicity
from .common import fresh, read_table, shared_folder

TOXIC_FROM = 0.4


def _row(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart: the id and 128 bits of the text."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for toxic go."""
    model = toxicity.teach(docs, read_table(spark, sf_dir, "labels"))
    score = fresh("score", docs.columns)
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its class stays, once; classes are of similarity 0.8 on five-word shingles."""
    return near_dedup.heads(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    leak = fresh("leak", docs.columns)
    return decontam.flagged(docs, read_table(spark, sf_dir, "benchmark"), leak).where(~F.col(leak)).drop(leak)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All identifiers in the texts become marks."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy that the mix takes is a row. Slim rows are mixed; texts are shuffled once."""
    taken = mixing.mix(docs.select("doc_id", "source", "text", _row().alias("row")), carry=("row",)).where("copies > 0")
    # rows that are the same in doc_id and text are one row, taken as often as they are together
    taken = taken.groupBy("row").agg(F.sum("copies").cast("int").alias("copies"), F.first("size").alias("size"), F.first("target").alias("target"))
    row = fresh("_row", docs.columns)
    names = {c: fresh(c, [*docs.columns, row]) for c in ("copy", "size", "target")}
    copies = fresh("copies", [*docs.columns, *names.values(), row])
    taken = taken.select(F.col("row").alias(row), F.col("copies").alias(copies), *[F.col(c).alias(names[c]) for c in ("size", "target")])
    chosen = docs.withColumn(row, _row()).join(taken, row).dropDuplicates([row])
    return chosen.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(row, copies)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: The first stage's learned model cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what the others return is written to the shared folder in turn."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
