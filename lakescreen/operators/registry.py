"""Registry lookups with ordered fallback, seeding, ruleset resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(requests: DataFrame, candidates: Column, registry: DataFrame) -> DataFrame:
    """requests (request_id, doc_type) with the first of its candidate numbers that the registry holds; none gives nulls.

    Spark picks the join: it broadcasts the registry only if its size is known to be small, and shuffles by the key otherwise.
    """
    tried = requests.select("request_id", F.lower(F.trim("doc_type")).alias("doc_type"), F.posexplode(candidates).alias("pos", "number"))
    tried = tried.withColumn("doc_number", F.upper(F.trim("number"))).where("doc_number <> '' AND doc_type <> ''")
    hits = tried.join(registry, ["doc_type", "doc_number"]).groupBy("request_id").agg(F.min_by(F.struct("doc_number", "registry_status"), "pos").alias("hit"))
    return requests.join(hits, "request_id", "left").select(*requests.columns, "hit.doc_number", "hit.registry_status")


def seed(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose (doc_type, doc_number) is not there yet; a second seeding adds nothing."""
    return rows.join(current.select("doc_type", "doc_number"), ["doc_type", "doc_number"], "left_anti")


def resolve_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The ruleset for (country, doc_type), or else for any country, or else the general one."""
    out = requests
    steps = [(F.col("country"), F.col("doc_type")), (F.lit("*"), F.col("doc_type")), (F.lit("*"), F.lit("unknown"))]
    for k, (country, kind) in enumerate(steps):
        side = rules.select(F.col("rule_country").alias(f"c{k}"), F.col("rule_type").alias(f"t{k}"), F.col("ruleset").alias(f"r{k}"))
        out = out.join(side, (F.col(f"c{k}") == country) & (F.col(f"t{k}") == kind), "left")
    return out.select(*requests.columns, F.coalesce("r0", "r1", "r2").alias("ruleset"))


def repeated_numbers(rows: DataFrame, owner: str, value: str, name: str, order: str) -> DataFrame:
    """Rows whose value stood under another name before, in the same owner."""
    from pyspark.sql import Window

    before = F.lag(name).over(Window.partitionBy(owner, value).orderBy(order))
    return rows.withColumn("earlier_name", before).where(F.col("earlier_name") != F.col(name))
