"""Screening tables derived from the driver's star schema, each in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DECISIONS, DOC_TYPES, EVENT_TYPES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS INTEGER) + 1]"


def screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    score = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice") % 101)
    return o.select(
        key.alias("id"),
        F.md5(key.cast("string")).alias("run_id"),
        F.sha2(key.cast("string"), 256).alias("file_sha256"),
        pick(DOC_TYPES, F.col("o_custkey") % 6).alias("doc_type_hint"),
        F.when(key % 4 != 0, pick(DOC_TYPES, key % 6)).alias("doc_type_detected"),
        F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("processing").alias("status"),
        score.alias("risk_score"),
        F.when(score <= 24, "low").when(score <= 49, "medium").when(score <= 74, "high").when(score.isNotNull(), "critical").alias("risk_band"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("human_review_required"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("operator_id"),
    )


SCREENINGS_SQL = f"""scr AS (SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) AS run_id, sha256(CAST(o_orderkey AS VARCHAR)) AS file_sha256,
  {_sql_pick(DOC_TYPES, 'o_custkey % 6')} AS doc_type_hint,
  CASE WHEN o_orderkey % 4 <> 0 THEN {_sql_pick(DOC_TYPES, 'o_orderkey % 6')} END AS doc_type_detected,
  CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'O' THEN 'pending_review' ELSE 'processing' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 101 END AS risk_score,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN CAST(floor(o_totalprice) AS BIGINT) % 101 <= 24 THEN 'low' WHEN CAST(floor(o_totalprice) AS BIGINT) % 101 <= 49 THEN 'medium'
    WHEN CAST(floor(o_totalprice) AS BIGINT) % 101 <= 74 THEN 'high' ELSE 'critical' END AS risk_band,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS human_review_required, o_orderdate AS created_at, o_custkey AS operator_id FROM orders)"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("screening_id"),
        pick(EVENT_TYPES, F.col("l_linenumber") % 3).alias("event_type"),
        F.when(F.col("l_linestatus") == "F", "anchored").otherwise("pending").alias("anchor_status"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_partkey").alias("block_number"),
        F.col("l_suppkey").alias("tx"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"),
    )


AUDIT_SQL = f"""aud AS (SELECT l_orderkey AS screening_id, {_sql_pick(EVENT_TYPES, 'l_linenumber % 3')} AS event_type,
  CASE WHEN l_linestatus = 'F' THEN 'anchored' ELSE 'pending' END AS anchor_status, l_shipdate AS created_at, l_partkey AS block_number,
  l_suppkey AS tx, l_linenumber AS line, l_extendedprice AS price FROM lineitem)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderkey % 3 = 0")
    return o.select(F.col("o_orderkey").alias("screening_id"), pick(DECISIONS, F.col("o_custkey") % 4).alias("decision"), F.col("o_custkey").alias("reviewer_id"), F.col("o_orderdate").alias("decided_at"))


REVIEWS_SQL = f"""rev AS (SELECT o_orderkey AS screening_id, {_sql_pick(DECISIONS, 'o_custkey % 4')} AS decision, o_custkey AS reviewer_id, o_orderdate AS decided_at
  FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0)"""

#: Fixed values of the derived registry.
REGISTRY_STATUSES = ("active", "expired", "reported_lost", "reported_stolen")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        pick(DOC_TYPES, F.col("p_partkey") % 5).alias("doc_type"),
        F.concat(F.lit("MOCK-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("doc_number"),
        pick(REGISTRY_STATUSES, F.col("p_size") % 4).alias("registry_status"),
        F.col("p_partkey").alias("part_id"),
    )


REGISTRY_SQL = f"""reg AS (SELECT {_sql_pick(DOC_TYPES, 'p_partkey % 5')} AS doc_type, 'MOCK-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS doc_number,
  {_sql_pick(REGISTRY_STATUSES, 'p_size % 4')} AS registry_status, p_partkey AS part_id FROM part)"""
#: Indicator kinds of the forensic stage.
INDICATORS = ("ela_inconsistency", "noise_inconsistency", "compression_inconsistency", "copy_paste_inconsistency", "image_editing_artifact", "region_anomaly", "metadata_anomaly", "model_verdict")


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    severity = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "R", "medium").when(F.col("l_linestatus") == "F", "low").otherwise("info")
    return li.select(F.col("l_orderkey").alias("id"), pick(INDICATORS, F.col("l_linenumber") % 8).alias("type"), severity.alias("severity"), F.least(F.lit(1.0), F.round(F.col("l_discount") * 10, 1)).alias("confidence"))


INDICATORS_SQL = f"""ind AS (SELECT l_orderkey AS id, {_sql_pick(INDICATORS, 'l_linenumber % 8')} AS type,
  CASE WHEN l_returnflag = 'A' THEN 'high' WHEN l_returnflag = 'R' THEN 'medium' WHEN l_linestatus = 'F' THEN 'low' ELSE 'info' END AS severity,
  least(1.0, round(l_discount * 10, 1)) AS confidence FROM lineitem)"""
