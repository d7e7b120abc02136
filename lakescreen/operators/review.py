"""The review queue and the decisions laid over screenings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import DECISIONS
from .audit import latest


def pending(screenings: DataFrame, reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """Screenings without a decision that wait for one, newest first."""
    waiting = screenings.where("status = 'pending_review'").join(reviews.select(F.col("screening_id").alias("id")), "id", "left_anti")
    return waiting if limit is None else waiting.orderBy(F.desc("created_at"), F.desc("id")).limit(max(0, min(limit, 100)))


def overlay(screenings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each screening with its latest decision; without one, 'pending'."""
    last = latest(reviews, "screening_id", [F.desc("decided_at"), F.desc("reviewer_id")])
    joined = screenings.join(last, F.col("id") == F.col("screening_id"), "left")
    return joined.withColumn("pending", F.col("decision").isNull()).withColumn("decision", F.coalesce("decision", F.lit("pending"))).drop("screening_id")


def queue_rows(waiting: DataFrame) -> DataFrame:
    """The seven columns that the queue of waiting screenings shows."""
    return waiting.select("run_id", "status", "risk_score", "risk_band", "human_review_required", "doc_type_detected", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


def decide(screenings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews to append and screenings with their new status, from decisions (screening_id, decision); unknown decisions are refused."""
    valid = decisions.where(F.col("decision").isin(*DECISIONS))
    known = valid.join(screenings.select(F.col("id").alias("screening_id")), "screening_id", "left_semi").dropDuplicates(["screening_id"])
    decided = known.select(F.col("screening_id").alias("id"), F.lit(True).alias("_now"))
    updated = screenings.join(decided, "id", "left").withColumn("status", F.when(F.col("_now"), "reviewed").otherwise(F.col("status"))).drop("_now")
    return known, updated


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of new in place of those with the same keys."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
