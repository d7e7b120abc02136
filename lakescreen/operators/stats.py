"""Distributions and counters over screenings, all (label, count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import DOC_TYPES, RISK_BANDS


def with_labels(counts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """A row for each label, 0 where nothing was counted."""
    spine = counts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return spine.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def band_label() -> Column:
    return F.when(F.col("risk_band").isin(*RISK_BANDS), F.col("risk_band")).otherwise("unassessed")


def type_label() -> Column:
    found = F.coalesce(F.lower("doc_type_detected"), F.lower("doc_type_hint"))
    return F.when(found.isin(*DOC_TYPES), found).otherwise("unknown")


def count_by(df: DataFrame, label: Column) -> DataFrame:
    return df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def per_day(df: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Counts of the last days up to as_of, with 0 for empty days, and one row 'older' for everything before."""
    spark: SparkSession = df.sparkSession
    end = F.lit(as_of).cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("label"))
    day = F.to_date("created_at")
    counted = count_by(df.where(day <= end), F.when(day < F.date_sub(end, days - 1), "older").otherwise(F.date_format(day, "yyyy-MM-dd")))
    spine = spine.unionByName(spark.createDataFrame([("older",)], "label string"))
    return spine.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def all_in_one_pass(df: DataFrame) -> DataFrame:
    """Every distribution from one scan: (chart, label, n) by grouping sets."""
    flat = df.select(band_label().alias("band"), type_label().alias("type"), F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce(F.col("human_review_required").cast("string"), F.lit("false")).alias("review"))
    sets = flat.groupingSets([["band"], ["type"], ["status"], ["review"], []], "band", "type", "status", "review").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    charts = {7: ("band", "band"), 11: ("type", "type"), 13: ("status", "status"), 14: ("review", "review"), 15: ("total", None)}
    chart, label = F.lit(None), F.lit(None)
    for g, (name, column) in charts.items():
        chart = F.when(F.col("g") == g, name).otherwise(chart)
        label = F.when(F.col("g") == g, F.col(column) if column else F.lit("all")).otherwise(label)
    return sets.select(chart.alias("chart"), label.alias("label"), "n")


def integrity_posture(screenings: DataFrame, events: DataFrame) -> DataFrame:
    """total, anchored and logged events of known screenings, and pending = max(0, total - anchored)."""
    joined = screenings.select("id").join(events, F.col("id") == F.col("screening_id"))
    counted = joined.agg(F.count_if((F.col("event_type") == "screening_completed") & (F.col("anchor_status") == "anchored")).alias("anchored"), F.count_if(F.col("event_type") == "audit_logged").alias("logged"))
    total = screenings.agg(F.count(F.lit(1)).alias("total"))
    return total.join(F.broadcast(counted)).select("total", "anchored", "logged", F.greatest(F.lit(0), F.col("total") - F.col("anchored")).cast("long").alias("pending"))
