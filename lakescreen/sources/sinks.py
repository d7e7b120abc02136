"""Writing tables: appends that may be repeated, rows replaced by key, completion events, ledger copies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import record


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in a folder, or None while nothing was written."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def append_new(df: DataFrame, folder: str, keys: list[str]) -> None:
    """Append the rows whose keys the folder lacks; of rows with equal keys one. A repeated call adds nothing."""
    known = stored(df.sparkSession, folder)
    rows = df.dropDuplicates(keys)
    fresh = rows if known is None else rows.join(known.select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(folder)


def screenings(df: DataFrame, folder: str, sealed: Column | None = None) -> None:
    """New screenings by run_id, in state processing, with their report sealed if a column for it is given."""
    new = df.withColumn("status", F.lit("processing"))
    append_new(new if sealed is None else new.withColumn("report", sealed), folder, ["run_id"])


def completed(df: DataFrame, folder: str) -> None:
    """One completion event for each screening; df: run_id, final_status, created_at."""
    events = df.select("run_id", F.lit("screening_completed").alias("event_type"), "final_status", F.lit("pending").alias("anchor_status"), "created_at")
    append_new(events, folder, ["run_id", "event_type"])


def to_ledger(df: DataFrame, folder: str) -> DataFrame:
    """Records of results without personal data, appended once by screening and result hash; returns the ledger's rows."""
    append_new(record(df), folder, ["screening_id", "result_hash"])
    return df.sparkSession.read.parquet(folder)


def replaced(df: DataFrame, folder: str, target: str, keys: list[str]) -> DataFrame:
    """The table of folder with df's rows in place of those with equal keys, written to another folder: readers of the old one keep it."""
    known = stored(df.sparkSession, folder)
    out = df if known is None else known.join(df.select(*keys), keys, "left_anti").unionByName(df, allowMissingColumns=True)
    out.write.mode("errorifexists").parquet(target)
    return df.sparkSession.read.parquet(target)
