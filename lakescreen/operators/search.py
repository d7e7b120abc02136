"""Search over screenings: filters, order, pages and the projections that callers see."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100


@dataclass(frozen=True)
class Filters:
    """What search and statistics are restricted to; None leaves a dimension open."""

    q: str | None = None
    risk_band: str | None = None
    doc_type: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    human_review_required: bool | None = None
    status: str | None = None


def _day(text: str | None) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text) if text else None
    except ValueError:
        return None


def condition(f: Filters) -> Column:
    """One predicate for table and charts. % and _ in q are wildcards; dates are whole UTC days, unreadable ones are ignored."""
    out = F.lit(True)
    if f.q:
        pattern = f"%{f.q.lower()}%"
        hit = F.lit(False)
        for c in ("run_id", "file_sha256", "doc_type_hint", "doc_type_detected"):
            hit = hit | F.coalesce(F.lower(c).like(pattern), F.lit(False))
        out = out & hit
    if f.risk_band:
        out = out & (F.col("risk_band") == f.risk_band)
    if f.doc_type:
        v = f.doc_type.lower()
        out = out & F.coalesce((F.lower("doc_type_detected") == v) | (F.lower("doc_type_hint") == v), F.lit(False))
    low, high = _day(f.date_from), _day(f.date_to)
    if low:
        out = out & (F.col("created_at") >= F.lit(low))
    if high:
        out = out & (F.col("created_at") < F.lit(high + datetime.timedelta(days=1)))
    if f.human_review_required is not None:
        out = out & (F.col("human_review_required") == f.human_review_required)
    if f.status:
        out = out & (F.col("status") == f.status)
    return out


def ordering(sort: str) -> list[Column]:
    """newest, oldest, risk_desc or risk_asc (null scores last in both); the id settles ties; anything else is newest."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return {
        "oldest": [F.col("created_at").asc(), F.col("id").asc()],
        "risk_desc": [F.col("risk_score").desc_nulls_last(), *newest],
        "risk_asc": [F.col("risk_score").asc_nulls_last(), *newest],
    }.get(sort, newest)


def summary(df: DataFrame) -> DataFrame:
    """The row that search shows: no personal data."""
    return df.select("id", "run_id", "file_sha256", "doc_type_hint", "doc_type_detected", "status", "risk_score", "risk_band", "human_review_required", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


def history_rows(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the history, newest first, in its own eight columns."""
    page = df.orderBy(*ordering("newest")).offset(max(offset, 0)).limit(max(0, min(limit, MAX_PAGE)))
    return page.select("run_id", "doc_type_hint", "doc_type_detected", "status", "risk_score", "risk_band", "human_review_required", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


def search(df: DataFrame, filters: Filters, sort: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of matches; Spark keeps offset + limit rows of each task and not the whole order."""
    page = df.where(condition(filters)).orderBy(*ordering(sort)).offset(max(offset, 0)).limit(max(0, min(limit, MAX_PAGE)))
    return summary(page)


def page_with_total(df: DataFrame, filters: Filters, sort: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in order, with the number of all matches beside each row. A page past the end is one row of nulls with that number."""
    total = df.where(condition(filters)).agg(F.count(F.lit(1)).alias("total")).withColumn("_page", F.lit(1))
    page = search(df, filters, sort, limit, offset).withColumns({"_page": F.lit(1), "_pos": F.monotonically_increasing_id()})
    columns = [c for c in page.columns if not c.startswith("_")]
    return F.broadcast(page).join(total, "_page", "right").orderBy("_pos").select(*columns, "total")


def applied(filters: Filters, sort: str) -> dict[str, object]:
    """What a search was restricted to, without what was left open."""
    return {k: v for k, v in {**vars(filters), "sort": sort}.items() if v is not None}


#: What callers may ask for.
ALLOWED = {
    "risk_band": ("low", "medium", "high", "critical"),
    "sort": ("newest", "oldest", "risk_desc", "risk_asc"),
    "decision": ("cleared", "flagged", "escalated", "inconclusive"),
    "doc_type": ("passport", "visa", "national_id", "driving_license", "permit", "unknown"),
}


def checked(**asked: str | None) -> None:
    """Refuse a value that is not among the allowed ones; None leaves a dimension open."""
    for name, value in asked.items():
        if value is not None and name in ALLOWED and value.lower() not in ALLOWED[name]:
            raise ValueError(f"{name} must be one of {', '.join(ALLOWED[name])}")


def by_run_id(df: DataFrame, run_id: str) -> DataFrame:
    """The one screening with this id, or no row."""
    return df.where(F.col("run_id") == run_id).limit(1)


def detail(df: DataFrame) -> DataFrame:
    """The full row of a screening with its report taken apart (stages of five columns each); a report that cannot be read is empty."""
    parsed = df.withColumn("_r", F.coalesce(F.try_parse_json("report"), F.parse_json(F.lit("{}"))))
    stage = "array<struct<stage:string,status:string,confidence:double,human_review_required:boolean,duration_ms:bigint>>"
    stages = F.transform(
        F.coalesce(F.try_variant_get("_r", "$.stages", stage), F.array().cast(stage)),
        lambda s: F.struct(s["stage"].alias("stage"), s["status"].alias("status"), s["confidence"].alias("confidence"), F.coalesce(s["human_review_required"], F.lit(False)).alias("human_review_required"), s["duration_ms"].alias("duration_ms")),
    )
    return parsed.select(
        "run_id", "created_at", "status", "doc_type_hint", "doc_type_detected", "file_sha256", "human_review_required",
        F.try_variant_get("_r", "$.final_status", "string").alias("final_status"), F.try_variant_get("_r", "$.processing_time_ms", "bigint").alias("processing_time_ms"),
        F.try_variant_get("_r", "$.pipeline_error", "string").alias("pipeline_error"), stages.alias("stages"))
