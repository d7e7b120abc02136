"""Search, history and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.search import Filters, condition, search
from ..sources.schemas import DOC_TYPES, RISK_BANDS
from ..sources.views import AUDIT_SQL, SCREENINGS_SQL, audit_events, read, screenings

AS_OF = "1998-06-15"
_SUMMARY = "id, run_id, file_sha256, doc_type_hint, doc_type_detected, status, risk_score, risk_band, human_review_required, strftime(created_at, '%Y-%m-%d') AS created_on"
_BAND = "CASE WHEN risk_band IN ('low', 'medium', 'high', 'critical') THEN risk_band ELSE 'unassessed' END"
_TYPE = f"coalesce(CASE WHEN coalesce(lower(doc_type_detected), lower(doc_type_hint)) IN {DOC_TYPES} THEN coalesce(lower(doc_type_detected), lower(doc_type_hint)) END, 'unknown')"


def _spine(labels: tuple[str, ...]) -> str:
    return f"(SELECT unnest({list(labels)}) AS label)"


def _zero_filled(labels: tuple[str, ...], expression: str) -> str:
    return f"WITH {SCREENINGS_SQL}, c AS (SELECT {expression} AS label, count(*) AS n FROM scr GROUP BY 1) SELECT s.label, coalesce(c.n, 0) AS n FROM {_spine(labels)} s LEFT JOIN c ON s.label = c.label"


def _module_outcomes(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    verdict = F.when(k.isNull(), "unknown").when(k < 20, "likely_manipulated").when(k < 50, "suspicious").when(k < 60, "inconclusive").otherwise("no_obvious_manipulation")
    return read(spark, sf_dir, "events").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(k % 2 == 0).alias("even"))


QUERIES = {
    "search_text_like": lambda s, d: search(screenings(s, d), Filters(q="a1_"), "newest", 100),
    "search_band_date_review_page": lambda s, d: search(screenings(s, d), Filters(risk_band="high", date_from="1996-01-01", date_to="1999-12-31", human_review_required=True), "risk_desc", 40, 20),
    "search_doc_type_either": lambda s, d: screenings(s, d).where(condition(Filters(doc_type="Visa", status="reviewed"))).select("id", "doc_type_hint", "doc_type_detected", "status"),
    "search_oldest_unreadable_date": lambda s, d: search(screenings(s, d), Filters(date_from="soon", status="processing"), "oldest", 500, -3),
    "search_risk_asc": lambda s, d: search(screenings(s, d), Filters(date_to="1995-02-01"), "risk_asc", 100),
    "history_page": lambda s, d: search(screenings(s, d), Filters(), "whatever", 25, 50),
    "stats_per_day_zero_filled": lambda s, d: stats.per_day(screenings(s, d), AS_OF),
    "stats_risk_distribution": lambda s, d: stats.with_labels(stats.count_by(screenings(s, d), stats.band_label()), (*RISK_BANDS, "unassessed")),
    "stats_doc_type_distribution": lambda s, d: stats.with_labels(stats.count_by(screenings(s, d), stats.type_label()), DOC_TYPES),
    "stats_review_status": lambda s, d: screenings(s, d).groupBy("status", "human_review_required").agg(F.count(F.lit(1)).alias("n")),
    "stats_all_single_pass": lambda s, d: stats.all_in_one_pass(screenings(s, d)),
    "stats_module_outcomes_json": _module_outcomes,
    "stats_score_percentiles": lambda s, d: screenings(s, d).where("risk_score IS NOT NULL").groupBy("doc_type_hint").agg(
        F.round(F.percentile("risk_score", F.lit(0.95)), 6).alias("p95"), F.round(F.percentile("risk_score", F.lit(0.1)), 6).alias("p10"), F.round(F.avg("risk_score"), 6).alias("mean"), F.max("risk_score").alias("most")),
    "integrity_posture": lambda s, d: stats.integrity_posture(screenings(s, d), audit_events(s, d)),
    "review_band_share": lambda s, d: screenings(s, d).groupBy(stats.band_label().alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
        "label", "n", F.round(F.col("n") / F.greatest(F.lit(1), F.max("n").over(Window.partitionBy())), 6).alias("bar")),
}

SQL = {
    "search_text_like": f"WITH {SCREENINGS_SQL} SELECT {_SUMMARY} FROM scr WHERE coalesce(lower(run_id) LIKE '%a1_%', false) OR coalesce(lower(file_sha256) LIKE '%a1_%', false) OR coalesce(lower(doc_type_hint) LIKE '%a1_%', false) OR coalesce(lower(doc_type_detected) LIKE '%a1_%', false) ORDER BY created_at DESC, id DESC LIMIT 100",
    "search_band_date_review_page": f"WITH {SCREENINGS_SQL} SELECT {_SUMMARY} FROM scr WHERE risk_band = 'high' AND created_at >= DATE '1996-01-01' AND created_at < DATE '2000-01-01' AND human_review_required ORDER BY risk_score DESC NULLS LAST, created_at DESC, id DESC LIMIT 40 OFFSET 20",
    "search_doc_type_either": f"WITH {SCREENINGS_SQL} SELECT id, doc_type_hint, doc_type_detected, status FROM scr WHERE (lower(doc_type_detected) = 'visa' OR lower(doc_type_hint) = 'visa') AND status = 'reviewed'",
    "search_oldest_unreadable_date": f"WITH {SCREENINGS_SQL} SELECT {_SUMMARY} FROM scr WHERE status = 'processing' ORDER BY created_at, id LIMIT 100",
    "search_risk_asc": f"WITH {SCREENINGS_SQL} SELECT {_SUMMARY} FROM scr WHERE created_at < DATE '1995-02-02' ORDER BY risk_score ASC NULLS LAST, created_at DESC, id DESC LIMIT 100",
    "history_page": f"WITH {SCREENINGS_SQL} SELECT {_SUMMARY} FROM scr ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50",
    "stats_per_day_zero_filled": f"""WITH {SCREENINGS_SQL}, days AS (SELECT strftime(CAST(unnest(generate_series(DATE '{AS_OF}' - 13, DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE), '%Y-%m-%d') AS label UNION ALL SELECT 'older'),
      c AS (SELECT CASE WHEN CAST(created_at AS DATE) < DATE '{AS_OF}' - 13 THEN 'older' ELSE strftime(created_at, '%Y-%m-%d') END AS label, count(*) AS n FROM scr WHERE CAST(created_at AS DATE) <= DATE '{AS_OF}' GROUP BY 1)
      SELECT days.label, coalesce(n, 0) AS n FROM days LEFT JOIN c ON days.label = c.label""",
    "stats_risk_distribution": _zero_filled((*RISK_BANDS, "unassessed"), _BAND),
    "stats_doc_type_distribution": _zero_filled(DOC_TYPES, _TYPE),
    "stats_review_status": f"WITH {SCREENINGS_SQL} SELECT status, human_review_required, count(*) AS n FROM scr GROUP BY ALL",
    "stats_all_single_pass": f"""WITH {SCREENINGS_SQL} SELECT 'band' AS chart, {_BAND} AS label, count(*) AS n FROM scr GROUP BY 2 UNION ALL SELECT 'type', {_TYPE}, count(*) FROM scr GROUP BY 2
      UNION ALL SELECT 'status', status, count(*) FROM scr GROUP BY 2 UNION ALL SELECT 'review', CAST(human_review_required AS VARCHAR), count(*) FROM scr GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM scr""",
    "stats_module_outcomes_json": """WITH e AS (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
      SELECT CASE WHEN k IS NULL THEN 'unknown' WHEN k < 20 THEN 'likely_manipulated' WHEN k < 50 THEN 'suspicious' WHEN k < 60 THEN 'inconclusive' ELSE 'no_obvious_manipulation' END AS verdict,
      count(*) AS n, count(*) FILTER (k % 2 = 0) AS even FROM e GROUP BY 1""",
    "stats_score_percentiles": f"WITH {SCREENINGS_SQL} SELECT doc_type_hint, round(quantile_cont(risk_score, 0.95), 6) AS p95, round(quantile_cont(risk_score, 0.1), 6) AS p10, round(avg(risk_score), 6) AS mean, max(risk_score) AS most FROM scr WHERE risk_score IS NOT NULL GROUP BY 1",
    "integrity_posture": f"""WITH {SCREENINGS_SQL}, {AUDIT_SQL}, j AS (SELECT a.* FROM scr JOIN aud a ON scr.id = a.screening_id),
      c AS (SELECT count(*) FILTER (event_type = 'screening_completed' AND anchor_status = 'anchored') AS anchored, count(*) FILTER (event_type = 'audit_logged') AS logged FROM j), t AS (SELECT count(*) AS total FROM scr)
      SELECT total, anchored, logged, greatest(0, total - anchored) AS pending FROM t, c""",
    "review_band_share": f"WITH {SCREENINGS_SQL}, c AS (SELECT {_BAND} AS label, count(*) AS n FROM scr GROUP BY 1) SELECT label, n, round(n / greatest(1, max(n) OVER ()), 6) AS bar FROM c",
}
