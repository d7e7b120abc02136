"""Forensic verdicts of whole rows, what reports tell, charts of modules, rows of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, fusion, reports, review, risk, search, validation
from ..sources.views import REVIEWS_SQL, SCREENINGS_SQL, read, reviews, screenings
from .case_queries import QUERIES as CASES
from .case_queries import SQL as CASES_SQL


def _lines(s, d):
    """Order lines with one of seven stages and one of five failures each."""
    named = lambda letter, key, n: F.concat(F.lit(letter), (F.col(key) % n).cast("string"))
    return read(s, d, "lineitem").withColumns({"mode": named("m", "l_suppkey", 7), "failure": named("f", "l_partkey", 5)})


_LINES_SQL = "li AS (SELECT *, 'm' || (l_suppkey % 7) AS mode, 'f' || (l_partkey % 5) AS failure FROM lineitem)"


def _forensics(s, d):
    """One image for each order: its lines give what the detectors measured."""
    n = F.count(F.lit(1))
    some = lambda flag: F.bool_or(F.col("l_returnflag") == flag)
    seen = _lines(s, d).groupBy(F.col("l_orderkey").alias("id")).agg(
        F.round(F.lit(1.5) + F.max("l_discount") * 30, 1).alias("contrast"), (F.sum("l_quantity") * 10).alias("area"), F.when(some("R"), "high").when(some("A"), "medium").alias("copied"),
        F.round(0.5 + F.min("l_tax") * 5, 2).alias("sure"), (F.min("l_tax") / 2).alias("agreement"), F.when(n % 5 != 0, F.round(F.max("l_tax") * 10 + 0.2, 1)).alias("usable"), (n == 1).alias("small"),
        F.sort_array(F.collect_set(F.when(F.col("l_quantity") < 6, F.col("mode")))).alias("failures"), F.when(some("N"), F.round(F.max("l_discount") * 12 - 0.1, 2)).alias("probability"))
    found = fusion.detected(F.struct("contrast", "area"), F.struct(F.col("copied").alias("severity"), F.col("sure").alias("confidence"), "agreement"))
    told = seen.select("id", F.explode(F.array(fusion.judged(found, fusion.coverage(F.col("usable"), F.col("small")), F.col("failures"), F.col("probability")))).alias("t"))
    shown = F.array_join(F.transform("t.contributions", lambda c: F.concat_ws(":", c["type"], c["severity"])), ",")
    return told.select("id", "t.risk", "t.verdict", "t.confidence", "t.tampering_detected", "t.human_review_required", F.array_join("t.agreeing", ",").alias("agreeing"), shown.alias("shown"))


def _tenths(x: str, places: int, to: str = "round_even") -> str:
    return f"CAST({to}(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 18)), {places}) AS DOUBLE)"


_FORENSICS_SQL = f"""WITH {_LINES_SQL}, g AS (SELECT l_orderkey AS id, round(1.5::DOUBLE + max(l_discount)::DOUBLE * 30, 1) AS contrast, sum(l_quantity) * 10 AS area,
    CASE WHEN bool_or(l_returnflag = 'R') THEN 'high' WHEN bool_or(l_returnflag = 'A') THEN 'medium' END AS copied, round(0.5::DOUBLE + min(l_tax)::DOUBLE * 5, 2) AS sure, min(l_tax)::DOUBLE / 2 AS agreement,
    CASE WHEN count(*) % 5 <> 0 THEN round(max(l_tax)::DOUBLE * 10 + 0.2::DOUBLE, 1) ELSE 1 END * CASE WHEN count(*) = 1 THEN 0.2::DOUBLE ELSE 1 END AS cov, count(DISTINCT mode) FILTER (l_quantity < 6) AS broken,
    CASE WHEN bool_or(l_returnflag = 'N') THEN greatest(0, least(1, round(max(l_discount)::DOUBLE * 12 - 0.1::DOUBLE, 2))) END AS prob FROM li GROUP BY 1),
  e AS (SELECT *, contrast >= 2 AND area >= 900 AS ela, CASE WHEN contrast >= 3.5 THEN 'high' ELSE 'medium' END AS es, round(least(0.6::DOUBLE, 0.3::DOUBLE + (contrast - 2) * 0.08::DOUBLE), 3) AS ec,
    CASE WHEN copied = 'high' AND agreement < 0.02 THEN 'medium' ELSE copied END AS cs FROM g),
  p AS (SELECT *, CASE WHEN ela THEN least(34, 22 * CASE es WHEN 'high' THEN 1 ELSE 0.7::DOUBLE END * (0.5::DOUBLE + 0.5::DOUBLE * ec)) ELSE 0 END AS pe,
    CASE WHEN cs IS NOT NULL THEN least(34, 26 * CASE cs WHEN 'high' THEN 1 ELSE 0.7::DOUBLE END * (0.5::DOUBLE + 0.5::DOUBLE * sure)) ELSE 0 END AS pc FROM e),
  q AS (SELECT *, 10 * sqrt({_tenths('CASE WHEN pe >= pc THEN pe ELSE pe * (pe / greatest(pc, 1)) END', 1, 'round')} + {_tenths('CASE WHEN pc >= pe THEN pc ELSE pc * (pc / greatest(pe, 1)) END', 1, 'round')}) AS total,
    list_filter([CASE WHEN cs IS NOT NULL AND sure >= 0.55 THEN 'copy_paste_inconsistency' END, CASE WHEN ela AND ec >= 0.55 THEN 'ela_inconsistency' END], lambda x: x IS NOT NULL) AS agreeing FROM p),
  r AS (SELECT *, {_tenths('least(98, 4 + CASE WHEN prob IS NULL THEN total ELSE total * 0.7::DOUBLE + (total + 30 * prob) * 0.3::DOUBLE END)', 1)} AS risk FROM q),
  v AS (SELECT *, CASE WHEN broken >= 3 OR cov < 0.45 THEN 'inconclusive' WHEN risk >= 55 THEN 'likely_manipulated' WHEN risk >= 20 OR ela OR cs IS NOT NULL THEN 'suspicious' ELSE 'no_obvious_manipulation' END AS verdict FROM r)
  SELECT id, risk, verdict, {_tenths("CASE verdict WHEN 'inconclusive' THEN 0.2::DOUBLE WHEN 'no_obvious_manipulation' THEN least(0.85::DOUBLE, 0.5::DOUBLE + cov * 0.35::DOUBLE) ELSE least(0.95::DOUBLE, (0.45::DOUBLE + 0.12::DOUBLE * len(agreeing)) * (0.6::DOUBLE + 0.4::DOUBLE * cov)) END", 3)} AS confidence,
    verdict IN ('suspicious', 'likely_manipulated') AS tampering_detected, verdict <> 'no_obvious_manipulation' AS human_review_required, array_to_string(agreeing, ',') AS agreeing,
    concat_ws(',', CASE WHEN ela THEN 'ela_inconsistency:' || es END, 'copy_paste_inconsistency:' || cs) AS shown FROM v"""


def _told(s, d):
    """What each order's report says: returned lines are failures, quick ones missing groups, and modes by quantity the stages."""
    named = lambda when, c: F.sort_array(F.collect_set(F.when(when, F.col(c))))
    status = F.when(F.col("l_quantity") < 15, "error").when(F.col("l_quantity") < 35, "skipped").otherwise("ok")
    g = _lines(s, d).groupBy(F.col("l_orderkey").alias("id")).agg(
        named(F.col("l_returnflag") == "R", "failure").alias("failures"), named(F.col("l_discount") > 0.02, "mode").alias("missing"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("mode").alias("stage"), status.alias("status")))).alias("st"))
    return g.select("id", risk.failures_told(F.col("failures")).alias("failures"), risk.missing_told(F.col("missing")).alias("missing"), risk.stages_told(F.col("st.stage"), F.col("st.status")).alias("stages"), risk.drivers_told(F.concat("failures", "missing")).alias("drivers"))


_TOLD_SQL = f"""WITH {_LINES_SQL}, g AS (SELECT l_orderkey AS id, coalesce(list_sort(list(DISTINCT failure) FILTER (l_returnflag = 'R')), []) AS f, coalesce(list_sort(list(DISTINCT mode) FILTER (l_discount > 0.02)), []) AS m,
    coalesce(list('stage ''' || mode || CASE WHEN l_quantity < 15 THEN ''' crashed' ELSE ''' skipped' END ORDER BY l_linenumber, mode, CASE WHEN l_quantity < 15 THEN 0 ELSE 1 END) FILTER (l_quantity < 35), []) AS s FROM li GROUP BY 1),
  more AS (SELECT *, list_concat(f, m) AS d FROM g)
  SELECT id, CASE WHEN len(f) > 0 THEN 'validation failed: ' || array_to_string(f[1:2], '; ') || CASE WHEN len(f) > 2 THEN ' (+' || (len(f) - 2) || ' more)' ELSE '' END END AS failures,
    CASE WHEN len(m) > 0 THEN 'missing: ' || array_to_string(m[1:5], ', ') || CASE WHEN len(m) > 5 THEN ' (+' || (len(m) - 5) || ' more)' ELSE '' END END AS missing,
    CASE WHEN len(s) > 0 THEN 'incomplete: ' || array_to_string(s[1:4], '; ') || CASE WHEN len(s) > 4 THEN '…' ELSE '' END END AS stages,
    CASE WHEN len(d) > 0 THEN 'top drivers: ' || array_to_string(d[1:3], '; ') ELSE 'no adverse signals' END AS drivers FROM more"""


def _examined(s, d):
    """Each order's checks name its lines' stages, and a zone on its first line; a mode was read where one of its lines was not returned."""
    li = _lines(s, d)
    mode = li.groupBy("l_orderkey", "mode").agg(F.max(F.when(F.col("l_returnflag") != "R", F.round(F.col("l_discount") * 10, 1))).alias("c"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_linenumber") == 1).alias("zone"))
    one = lambda name: F.struct(name.alias("field"))
    checks = F.flatten(F.collect_list(F.concat(F.array_repeat(one(F.col("mode")), F.col("n").cast("int")), F.when(F.col("zone"), F.array(one(F.lit("mrz")))).otherwise(F.array().cast("array<struct<field:string>>")))))
    fields = F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("mode", "c"))))
    g = mode.groupBy(F.col("l_orderkey").alias("id")).agg(checks.alias("checks"), fields.alias("fields"))
    return g.select("id", F.size("checks").cast("long").alias("checks"), F.round(validation.examined_confidence(F.col("checks"), F.col("fields")), 6).alias("confidence"))


def _report_rows(s, d):
    """Stored reports of screenings: those in processing have none, and each thirteenth cannot be read."""
    score = F.col("risk_score")
    verdict = F.when(score < 30, "no_obvious_manipulation").when(score < 60, "suspicious").when(score < 80, "likely_manipulated").when(score < 95, "strange")
    text = F.to_json(F.struct(
        F.when(score % 3 != 0, F.struct((score % 2 == 0).alias("is_valid"))).alias("validation"), F.struct(verdict.alias("verdict")).alias("tampering"),
        F.struct(F.when(score % 4 == 0, "MATCH").when(score % 4 == 1, "NO_MATCH").when(score % 4 == 2, "INCONCLUSIVE").alias("match_status")).alias("face_verification")))
    return screenings(s, d).select(F.try_parse_json(F.when(F.col("id") % 13 == 0, F.lit("{broken")).when(score.isNotNull(), text)).alias("report"))


_CHART_SQL = f"""WITH {SCREENINGS_SQL}, r AS (SELECT CASE WHEN id % 13 <> 0 THEN risk_score END AS k FROM scr),
  o AS (SELECT 'validation' AS module, CASE WHEN k IS NULL OR k % 3 = 0 THEN 'unknown' WHEN k % 2 = 0 THEN 'valid' ELSE 'invalid' END AS outcome FROM r
    UNION ALL SELECT 'tampering', CASE WHEN k < 30 THEN 'no_obvious_manipulation' WHEN k < 60 THEN 'suspicious' WHEN k < 80 THEN 'likely_manipulated' ELSE 'unknown' END FROM r
    UNION ALL SELECT 'face', CASE k % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'no_match' WHEN 2 THEN 'inconclusive' ELSE 'not_performed' END FROM r),
  c AS (SELECT module, outcome, count(*) AS n FROM o GROUP BY ALL),
  all_(module, outcome) AS (VALUES {', '.join(f"('{m}', '{o}')" for m, of in reports.MODULE_OUTCOMES.items() for o in of)})
  SELECT a.module, a.outcome, coalesce(n, 0) AS n FROM all_ a LEFT JOIN c ON a.module = c.module AND a.outcome = c.outcome"""


def _in_range(values):
    """Judges amounts; a value that is no number makes the whole batch fail."""
    return values.map(lambda v: None if v is None else "PASS" if 1000 <= float(v) <= 200_000 else "FAIL")


def _own_rules(s, d):
    """Order totals under a rule in Python, which fails on some, beside a rule in columns."""
    o = read(s, d, "orders")
    total = F.when(F.col("o_orderkey") % 101 == 0, "n/a").when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("total"), F.struct(total.alias("value"), F.lit(None).cast("boolean").alias("check_digit_ok"))).alias("fields"))
    rules = validation.Ruleset("order", [validation.required("total"), validation.python_rule("in_range", "total", _in_range)])
    none = F.lit(None)
    made = validation.validate(rows, rules, F.col("fields"), none.cast("map<string,string>"), none.cast("string"), none.cast("boolean"), F.lit("order"), F.lit("2024-06-30").cast("date"))
    return made.select("id", F.explode("checks").alias("c")).select("id", "c.field", "c.status", "c.rule", F.when(F.col("c.field") == "engine", F.col("c.message")).alias("error"))


def _counts_of_checkpoints(s, d):
    rows = CASES["scripted_checkpoints"](s, d).groupBy("id", "case_id").agg(F.collect_list(F.struct("checkpoint", "ok", "informational")).alias("c"))
    return rows.select("id", "case_id", F.inline(F.array(cases.checkpoint_counts(F.col("c")))))


QUERIES = {
    "forensic_verdicts": _forensics,
    "report_sentences": _told,
    "examined_confidence": _examined,
    "module_chart": lambda s, d: reports.module_chart(_report_rows(s, d)),
    "scripted_checkpoint_counts": _counts_of_checkpoints,
    "own_rules_isolated": _own_rules,
    "history_rows": lambda s, d: search.history_rows(screenings(s, d), 25, 50),
    "pending_rows": lambda s, d: review.queue_rows(review.pending(screenings(s, d), reviews(s, d))),
}

SQL = {
    "forensic_verdicts": _FORENSICS_SQL,
    "report_sentences": _TOLD_SQL,
    "examined_confidence": f"""WITH {_LINES_SQL}, m AS (SELECT l_orderkey AS id, mode, max(round(l_discount::DOUBLE * 10, 1)) FILTER (l_returnflag <> 'R') AS c, count(*) AS n, count(DISTINCT CASE WHEN l_linenumber = 1 THEN 1 END) AS z FROM li GROUP BY ALL)
      SELECT id, CAST(sum(n + z) AS BIGINT) AS checks, round(sum(coalesce(c, 0)) / count(*), 6) AS confidence FROM m GROUP BY 1""",
    "module_chart": _CHART_SQL,
    "scripted_checkpoint_counts": f"SELECT id, case_id, count(*) AS total, count(*) FILTER (NOT informational AND coalesce(ok, false)) AS met, count(*) FILTER (NOT informational AND NOT coalesce(ok, false)) AS failed, count(*) FILTER (informational) AS informational FROM ({CASES_SQL['scripted_checkpoints']}) GROUP BY 1, 2",
    "own_rules_isolated": """WITH v AS (SELECT o_orderkey AS id, o_orderkey % 101 = 0 AS broken, o_orderkey % 101 = 0 OR o_orderkey % 7 <> 0 AS there, o_totalprice FROM orders)
      SELECT id, 'total' AS field, CASE WHEN there THEN 'PASS' ELSE 'FAIL' END AS status, 'required_fields[total]' AS rule, NULL::VARCHAR AS error FROM v
      UNION ALL SELECT id, CASE WHEN broken THEN 'engine' ELSE 'total' END, CASE WHEN broken THEN 'WARNING' WHEN o_totalprice BETWEEN 1000 AND 200000 THEN 'PASS' ELSE 'FAIL' END, 'in_range', CASE WHEN broken THEN 'rule in_range failed: ValueError' END FROM v WHERE there""",
    "history_rows": f"WITH {SCREENINGS_SQL} SELECT run_id, doc_type_hint, doc_type_detected, status, risk_score, risk_band, human_review_required, strftime(created_at, '%Y-%m-%d') AS created_on FROM scr ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50",
    "pending_rows": f"WITH {SCREENINGS_SQL}, {REVIEWS_SQL} SELECT run_id, status, risk_score, risk_band, human_review_required, doc_type_detected, strftime(created_at, '%Y-%m-%d') AS created_on FROM scr WHERE status = 'pending_review' AND id NOT IN (SELECT screening_id FROM rev)",
}
