"""Cases: the stage chain, rules on metadata and faces, checkpoints, pages with totals, accounts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, dataflow, search
from ..functions import text
from ..sources.views import INDICATORS_SQL, SCREENINGS_SQL, AUDIT_SQL, audit_events, indicators, read, screenings

def _providers():
    """Providers with known outcomes: which rows fail, lack an output or ask for a review follows from the case's id."""
    text_or = lambda when, value: F.when(when, F.lit(value))
    return {
        "preprocessing": lambda ctx: {"preprocessed_image_path": ctx("original_path"), "confidence": F.lit(1.5), "error": text_or(F.col("id") % 11 == 0, "unreadable image")},
        "ocr": lambda ctx: {"ocr_fields": F.when(F.col("id") % 5 != 0, F.concat(ctx("preprocessed_image_path"), F.lit("#fields"))), "confidence": F.lit(0.8), "human_review_required": F.col("id") % 3 == 0},
        "validation": lambda ctx: {"validation": F.concat(ctx("ocr_fields"), F.lit("#checked")), "human_review_required": F.col("id") % 2 == 0},
        "face": lambda ctx: {"face_verification": F.lit("MATCH"), "error": text_or(F.col("id") % 7 == 0, "no face")},
        "risk": lambda ctx: {"risk": F.size(F.filter(ctx("stage_results"), lambda r: r["status"] != "ok")), "human_review_required": F.lit(False)},
    }


def _run(s, d):
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"))).alias("original_path"))
    return dataflow.run(rows, dataflow.stages(_providers()))


def _stage_rows(s, d):
    out = _run(s, d).select("id", F.inline("stage_results"))
    return out.select("id", "stage", "status", F.round("confidence", 6).alias("confidence"), "human_review_required", "error", F.array_join("missing_inputs", ",").alias("missing_inputs"))


def _assembled(s, d):
    return dataflow.assembled(_run(s, d), "id").select("id", "final_status", "human_review_required", "degraded", "failed", "risk")


_STAGES_SQL = """g AS (SELECT o_orderkey AS id, o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0 AS path, o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0 AS fields FROM orders),
  st AS (
    SELECT id, 1 AS k, 'preprocess' AS stage, CASE WHEN id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN id % 11 <> 0 THEN 1.0::DOUBLE END AS confidence, id % 11 = 0 AS review, CASE WHEN id % 11 = 0 THEN 'unreadable image' END AS error, '' AS missing FROM g
    UNION ALL SELECT id, 2, 'ocr', CASE WHEN path THEN 'ok' ELSE 'skipped' END, CASE WHEN path THEN 0.8::DOUBLE END, NOT path OR id % 3 = 0, NULL, CASE WHEN path THEN '' ELSE 'preprocessed_image_path' END FROM g
    UNION ALL SELECT id, 3, 'document_validation', CASE WHEN fields THEN 'ok' ELSE 'skipped' END, NULL, NOT fields OR id % 2 = 0, NULL, CASE WHEN fields THEN '' ELSE 'ocr_fields' END FROM g
    UNION ALL SELECT id, 4, 'tampering_detection', CASE WHEN path THEN 'not_implemented' ELSE 'skipped' END, NULL, true, NULL, CASE WHEN path THEN '' ELSE 'preprocessed_image_path' END FROM g
    UNION ALL SELECT id, 5, 'face_verification', CASE WHEN NOT path THEN 'skipped' WHEN id % 7 = 0 THEN 'error' ELSE 'ok' END, NULL, NOT path OR id % 7 = 0, CASE WHEN path AND id % 7 = 0 THEN 'no face' END, CASE WHEN path THEN '' ELSE 'preprocessed_image_path' END FROM g
    UNION ALL SELECT id, 6, 'risk_assessment', 'ok', NULL, false, NULL, '' FROM g)"""


def _metadata(s, d):
    p = read(s, d, "part")
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    tags = F.map_filter(
        F.create_map(
            F.lit("Software"), F.when(k % 3 == 0, F.lit("Adobe PHOTOSHOP 25")).when(k % 3 == 1, F.lit("scanner 1.2")).otherwise(F.lit("iOS 17")),
            F.lit("Make"), F.when(k % 4 == 0, F.lit("Canon")).otherwise(none),
            F.lit("DateTime"), F.lit("2024:01:01"),
            F.lit("DateTimeOriginal"), F.when(k % 5 == 0, F.lit("2023:12:31")).otherwise(none),
        ),
        lambda _, v: v.isNotNull(),
    )
    meta = F.struct(
        F.when(k % 2 == 0, "jpg").otherwise("png").alias("format"), (k % 6 != 0).alias("has_exif"), (k % 7 == 0).alias("has_xmp"), tags.alias("tags"),
        F.lit(None).cast("map<string,string>").alias("text_chunks"), F.array(F.lit(0), (k % 9).cast("int")).alias("quant_tables"))
    one = p.select(k.alias("id"), meta.alias("meta")).select("id", "meta", F.inline(F.array(F.struct(cases.metadata_indicators(F.col("meta")).alias("found")))))
    points = cases.metadata_points(F.col("found"), F.col("meta.has_xmp"), F.col("meta.has_exif"))
    return one.select("id", F.array_join(F.transform("found", lambda i: F.concat_ws(":", i["severity"], i["confidence"])), ",").alias("found"), points.alias("points"))


def _faces(s, d):
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"))
    no = F.array().cast("array<string>")
    gate = lambda k: cases.face_gate(F.when(k % 13 != 0, F.lit(100) + k % 50), F.lit(200), F.when(k % 9 == 0, 0).when(k % 4 == 0, 2).otherwise(1), F.lit(40) + k % 20, k % 17 == 0, k % 19 == 0, F.when(k % 6 == 0, F.array(F.lit("too_dark"))).otherwise(no))
    one = v.select("id", gate(F.col("id")).alias("document"), gate(F.col("id") + 7).alias("probe"), (F.col("id") % 4 == 0).alias("many"), F.when(F.col("id") % 8 != 0, (F.col("id") % 10) / 20).alias("similarity"))
    verdict = cases.face_verdict(F.col("document"), F.col("probe"), F.col("many"), F.col("similarity"))
    return one.select("id", "document", "probe", verdict.alias("v")).select("id", "document", "probe", "v.verdict", "v.reason")


def _gate_sql(k: str) -> str:
    return f"""CASE WHEN {k} % 13 = 0 THEN 'image_unreadable' WHEN 100 + {k} % 50 < 120 THEN 'image_too_small' WHEN {k} % 9 = 0 THEN 'no_face_detected' WHEN 40 + {k} % 20 < 48 THEN 'face_too_small'
      WHEN {k} % 17 = 0 THEN 'extreme_pose' WHEN {k} % 19 = 0 THEN 'face_occluded' WHEN {k} % 6 = 0 THEN 'too_dark' END"""


def _checkpoints(s, d):
    sc = screenings(s, d)
    case = F.element_at(F.array(*[F.lit(c) for c in ("case1_valid", "case2_tampered", "case3_identity_mismatch", "case4_low_quality", "other")]), (F.col("id") % 5 + 1).cast("int"))
    verdict = F.when(F.col("id") % 3 == 0, "suspicious").otherwise("no_obvious_manipulation")
    face = F.when(F.col("id") % 2 == 0, "MATCH").otherwise("NO_MATCH")
    made = cases.checkpoints(case, F.col("id") % 4 != 0, (F.col("id") % 10) / 10, F.col("id") % 3, verdict, face, F.col("risk_score"), F.lit(24), F.col("human_review_required"), F.col("status") == "reviewed")
    rows = sc.select("id", case.alias("case_id"), F.inline(made))
    return rows.select("id", "case_id", "checkpoint", "ok", "informational")


def _reasons(s, d):
    sc = screenings(s, d).where("risk_score IS NOT NULL")
    score = F.col("risk_score").cast("double")
    degraded = F.filter(F.array(*[F.when(F.col("id") % n == 0, F.lit(name)) for n, name in ((2, "ocr"), (3, "document_validation"), (5, "tampering_detection"), (7, "face_verification"), (1, "risk_assessment"))]), lambda x: x.isNotNull() & (F.col("id") % 4 == 0))
    level = F.upper("risk_band")
    told = cases.explanation(F.element_at(F.array(*[F.lit(x) for x in ("likely_manipulated", "suspicious", "inconclusive", "no_obvious_manipulation")]), (F.col("id") % 4 + 1).cast("int")), score, F.when(F.col("id") % 3 == 0, F.array()).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).cast("array<string>"), F.when(F.col("id") % 8 == 2, F.array(F.lit("ela"), F.lit("noise"))).otherwise(F.array()).cast("array<string>"))
    risk = F.struct(score.alias("score"), level.alias("level"), F.lit(0.5).alias("confidence"), (F.col("id") % 2 == 0).alias("human_review_required"))
    safe = cases.or_unavailable(risk, F.when(F.col("id") % 6 == 0, F.lit("engine failed")))
    return sc.select("id", F.array_join(cases.review_reasons(score, level, degraded), "; ").alias("reasons"), told.alias("explanation"), safe.alias("r")).select("id", "reasons", "explanation", F.col("r.score").alias("score"), F.col("r.level").alias("level"), F.col("r.human_review_required").alias("human_review_required"))


def _page_total(s, d):
    return search.page_with_total(screenings(s, d), search.Filters(risk_band="high"), "risk_desc", 10, 5).select("id", "risk_score", "total")


def _accounts(s, d):
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, F.lit(" us er")).when(k % 3 == 1, F.lit(" u.")).otherwise(F.lit("ü_user-")), (k % 10).cast("string"))
    password = F.element_at(F.array(*[F.lit(p) for p in ("short", "nouppercase12", "NOLOWERCASE12", "NoDigitsInHere", "GoodPassword12")]), (k % 5 + 1).cast("int"))
    return c.select(k.alias("id"), text.user_name_ok(name).alias("name_ok"), text.password_lack(password).alias("lacks"))


def _tokens(s, d):
    e = read(s, d, "events")
    revoked = e.where("event_type = 'error'").select(F.col("user_id").alias("jti"), "ts").groupBy("jti").agg(F.max("ts").alias("until"))
    now = F.lit("2024-01-15").cast("timestamp")
    live = revoked.where(F.col("until") >= now)
    return e.select("event_id", "user_id").join(live.select(F.col("jti").alias("user_id")), "user_id", "left_anti").select("event_id")


def _hosts(s, d):
    p = read(s, d, "supplier")
    k = F.col("s_suppkey")
    host = F.element_at(F.array(F.concat(F.lit("172."), (k % 40).cast("string"), F.lit(".0.1")), F.concat(F.lit("192.168.0."), (k % 300).cast("string")), F.lit("10.1.2.3"), F.lit("8.8.8.8"), F.lit("not a host")), (k % 5 + 1).cast("int"))
    return p.select(k.alias("id"), host.alias("host"), cases.private_network(host).alias("trusted"))


def _queue(s, d):
    mine = screenings(s, d).where("status = 'pending_review' AND risk_band = 'critical'").where(F.contains("run_id", F.lit("ab")))
    page = mine.orderBy(F.desc("created_at"), F.desc("id")).limit(40)
    # of the page alone, what needs a review comes first
    order = F.struct((~F.col("human_review_required")).alias("a"), (-F.unix_date(F.to_date("created_at"))).alias("b"), (-F.col("id")).alias("c"))
    ranked = page.groupBy().agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "id", "human_review_required"))).alias("rows"))
    return ranked.select(F.posexplode("rows").alias("pos", "r")).select("pos", "r.id", "r.human_review_required")


def _chase(s, d):
    e = audit_events(s, d).where("anchor_status = 'anchored'").select("screening_id", "line")
    return e.join(screenings(s, d).select(F.col("id").alias("screening_id"), "run_id", "operator_id"), "screening_id").join(read(s, d, "customer").select(F.col("c_custkey").alias("operator_id"), "c_name"), "operator_id").select("screening_id", "line", "run_id", "c_name")


def _sealed(s, d):
    from ..sources.readers import opened, sealed

    key = F.lit("0123456789abcdef")
    rows = screenings(s, d).select("id", F.concat(F.lit('{"status":"'), "status", F.lit('"}')).alias("report"), (F.col("id") % 2 == 0).alias("encrypted"))
    kept = rows.select("id", "report", "encrypted", sealed(F.col("report"), F.col("encrypted"), key).alias("stored"))
    broken = F.when(F.col("id") % 6 == 0, F.translate("stored", "ABC", "BCA")).otherwise(F.col("stored"))
    return kept.select("id", "encrypted", (F.col("stored") != F.col("report")).alias("hidden"), F.coalesce(opened(F.col("stored"), F.col("encrypted"), key) == F.col("report"), F.lit(False)).alias("whole"),
                       F.when(F.col("id") % 6 == 0, opened(broken, F.col("encrypted"), key).isNull()).alias("refused"))


def _signals(s, d):
    i = indicators(s, d)
    return i.select("id", F.concat("type", F.lit(" ("), "severity", F.lit(")")).alias("name"), (F.col("severity") != "info").alias("suspicious")).groupBy("name", "suspicious").agg(F.count(F.lit(1)).alias("n"))


def _counts(s, d):
    rows = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "A", "FAIL").when(F.col("l_returnflag") == "R", "WARNING").otherwise("PASS")).alias("statuses"))
    return rows.select("id", cases.status_counts(F.col("statuses")).alias("c")).select("id", "c.passed", "c.warnings", "c.failed")


QUERIES = {
    "stage_outcomes": _stage_rows,
    "screening_assembly": _assembled,
    "metadata_anomalies": _metadata,
    "face_gates": _faces,
    "scripted_checkpoints": _checkpoints,
    "review_reasons": _reasons,
    "search_page_total": _page_total,
    "account_rules": _accounts,
    "token_denylist": _tokens,
    "trusted_proxy": _hosts,
    "review_queue_page": _queue,
    "event_case_chase": _chase,
    "sealed_reports": _sealed,
    "legacy_signals": _signals,
    "check_status_counts": _counts,
}

SQL = {
    "stage_outcomes": f"WITH {_STAGES_SQL} SELECT id, stage, status, confidence, review AS human_review_required, error, missing AS missing_inputs FROM st",
    "screening_assembly": f"""WITH {_STAGES_SQL} SELECT id, CASE WHEN bool_or(status = 'error') THEN 'completed_with_errors' WHEN bool_or(status = 'skipped') THEN 'completed_with_skips' ELSE 'completed_with_degraded_modules' END AS final_status,
      bool_or(review) AS human_review_required, coalesce(array_to_string((array_agg(stage ORDER BY k) FILTER (status <> 'ok'))[1:4], ', '), '') AS degraded, coalesce(string_agg(stage, ', ' ORDER BY k) FILTER (status = 'error'), '') AS failed,
      CAST(count(*) FILTER (status <> 'ok') AS INTEGER) AS risk FROM st GROUP BY id""",
    "metadata_anomalies": """WITH m AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS jpg, p_partkey % 6 <> 0 AS exif, p_partkey % 7 = 0 AS xmp FROM part),
      f AS (SELECT *, id % 3 = 0 AS edited, jpg AND NOT exif AS bare, exif AND id % 4 <> 0 AND id % 3 <> 2 AS alone FROM m)
      SELECT id, concat_ws(',', CASE WHEN edited THEN 'medium:0.7' END, CASE WHEN NOT edited AND xmp THEN 'info:0.2' END, CASE WHEN bare THEN 'low:0.45' END, CASE WHEN NOT bare AND alone THEN 'low:0.4' END,
        CASE WHEN exif AND id % 5 <> 0 THEN 'info:0.25' END, CASE WHEN jpg AND id % 9 > 1 THEN 'info:0.3' END) AS found,
        least(15.0::DOUBLE, CASE WHEN edited THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN bare OR alone THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN xmp AND NOT exif THEN 4.0::DOUBLE ELSE 0 END) AS points FROM f""",
    "face_gates": f"""WITH e AS (SELECT vec_id AS id, {_gate_sql('vec_id')} AS document, {_gate_sql('(vec_id + 7)')} AS probe, CASE WHEN vec_id % 8 <> 0 THEN (vec_id % 10) / 20 END AS sim FROM embeddings),
      v AS (SELECT *, CASE WHEN document IS NOT NULL OR probe IS NOT NULL OR sim IS NULL THEN 'INCONCLUSIVE' WHEN sim >= 0.363 THEN 'MATCH' WHEN sim <= 0.25 THEN 'NO_MATCH' ELSE 'INCONCLUSIVE' END AS verdict FROM e)
      SELECT id, document, probe, verdict, CASE WHEN document IS NOT NULL OR probe IS NOT NULL THEN coalesce(document, probe) WHEN sim IS NULL THEN 'no_embedding' WHEN id % 4 = 0 THEN 'multiple_faces' WHEN verdict = 'INCONCLUSIVE' THEN 'ambiguous_similarity' END AS reason FROM v""",
    "scripted_checkpoints": f"""WITH {SCREENINGS_SQL}, x AS (SELECT *, coalesce(risk_score <= 24, false) AS low, coalesce(risk_score > 24, false) AS raised, id % 4 <> 0 AS ocr, id % 3 = 0 AS clean, status = 'reviewed' AS told FROM scr),
      r AS (SELECT id, 'case1_valid' AS case_id, unnest([('OCR successful', ocr, false), ('Validation passes', clean, false), ('No obvious tampering', id % 3 <> 0, false), ('Face match', id % 2 = 0, false), ('Low risk', low, false), ('Audit recorded', told, false)]) AS c FROM x WHERE id % 5 = 0
        UNION ALL SELECT id, 'case2_tampered', unnest([('OCR successful', ocr, false), ('Validation may pass', true, true), ('Tampering indicators detected', id % 3 = 0, false), ('Risk increased', raised, false), ('Human review required', human_review_required, false), ('Audit recorded', told, false)]) FROM x WHERE id % 5 = 1
        UNION ALL SELECT id, 'case3_identity_mismatch', unnest([('Document information extracted', ocr, false), ('Document validation passes', clean, false), ('Face verification fails', id % 2 <> 0, false), ('High risk', raised, false), ('Human review required', human_review_required, false), ('Audit recorded', told, false)]) FROM x WHERE id % 5 = 2
        UNION ALL SELECT id, 'case4_low_quality', unnest([('Low OCR confidence', (id % 10) / 10 < 0.6 OR NOT ocr, false), ('Inconclusive validation where appropriate', true, true), ('Human review required', human_review_required, false), ('Audit recorded', told, false)]) FROM x WHERE id % 5 = 3)
      SELECT id, case_id, c[1] AS checkpoint, c[2] AS ok, c[3] AS informational FROM r""",
    "review_reasons": f"""WITH {SCREENINGS_SQL}, x AS (SELECT *, upper(risk_band) AS lvl, CASE WHEN id % 4 = 0 THEN list_filter(['ocr', CASE WHEN id % 3 = 0 THEN 'document_validation' END, CASE WHEN id % 5 = 0 THEN 'tampering_detection' END, CASE WHEN id % 7 = 0 THEN 'face_verification' END, 'risk_assessment'], lambda v: v IS NOT NULL) ELSE [] END AS bad FROM scr WHERE risk_score IS NOT NULL)
      SELECT id, coalesce(nullif(concat_ws('; ', CASE WHEN risk_score >= 50 THEN 'score ' || risk_score || ' above the medium band' END, CASE WHEN lvl <> 'LOW' THEN 'level ' || lvl END, CASE WHEN len(bad) > 0 THEN 'degraded: ' || array_to_string(bad[1:4], ', ') END), ''), 'low risk, confirmation by policy') AS reasons,
        CASE id % 4 WHEN 0 THEN 'independent signals agree (' || CASE WHEN id % 3 = 0 THEN 'none' ELSE 'a, b' END || '); risk ' || risk_score || '/100' WHEN 1 THEN 'some signals fired (' || CASE WHEN id % 3 = 0 THEN 'none' ELSE 'a, b' END || '); risk ' || risk_score || '/100'
          WHEN 2 THEN 'not completed (' || CASE WHEN id % 8 = 2 THEN 'ela, noise' ELSE 'low image coverage/quality' END || ')' ELSE 'nothing to flag' END AS explanation,
        CASE WHEN id % 6 <> 0 THEN CAST(risk_score AS DOUBLE) END AS score, CASE WHEN id % 6 <> 0 THEN lvl END AS level, id % 6 = 0 OR id % 2 = 0 AS human_review_required FROM x""",
    "search_page_total": f"WITH {SCREENINGS_SQL} SELECT id, risk_score, count(*) OVER () AS total FROM scr WHERE risk_band = 'high' ORDER BY risk_score DESC NULLS LAST, created_at DESC, id DESC LIMIT 10 OFFSET 5",
    "account_rules": "SELECT c_custkey AS id, c_custkey % 3 <> 0 AS name_ok, ([ 'at least 12 characters', 'an uppercase letter', 'a lowercase letter', 'a digit', NULL])[c_custkey % 5 + 1] AS lacks FROM customer",
    "token_denylist": "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-15')",
    "trusted_proxy": """SELECT s_suppkey AS id, (['172.' || s_suppkey % 40 || '.0.1', '192.168.0.' || s_suppkey % 300, '10.1.2.3', '8.8.8.8', 'not a host'])[s_suppkey % 5 + 1] AS host,
      CASE s_suppkey % 5 WHEN 0 THEN s_suppkey % 40 BETWEEN 16 AND 31 WHEN 1 THEN s_suppkey % 300 <= 255 WHEN 2 THEN true ELSE false END AS trusted FROM supplier""",
    "review_queue_page": f"""WITH {SCREENINGS_SQL}, p AS (SELECT * FROM scr WHERE status = 'pending_review' AND risk_band = 'critical' AND contains(run_id, 'ab') ORDER BY created_at DESC, id DESC LIMIT 40)
      SELECT CAST(row_number() OVER (ORDER BY human_review_required DESC, created_at DESC, id DESC) - 1 AS INTEGER) AS pos, id, human_review_required FROM p""",
    "event_case_chase": f"WITH {SCREENINGS_SQL}, {AUDIT_SQL} SELECT screening_id, line, run_id, c_name FROM aud JOIN scr ON screening_id = id JOIN customer ON c_custkey = operator_id WHERE anchor_status = 'anchored'",
    "sealed_reports": f"WITH {SCREENINGS_SQL} SELECT id, id % 2 = 0 AS encrypted, id % 2 = 0 AS hidden, true AS whole, CASE WHEN id % 6 = 0 THEN true END AS refused FROM scr",
    "legacy_signals": f"WITH {INDICATORS_SQL} SELECT type || ' (' || severity || ')' AS name, severity <> 'info' AS suspicious, count(*) AS n FROM ind GROUP BY 1, 2",
    "check_status_counts": "SELECT l_orderkey AS id, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS passed, count(*) FILTER (l_returnflag = 'R') AS warnings, count(*) FILTER (l_returnflag = 'A') AS failed FROM lineitem GROUP BY 1",
}
