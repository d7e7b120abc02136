"""Audit trail, review queue, registry, access control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import audit, pipeline_state, registry as reg_ops, review
from ..sources.schemas import ROLES
from ..sources.views import AUDIT_SQL, REGISTRY_SQL, REVIEWS_SQL, SCREENINGS_SQL, audit_events, read, registry, reviews, screenings
from ..streaming import controls

_TIES = ["created_at", "event_type", "anchor_status", "block_number", "tx", "line", "price"]
_NEWEST_SQL = ", ".join(f"{c} DESC" for c in _TIES)
_EVENT = "screening_id, event_type, anchor_status, strftime(created_at, '%Y-%m-%d') AS created_on, block_number, tx"


def _newest():
    return [F.col(c).desc() for c in _TIES]


def _event(df):
    return df.select("screening_id", "event_type", "anchor_status", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "block_number", "tx")


def _case_events(s, d):
    rows = audit.case_event_rows(screenings(s, d).where("status = 'reviewed'").select("id", "run_id"), audit_events(s, d), _TIES)
    return rows.select("id", "run_id", "n_events", "pos", "event.event_type", "event.block_number", F.date_format("event.created_at", "yyyy-MM-dd").alias("created_on"))


def _records(s, d):
    flat = screenings(s, d).select(
        "run_id", "created_at", F.sha2(F.concat_ws("|", "run_id", "status"), 256).alias("result_hash"), "risk_score",
        F.when(F.col("id") % 5 != 0, F.col("id") % 2 == 0).alias("is_valid"), F.when(F.col("id") % 3 == 0, "suspicious").alias("tampering_verdict"), F.when(F.col("id") % 7 == 0, "MATCH").alias("match_status"))
    return audit.record(flat)


def _canonical(s, d):
    o = screenings(s, d)
    text = F.concat(F.lit('{"status":"'), "status", F.lit('","id":'), F.col("id").cast("string"), F.lit(', "band":'), F.coalesce(F.concat(F.lit('"'), "risk_band", F.lit('"')), F.lit("null")), F.lit("}"))
    return o.select("id", audit.result_hash(text).alias("result_hash"))


def _chain(s, d):
    return audit.hash_chain(screenings(s, d), "operator_id", ["created_at", "id"], F.concat_ws("|", "run_id", "status")).select("ledger", "sequence", "id", "prev_entry_hash", "entry_hash")


def _verify(s, d):
    claims = screenings(s, d).select("id", F.when(F.col("id") % 11 != 0, F.sha2(F.concat_ws("|", "run_id", F.when(F.col("id") % 5 == 0, F.lit("edited")).otherwise(F.col("status"))), 256)).alias("computed"))
    stored = screenings(s, d).where("status <> 'processing'").select("id", F.sha2(F.concat_ws("|", "run_id", "status"), 256).alias("stored"))
    return audit.verify(claims, stored, "id").select("id", "outcome")


def _anchor(s, d):
    new = screenings(s, d).select(numbers.ledger_key(F.col("run_id")).alias("numeric_id"), F.col("file_sha256").alias("report_hash"), "status")
    return audit.anchor(new, new.where("status = 'reviewed'"), ["numeric_id", "report_hash"]).select("numeric_id", "report_hash")


def _registry_lookup(s, d):
    c = read(s, d, "customer")
    request = c.select(F.col("c_custkey").alias("request_id"), F.element_at(F.array(*[F.lit(x) for x in ("passport", "visa", "national_id", "driving_license", "permit")]), (F.col("c_nationkey") % 5 + 1)).alias("doc_type"), "c_custkey")
    number = lambda k: F.concat(F.lit(" mock-"), F.lpad(k.cast("string"), 7, "0"))
    tried = F.array(number(F.col("c_custkey") * 3), number(F.col("c_custkey") + 1), F.lit(""), number(F.col("c_custkey")))
    return reg_ops.lookup(request, tried, registry(s, d)).select("request_id", "doc_type", "doc_number", "registry_status")


def _resolution(s, d):
    c = read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    requests = c.select(F.col("c_custkey").alias("request_id"), F.col("n_name").alias("country"), F.when(F.col("c_custkey") % 3 == 0, "passport").when(F.col("c_custkey") % 3 == 1, "visa").otherwise("other").alias("doc_type"))
    rules = s.createDataFrame([("NATION_1", "passport", "nation one passport"), ("NATION_2", "visa", "nation two visa"), ("*", "passport", "passport"), ("*", "visa", "visa"), ("*", "unknown", "generic")], "rule_country string, rule_type string, ruleset string")
    return reg_ops.resolve_rules(requests, rules)


def _repeated(s, d):
    rows = read(s, d, "part").select((F.col("p_partkey") % 700).alias("run"), F.concat(F.lit("N"), F.col("p_size").cast("string")).alias("value"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("pos"))
    return reg_ops.repeated_numbers(rows, "run", "value", "name", "pos").select("run", "value", "name", "pos", "earlier_name")


def _permissions(s, d):
    people = read(s, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.element_at(F.array(*[F.lit(r) for r in (*ROLES, "GUEST")]), (F.col("n_nationkey") % 4 + 1)).alias("role"))
    wanted = F.explode(F.array(*[F.lit(p) for p in (*pipeline_state.PERMISSIONS, "delete")]))
    return pipeline_state.allowed(people.select("user_id", "role", wanted.alias("permission"))).select("user_id", "role", "permission", "allowed")


def _attempts(s, d):
    return read(s, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))


QUERIES = {
    "case_events_ordered": _case_events,
    "latest_event_per_case": lambda s, d: _event(audit.latest(audit_events(s, d), "screening_id", _newest())),
    "prioritised_event": lambda s, d: _event(audit.prefer(audit_events(s, d), "screening_id", F.col("event_type") == "screening_completed", _newest())),
    "pending_reviews": lambda s, d: review.pending(screenings(s, d), reviews(s, d)).select("id", "run_id", "risk_band", "human_review_required"),
    "undecided_screenings": lambda s, d: screenings(s, d).join(reviews(s, d).select(F.col("screening_id").alias("id")), "id", "left_anti").select("id", "status"),
    "review_overlay": lambda s, d: review.overlay(screenings(s, d), reviews(s, d)).select("id", "status", "decision", "pending", "reviewer_id"),
    "decision_updates_status": lambda s, d: review.decide(screenings(s, d), screenings(s, d).where("status = 'pending_review'").select(F.col("id").alias("screening_id"), F.when(F.col("id") % 4 == 0, "cleared").when(F.col("id") % 4 == 1, "maybe").otherwise("flagged").alias("decision")))[1].select("id", "status"),
    "registry_priority_lookup": _registry_lookup,
    "registry_seed_missing": lambda s, d: reg_ops.seed(registry(s, d).where("part_id % 3 = 0"), registry(s, d)).select("doc_type", "doc_number", "registry_status"),
    "audit_record": _records,
    "canonical_hash": _canonical,
    "ledger_hash_chain": _chain,
    "ledger_hash_chain_whole": _chain,
    "verify_ladder": _verify,
    "anchor_idempotent": _anchor,
    "ruleset_resolution": _resolution,
    "duplicate_number": _repeated,
    "permission_matrix": _permissions,
    "login_failure_runs": lambda s, d: controls.failure_runs(read(s, d, "events"), F.col("event_type") == "error").where("failures >= 2").select("user_id", "failures", controls.micros("first_failure").alias("first_failure")),
    "login_lockout": lambda s, d: controls.lockout(_attempts(s, d)),
    "rate_limit_windows": lambda s, d: controls.rate_windows(read(s, d, "events"), 2, width="6 hours").select("user_id", controls.micros("window_start").alias("window_start"), "n"),
    "retention_expired": lambda s, d: read(s, d, "events").where(F.col("ts") < F.lit("2024-01-20").cast("timestamp") - F.make_dt_interval(F.lit(7))).select("event_id"),
}

SQL = {
    "case_events_ordered": f"""WITH {SCREENINGS_SQL}, {AUDIT_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY screening_id ORDER BY {', '.join(_TIES)}) - 1 AS pos, count(*) OVER (PARTITION BY screening_id) AS n FROM aud)
      SELECT id, run_id, coalesce(n, 0) AS n_events, CAST(pos AS INTEGER) AS pos, e.event_type, e.block_number, strftime(e.created_at, '%Y-%m-%d') AS created_on FROM scr LEFT JOIN e ON scr.id = e.screening_id WHERE status = 'reviewed'""",
    "latest_event_per_case": f"WITH {AUDIT_SQL} SELECT {_EVENT} FROM aud QUALIFY row_number() OVER (PARTITION BY screening_id ORDER BY {_NEWEST_SQL}) = 1",
    "prioritised_event": f"WITH {AUDIT_SQL} SELECT {_EVENT} FROM aud QUALIFY row_number() OVER (PARTITION BY screening_id ORDER BY (event_type = 'screening_completed') DESC, {_NEWEST_SQL}) = 1",
    "pending_reviews": f"WITH {SCREENINGS_SQL}, {REVIEWS_SQL} SELECT id, run_id, risk_band, human_review_required FROM scr WHERE status = 'pending_review' AND id NOT IN (SELECT screening_id FROM rev)",
    "undecided_screenings": f"WITH {SCREENINGS_SQL}, {REVIEWS_SQL} SELECT id, status FROM scr WHERE id NOT IN (SELECT screening_id FROM rev)",
    "review_overlay": f"WITH {SCREENINGS_SQL}, {REVIEWS_SQL} SELECT id, status, coalesce(decision, 'pending') AS decision, decision IS NULL AS pending, reviewer_id FROM scr LEFT JOIN rev ON id = screening_id",
    "decision_updates_status": f"WITH {SCREENINGS_SQL} SELECT id, CASE WHEN status = 'pending_review' AND id % 4 <> 1 THEN 'reviewed' ELSE status END AS status FROM scr",
    "registry_priority_lookup": f"""WITH {REGISTRY_SQL}, q AS (SELECT c_custkey AS request_id, (['passport', 'visa', 'national_id', 'driving_license', 'permit'])[c_nationkey % 5 + 1] AS doc_type,
        unnest([c_custkey * 3, c_custkey + 1, NULL, c_custkey]) AS k, unnest([0, 1, 2, 3]) AS pos FROM customer),
      h AS (SELECT request_id, arg_min(doc_number, pos) AS doc_number, arg_min(registry_status, pos) AS registry_status FROM q JOIN reg ON q.doc_type = reg.doc_type AND reg.part_id = q.k GROUP BY 1)
      SELECT c_custkey AS request_id, (['passport', 'visa', 'national_id', 'driving_license', 'permit'])[c_nationkey % 5 + 1] AS doc_type, doc_number, registry_status FROM customer LEFT JOIN h ON c_custkey = request_id""",
    "registry_seed_missing": f"WITH {REGISTRY_SQL} SELECT doc_type, doc_number, registry_status FROM reg WHERE part_id % 3 <> 0",
    "audit_record": f"""WITH {SCREENINGS_SQL} SELECT run_id AS screening_id, strftime(created_at, '%Y-%m-%d') AS timestamp, sha256(run_id || '|' || status) AS result_hash, coalesce(CAST(risk_score AS VARCHAR), 'unknown') AS risk_score,
      CASE WHEN id % 5 = 0 THEN 'unknown' WHEN id % 2 = 0 THEN 'valid' ELSE 'invalid' END AS validation_status, CASE WHEN id % 3 = 0 THEN 'suspicious' ELSE 'unknown' END AS tampering_status,
      CASE WHEN id % 7 = 0 THEN 'MATCH' ELSE 'unknown' END AS face_match_status, 'lakescreen' AS system_id FROM scr""",
    "canonical_hash": f"""WITH {SCREENINGS_SQL} SELECT id, sha256('{{"band":' || coalesce('"' || risk_band || '"', 'null') || ',"id":' || id || ',"status":"' || status || '"}}') AS result_hash FROM scr""",
    "verify_ladder": f"""WITH {SCREENINGS_SQL} SELECT id, CASE WHEN id % 11 = 0 THEN 'UNAVAILABLE' WHEN status = 'processing' THEN 'NOT ON LEDGER' WHEN id % 5 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS outcome FROM scr""",
    "anchor_idempotent": f"WITH {SCREENINGS_SQL} SELECT DISTINCT CAST(('0x' || run_id[1:8]) AS BIGINT) AS numeric_id, file_sha256 AS report_hash FROM scr WHERE status <> 'reviewed'",
    "ledger_hash_chain": f"""WITH RECURSIVE {SCREENINGS_SQL}, o AS (SELECT operator_id AS ledger, id, run_id || '|' || status AS payload, row_number() OVER (PARTITION BY operator_id ORDER BY created_at, id) AS sequence FROM scr),
      c AS (SELECT ledger, sequence, id, repeat('0', 64) AS prev_entry_hash, sha256(payload || repeat('0', 64)) AS entry_hash FROM o WHERE sequence = 1
        UNION ALL SELECT o.ledger, o.sequence, o.id, c.entry_hash, sha256(o.payload || c.entry_hash) FROM c JOIN o ON o.ledger = c.ledger AND o.sequence = c.sequence + 1) SELECT * FROM c""",
    "ruleset_resolution": """WITH q AS (SELECT c_custkey AS request_id, n_name AS country, CASE c_custkey % 3 WHEN 0 THEN 'passport' WHEN 1 THEN 'visa' ELSE 'other' END AS doc_type FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT *, CASE WHEN country = 'NATION_1' AND doc_type = 'passport' THEN 'nation one passport' WHEN country = 'NATION_2' AND doc_type = 'visa' THEN 'nation two visa' WHEN doc_type = 'other' THEN 'generic' ELSE doc_type END AS ruleset FROM q""",
    "duplicate_number": """WITH r AS (SELECT p_partkey % 700 AS run, 'N' || p_size AS value, p_brand AS name, p_partkey AS pos FROM part), l AS (SELECT *, lag(name) OVER (PARTITION BY run, value ORDER BY pos) AS earlier_name FROM r)
      SELECT * FROM l WHERE earlier_name <> name""",
    "permission_matrix": """WITH p AS (SELECT n_nationkey AS user_id, (['ADMIN', 'SECURITY_OFFICER', 'REVIEWER', 'GUEST'])[n_nationkey % 4 + 1] AS role,
        unnest(['screening:run', 'screening:read', 'audit:read', 'audit:write', 'admin:manage', 'delete']) AS permission FROM nation)
      SELECT user_id, role, permission, role = 'ADMIN' AND permission <> 'delete' OR role = 'SECURITY_OFFICER' AND permission IN ('screening:run', 'screening:read', 'audit:read', 'audit:write')
        OR role = 'REVIEWER' AND permission IN ('screening:read', 'audit:read') AS allowed FROM p""",
    "login_failure_runs": """WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
      SELECT user_id, count(*) AS failures, epoch_us(min(ts)) AS first_failure FROM r WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 2""",
    "login_lockout": """WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      s AS (SELECT user_id, 0 AS k, CAST(0 AS BIGINT) AS failures, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome FROM a WHERE k = 1
        UNION ALL SELECT a.user_id, a.k,
          CASE WHEN a.t < s.until THEN s.failures WHEN NOT a.failed OR s.failures + 1 >= 5 THEN 0 ELSE s.failures + 1 END,
          CASE WHEN a.t < s.until THEN s.until WHEN a.failed AND s.failures + 1 >= 5 THEN a.t + 900000000 END, a.event_id,
          CASE WHEN a.t < s.until THEN 'locked' WHEN NOT a.failed THEN 'accepted' WHEN s.failures + 1 >= 5 THEN 'lock' ELSE 'rejected' END
        FROM s JOIN a ON a.user_id = s.user_id AND a.k = s.k + 1)
      SELECT user_id, event_id, outcome FROM s WHERE k > 0""",
    "rate_limit_windows": "SELECT user_id, epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2",
    "retention_expired": "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY",
}

#: The same query under the name that it had while the first one held some ledgers only.
SQL["ledger_hash_chain_whole"] = SQL["ledger_hash_chain"]
