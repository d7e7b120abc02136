"""Ledgers as defined, in batches and on streams; refused tokens; anchors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit
from ..sources import keyed, ledger_source
from ..sources.shared import shared_folder
from ..sources.views import SCREENINGS_SQL, read, screenings
from ..streaming import ledgers

_FIELDS = ["screening_id", "timestamp", "result_hash", "risk_score", "validation_status", "tampering_status", "face_match_status", "system_id"]


def _told(s, d, name):
    """A table as a stream: one batch for what it holds. The path is a pattern, as a stream takes one file by a pattern only."""
    return s.readStream.schema(read(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _records(s, d):
    """Records of all screenings; each fiftieth has no id."""
    i = F.col("id")
    flat = screenings(s, d).select(
        "id", "operator_id", F.when(i % 50 != 7, F.col("run_id")).otherwise("").alias("run_id"), "created_at", F.sha2(F.concat_ws("|", "run_id", "status"), 256).alias("result_hash"), "risk_score",
        (F.col("status") == "reviewed").alias("is_valid"), F.col("risk_band").alias("tampering_verdict"), F.when(F.col("human_review_required"), "MATCH").alias("match_status"))
    return flat.select("id", "operator_id", *[c.alias(n) for n, c in zip(_FIELDS, _columns(flat), strict=True)])


def _columns(flat):
    """The record's columns as expressions over flat."""
    return [
        F.col("run_id"), F.date_format("created_at", "yyyy-MM-dd"), F.col("result_hash"), F.coalesce(F.col("risk_score").cast("string"), F.lit("unknown")),
        F.when(F.col("is_valid"), "valid").otherwise("invalid"), F.coalesce("tampering_verdict", F.lit("unknown")), F.coalesce("match_status", F.lit("unknown")), F.lit("lakescreen"),
    ]


def _chain(s, d):
    out = audit.record_chain(_records(s, d), "operator_id", ["timestamp", "id"], _FIELDS)
    return out.select("ledger", "id", "sequence", "prev_entry_hash", "entry_hash", "ledger_status")


def _stream(s, d):
    rows = _told(s, d, "orders")
    key = F.col("o_orderkey").cast("string")
    position = F.concat_ws("/", F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lpad(key, 20, "0"))
    status = F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("processing")
    entries = rows.select(F.col("o_custkey").alias("ledger"), position.alias("position"), key.alias("entry"), F.concat_ws("|", F.md5(key), status).alias("before"), F.lit("").alias("after"))
    with ledgers.rocksdb(s):
        done = ledgers.drained(ledgers.chained(entries).writeStream, s)
    return done.select(F.col("ledger").cast("long").alias("ledger"), "sequence", F.col("entry").cast("long").alias("id"), "prev_entry_hash", "entry_hash")


def _tokens(s, d):
    e = _told(s, d, "events")
    at = F.col("ts").cast("timestamp")
    revokes = F.col("event_type") == "error"
    checks = e.select(F.col("user_id").alias("token"), at.alias("ts"), revokes.alias("revokes"), F.when(revokes, at + F.expr("INTERVAL 12 HOURS")).alias("expires"), F.col("event_id").alias("request"))
    with ledgers.rocksdb(s):
        done = ledgers.drained(ledgers.token_checks(checks).writeStream, s)
    return done.select(F.col("request").alias("event_id"), "refused")


def _anchored(s, d):
    """Files by hash are anchored once, whatever case they belong to; the batch's number is that of the stream."""
    rows = _told(s, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    folder = f"{shared_folder(s)}/anchors-{uuid.uuid4().hex}"
    rows.writeStream.foreachBatch(ledgers.anchor_batch(f"{folder}/rows", ["part", "supplier"])).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledgers.anchors(s, f"{folder}/rows").select("part", "supplier", "anchor_count")


def _verified(s, d):
    i, good = F.col("id"), F.sha2(F.concat_ws("|", "run_id", "status"), 256)
    rows = screenings(s, d)
    claims = rows.select("id", F.when(i % 11 != 0, good).alias("recomputed"))
    stored = rows.where("status <> 'processing'").select("id", F.when(i % 5 == 0, F.sha2(F.concat(F.lit("edited"), "run_id"), 256)).otherwise(good).alias("stored"))
    committed = rows.where(i % 3 != 0).select("id", F.when(i % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(good).alias("committed"))
    return audit.verify_record(claims, stored, committed, "id").select("id", "db_hash_match", "verified", "on_ledger", "record_changed", "conclusion")


def _folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _upserted(s, d):
    """Screenings stored by id; then those in progress get their report, and pending ones an anchor, which reviewed ones keep as it is."""
    folder = _folder(s, "keyed")
    rows = screenings(s, d).select("id", "status", "risk_score")
    keyed.upsert(rows, folder, ["id"])
    keyed.upsert(rows.where("status = 'processing'").select("id", F.lit("pending_review").alias("status"), (F.col("id") % 101).alias("risk_score")), folder, ["id"])
    keyed.upsert(rows.where("id % 4 = 0").select("id", F.lit("anchored").alias("status"), "risk_score", F.col("id").cast("string").alias("anchor")), folder, ["id"], unless=F.col("status") == "reviewed")
    return keyed.current(s, folder).select("id", "status", "risk_score", "anchor")


def _looked_up(s, d):
    folder = _folder(s, "lookup")
    keyed.for_lookups(screenings(s, d).select("run_id", "id", "status"), folder, "run_id")
    wanted = s.range(1).select(F.md5(F.lit("77"))).first()[0]
    return keyed.lookup(s, folder, "run_id", wanted).select("run_id", "id", "status")


def _widened(s, d):
    """Suppliers stored with two columns; later ones come with a third one, and a fourth is asked for that no file has."""
    folder = _folder(s, "widened")
    rows = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    keyed.upsert(rows, folder, ["id"], parts=16)
    keyed.upsert(rows.where("id % 3 = 0").withColumn("grade", (F.col("id") % 5).cast("int")), folder, ["id"])
    return keyed.added(keyed.current(s, folder), "id long, grade int, note string")[0].select("id", "nation", "grade", "note")


def _backend(s, d):
    """Records appended in two goes, the second of which tells half of the first again."""
    path, records = _folder(s, "ledger"), _records(s, d).where("screening_id <> ''")
    order = ["timestamp", "id"]
    for part in (records.where("timestamp < '1996-01-01'"), records.where("timestamp >= '1996-01-01' OR id % 2 = 0")):
        ledger_source.append(part, path, "operator_id", order, _FIELDS)
    return ledger_source.entries(s, path).select(F.col("ledger").cast("long").alias("ledger"), "sequence", "screening_id", "prev_entry_hash", "entry_hash")


QUERIES = {
    "keyed_upsert": _upserted,
    "point_lookup": _looked_up,
    "added_columns": _widened,
    "ledger_backend": _backend,
    "ledger_record_chain": _chain,
    "ledger_chain_stream": _stream,
    "token_denylist_stream": _tokens,
    "anchor_stream": _anchored,
    "verify_record_full": _verified,
}

SQL = {
    "keyed_upsert": f"""WITH {SCREENINGS_SQL}, p AS (SELECT id, CASE WHEN status = 'processing' THEN 'pending_review' ELSE status END AS status, risk_score AS first_score, CASE WHEN status = 'processing' THEN id % 101 ELSE risk_score END AS risk_score FROM scr)
      SELECT id, CASE WHEN id % 4 = 0 AND status <> 'reviewed' THEN 'anchored' ELSE status END AS status, CASE WHEN id % 4 = 0 AND status <> 'reviewed' THEN first_score ELSE risk_score END AS risk_score,
        CASE WHEN id % 4 = 0 AND status <> 'reviewed' THEN CAST(id AS VARCHAR) END AS anchor FROM p""",
    "point_lookup": f"WITH {SCREENINGS_SQL} SELECT run_id, id, status FROM scr WHERE run_id = md5('77')",
    "added_columns": "SELECT s_suppkey AS id, s_nationkey AS nation, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 5 AS INTEGER) END AS grade, CAST(NULL AS VARCHAR) AS note FROM supplier",
    "ledger_record_chain": f"""WITH RECURSIVE {SCREENINGS_SQL}, r AS (SELECT operator_id AS ledger, id, CASE WHEN id % 50 <> 7 THEN run_id ELSE '' END AS entry, strftime(created_at, '%Y-%m-%d') AS ts,
        '{{"face_match_status":"' || CASE WHEN human_review_required THEN 'MATCH' ELSE 'unknown' END || '","prev_entry_hash":"' AS head,
        '","result_hash":"' || sha256(run_id || '|' || status) || '","risk_score":"' || coalesce(CAST(risk_score AS VARCHAR), 'unknown') || '","screening_id":"' || CASE WHEN id % 50 <> 7 THEN run_id ELSE '' END
          || '","system_id":"lakescreen","tampering_status":"' || coalesce(risk_band, 'unknown') || '","timestamp":"' || strftime(created_at, '%Y-%m-%d') || '","validation_status":"' || CASE WHEN status = 'reviewed' THEN 'valid' ELSE 'invalid' END || '"}}' AS tail FROM scr),
      o AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY ts, id) AS sequence FROM r WHERE entry <> ''),
      c AS (SELECT ledger, id, sequence, repeat('0', 64) AS prev_entry_hash, sha256(head || repeat('0', 64) || tail) AS entry_hash FROM o WHERE sequence = 1
        UNION ALL SELECT o.ledger, o.id, o.sequence, c.entry_hash, sha256(o.head || c.entry_hash || o.tail) FROM c JOIN o ON o.ledger = c.ledger AND o.sequence = c.sequence + 1)
      SELECT ledger, id, sequence, prev_entry_hash, entry_hash, 'logged' AS ledger_status FROM c UNION ALL SELECT ledger, id, NULL, NULL, NULL, 'failed' FROM r WHERE entry = ''""",
    "ledger_chain_stream": f"""WITH RECURSIVE {SCREENINGS_SQL}, o AS (SELECT operator_id AS ledger, id, run_id || '|' || status AS payload, row_number() OVER (PARTITION BY operator_id ORDER BY created_at, id) AS sequence FROM scr),
      c AS (SELECT ledger, sequence, id, repeat('0', 64) AS prev_entry_hash, sha256(payload || repeat('0', 64)) AS entry_hash FROM o WHERE sequence = 1
        UNION ALL SELECT o.ledger, o.sequence, o.id, c.entry_hash, sha256(o.payload || c.entry_hash) FROM c JOIN o ON o.ledger = c.ledger AND o.sequence = c.sequence + 1) SELECT * FROM c""",
    "token_denylist_stream": """WITH r AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
      SELECT event_id, EXISTS (FROM r WHERE r.user_id = e.user_id AND epoch_ms(r.ts) <= epoch_ms(e.ts) AND epoch_ms(e.ts) < epoch_ms(r.ts) + 43200000) AS refused FROM events e WHERE event_type <> 'error'""",
    "anchor_stream": "WITH a AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem) SELECT part, supplier, (SELECT count(*) FROM a) AS anchor_count FROM a",
    "verify_record_full": f"""WITH {SCREENINGS_SQL}, v AS (SELECT id, id % 11 <> 0 AS known, status <> 'processing' AS on_ledger, CASE WHEN id % 3 <> 0 AND id % 11 <> 0 THEN id % 7 <> 0 END AS db_hash_match, id % 11 <> 0 AND status <> 'processing' AND id % 5 <> 0 AS verified FROM scr),
      c AS (SELECT *, known AND (coalesce(NOT db_hash_match, false) OR (on_ledger AND NOT verified)) AS record_changed FROM v)
      SELECT id, db_hash_match, verified, on_ledger, record_changed, CASE WHEN NOT known THEN 'UNAVAILABLE' WHEN verified THEN 'UNCHANGED' WHEN record_changed THEN 'CHANGED' ELSE 'NOT ON LEDGER' END AS conclusion FROM c""",
}

#: The same chain as that of ledger_record_chain, by the record's own id.
SQL["ledger_backend"] = SQL["ledger_record_chain"].split("SELECT ledger, id, sequence, prev_entry_hash, entry_hash, 'logged'")[0] + "SELECT c.ledger, c.sequence, scr.run_id AS screening_id, prev_entry_hash, entry_hash FROM c JOIN scr ON c.id = scr.id"
