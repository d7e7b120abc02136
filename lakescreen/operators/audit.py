"""Audit events and the ledger: latest events, hash chains, verification, idempotent anchoring."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a ledger record never has, and the chain's first hash.
FORBIDDEN = frozenset(
    {
        "image",
        "images",
        "photo",
        "portrait",
        "file",
        "files",
        "embedding",
        "embeddings",
        "biometric",
        "template",
        "full_name",
        "surname",
        "given_names",
        "date_of_birth",
        "passport_number",
        "nationality",
        "gender",
        "address",
        "national_id_number",
        "document_number",
        "personal_number",
        "raw_text",
        "mrz_raw",
        "original_path",
        "probe_image_path",
    }
)
GENESIS = "0" * 64


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def prefer(df: DataFrame, key: str, wanted: Column, order: list[Column]) -> DataFrame:
    """The first wanted row of each key, or else the first of all."""
    return latest(df, key, [F.coalesce(wanted, F.lit(False)).desc(), *order])


def case_event_rows(cases: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """Cases with a row for each of their events in order: n_events, pos (from 0) and event; a case without events is one row of nulls.

    Join and windows share one partitioning, and no array is made of a case.
    """
    of = Window.partitionBy("id")
    event = F.struct(*[F.col(c) for c in events.columns])
    joined = cases.join(events.select(F.col("screening_id").alias("id"), event.alias("event")), "id", "left")
    some = F.col("event").isNotNull()
    ranked = joined.withColumn("n_events", F.count("event").over(of)).withColumn("pos", F.when(some, F.row_number().over(of.orderBy(*[F.col(f"event.{c}") for c in order])) - 1))
    return ranked.select(*cases.columns, "n_events", "pos", "event")


def case_events(screenings: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """Each screening with its events in order of time; none gives an empty list."""
    listed = events.groupBy("screening_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("events"))
    return screenings.join(listed, F.col("id") == F.col("screening_id"), "left").drop("screening_id").withColumn("events", F.coalesce("events", F.array()))


def record(df: DataFrame) -> DataFrame:
    """The eight fields of a ledger record, with 'unknown' for what is missing; personal fields are refused before anything runs."""
    found = FORBIDDEN & {c.lower() for c in df.columns}
    if found:
        raise ValueError(f"not for the ledger: {', '.join(sorted(found))}")
    state = F.when(F.col("is_valid"), "valid").when(~F.col("is_valid"), "invalid").otherwise("unknown")
    return df.select(
        F.col("run_id").alias("screening_id"),
        F.date_format("created_at", "yyyy-MM-dd").alias("timestamp"),
        F.col("result_hash"),
        F.coalesce(F.col("risk_score").cast("string"), F.lit("unknown")).alias("risk_score"),
        state.alias("validation_status"),
        F.coalesce("tampering_verdict", F.lit("unknown")).alias("tampering_status"),
        F.coalesce("match_status", F.lit("unknown")).alias("face_match_status"),
        F.lit("lakescreen").alias("system_id"),
    )


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no spaces, so that order of keys does not matter."""
    return F.to_json(F.parse_json(json))


def result_hash(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def hash_chain(df: DataFrame, ledger: str, order: list[str], payload: Column) -> DataFrame:
    """Each ledger's rows with sequence, prev_entry_hash and entry_hash = sha256(payload + previous).

    A chain is sequential by nature: the rows of one ledger pass through one task in order, which keeps the last hash alone.
    A null payload has a null hash, and so have the rows after it.
    """
    rows = df.select(F.col(ledger).alias("ledger"), *order, payload.cast("string").alias("payload"))
    dealt = rows.repartition("ledger").sortWithinPartitions("ledger", *order, "payload")
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in ("ledger", *order, "payload")] + ["sequence LONG", "prev_entry_hash STRING", "entry_hash STRING"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sequence, last = object(), 0, GENESIS
        for batch in batches:
            out = []
            for name, text in zip(batch.column("ledger").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if name != now:
                    now, sequence, last = name, 0, GENESIS
                before, sequence = last, sequence + 1
                last = None if text is None or before is None else hashlib.sha256((text + before).encode()).hexdigest()
                out.append((sequence, before, last))
            more = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "sequence", "prev_entry_hash", "entry_hash"])

    chained = dealt.mapInArrow(follow, schema)
    return chained.select("ledger", "sequence", *order, "payload", "prev_entry_hash", "entry_hash")


def broken_links(chain: DataFrame) -> DataFrame:
    """Rows whose previous hash is not the hash of the row before."""
    before = F.lag("entry_hash", 1, GENESIS).over(Window.partitionBy("ledger").orderBy("sequence"))
    return chain.withColumn("_before", before).where("prev_entry_hash <> _before").drop("_before")


def verify(claims: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """claims (key, computed) against ledger (key, stored): UNCHANGED, CHANGED, NOT ON LEDGER, or UNAVAILABLE without a computed hash."""
    outcome = F.when(F.col("computed").isNull(), "UNAVAILABLE").when(F.col("stored").isNull(), "NOT ON LEDGER").when(F.col("computed") == F.col("stored"), "UNCHANGED").otherwise("CHANGED")
    return claims.join(ledger, key, "left").withColumn("outcome", outcome)


def anchor(new: DataFrame, anchored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that are not anchored yet, each once: anchoring twice is the same as once."""
    return new.dropDuplicates(keys).join(anchored.select(*keys), keys, "left_anti")


def around_previous(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """The canonical JSON of a record and prev_entry_hash, cut where the previous hash stands: what comes before it, and after."""
    early, late = (sorted(c for c in columns if (c < "prev_entry_hash") == first) for first in (True, False))
    keep = {"ignoreNullFields": "false"}
    json = lambda names: F.regexp_replace(F.to_json(F.struct(*names), keep), r"^\{|\}$", "")
    head = F.concat(F.lit("{"), *([json(early), F.lit(",")] if early else []), F.lit('"prev_entry_hash":"'))
    tail = F.concat(F.lit('"'), *([F.lit(","), json(late)] if late else []), F.lit("}"))
    return head, tail


def record_chain(df: DataFrame, ledger: str, order: list[str], columns: list[str], entry: str = "screening_id", keep: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """Each ledger's records in order, with sequence, prev_entry_hash, entry_hash and ledger_status.

    entry_hash is the SHA-256 of the record's canonical JSON, sorted by key, with prev_entry_hash as one of its keys; the first one's is 64 zeros.
    Personal fields are refused before anything runs. A record whose entry is null or empty is failed and takes no place in the chain. With
    start (ledger, start_sequence, start_hash) the chains of these ledgers go on from there. Columns of keep are returned too.
    """
    found = FORBIDDEN & {c.lower() for c in columns}
    if found:
        raise ValueError(f"not for the ledger: {', '.join(sorted(found))}")
    head, tail = around_previous(df, columns)
    kept = ["ledger", *dict.fromkeys([*order, entry, *keep])]
    rows = df.select(F.col(ledger).alias("ledger"), *[F.col(c) for c in kept[1:]], head.alias("before"), tail.alias("after"))
    tails = F.lit(0).cast("long").alias("start_sequence"), F.lit(GENESIS).alias("start_hash")
    if start is not None:
        tail_of = start.select(F.col("ledger").cast("string").alias("_of"), "start_sequence", "start_hash")
        rows = rows.join(tail_of, F.col("ledger").cast("string").eqNullSafe(F.col("_of")), "left")
        tails = F.coalesce("start_sequence", tails[0]).alias("start_sequence"), F.coalesce("start_hash", tails[1]).alias("start_hash")
    dealt = rows.select(*kept, "before", "after", *tails).repartition("ledger").sortWithinPartitions("ledger", *order, "before", "after")
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["sequence LONG", "prev_entry_hash STRING", "entry_hash STRING", "ledger_status STRING"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sequence, last = object(), 0, GENESIS
        for batch in batches:
            out = []
            for name, key, before, after, first, tail_hash in zip(*(batch.column(c).to_pylist() for c in ("ledger", entry, "before", "after", "start_sequence", "start_hash")), strict=True):
                if name != now:
                    now, sequence, last = name, first, tail_hash
                if key is None or key == "":
                    out.append((None, None, None, "failed"))
                    continue
                previous, sequence = last, sequence + 1
                last = hashlib.sha256((before + previous + after).encode()).hexdigest()
                out.append((sequence, previous, last, "logged"))
            more = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *more], [*kept, "sequence", "prev_entry_hash", "entry_hash", "ledger_status"])

    return dealt.mapInArrow(follow, schema)


def verify_record(claims: DataFrame, ledger: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """claims (key, recomputed) against the ledger (key, stored) and the database's own commitment (key, committed).

    Returns recomputed, stored, committed, db_hash_match (null without a commitment), verified, on_ledger, record_changed and conclusion:
    UNCHANGED if the ledger has the recomputed hash, CHANGED if ledger or database has another one, NOT ON LEDGER if neither says so and the ledger has none,
    UNAVAILABLE without a recomputed hash.
    """
    both = claims.join(ledger, key, "left").join(committed, key, "left")
    recomputed, stored = F.col("recomputed"), F.col("stored")
    match = F.col("committed") == recomputed
    verified = F.coalesce(stored == recomputed, F.lit(False))
    changed = F.coalesce(~match, F.lit(False)) | (stored.isNotNull() & ~verified)
    conclusion = F.when(recomputed.isNull(), "UNAVAILABLE").when(verified, "UNCHANGED").when(changed, "CHANGED").otherwise("NOT ON LEDGER")
    known = recomputed.isNotNull()
    return both.select(key, "recomputed", "stored", "committed", match.alias("db_hash_match"), (known & verified).alias("verified"), stored.isNotNull().alias("on_ledger"), (known & changed).alias("record_changed"), conclusion.alias("conclusion"))
