"""Ledgers as defined, in batches and on streams that stop in the middle; refused tokens that expire; anchors told twice."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakescreen.operators import audit
from lakescreen.streaming import ledgers

FIELDS = ["screening_id", "note", "result_hash", "a_first", "zulu"]


def chain_of(records):
    last, out = "0" * 64, []
    for r in records:
        if not r["screening_id"]:
            out.append((r["screening_id"], None, None, None, "failed"))
            continue
        text = json.dumps({**r, "prev_entry_hash": last}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        before, last = last, hashlib.sha256(text.encode()).hexdigest()
        out.append((r["screening_id"], sum(x[4] == "logged" for x in out) + 1, before, last, "logged"))
    return out


def records(n):
    return [{"screening_id": f"s{i}" if i % 7 else ("" if i % 2 else None), "note": 'quote " and é\\' if i % 3 else None, "result_hash": f"h{i}", "a_first": i, "zulu": bool(i % 2)} for i in range(n)]


def test_records_are_chained_as_defined(spark):
    rows = records(40)
    data = [(g, i, *[r[f] for f in FIELDS]) for g in ("one", "two") for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "ledger string, pos int, screening_id string, note string, result_hash string, a_first int, zulu boolean").repartition(4)
    got = audit.record_chain(df, "ledger", ["pos"], FIELDS).orderBy("ledger", "pos").collect()
    for name in ("one", "two"):
        assert [(r.screening_id, r.sequence, r.prev_entry_hash, r.entry_hash, r.ledger_status) for r in got if r.ledger == name] == chain_of(rows)
    assert audit.record_chain(df.where("false"), "ledger", ["pos"], FIELDS).count() == 0
    with pytest.raises(ValueError, match="not for the ledger"):
        audit.record_chain(df.withColumn("surname", F.lit("x")), "ledger", ["pos"], [*FIELDS, "surname"])


def test_changed_and_missing_records(spark):
    claims = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e"), (6, "f")], "id long, recomputed string")
    stored = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (6, "f")], "id long, stored string")
    committed = spark.createDataFrame([(1, "a"), (3, "z"), (4, "d"), (6, "y")], "id long, committed string")
    got = {r.id: (r.conclusion, r.verified, r.on_ledger, r.db_hash_match, r.record_changed) for r in audit.verify_record(claims, stored, committed, "id").collect()}
    assert got == {
        1: ("UNCHANGED", True, True, True, False), 2: ("CHANGED", False, True, None, True), 3: ("CHANGED", False, False, False, True),
        4: ("UNAVAILABLE", False, True, None, False), 5: ("NOT ON LEDGER", False, False, None, False), 6: ("UNCHANGED", True, True, False, True),
    }


ENTRIES = "ledger string, position string, entry string, before string, after string"


def written(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run_stream(spark, make, schema, folder, sink):
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*"))
    with ledgers.rocksdb(spark, partitions=2):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{sink}").option("checkpointLocation", f"{folder}/{sink}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def test_a_chain_goes_on_after_a_stop(spark, tmp_path):
    folder = str(tmp_path)
    rows = [[(f"l{i % 3}", f"{i:04}", f"e{i}", f"<{i}|", ">") for i in range(lo, lo + 20)] for lo in (0, 20, 40)]
    rows[1] += [("l0", "0100", "e0", "<told again|", ">"), ("l1", "0101", "", "x", "y"), ("l1", "0102", None, "x", "y")]
    for k, part in enumerate(rows):
        written(spark, part, ENTRIES, folder, f"in-{k}")
        run_stream(spark, ledgers.chained, ENTRIES, folder, "out")  # each run starts anew from the checkpoint of the last
    got = spark.read.parquet(f"{folder}/out").orderBy("ledger", "sequence").collect()
    assert sorted(r.entry or "" for r in got if r.ledger_status == "failed") == ["", ""] and len(got) == 62
    for name in ("l0", "l1", "l2"):
        last, mine = audit.GENESIS, [r for r in got if r.ledger == name and r.sequence is not None]
        assert [r.sequence for r in mine] == list(range(1, 21))
        for r in mine:
            assert r.prev_entry_hash == last
            last = hashlib.sha256(f"<{r.entry[1:]}|{last}>".encode()).hexdigest()
            assert r.entry_hash == last


TOKENS = "token string, ts timestamp, revokes boolean, expires timestamp, request long"


def test_refused_until_expiry_and_state_shrinks(spark, tmp_path):
    folder, start = str(tmp_path), datetime.datetime(2024, 1, 1, 12)
    at = lambda m: start + datetime.timedelta(minutes=m)
    parts = [
        [("t", at(0), False, None, 1), ("t", at(1), True, at(60), None), ("t", at(1), False, None, 2), ("u", at(2), True, at(5), None), ("u", at(3), False, None, 3), ("t", at(4), True, at(30), None), (None, at(1), True, at(9), None), ("v", at(1), True, None, None)],
        [("t", at(59), False, None, 4), ("t", at(60), False, None, 5), ("u", at(6), False, None, 6)],
        [("w", at(200), False, None, 7), ("t", at(200), False, None, 8)],
        [("t", at(20), True, at(900), None), ("t", at(201), False, None, 9)],  # later than allowed: does nothing
    ]
    sizes = []
    for k, part in enumerate(parts):
        written(spark, part, TOKENS, folder, f"in-{k}")
        query = run_stream(spark, ledgers.token_checks, TOKENS, folder, "out")
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.request: r.refused for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False, 9: False}
    assert sizes[0] > 0 and sizes[-1] == 0


def test_a_batch_told_twice_anchors_once(spark, tmp_path):
    folder = str(tmp_path)
    schema = "key long, hash string"
    write = ledgers.anchor_batch(f"{folder}/anchors", ["key", "hash"])
    fail = {1}

    def failing(batch, batch_id):
        write(batch, batch_id)
        if batch_id in fail:  # after the write, before the stream commits
            fail.discard(batch_id)
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in-*")
        stream.writeStream.foreachBatch(failing).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    assert ledgers.anchors(spark, f"{folder}/anchors").count() == 0
    written(spark, [(i, "h") for i in range(10)] + [(3, "h")], schema, folder, "in-0")
    run()
    written(spark, [(i, "h") for i in range(5, 15)] + [(3, "other")], schema, folder, "in-1")
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    got = ledgers.anchors(spark, f"{folder}/anchors").collect()
    assert sorted((r.key, r.hash) for r in got) == sorted([(i, "h") for i in range(15)] + [(3, "other")])
    assert {(r.batch, r.anchor_count) for r in got} == {(0, 10), (1, 16)}


def chains_by_hand(batches):
    """(ledger, entry) to (sequence, previous hash, hash), as each batch is told in order."""
    tails, done, failed = {}, {}, 0
    for batch in batches:
        for ledger, _, entry, before, after in sorted(batch, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, r[2] or "")):
            if not entry:
                failed += 1
            elif (ledger, entry) not in done:
                sequence, last = tails.get(ledger, (0, audit.GENESIS))
                tails[ledger] = sequence + 1, hashlib.sha256((before + last + after).encode()).hexdigest()
                done[ledger, entry] = sequence + 1, last, tails[ledger][1]
    return done, failed


def test_long_ledgers_hold_every_entry_and_short_ones_are_one_row_of_state(spark, tmp_path):
    folder = str(tmp_path)
    row = lambda ledger, i: (ledger, f"{i * 7919 % 1000:04}", f"e{i}", f"<{i}|", ">")
    short = [row(f"s{g}", i) for g in range(40) for i in range(20)]
    batches = [
        short + [row("long", i) for i in range(600)] + [row("long", i) for i in range(0, 600, 3)] + [row(None, i) for i in range(5)],
        short + [row("long", i) for i in range(0, 900)] + [row(None, i) for i in range(3, 9)] + [("long", None, "", "x", "y"), ("grown", None, "e1", "x", "y"), ("s0", None, None, "x", "y")],
        [row("long", i) for i in range(1200)] + [row("grown", i) for i in range(300)] + [row("s1", i) for i in range(25)],
    ]
    states = []
    for k, part in enumerate(batches):
        written(spark, part, ENTRIES, folder, f"in-{k}")
        query = run_stream(spark, ledgers.chained, ENTRIES, folder, "out")
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    want, failed = chains_by_hand(batches)
    got = spark.read.parquet(f"{folder}/out").collect()
    assert sum(r.ledger_status == "failed" for r in got) == failed == 2 and len(got) == len(want) + failed
    assert {(r.ledger, r.entry): (r.sequence, r.prev_entry_hash, r.entry_hash) for r in got if r.sequence} == want
    # each call to the state's process takes as long as many entries: 1405 entries are fewer rows of state, as short ledgers are one row each
    assert states[0] < 700


def test_a_state_of_each_ledgers_own_gives_the_same_chains(spark, tmp_path):
    folder = str(tmp_path)
    batches = [[(f"l{i % 3}", f"{i:04}", f"e{i % 25}", f"<{i}|", ">") for i in range(lo, lo + 30)] for lo in (0, 30)]
    for k, part in enumerate(batches):
        written(spark, part, ENTRIES, folder, f"in-{k}")
        run_stream(spark, lambda s: ledgers.chained(s, each=True), ENTRIES, folder, "out")
    got = spark.read.parquet(f"{folder}/out").collect()
    assert {(r.ledger, r.entry): (r.sequence, r.prev_entry_hash, r.entry_hash) for r in got} == chains_by_hand(batches)[0]
