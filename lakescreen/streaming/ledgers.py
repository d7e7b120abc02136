"""State that outlives a batch: ledgers' chains, refused tokens, anchors. All take streaming DataFrames.

The state of ``chained`` and ``token_checks`` is kept by key in RocksDB (set spark.sql.streaming.stateStore.providerClass to ``ROCKSDB``), in
the query's checkpoint; a query that is stopped anywhere goes on from there.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Generator, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import GENESIS
from ..sources.shared import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None):
    """Streams that are started inside keep their state in RocksDB, in that many partitions if given."""
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def drained(stream: DataStreamWriter, spark: SparkSession) -> DataFrame:
    """All rows that an append stream gives for what its source holds now, by way of a table in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def _last(value: str | None) -> tuple[bool, str]:
    """A key of order that puts null last."""
    return (value is None, value or "")


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str], by: Callable[[tuple], tuple]) -> list[tuple]:
    """The rows of one key as tuples in order; most keys have a few rows, for which sorting a frame costs many times more."""
    return sorted((r for part in rows for r in zip(*(part[c].tolist() for c in columns), strict=True)), key=by)


class _Chain(StatefulProcessor):
    """A ledger's tail (sequence and last hash) as value state, and the hash of each entry that it holds as map state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "sequence long, last string")
        self.held = handle.getMapState("held", "entry string", "hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sequence, last = self.tail.get() if self.tail.exists() else (0, GENESIS)
        known = sequence > 0  # a ledger without entries needs no question for each row, which is a call to the state's process
        out, new = [], set()
        for _, entry, before, after in _in_order(rows, ["position", "entry", "before", "after"], lambda r: (_last(r[0]), _last(r[1]))):
            if entry is None or entry == "":
                out.append((key[0], entry, None, None, None, "failed"))
            elif entry in new or known and self.held.containsKey((entry,)):
                continue  # told again
            else:
                sequence, previous = sequence + 1, last
                last = hashlib.sha256((before + previous + after).encode()).hexdigest()
                self.held.updateValue((entry,), (last,))
                new.add(entry)
                out.append((key[0], entry, sequence, previous, last, "logged"))
        self.tail.update((int(sequence), last))
        columns = dict(zip(["ledger", "entry", "sequence", "prev_entry_hash", "entry_hash", "ledger_status"], zip(*out, strict=True), strict=True)) if out else {}
        if columns:
            yield pd.DataFrame(columns | {"sequence": pd.array(columns["sequence"], "Int64")})

    def close(self) -> None:
        pass


# Fixed values, as checkpoints hold state laid out by them: ledgers are dealt into classes, and those of a class into bins; a ledger's first entries are kept
# with its tail, later ones in pages.
CLASSES, BINS, FIRST, PAGES = 4096, 64, 256, 1024


def _part(name: str | None, parts: int) -> int:
    return zlib.crc32((name or "").encode()) % parts


class _Chains(StatefulProcessor):
    """Map states of a class of ledgers: by bin, the tails of its ledgers (name, sequence, last hash and the names of the first entries); by ledger and page, the
    names of later entries. A call to the state's process costs as much as many entries, so what is small is read and written together, as JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = handle.getMapState("bins", "bin int", "tails string")
        self.pages = handle.getMapState("pages", "ledger string, page int", "entries string")

    def _follow(self, ledger: str | None, told: list[tuple], tails: dict) -> Generator[tuple, None, bool]:
        """The output's rows of one ledger, whose tail and pages are brought up to date; whether it grew."""
        held, last, entries = tails.get(ledger, (0, GENESIS, []))
        sequence, paged = held, held > len(entries)
        first, pages, changed = set(entries), {}, set()
        for _, entry, before, after in sorted(told, key=lambda r: (r[0] is None, r[0], r[1] is None, r[1])):
            if entry is None or entry == "":
                yield ledger, entry, None, None, None, "failed"
                continue
            if entry in first:
                continue  # told again
            if len(entries) < FIRST:
                entries.append(entry)
                first.add(entry)
            else:
                page = _part(entry, PAGES)
                if page not in pages:
                    stored = self.pages.getValue((ledger, page)) if paged else None
                    pages[page] = dict.fromkeys(json.loads(stored[0])) if stored else {}
                if entry in pages[page]:
                    continue  # told again
                pages[page][entry] = None
                changed.add(page)
            sequence, previous = sequence + 1, last
            last = hashlib.sha256((before + previous + after).encode()).hexdigest()
            yield ledger, entry, sequence, previous, last, "logged"
        for page in changed:
            self.pages.updateValue((ledger, page), (json.dumps(list(pages[page])),))
        if sequence > held:
            tails[ledger] = sequence, last, entries
        return sequence > held

    def _bins(self, dealt: dict[int, dict]) -> Iterator[tuple]:
        begun = self.bins.exists()  # a class without ledgers needs no question for each bin
        for name, ledgers in dealt.items():
            stored = self.bins.getValue((name,)) if begun else None
            tails = {ledger: tail for ledger, *tail in json.loads(stored[0])} if stored else {}
            grew = False
            for ledger, told in ledgers.items():
                grew |= yield from self._follow(ledger, told, tails)
            if grew:
                self.bins.updateValue((name,), (json.dumps([(ledger, *tail) for ledger, tail in tails.items()]),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledgers: dict[str | None, list[tuple]] = {}
        for part in rows:
            for ledger, *row in zip(*(part[c].tolist() for c in ("ledger", "position", "entry", "before", "after")), strict=True):
                ledgers.setdefault(ledger, []).append(row)
        dealt: dict[int, dict] = {}
        for ledger, told in ledgers.items():
            dealt.setdefault(_part(ledger, BINS), {})[ledger] = told
        done = self._bins(dealt)
        while out := list(itertools.islice(done, 20_000)):
            columns = dict(zip(["ledger", "entry", "sequence", "prev_entry_hash", "entry_hash", "ledger_status"], zip(*out, strict=True), strict=True))
            yield pd.DataFrame(columns | {"sequence": pd.array(columns["sequence"], "Int64")})

    def close(self) -> None:
        pass


def chained(rows: DataFrame, each: bool = False) -> DataFrame:
    """rows (ledger, position, entry, before, after) to (ledger, entry, sequence, prev_entry_hash, entry_hash, ledger_status).

    An entry's hash is that of before + the previous hash + after. Inside a batch entries go by position and entry; batches go in the order of
    the source. An entry without a name is failed and takes no place; an entry that the ledger holds is not chained again.

    State is kept for classes of ledgers, as a call of Python for each ledger costs far more than its few entries; a task holds one class's rows of a batch.
    With ``each`` every ledger has a state of its own, as in checkpoints that were begun so, which nothing else goes on from; that is much slower.
    """
    slim = rows.select(F.col("ledger").cast("string").alias("ledger"), F.col("position").cast("string").alias("position"), F.col("entry").cast("string").alias("entry"), "before", "after")
    schema = "ledger string, entry string, sequence long, prev_entry_hash string, entry_hash string, ledger_status string"
    dealt = slim if each else slim.withColumn("class", F.pmod(F.xxhash64("ledger"), F.lit(CLASSES)).cast("int"))
    return dealt.groupBy("ledger" if each else "class").transformWithStateInPandas(statefulProcessor=_Chain() if each else _Chains(), outputStructType=schema, outputMode="Append", timeMode="None")


class _Tokens(StatefulProcessor):
    """When a refused token expires, as value state that a timer clears."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = until = int(self.until.get()[0]) if self.until.exists() else -1
        requests, refused = [], []
        for ms, revokes, expires, request in _in_order(rows, ["ms", "revokes", "expires", "request"], lambda r: (r[0], not r[1], r[3])):
            if revokes:
                until = max(until, int(expires))
            else:
                requests.append(request)
                refused.append(ms < until)
        if until > had:
            if had >= 0:
                self.handle.deleteTimer(had)
            self.until.update((until,))
            self.handle.registerTimer(until)
        if requests:
            yield pd.DataFrame({"token": [key[0]] * len(requests), "request": requests, "refused": refused})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def token_checks(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """events (token, ts, revokes boolean, expires timestamp, request long) to (token, request, refused): whether a request came after its token was refused
    and before that expired. Inside a batch rows go by time, refusals first.

    State is one number for each refused token, which goes when the watermark passes its expiry; rows later than ``lateness`` are dropped. Rows
    without a token, a time or, if they refuse, an expiry, do nothing.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    timed = events.where(F.col("token").isNotNull() & F.col("ts").isNotNull() & (~F.col("revokes") | F.col("expires").isNotNull())).withWatermark("ts", lateness)
    slim = timed.select(F.col("token").cast("string").alias("token"), "ts", ms("ts").alias("ms"), "revokes", ms("expires").alias("expires"), F.col("request").cast("long").alias("request"))
    slim = slim.withColumns({"expires": F.coalesce("expires", F.lit(-1).cast("long")), "request": F.coalesce("request", F.lit(-1).cast("long"))})
    return slim.groupBy("token").transformWithStateInPandas(statefulProcessor=_Tokens(), outputStructType="token string, request long, refused boolean", outputMode="Append", timeMode="EventTime")


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """What is anchored: the rows of folder with the batch that brought them and anchor_count, the running total by batch. Nothing while there is none."""
    from ..sources.sinks import stored

    held = stored(spark, folder)
    if held is None:
        return spark.createDataFrame([], "batch long, anchor_count long")
    totals = held.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).alias("t")
    # one row a batch: few enough to be added up in order
    counted = totals.join(totals.select(F.col("batch").alias("upto"), F.col("n").alias("m")), F.col("upto") <= F.col("batch")).groupBy("batch").agg(F.sum("m").alias("anchor_count"))
    # sent to all tasks: a join by batch would deal each batch to one task
    return held.join(F.broadcast(counted), "batch")


def anchor_batch(folder: str, keys: list[str]):
    """A function of (batch, batch id) for foreachBatch: anchors rows whose keys no other batch has, each once.

    A batch is a partition of the folder under its id and is written by overwriting just that, so a batch that is told again after it failed
    anywhere, even between its write and the stream's commit, leaves the same rows once.
    """

    def anchor(batch: DataFrame, batch_id: int) -> None:
        from ..sources.sinks import stored

        held = stored(batch.sparkSession, folder)
        rows = batch.dropDuplicates(keys)
        if held is not None:
            rows = rows.join(held.where(F.col("batch") != batch_id).select(*keys), keys, "left_anti")
        rows = rows.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(folder)

    return anchor
