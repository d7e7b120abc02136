"""Rate windows and login lockout. The streaming forms take a streaming DataFrame; the batch forms replay a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_FAILURES, LOCK_MINUTES = 5, 15


def micros(ts: str) -> Column:
    """Microseconds since 1970, of either timestamp type."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts).cast("timestamp_ntz"))


def rate_windows(events: DataFrame, limit: int, key: str = "user_id", ts: str = "ts", width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Keys over the limit in tumbling windows. The same plan serves both; a stream drops windows older than lateness."""
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    counted = rows.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")


def failure_runs(events: DataFrame, failed: Column, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Batch islands: each run of failures between two successes, with its length."""
    w = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    return events.withColumn("run", run).where(failed).groupBy(key, "run").agg(F.count(F.lit(1)).alias("failures"), F.min(order[0]).alias("first_failure"))


def _step(failures: int, locked_until: float | None, now: float | None, failed: bool, second: int = 1) -> tuple[int, float | None, str]:
    """State after one attempt, and what becomes of the attempt. second is a second in the unit of the times."""
    if locked_until is not None and now is not None and now < locked_until:
        return failures, locked_until, "locked"
    if not failed:
        return 0, None, "accepted"
    failures += 1
    if failures >= MAX_FAILURES:
        return 0, None if now is None else now + LOCK_MINUTES * 60 * second, "lock"
    return failures, None, "rejected"


def lockout_stream(attempts: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """attempts (user_id long, ts timestamp, failed boolean) as a stream, to (user_id, ts, outcome) with state for each user.

    State is two numbers for a user, and goes when the watermark is a day past the last attempt.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, until = state.get if state.exists else (0, -1.0)
        rows = pd.concat(batches).sort_values("ts")
        outcomes = []
        for ts, failed in zip(rows["ts"], rows["failed"], strict=True):
            failures, locked, what = _step(failures, until if until >= 0 else None, ts.timestamp(), bool(failed))
            until = -1.0 if locked is None else locked
            outcomes.append(what)
        state.update((failures, until))
        latest = max(int(rows["ts"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(latest + 24 * 3600 * 1000)
        yield pd.DataFrame({"user_id": key[0], "ts": rows["ts"].to_numpy(), "outcome": outcomes})

    timed = attempts.withWatermark("ts", lateness)
    return timed.groupBy("user_id").applyInPandasWithState(follow, "user_id long, ts timestamp, outcome string", "failures int, until double", "append", GroupStateTimeout.EventTimeTimeout)


def lockout(attempts: DataFrame) -> DataFrame:
    """The batch form: (user_id, event_id, outcome), each user's attempts in order of ts, then event_id.

    One user's attempts pass through one task in order, which keeps the state of the lock alone.
    """
    rows = attempts.select("user_id", micros("ts").alias("t"), "event_id", "failed")
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id", "failed")
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, failures, until = object(), 0, None
        for batch in batches:
            out = []
            for user, t, failed in zip(*(batch.column(c).to_pylist() for c in ("user_id", "t", "failed")), strict=True):
                if user != now:
                    now, failures, until = user, 0, None
                # without a time no lock holds and none begins; a null counts as failed
                failures, until, what = _step(failures, until, t, failed is None or failed, 1_000_000)
                out.append(what)
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("event_id"), pa.array(out, pa.string())], ["user_id", "event_id", "outcome"])

    return dealt.mapInArrow(follow, f"user_id {types['user_id']}, event_id {types['event_id']}, outcome STRING")
