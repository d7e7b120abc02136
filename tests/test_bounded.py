"""What a writer, a state and a join hold or ask for at once."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet

from lakescreen.sources import ledger_source
from lakescreen.streaming import ledgers


def test_a_writer_sends_its_entries_as_they_come(tmp_path):
    def batches(parts=5, size=1 << 15):
        for p in range(parts):
            keys = [f"{(p * 7 + 3) % parts}-{i:06d}" for i in range(size)]
            yield pa.RecordBatch.from_arrays([pa.array(["l"] * size), pa.array(range(size), pa.int64()), pa.array(keys), *[pa.array(["x"] * size)] * 3], ledger_source._ARROW.names)

    told = ledger_source._Writer(str(tmp_path)).write(batches())
    file = pa.parquet.ParquetFile(tmp_path / "entries" / told.file)
    assert (told.entries, told.low, told.high) == (5 << 15, "0-000000", "4-032767")
    assert file.metadata.num_rows == 5 << 15 and file.metadata.num_row_groups == 3
    assert ledger_source._Writer(str(tmp_path)).write(iter([])).file is None


class _State:
    """A state that counts what it is asked."""

    def __init__(self):
        self.value, self.map, self.asked = None, {}, 0

    getValueState = getMapState = lambda self, *a: self  # noqa: E731, N815

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.map

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value


def test_a_new_ledger_is_not_asked_for_each_entry():
    chain, state = ledgers._Chain(), _State()
    chain.init(state)
    rows = pd.DataFrame({"position": ["2", "1", "1", None], "entry": ["b", "a", "a", ""], "before": ["x"] * 4, "after": [""] * 4})
    first = pd.concat(chain.handleInputRows(("l",), iter([rows]), None))
    assert first["entry"].tolist() == ["a", "b", ""] and first["sequence"].tolist()[:2] == [1, 2] and state.asked == 0
    assert not list(chain.handleInputRows(("l",), iter([rows[:3]]), None)) and state.asked == 3


def test_anchors_are_not_dealt_by_batch(spark, tmp_path):
    anchor = ledgers.anchor_batch(str(tmp_path / "rows"), ["part"])
    anchor(spark.range(50).withColumnRenamed("id", "part"), 0)
    anchor(spark.range(80).withColumnRenamed("id", "part"), 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ledgers.anchors(spark, str(tmp_path / "rows"))
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.batch, r.anchor_count) for r in got.select("batch", "anchor_count").distinct().collect()) == [(0, 50), (1, 80)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
