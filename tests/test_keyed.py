"""Tables by key, lookups, added columns, and the ledger as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from lakescreen.operators import audit
from lakescreen.sources import keyed, ledger_source


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def as_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_a_change_leaves_other_partitions_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert keyed.current(spark, folder) is None
    base = spark.createDataFrame([(i, f"v{i}", "pending") for i in range(500)], "id long, value string, state string")
    assert keyed.upsert(base, folder, ["id"], parts=16) == 16
    before = files(folder)
    change = spark.createDataFrame([(3, "new", "anchored"), (1000, "more", "pending"), (None, "none", "pending")], "id long, value string, state string")
    written = keyed.upsert(change, folder, ["id"], parts=99)  # the number of partitions stays
    after = files(folder)
    assert 1 <= written <= 3 and {f: t for f, t in after.items() if f in before} == before
    want = {i: (f"v{i}", "pending") for i in range(500)} | {3: ("new", "anchored"), 1000: ("more", "pending"), None: ("none", "pending")}
    assert {r.id: (r.value, r.state) for r in keyed.current(spark, folder).collect()} == want
    # what is anchored stays as it is
    keyed.upsert(spark.createDataFrame([(3, "late", "pending"), (4, "x", "anchored"), (None, "again", "pending")], base.schema), folder, ["id"], unless=F.col("state") == "anchored")
    want |= {4: ("x", "anchored"), None: ("again", "pending")}
    assert {r.id: (r.value, r.state) for r in keyed.current(spark, folder).collect()} == want
    assert keyed.upsert(base.where("false"), folder, ["id"]) == 0 and keyed.current(spark, folder).count() == 502


def test_an_unfinished_change_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "t")
    base = spark.createDataFrame([(i, "a") for i in range(20)], "id long, value string")
    keyed.upsert(base, folder, ["id"], parts=4)
    bad = base.withColumn("value", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise("b"))
    with pytest.raises(Exception, match="lost"):
        keyed.upsert(bad, folder, ["id"])
    assert {r.value for r in keyed.current(spark, folder).collect()} == {"a"}
    keyed.upsert(base.withColumn("value", F.lit("c")), folder, ["id"])
    assert {r.value for r in keyed.current(spark, folder).collect()} == {"c"}


def test_columns_that_are_added_later(spark, tmp_path):
    folder = str(tmp_path / "t")
    keyed.upsert(spark.createDataFrame([(i, "a") for i in range(40)], "id long, value string"), folder, ["id"], parts=8)
    keyed.upsert(spark.createDataFrame([(1, 2.5)], "id long, score double"), folder, ["id"])
    got = {r.id: (r.value, r.score) for r in keyed.current(spark, folder).collect()}
    assert got == {i: ("a", None) for i in range(40)} | {1: (None, 2.5)}
    told = keyed.columns(keyed.current(spark, folder)).collect()
    assert {(r.name, r.type) for r in told} == {("id", "bigint"), ("value", "string"), ("score", "double")}
    df, names = keyed.added(keyed.current(spark, folder), "ID long, pages int, note string")
    assert names == ["pages", "note"] and dict(df.dtypes)["pages"] == "int" and df.where("pages IS NULL").count() == 40
    with pytest.raises(ValueError, match="another type"):
        keyed.added(df, "pages string")


def scanned(df):
    """Rows that left the scan, from its metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())

    walk(plan)
    return sum(found)


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("run_id"), "id")
    folder = str(tmp_path / "t")
    keyed.for_lookups(df, folder, "run_id", files=4, rows_a_group=500, distinct=500)
    some = df.where("id = 77").first().run_id
    hit = keyed.lookup(spark, folder, "run_id", some)
    assert [r.id for r in hit.collect()] == [77] and scanned(hit) <= 500
    # inside a group's range, but not in its filter
    assert scanned(keyed.lookup(spark, folder, "run_id", some[:-1] + ("0" if some[-1] != "0" else "1"))) == 0


COLUMNS = ["screening_id", "result_hash"]


def entries_of(spark, n, start=0):
    return spark.createDataFrame([(f"l{i % 2}", i, f"s{i:03}", f"h{i}") for i in range(start, start + n)], "ledger string, pos long, screening_id string, result_hash string")


def test_ledger_reads_appends_and_verifies(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger_source.entries(spark, path).count() == 0
    first = entries_of(spark, 20)
    ledger_source.append(first, path, "ledger", ["pos"], COLUMNS)
    more = entries_of(spark, 20, 10).union(spark.createDataFrame([("l0", 99, "", "h"), ("l0", 98, None, "h")], first.schema))
    ledger_source.append(more, path, "ledger", ["pos"], COLUMNS)  # half of them told again
    whole = ledger_source.entries(spark, path)
    once = audit.record_chain(entries_of(spark, 30), "ledger", ["pos"], COLUMNS)
    assert as_rows(whole.select("ledger", "screening_id", "sequence", "entry_hash")) == as_rows(once.select("ledger", "screening_id", "sequence", "entry_hash"))
    assert audit.broken_links(whole).count() == 0
    assert {(r.screening_id, r.ledger_status) for r in ledger_source.statuses(more, path).where("pos > 90 OR pos = 12").collect()} == {("", "failed"), (None, "failed"), ("s012", "logged")}
    assert [r.sequence for r in whole.where("screening_id = 's011'").collect()] == [6]
    reader = ledger_source._Reader(path)
    list(reader.pushFilters([ledger_source.EqualTo(("screening_id",), "s029")]))
    assert len(reader.partitions()) < len(ledger_source._Reader(path).partitions())


def test_an_aborted_append_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger_source.append(entries_of(spark, 10), path, "ledger", ["pos"], COLUMNS)
    bad = ledger_source.entries(spark, path).withColumn("sequence", F.when(F.col("screening_id") == "s007", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("sequence")))
    with pytest.raises(Exception, match="lost"):
        bad.repartition(4, "screening_id").write.format("ledger").mode("append").save(path)
    assert ledger_source.entries(spark, path).count() == 10
    assert len(os.listdir(f"{path}/entries")) == sum(1 for _ in ledger_source._committed(path))
    with pytest.raises(Exception, match="never overwritten"):
        ledger_source.entries(spark, path).write.format("ledger").mode("overwrite").save(path)
    with pytest.raises(Exception, match="not for the ledger"):
        ledger_source.entries(spark, path).withColumn("surname", F.lit("x")).write.format("ledger").mode("append").save(path)
