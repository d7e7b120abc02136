"""Operators on small fixtures."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from lakescreen.functions import mrz, text, vectors
from lakescreen.operators import audit, fusion, risk, validation
from lakescreen.plans import catalogue
from lakescreen.sources import readers
from lakescreen.streaming import controls

TOP = "P<UTOSMITH<<ALICE<JANE<<<<<<<<<<<<<<<<<<<<<<"
BOTTOM = "L898902C36UTO7408122F2804154Z184226B<<<<<<70"


@pytest.mark.parametrize("payload, digit", [("L898902C3", 6), ("AB9876543", 5), ("740812", 2), ("280415", 4), ("Z184226B<<<<<<", 7), ("<<<", 0), ("520727", 3)])
def test_check_digit(spark, payload, digit):
    assert spark.range(1).select(mrz.check_digit(F.lit(payload))).first()[0] == digit


def test_passport_zone(spark):
    as_of = F.lit("2025-01-01").cast("date")
    m = spark.range(1).select(mrz.parse_td3(F.lit(TOP), F.lit(BOTTOM), as_of).alias("m")).first().m
    assert (m.surname, m.given_names, m.number, m.nationality, m.sex) == ("SMITH", "ALICE JANE", "L898902C3", "UTO", "F")
    assert (m.date_of_birth, m.expiry_date) == ("1974-08-12", "2028-04-15")
    assert m.number_ok and m.birth_ok and m.expiry_ok


def test_repair(spark):
    for read, digit, want in (("L8989O2C3", "6", "L898902C3"), ("L898902C3", "6", "L898902C3"), ("LLLL", "9", "LLLL")):
        assert spark.range(1).select(mrz.repair(F.lit(read), F.lit(digit))).first()[0] == want


def test_fusion_points(spark):
    rows = [("a", "ela_inconsistency", "medium", 0.5), ("b", "ela_inconsistency", "high", 0.8), ("b", "noise_inconsistency", "medium", 0.7), ("b", "copy_paste_inconsistency", "high", 0.85), ("c", "metadata_anomaly", "info", 0.9), ("d", "metadata_anomaly", "low", 0.45)]
    out = {r.id: r for r in fusion.fuse(spark.createDataFrame(rows, "id string, type string, severity string, confidence double"), "id").collect()}
    assert (out["a"].risk, out["a"].verdict) == (37.9, "suspicious")
    assert (out["b"].risk, out["b"].verdict) == (72.0, "likely_manipulated")
    assert (out["c"].risk, out["c"].verdict) == (4.0, "no_obvious_manipulation")
    assert (out["d"].risk, out["d"].verdict) == (23.0, "suspicious")


def test_no_match_is_high(spark):
    parts = [*risk.face(F.lit("NO_MATCH"), F.lit(0.9)), *risk.impostor(F.lit("NO_MATCH"), F.lit(0), F.lit("no_obvious_manipulation"))]
    row = spark.range(1).select(risk.score(risk.ledger(parts)).alias("s")).select("s", risk.level(F.col("s")).alias("l")).first()
    assert (row.s, row.l) == (51.0, "HIGH")


def test_validation_rules(spark):
    fields = F.create_map(*[F.lit(x) for x in ("full_name", "A B", "date_of_birth", "12/08/1974", "expiry_date", "2020-01-15", "entries", "multiple", "stay", "500 days")])
    as_of = F.lit("2024-01-01").cast("date")
    rules = [validation.required("full_name", "passport_number"), validation.dates("date_of_birth", "issue"), validation.not_expired("expiry_date"), validation.entries("entries"), validation.stay("stay")]
    values = F.transform_values(fields, lambda k, v: F.struct(v.alias("value"), F.lit(None).cast("boolean").alias("check_digit_ok")))
    none = F.lit(None)
    df = validation.validate(spark.range(1), validation.Ruleset("made", rules), values, none.cast("map<string,string>"), none.cast("string"), none.cast("boolean"), F.lit("made"), as_of)
    got = [c.status for c in df.first().checks]
    assert got == ["PASS", "FAIL", "FAIL", "WARNING", "WARNING", "PASS", "WARNING"]


def _validated(spark, ruleset, values, zone=None, raw=None, composite=None, kind="passport"):
    made = spark.createDataFrame([(1,)], "id int")
    fields = F.create_map(*[x for k, (v, ok) in values.items() for x in (F.lit(k), F.struct(F.lit(v).cast("string").alias("value"), F.lit(ok).cast("boolean").alias("check_digit_ok")))])
    held = F.create_map(*[F.lit(x) for kv in zone.items() for x in kv]) if zone else F.lit(None).cast("map<string,string>")
    out = validation.validate(made, ruleset, fields, held, F.lit(raw).cast("string"), F.lit(composite).cast("boolean"), F.lit(kind), F.lit("2024-01-01").cast("date"))
    row = out.select("checks", validation.summary(F.col("checks")).alias("s")).first()
    return {(c.rule, c.field): c.status for c in row.checks}, row.s


def test_passport_ruleset(spark):
    good = {"full_name": ("A B", None), "passport_number": (" P1234567 ", True), "nationality": ("UTO", None), "date_of_birth": ("1980-01-02", True), "expiry_date": ("2030-01-02", True)}
    zone = {"document_code": "P", "passport_number": "P1234567", "nationality": "UTO", "date_of_birth": "1980-01-02", "expiry_date": "2030-01-02"}
    got, s = _validated(spark, validation.ruleset_for("passport"), good, zone, "raw", True)
    assert len(got) == 21 and set(got.values()) == {"PASS"} and s.is_valid and not s.human_review_required
    got, s = _validated(spark, validation.ruleset_for("passport"), {**good, "expiry_date": ("2020-01-02", False)}, {**zone, "document_code": "V"}, "raw", False)
    assert got[("expiry_validity[expiry_date]", "expiry_date")] == "WARNING" and got[("mrz_doc_code", "mrz")] == "FAIL" and got[("mrz_composite", "mrz")] == "FAIL"
    assert got[("mrz_check_digit[expiry_date]", "expiry_date")] == "FAIL" and got[("mrz_consistency", "expiry_date")] == "FAIL" and not s.is_valid and s.human_review_required
    got, s = _validated(spark, validation.ruleset_for("passport"), good)
    assert [got[(r, "mrz")] for r in ("mrz_presence", "mrz_doc_code", "mrz_composite", "mrz_consistency")] == ["WARNING"] * 4 and s.is_valid and s.human_review_required


def test_rulesets_are_registered_and_broken_rules_warn(spark):
    assert validation.ruleset_for("spacecraft").doc_type == "unknown" and validation.ruleset_for("visa", "UTO").doc_type == "visa"
    got, s = _validated(spark, validation.ruleset_for("permit"), {"expiry_date": ("2030-01-01", None)}, kind="permit")
    assert got[("mrz_presence", "mrz")] == "PASS" and got[("mrz_check_digit[document_number]", "document_number")] == "WARNING" and s.is_valid
    broken = validation.Rule("broken", lambda d: d.value("never prepared") + 1 / 0)
    validation.register_ruleset(validation.Ruleset("passport", [broken, validation.required("full_name")], country="zz"))
    try:
        got, s = _validated(spark, validation.ruleset_for("passport", "ZZ"), {"full_name": ("A", None)})
        assert got == {("broken", "engine"): "WARNING", ("required_fields[full_name]", "full_name"): "PASS"} and s.is_valid
    finally:
        del validation._RULESETS[("ZZ", "passport")]
    assert _validated(spark, None, {"full_name": ("A", None)})[0] == {("engine", "ruleset"): "FAIL"}


def test_hash_chain_links_and_breaks(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c")], "ledger string, at int, body string")
    chain = audit.hash_chain(df, "ledger", ["at"], F.col("body"))
    assert audit.broken_links(chain).count() == 0
    edited = chain.withColumn("entry_hash", F.when((F.col("ledger") == "x") & (F.col("sequence") == 1), "0").otherwise(F.col("entry_hash")))
    assert audit.broken_links(edited).count() == 1


def test_canonical_hash_ignores_key_order(spark):
    row = spark.range(1).select(audit.result_hash(F.lit('{"x":1,"z":{"b":2,"a":3}}')).alias("p"), audit.result_hash(F.lit('{"z":{"a":3,"b":2},"x":1}')).alias("q")).first()
    assert row.p == row.q


def test_ledger_refuses_personal_fields(spark):
    with pytest.raises(ValueError):
        audit.record(spark.createDataFrame([("a", "b")], "run_id string, full_name string"))


def test_uploads(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0data")
    (tmp_path / "b.png").write_bytes(b"GIF89a")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    files = readers.uploads(spark, str(tmp_path)).withColumn("why", readers.rejected(F.regexp_extract("path", r"\.(\w+)$", 1), F.col("length"), F.col("kind")))
    assert {r.path[-5:]: (r.kind, r.why) for r in files.select("path", "kind", "why").collect()} == {"a.jpg": ("jpeg", None), "b.png": (None, "content"), "c.pdf": ("pdf", None)}


def test_report_that_cannot_be_read(spark):
    df = spark.createDataFrame([('{"final_status":"error"}',), ("{broken",), (None,)], "j string").select(readers.report(F.col("j")).alias("r"))
    assert [r[0] for r in df.select(F.try_variant_get("r", "$.final_status", "string")).collect()] == ["error", None, None]


def test_zero_vector(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row.c == 0.0


def test_text_functions(spark):
    row = spark.range(1).select(text.rightmost_hop(F.lit("1.1.1.1, 2.2.2.2, ,")).alias("hop"), text.date_tokens(F.lit("on 3/4/2021 and 2020-01-02")).alias("dates"), text.strip(F.lit("\t a \n")).alias("s"), text.redact_digits(F.lit("no 1234567 ok 12345")).alias("r")).first()
    assert (row.hop, row.dates, row.s, row.r) == ("2.2.2.2", ["2021-04-03", "2020-01-02"], "a", "no ###### ok 12345")


def test_folds_keep_no_group(spark):
    """Long groups over several Arrow batches, by hand; no plan gathers a group into an array."""
    rows = [(g, k, f"{g}-{k}") for g in range(3) for k in range(700)]
    df = spark.createDataFrame(rows, "ledger long, at long, body string").repartition(5)
    attempts = df.select(F.col("ledger").alias("user_id"), F.timestamp_seconds(F.col("at") * 60).alias("ts"), F.col("at").alias("event_id"), (F.col("at") % 9 != 0).alias("failed"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        frames = audit.hash_chain(df, "ledger", ["at"], F.col("body")), controls.lockout(attempts)
        assert not any("collect_list" in f._jdf.queryExecution().toString() for f in frames)
        chain, locks = (f.collect() for f in frames)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, outcomes = {}, {}
    for g in range(3):
        last, failures, until = "0" * 64, 0, -1
        for k in range(700):
            before, last = last, hashlib.sha256(f"{g}-{k}{last}".encode()).hexdigest()
            want[g, k] = (k + 1, before, last)
            if k * 60 < until:
                what = "locked"
            elif k % 9 == 0:
                what, failures = "accepted", 0
            else:
                failures += 1
                what = "lock" if failures == 5 else "rejected"
                if what == "lock":
                    failures, until = 0, k * 60 + 900
            outcomes[g, k] = what
    assert {(r.ledger, r["at"]): (r.sequence, r.prev_entry_hash, r.entry_hash) for r in chain} == want
    assert {(r.user_id, r.event_id): r.outcome for r in locks} == outcomes


def test_whole_ledger_query_has_every_screening(spark):
    folder = "/root/testdata/sf0.001"
    assert catalogue.queries()["ledger_hash_chain_whole"](spark, folder).count() == spark.read.parquet(f"{folder}/orders.parquet").count()


def test_lockout_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, i, start + datetime.timedelta(minutes=3 * i + u), (i + u) % 4 != 0) for u in range(3) for i in range(24)]
    rows += [(9, 100 + i, start + datetime.timedelta(seconds=i), True) for i in range(8)]
    table = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, failed boolean")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = controls.lockout_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")).select("user_id", "ts", "failed"))
    query = stream.writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.user_id, r.ts, r.outcome) for r in spark.table("outcomes").collect())
    batch = controls.lockout(table).join(table.select("user_id", "event_id", "ts"), ["user_id", "event_id"])
    assert got == sorted((r.user_id, r.ts, r.outcome) for r in batch.collect())
    assert [g[2] for g in got if g[0] == 9] == ["rejected"] * 4 + ["lock"] + ["locked"] * 3


def test_rate_windows_on_a_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, start + datetime.timedelta(seconds=5 * i)) for i in range(30)], "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = controls.rate_windows(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")), 10)
    query = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("rates").collect()) == [12, 12]


def test_medians_are_exact(spark):
    rows = [("a", float(v)) for v in (5, 1, 3, 3, 9, 2)] + [("b", 7.0)] * 40 + [("b", 1e9), ("b", -1e9)] + [("c", float(v * v)) for v in range(501)] + [("d", None), (None, 1.0), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in fusion.medians(df, "g", "v", bins=8).collect()}
    assert got == {"a": 3.0, "b": 7.0, "c": 62500.0}
    assert fusion.medians(df.limit(0), "g", "v").count() == 0
    far = fusion.robust_outliers(df, "g", "v").collect()
    assert sorted(r.v for r in far if r.g == "b") == [-1e9, 1e9]
    assert all(r.g is not None and r.v == r.v for r in far)


@pytest.mark.parametrize("tile_rows", [7, 4096])
def test_similar_blocks_equal_brute_force(spark, tile_rows):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.normal(size=(60, 6)).astype(np.float32)
    v[40:] = v[:20] + r.normal(size=(20, 6)) * 0.01
    v[30:36], v[3] = v[30], 0
    unit = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    alike = np.round(unit @ unit.T, 4)
    want = set()
    for a in range(60):
        for rank, b in enumerate(sorted((b for b in range(60) if b != a), key=lambda b: (-alike[a, b], b))[:4], 1):
            if alike[a, b] >= 0.98 and (a % 8 - b % 8) ** 2 + (a // 8 - b // 8) ** 2 >= 4:
                want.add((a, b, rank))
    df = spark.createDataFrame([(i, x.tolist(), i % 8, i // 8) for i, x in enumerate(v)] + [(None, [1.0] * 6, 0, 0), (99, None, 0, 0)], "id long, e array<float>, x long, y long")
    got = {(r.a, r.b, r.rank) for r in fusion.similar_blocks(df, "id", "e", "x", "y", apart=2, tile_rows=tile_rows).collect()}
    assert got == want and len(want) > 30
    assert fusion.similar_blocks(df.limit(0), "id", "e", "x", "y").count() == 0
