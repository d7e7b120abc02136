"""Stages, sinks, cases and page replies."""

import pytest
from pyspark.sql import functions as F

from lakescreen.operators import cases, dataflow, fields, search
from lakescreen.sources import readers, sinks
from lakescreen.functions import mrz, text


def test_stages_skip_isolate_and_publish(spark):
    df = spark.createDataFrame([(1, "a.png"), (2, None), (3, "bad.png")], "id int, original_path string")
    broken = lambda ctx: {"preprocessed_image_path": ctx("original_path"), "error": F.when(ctx("original_path") == "bad.png", "ValueError: bad")}
    chain = dataflow.stages({"preprocessing": broken, "ocr": lambda ctx: {"ocr_fields": F.lit("f"), "confidence": F.lit(-3)}})
    out = {r.id: {s.stage: s for s in r.stage_results} for r in dataflow.run(df, chain).collect()}
    assert [out[1][s].status for s in out[1]] == ["ok", "ok", "not_implemented", "not_implemented", "not_implemented", "not_implemented"] and out[1]["ocr"].confidence == 0.0
    assert out[2]["ocr"].status == "skipped" and out[2]["ocr"].missing_inputs == ["preprocessed_image_path"] and out[2]["risk_assessment"].status == "not_implemented"
    assert out[3]["preprocess"].error == "ValueError: bad" and out[3]["ocr"].status == "skipped" and out[3]["ocr"].human_review_required
    stopped = {r.id: len(r.stage_results) for r in dataflow.run(df, chain, fail_fast=True).collect()}
    assert stopped == {1: 6, 2: 6, 3: 1}
    done = {r.id: r for r in dataflow.assembled(dataflow.run(df, chain), "id").collect()}
    assert (done[3].final_status, done[3].failed, done[2].final_status) == ("completed_with_errors", "preprocess", "completed_with_skips")


def test_providers_and_models_are_registered(spark):
    with pytest.raises(ValueError):
        dataflow.register_provider("teleport", "x", lambda ctx: {})
    dataflow.register_provider("face", "always", lambda ctx: {"face_verification": F.lit("MATCH")})
    try:
        assert "face_verification" in dataflow.provider("face")(None) and "implemented" in dataflow.provider("face", "other")(None)
    finally:
        dataflow._PROVIDERS.clear()
    assert spark.range(1).select(dataflow.model("tampering")(F.lit(1)).alias("s")).first().s is None
    dataflow.register_model("embedding", "two", lambda c: c * 2)
    try:
        assert spark.range(1).select(dataflow.model("embedding", "two")(F.lit(4)).alias("s")).first().s == 8
    finally:
        dataflow._MODELS.clear()


def test_screening_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.png"), (2, None)], "id int, original_path string")
    for _ in range(2):
        done = dataflow.screen(df, dataflow.stages(), f"{tmp_path}/results", f"{tmp_path}/events", "id")
    assert done.count() == 2 and spark.read.parquet(f"{tmp_path}/events").count() == 2


def test_sinks_append_once_and_replace(spark, tmp_path):
    rows = spark.createDataFrame([("a", "{}", True), ("b", "{}", False)], "run_id string, report string, secret boolean")
    key = F.lit("0123456789abcdef")
    for _ in range(2):
        sinks.screenings(rows, f"{tmp_path}/s", readers.sealed(F.col("report"), F.col("secret"), key))
        sinks.completed(rows.select("run_id", F.lit("ok").alias("final_status"), F.current_timestamp().alias("created_at")), f"{tmp_path}/e")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 2 and spark.read.parquet(f"{tmp_path}/e").count() == 2
    assert [r.p for r in back.orderBy("run_id").select(readers.opened(F.col("report"), F.col("secret"), key).alias("p")).collect()] == ["{}", "{}"]
    assert back.where("secret AND report = '{}'").count() == 0
    assert back.where("secret").select(readers.opened(F.col("report"), F.col("secret"), F.lit("another key here")).alias("p")).first().p is None
    new = sinks.replaced(back.where("run_id = 'a'").withColumn("status", F.lit("reviewed")), f"{tmp_path}/s", f"{tmp_path}/s2", ["run_id"])
    assert sorted((r.run_id, r.status) for r in new.collect()) == [("a", "reviewed"), ("b", "processing")]


def test_metadata_of_every_kind(spark):
    kind = "struct<format:string,has_exif:boolean,has_xmp:boolean,tags:map<string,string>,text_chunks:map<string,string>,quant_tables:array<int>>"
    rows = [
        (("jpg", False, False, {}, None, [0]),),
        (("png", False, True, {}, {"Comment": "made with GIMP"}, None),),
        (("jpg", True, True, {"Software": "weird", "DateTime": "x"}, None, [0, 2]),),
        (("png", None, None, None, None, None),),
    ]
    df = spark.createDataFrame(rows, f"m {kind}").coalesce(1)
    out = [(sorted((i.severity, i.confidence) for i in r.i), r.p) for r in df.select(cases.metadata_indicators(F.col("m")).alias("i"), "m").select("i", cases.metadata_points(F.col("i"), F.col("m.has_xmp"), F.col("m.has_exif")).alias("p")).collect()]
    assert out == [([("low", 0.45)], 5.0), ([("medium", 0.7)], 14.0), ([("info", 0.2), ("info", 0.25), ("info", 0.3), ("low", 0.4)], 5.0), ([], 0.0)]


def test_detail_and_lookup(spark):
    report = '{"final_status":"completed","processing_time_ms":12,"stages":[{"stage":"ocr","status":"ok","confidence":0.5,"duration_ms":3},{"stage":"risk","status":"ok","human_review_required":true}]}'
    df = spark.createDataFrame([("r1", report), ("r2", "not json")], "run_id string, report string")
    for c in ("created_at", "status", "doc_type_hint", "doc_type_detected", "file_sha256", "human_review_required"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    a, b = search.detail(df).orderBy("run_id").collect()
    assert a.final_status == "completed" and [(s.stage, s.human_review_required, s.duration_ms) for s in a.stages] == [("ocr", False, 3), ("risk", True, None)]
    assert b.final_status is None and b.stages == []
    assert search.by_run_id(df, "r1").count() == 1 and search.by_run_id(df, "r9").count() == 0
    assert search.applied(search.Filters(risk_band="high"), "newest") == {"risk_band": "high", "sort": "newest"}
    search.checked(risk_band="HIGH", sort=None)
    with pytest.raises(ValueError):
        search.checked(sort="sideways")


def test_visa_fields_and_cards(spark):
    day = F.lit("2024-01-01").cast("date")
    top, bottom = "V<UTOERIKSSON<<ANNA".ljust(36, "<"), "L8988901C4UTO6908061F9406236M30<<<<<"
    none = F.array().cast("array<struct<text:string,confidence:double,line:int>>")
    one = spark.range(1).select(mrz.parse_mrv_b(F.lit(top), F.lit(bottom), day).alias("z"))
    got = {r.name: r for r in one.select(F.inline(fields.visa_fields(F.col("z"), F.lit(top), F.lit(bottom), none, F.array(F.lit("Visa type: tourist b2"))))).collect()}
    assert got["visa_type"].value == "TOURIST B2" and got["full_name"].value == "ERIKSSON ANNA" and got["visa_number"].value == "L8988901C" and got["visa_number"].check_digit_ok
    a, b, c = "I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA".ljust(30, "<")
    td1 = spark.range(1).select(F.inline(F.array(mrz.parse_td1(F.lit(a), F.lit(b), F.lit(c), day)))).first()
    assert (td1.number, td1.number_ok, td1.date_of_birth, td1.sex, td1.expiry_date, td1.surname, td1.given_names) == ("D23145890", True, "1974-08-12", "F", "2012-04-15", "ERIKSSON", "ANNA MARIA")
    top, bottom = mrz.repair_classes(F.lit("P<UT0ERIKSSON".ljust(44, "<")), F.lit("L898902C36UTO74O8l22F12O4159".ljust(44, "<")))
    row = spark.range(1).select(top.alias("t"), bottom.alias("b")).first()
    assert row.t.startswith("P<UTOERIKSSON") and row.b.startswith("L898902C36UTO7408122F1204159") and len(row.b) == 44


def test_text_in_compatibility_forms(spark):
    row = spark.createDataFrame([("ﬁ＠Ａ №",)], "t string").select(text.nfkc(F.col("t")).alias("n"), text.has_token(F.lit("GIMP 2"), ["gimp"]).alias("h")).first()
    assert row.n == "fi@A No" and row.h
