"""Reports, fields and visa zones on small fixtures."""

from pyspark.sql import functions as F

from lakescreen.functions import mrz
from lakescreen.operators import fields, reports
from lakescreen.sources.readers import report

REPORT = '{"final_status":"completed","validation":{"is_valid":false,"confidence":0.8,"checks":[{"field":"name","status":"FAIL","message":"missing","rule":"x"}]},"tampering":{"verdict":"suspicious","indicators":[{"type":"t","severity":"low","confidence":0.5,"note":"%s","details":{}}]},"face_verification":{"match_status":"MATCH"}}' % ("n" * 300)


def test_case_view(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "{}"), (3, None), (4, "{bad")], "id long, j string").select("id", report(F.col("j")).alias("report"))
    out = {r.id: r for r in reports.case(df).collect()}
    assert out[1].validation == {"is_valid": "false", "confidence": "0.8"}
    assert [(c.field, c.status) for c in out[1].checks] == [("name", "FAIL")] and len(out[1].indicators[0].note) == 200
    assert out[2].validation is None and out[3].checks is None and out[4].indicators is None
    counted = {(r.module, r.outcome): r.n for r in reports.outcomes(df).collect()}
    assert counted == {("validation", "invalid"): 1, ("validation", "unknown"): 3, ("tampering", "suspicious"): 1, ("tampering", "unknown"): 3, ("face", "MATCH"): 1, ("face", "not_performed"): 3}


def test_lines_and_labels(spark):
    words = [("Doe", 60.0, 11.0, 20.0), ("Surname:", 5.0, 10.0, 20.0), ("P a s s", 5.0, 40.0, 50.0), ("port No X12", 50.0, 42.0, 52.0)]
    df = spark.createDataFrame([(words,)], "words array<struct<text:string,left:double,top:double,bottom:double>>").select(fields.text_lines(F.col("words")).alias("lines"))
    row = df.select("lines", fields.labelled(F.col("lines"), "surname").alias("s"), fields.labelled(F.col("lines"), "passport no").alias("n"), fields.labelled(F.col("lines"), "visa").alias("v")).first()
    assert (row.lines, row.s, row.n, row.v) == (["Surname: Doe", "P a s s port No X12"], "Doe", "X12", None)


def test_flags_and_patterns(spark):
    one = spark.range(1)
    as_of = F.lit("2024-01-01").cast("date")
    got = one.select(fields.flags(F.lit("expiry_date"), F.lit("2020-01-15"), F.lit(0.5), F.lit(False), as_of).alias("f")).first().f
    assert got == ["low confidence", "expired", "check digit"]
    rows = [("passport_number", "98O8902C3"), ("document_number", "98O8902C3"), ("full_name", "AL1CE")]
    df = spark.createDataFrame([(rows,), ([("passport_number", "L898902C3")],)], "f array<struct<name:string,value:string>>").select(fields.suspicious(F.col("f")).alias("s"))
    first, second = [r.s for r in df.collect()]
    assert sum(x.points for x in first) == 18 and first[-1].signal == "cap_applied" and second == []


def test_visa_zone(spark):
    top, bottom = "V<UTOSEDERBERG<<KARL<THEO<<<<<<<<<<<", "AB98765435UTO8506151M2912316M903<<<7"
    m = spark.range(1).select(mrz.parse_mrv_b(F.lit(top), F.lit(bottom), F.lit("2025-01-01").cast("date")).alias("m"), mrz.zone_format(F.array(F.lit(top), F.lit(bottom))).alias("z")).first()
    assert m.z == "MRV-B"
    assert (m.m.number, m.m.number_ok, m.m.surname, m.m.entries, m.m.stay, m.m.date_of_birth) == ("AB9876543", True, "SEDERBERG", "multiple", "90 days", "1985-06-15")


def test_confidence_summary(spark):
    df = spark.createDataFrame([([("ocr", 0.12345), ("face", None), ("ocr", 0.5)],)], "s array<struct<stage:string,confidence:double>>")
    assert df.select(reports.confidence_summary(F.col("s")).alias("m")).first().m == {"face": None, "ocr": 0.5}
