"""Verdicts of one row, shortened lists, isolated Python, shapes of a reader's rows, lenient labels."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakescreen.functions import text
from lakescreen.operators import cases, dataflow, fields, fusion, reports, risk, validation

INDICATORS = "array<struct<type:string,severity:string,confidence:double>>"


def tenth(v):
    return float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def by_hand(rows, covered, failures, p):
    rated = [(t, s, c or 0.0, min(34.0, fusion.WEIGHTS.get(t, 10.0) * {"low": 0.35, "medium": 0.7, "high": 1.0}.get(s, 0.0) * (0.5 + 0.5 * (c or 0.0)))) for t, s, c in rows if s != "info"]
    most = max((r[3] for r in rated), default=0.0)
    total = 10 * math.sqrt(sum(tenth(v if v >= most else v * (v / max(most, 1.0))) for *_, v in rated))
    if p is not None:
        total = 0.7 * total + 0.3 * (total + 30 * max(0.0, min(1.0, p)))
    score = min(98.0, 4.0 + total)
    agreeing = sorted({t for t, _, c, _ in rated if c >= 0.55})
    strong = any(s in ("medium", "high") for _, s, *_ in rated)
    verdict = "inconclusive" if len(failures) >= 3 or covered < 0.45 else "likely_manipulated" if round(score, 1) >= 55 or len(agreeing) >= 3 else "suspicious" if round(score, 1) >= 20 or strong else "no_obvious_manipulation"
    sure = {"inconclusive": 0.2, "no_obvious_manipulation": min(0.85, 0.5 + covered * 0.35)}.get(verdict, min(0.95, (0.45 + 0.12 * len(agreeing)) * (0.6 + 0.4 * covered)))
    return score, verdict, sure, agreeing


def test_verdicts_equal_those_by_hand(spark):
    rng = random.Random(3)
    made = []
    for i in range(300):
        rows = [(rng.choice([*fusion.WEIGHTS, "other"]), rng.choice(("info", "low", "medium", "high")), rng.choice((None, 0.1, 0.3, 0.55, 0.8, 1.0))) for _ in range(rng.choice((0, 0, 1, 2, 4)))]
        made.append((i, rows, rng.choice((0.2, 0.44, 0.45, 0.7, 1.0)), ["x"] * rng.choice((0, 0, 1, 3)), rng.choice((None, -1.0, 0.2, 0.9, 3.0))))
    df = spark.createDataFrame(made, f"i int, found {INDICATORS}, covered double, failures array<string>, p double")
    got = {r.i: r.j for r in df.select("i", fusion.judged(F.col("found"), F.col("covered"), F.col("failures"), F.col("p")).alias("j")).collect()}
    seen = set()
    for i, rows, covered, failures, p in made:
        score, verdict, sure, agreeing = by_hand(rows, covered, failures, p)
        j = got[i]
        assert j.risk == pytest.approx(score, abs=0.051) and j.verdict == verdict and j.confidence == pytest.approx(sure, abs=0.0006) and list(j.agreeing) == agreeing, (rows, covered, failures, p)
        assert j.human_review_required == (verdict != "no_obvious_manipulation") and j.tampering_detected == (verdict in ("suspicious", "likely_manipulated"))
        assert len(j.contributions) == sum(s != "info" for _, s, _ in rows)
        seen.add(verdict)
    assert len(seen) == 4


def test_no_indicators_and_unknown_failures(spark):
    j = spark.range(1).select(fusion.judged(F.lit(None).cast(INDICATORS), F.lit(1.0), F.lit(None).cast("array<string>"), F.lit(None).cast("double")).alias("j")).first().j
    assert (j.risk, j.verdict, j.confidence, j.human_review_required, j.contributions) == (4.0, "no_obvious_manipulation", 0.85, False, [])


def test_detectors_become_indicators(spark):
    rows = [(0, (1.9, 5000.0), None), (1, (2.0, 899.0), ("high", 0.8, 0.019)), (2, (2.0, 900.0), ("high", 0.8, 0.02)), (3, (3.5, 900.0), ("high", 0.8, None)), (4, (9.0, 1e6), ("low", 0.4, 0.5)), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, ela struct<contrast:double,area:double>, copies struct<severity:string,confidence:double,agreement:double>")
    got = {r.i: [(x.type[:3], x.severity, x.confidence) for x in r.d] for r in df.select("i", fusion.detected(F.col("ela"), F.col("copies")).alias("d")).collect()}
    assert got == {0: [], 1: [("cop", "medium", 0.8)], 2: [("ela", "medium", 0.3), ("cop", "high", 0.8)], 3: [("ela", "high", 0.42), ("cop", "medium", 0.8)], 4: [("ela", "high", 0.6), ("cop", "low", 0.4)], 5: []}
    covered = spark.sql("SELECT 0.5D AS u, true AS s UNION ALL SELECT null, false UNION ALL SELECT null, true").select(F.round(fusion.coverage(F.col("u"), F.col("s")), 3)).collect()
    assert sorted(r[0] for r in covered) == [0.1, 0.2, 1.0]


def test_lists_are_shortened(spark):
    lit = lambda xs: F.lit(xs) if xs else F.array().cast("array<string>")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(risk.failures_told(lit(list("abcd"[:n])))) for n in (0, 2, 4)] == [None, "validation failed: a; b", "validation failed: a; b (+2 more)"]
    assert [one(risk.missing_told(lit(list("abcdefg"[:n])))) for n in (0, 5, 7)] == [None, "missing: a, b, c, d, e", "missing: a, b, c, d, e (+2 more)"]
    stages = one(risk.stages_told(lit(list("abcdef")), lit(["error", "ok", "skipped", "error", "error", "error"])))
    assert stages == "incomplete: stage 'a' crashed; stage 'c' skipped; stage 'd' crashed; stage 'e' crashed…"
    assert one(risk.drivers_told(lit(list("abcd")))) == "top drivers: a; b; c" and one(risk.drivers_told(lit([]))) == "no adverse signals"


def test_examined_fields_count_once(spark):
    checks = F.expr("array(named_struct('field', 'a'), named_struct('field', 'a'), named_struct('field', 'b'), named_struct('field', 'mrz'), named_struct('field', ''), named_struct('field', cast(null as string)))")
    got = spark.range(1).select(validation.examined_confidence(checks, F.expr("map('a', 0.8D)")), validation.examined_confidence(checks, F.lit(None).cast("map<string,double>")), validation.examined_confidence(F.slice(checks, 4, 3), F.expr("map('a', 0.8D)"))).first()
    assert tuple(got) == (pytest.approx(0.4), 0.0, 0.0)


def test_checkpoints_are_counted(spark):
    checks = F.expr("array(named_struct('ok', true, 'informational', false), named_struct('ok', false, 'informational', false), named_struct('ok', false, 'informational', true))")
    assert tuple(spark.range(1).select(cases.checkpoint_counts(checks).alias("c")).first().c) == (3, 1, 1, 1)


def test_chart_has_every_outcome(spark):
    df = spark.createDataFrame([('{"validation": {"is_valid": true}, "face_verification": {"match_status": "NO_MATCH"}}',), ("{broken",), (None,), ('{"tampering": {"verdict": "odd"}}',)], "t string")
    rows = {(r.module, r.outcome): r.n for r in reports.module_chart(df.select(F.try_parse_json("t").alias("report"))).collect()}
    assert set(rows) == {(m, o) for m, of in reports.MODULE_OUTCOMES.items() for o in of}
    assert {k: n for k, n in rows.items() if n} == {("validation", "valid"): 1, ("validation", "unknown"): 3, ("tampering", "unknown"): 4, ("face", "no_match"): 1, ("face", "not_performed"): 3}


def test_one_raising_row_costs_that_row(spark):
    def inverse(x: pd.Series) -> pd.Series:
        if (x == 5000).any():
            raise ZeroDivisionError("five thousand")
        return 1.0 / (x + 1)

    made = spark.range(0, 20000, 1, 2).select("id", dataflow.isolated(inverse, "double")(F.col("id")).alias("r"))
    bad = made.where("r.error IS NOT NULL").collect()
    assert [(b.id, b.r.error, b.r.value) for b in bad] == [(5000, "ZeroDivisionError: five thousand", None)]
    assert made.where("r.value = 1.0D / (id + 1)").count() == 19999


def test_isolated_model_is_called_once_and_finds_many_faults_cheaply(spark):
    calls = []

    def judge(x: pd.Series) -> pd.Series:
        calls.append(len(x))
        bad = x[x % 97 == 5]
        if len(bad):
            raise ValueError(f"no model for {bad.iloc[0]}")
        return x / 8.0

    one = dataflow.isolated(judge, "double")
    made = one.func(pd.Series(range(10000)))
    assert made["error"].tolist() == [f"ValueError: no model for {i}" if i % 97 == 5 else None for i in range(10000)]
    assert [v for v in made["value"] if v is not None] == [i / 8.0 for i in range(10000) if i % 97 != 5]
    assert len(calls) < 1200  # halving every batch at fault took 1,581
    together = dataflow.isolated(lambda x: x.drop_duplicates(), "long").func(pd.Series([1, 1, 1, 2]))
    assert together["value"].tolist() == [1, 1, 1, 2] and not together["error"].notna().any()
    dataflow.register_model("tampering", "once", one)
    said = dataflow.model_indicators(spark.range(0, 1000, 1, 1), "id", "once", "id")
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert said.count() == 1000 and said.where("error IS NOT NULL").count() == 11


def test_shapes_of_reader_rows_agree(spark):
    shapes = [
        '[{"name": "a", "value": "1", "confidence": 0.5}, {"value": "lost"}, {"name": "", "value": "x"}, 7]',
        '{"ocr_fields": [{"name": "a", "value": "1", "confidence": 0.5}]}',
        '{"fields": {"a": {"value": "1", "confidence": 0.5}}}',
        '{"ocr_fields": null, "fields": {"a": {"value": "1", "confidence": 0.5}}}',
    ]
    df = spark.createDataFrame([(s,) for s in [*shapes, '{"fields": {"a": "1"}}', "{broken", None, "3", "{}"]], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(fields.ocr_rows(F.col("t"))).collect()]
    assert got[:4] == [[("a", "1", 0.5)]] * 4 and got[4] == [("a", "1", None)] and got[5:] == [[]] * 4


@pytest.mark.parametrize(
    ("line", "key", "want"),
    [("N A T I O N A L I T Y : INDIAN", "nationality", "INDIAN"), ("Nationality= INDIAN", "nationality", "INDIAN"), ("Visa No - AX123456", "visa_number", "AX123456"), ("S E X : F", "gender", "Female"), ("Surname; ROE", "surname", "ROE"), ("nothing here", "surname", None)],
)
def test_labels_are_lenient(spark, line, key, want):
    words = F.expr("cast(array() as array<struct<text:string,confidence:double,line:int>>)")
    got = spark.range(1).select(fields.visual_field(F.array(F.lit(line)), words, key).alias("v")).first().v
    assert (got and got.value) == want


def test_months_with_a_letter_that_is_no_digit(spark):
    got = spark.createDataFrame([("12 AUG 2030",), ("2O30-08-l2",), ("12/8/2030",), ("none",)], "t string").select(text.expiry_date(F.col("t")).cast("string")).collect()
    assert [r[0] for r in got] == ["2030-08-12", "2030-08-12", "2030-08-12", None]


def test_generic_fields_have_a_number_and_take_the_zone_first(spark):
    lines = ["Surname — O’Brien", "Visa no: V1234567", "Passport K7654321", "Nationality: UTOPIA", "Sex: F", "Expiry: 2031-02-03"]
    zone = "struct<surname:string,given_names:string,number:string,number_ok:boolean,nationality:string,date_of_birth:string,birth_ok:boolean,sex:string,expiry_date:string,expiry_ok:boolean>"
    told = ("ROE", "ANNA", "P0000012", False, "UTO", "1990-05-06", True, "<", None, None)
    word = "array<struct<text:string,confidence:double,line:int>>"
    rows = [
        (1, lines, [], None, None, None),
        (2, lines[2:5], [("Passport", 0.8, 0)], None, None, None),
        (3, lines, [("P0000012", 0.6, 7), ("0UTO9005", 0.7, 7), ("other", 0.1, 0)], told, "P<UTOROE<<ANNA", "P00000120UTO9005068"),
        (4, [], [], told, "P<UTOROE<<ANNA", "P00000120UTO9005068"),
    ]
    df = spark.createDataFrame(rows, f"id int, lines array<string>, words {word}, zone {zone}, top string, bottom string")
    of = lambda *more: df.select("id", fields.generic_fields(F.col("lines"), F.col("words"), *map(F.col, more)).alias("f")).orderBy("id").collect()
    assert {f.name for f in of()[0].f} == {"full_name", "document_number", "date_of_birth", "expiry_date", "gender", "nationality"}
    got = {r.id: {f.name: (f.value, round(f.confidence, 3), f.source, f.check_digit_ok) for f in r.f} for r in of("zone", "top", "bottom")}
    shown = lambda v, c=0.45: (v, c, "visual_zone", None)
    both = shown("2031-02-03")
    assert got[1] == {"full_name": shown("O'Brien"), "document_number": shown("V1234567"), "date_of_birth": both, "expiry_date": both, "gender": shown("Female"), "nationality": shown("UTOPIA")}
    assert got[2] == {"document_number": shown("K7654321", 0.72), "gender": shown("Female"), "nationality": shown("UTOPIA")}
    # of the second line's two words, the first covers the number, the nation and the birth; the zone's sex and expiry are missing
    assert got[3] == {
        "full_name": ("ROE ANNA", 0.65, "mrz", None), "document_number": ("P0000012", 0.6, "mrz", False), "date_of_birth": ("1990-05-06", 0.6, "mrz", True),
        "expiry_date": both, "gender": shown("Female"), "nationality": ("UTO", 0.6, "mrz", None),
    }
    assert got[4]["gender"] == (None, 0.911, "mrz", None) and "expiry_date" not in got[4] and got[4]["document_number"][:2] == ("P0000012", 0.821)
