"""Reading fields: repaired characters, dates, card zones, fields with confidence, cleaned lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mrz, text
from ..operators import fields
from ..sources.shared import spread
from ..sources.views import read
from .document_queries import AS_OF, ZONES_SQL, _as_of, _iso, _PARSE_SQL, _sql_digit, zones

# Tokens that the queries repair, tried in turn.
TOKENS = ("A1B2C3", "O0Il|5", "1S5", "ABC", "12O45", "Z", "", "G6-B8")
WORDS_CONF = (0.9, 0.8, 0.7, 0.6)


def _one_of(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _repairs(s, d):
    token = _one_of(TOKENS, F.col("p_partkey") % len(TOKENS))
    t = F.concat(token, F.when(F.col("p_partkey") % 16 >= 8, F.lit("q7")).otherwise(""))
    return read(s, d, "part").select("p_partkey", text.letters(t).alias("letters"), text.digits(t).alias("digits"), text.by_neighbours(t).alias("by_neighbours"), text.ambiguous(t).alias("ambiguous"))


def _dates(s, d):
    day = F.col("o_orderdate")
    shape = (
        F.when(F.col("o_orderkey") % 6 == 0, F.date_format(day, "d MMM yyyy"))
        .when(F.col("o_orderkey") % 6 == 1, F.date_format(day, "dd.MM.yy"))
        .when(F.col("o_orderkey") % 6 == 2, F.date_format(day, "yyyy/M/d"))
        .when(F.col("o_orderkey") % 6 == 3, F.date_format(day, "d-M-yyyy"))
        .when(F.col("o_orderkey") % 6 == 4, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.lit("31 Foo 2001"))
    )
    line = F.concat_ws(" ", F.lit("valid"), shape, F.lit("to 45/45/2001"))
    return read(s, d, "orders").select("o_orderkey", F.array_join(text.date_tokens(line), ",").alias("dates"), F.date_format(text.expiry_date(F.translate(shape, "01", "OI")), "yyyy-MM-dd").alias("expiry"))


def _cards(s, d):
    c = spread(read(s, d, "customer"), "c_custkey")
    k = F.col("c_custkey")
    number = F.concat(F.lit("C"), F.lpad(k.cast("string"), 7, "0"))
    birth = F.concat(F.lpad((k * 7 % 100).cast("string"), 2, "0"), F.lit("0615"))
    expiry = F.concat(F.lpad((k * 3 % 50).cast("string"), 2, "0"), F.lit("1130"))
    n, b, e = (mrz.check_digit(x, size).cast("string") for x, size in ((number, 8), (birth, 6), (expiry, 6)))
    wrong = F.when(k % 5 == 0, "0").otherwise(n)
    top = F.rpad(F.concat(F.lit("I<UT0"), "c_mktsegment", F.lit("<<ANNA")), 36, "<")
    # O is read for 0 in the dates of each third card
    seen = lambda x: F.when(k % 3 == 0, F.translate(x, "0", "O")).otherwise(x)
    bottom = F.concat(number, wrong, F.lit("<UT0"), seen(birth), b, F.lit("F"), seen(expiry), e, F.lit("<<<<<<<<"))
    one = c.select(k.alias("id"), top.alias("top"), bottom.alias("bottom"))
    two = F.array(mrz.parse_td2(F.col("top"), F.col("bottom"), _as_of()))
    return one.select("id", F.inline(two))


_BIRTH, _EXPIRY = "lpad(CAST(id * 7 % 100 AS VARCHAR), 2, '0') || '0615'", "lpad(CAST(id * 3 % 50 AS VARCHAR), 2, '0') || '1130'"


def _field_map(s, d):
    z = zones(s, d)
    parsed = z.select("id", "top", "bottom", mrz.parse_td3(F.col("top"), F.col("bottom"), _as_of()).alias("zone"))
    word = lambda i: F.struct(mrz.at(F.col("bottom"), 11 * i, 11 * i + 11).alias("text"), F.lit(WORDS_CONF[i]).alias("confidence"), F.lit(1).alias("line"))
    words = F.when(F.col("id") % 3 != 0, F.array(*[word(i) for i in range(4)])).otherwise(F.array().cast("array<struct<text:string,confidence:double,line:int>>"))
    one = parsed.select("id", "top", "bottom", "zone", words.alias("words"))
    rows = one.select("id", F.inline(fields.passport_fields(F.col("zone"), F.col("top"), F.col("bottom"), F.col("words"))))
    return rows.select("id", "name", "value", F.round("confidence", 6).alias("confidence"), "check_digit_ok")


def _sql_prior(start: int, end: int) -> float:
    return round(max(0.55, 0.92 - abs((start + end) / 2 / 44 - 0.5) * 0.25), 6)


def _sql_conf(held: float, start: int, end: int) -> str:
    return f"CASE WHEN id % 3 <> 0 THEN {held} ELSE {_sql_prior(start, end)} END::DOUBLE"


def _sql_shown(name: str, value: str, confidence: float = 0.45) -> str:
    return f"{{'name': '{name}', 'value': {value}, 'confidence': {confidence}::DOUBLE}}"


def _visual(s, d):
    """Fields of pages of any document: some have a number by its label or by its look, and each thirteenth has a zone, whose dates may lack a day."""
    c = spread(read(s, d, "customer"), "c_custkey")
    k = F.col("c_custkey")
    day = F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" May 19"), F.lpad((k % 60 + 30).cast("string"), 2, "0"))
    digits = F.lpad(k.cast("string"), 7, "0")
    lines = F.array_compact(F.array(
        F.concat(F.lit("Surname : "), "c_mktsegment"),
        F.when(k % 4 != 0, F.lit("Given names ANNA MARIA 7")),
        F.when(k % 5 != 0, F.concat(F.when(k % 2 == 0, F.lit("Date of birth ")).otherwise(F.lit("born ")), day)),
        F.when(k % 7 == 0, F.lit("Expiry: 2031-02-03")),
        F.lit("Sex: F"),
        F.when(k % 3 != 0, F.concat(F.when(k % 3 == 1, F.lit("Visa no; V")).otherwise(F.lit("No. P")), digits)),
        F.when(k % 2 == 0, F.lit("Nationality — Utopia")),
    ))
    words = F.array(F.struct(F.lit("x").alias("text"), F.lit(0.8).alias("confidence"), F.lit(0).alias("line")))
    zone = F.when(F.col("top").isNotNull(), mrz.parse_td3(F.col("top"), F.col("bottom"), _as_of()))
    pages = c.select(k.alias("id"), lines.alias("lines"), words.alias("words")).join(zones(s, d).where("id % 13 = 0"), "id", "left")
    one = pages.select("id", "lines", "words", "top", "bottom", zone.alias("zone"))
    made = one.select("id", F.inline(fields.generic_fields(F.col("lines"), F.col("words"), F.col("zone"), F.col("top"), F.col("bottom"))))
    return made.select("id", "name", "value", F.round("confidence", 6).alias("confidence"))


def _routing(s, d):
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"))
    conf = F.when(F.col("id") % 9 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.95), F.lit(0.8) + F.col("id") % 3 * F.lit(0.1)))
    return c.select("id", fields.routed(conf, F.col("id") % 4 == 0).alias("review"))


def _clean(s, d):
    docs = read(s, d, "documents")
    lines = F.array(F.concat(F.lit("  «Name»   "), F.col("doc_id").cast("string")), F.lit("plain"), F.concat(F.lit("P<UTOERIKSSON<<ANNA(MARIA<<<|<<<<<<<<"), F.when(F.col("doc_id") % 2 == 0, F.lit("§")).otherwise("")))
    one = docs.select("doc_id", F.inline(F.array(fields.cleaned_lines(lines))))
    return one.select("doc_id", F.array_join("lines", "|").alias("lines"), "changed", "removed")


QUERIES = {
    "confusable_repair": _repairs,
    "free_text_dates": _dates,
    "mrz_parse_td2": _cards,
    "passport_field_map": _field_map,
    "visual_field_map": _visual,
    "extraction_routing": _routing,
    "line_cleanup_report": _clean,
}

# The values below are worked out by hand from the rules, not by the code under test.

SQL = {
    "confusable_repair": """WITH t(i, l, g, n, a) AS (VALUES
        (0, 'AIBZC3', 'A182C3', 'AI82C3', true), (1, 'OOIl|S', '0011|5', '0011|5', true), (2, 'ISS', '155', 'I55', true), (3, 'ABC', 'A8C', 'ABC', true),
        (4, 'IZO4S', '12045', '12045', true), (5, 'Z', '2', 'Z', true), (6, '', '', '', false), (7, 'GG-BB', '66-88', '66-88', true)),
      q(i, l, g, n) AS (VALUES (0, 'AIBZC3q7', 'A182C307', 'AI82C307'), (1, 'OOIl|Sq7', '0011|507', '0011|S07'), (2, 'ISSq7', '15507', 'I5507'), (3, 'ABCq7', 'A8C07', 'ABC07'),
        (4, 'IZO4Sq7', '1204507', '1204507'), (5, 'Zq7', '207', 'Z07'), (6, 'q7', '07', '07'), (7, 'GG-BBq7', '66-8807', '66-8807'))
      SELECT p_partkey, CASE WHEN p_partkey % 16 >= 8 THEN q.l ELSE t.l END AS letters, CASE WHEN p_partkey % 16 >= 8 THEN q.g ELSE t.g END AS digits, CASE WHEN p_partkey % 16 >= 8 THEN q.n ELSE t.n END AS by_neighbours,
        t.a AS ambiguous FROM part JOIN t ON t.i = p_partkey % 8 JOIN q ON q.i = p_partkey % 8""",
    # months with an l, S, O or o in their short names are not read back once these stand for digits
    "free_text_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dates,
      CASE WHEN o_orderkey % 6 = 4 OR o_orderkey % 6 = 0 AND month(o_orderdate) NOT IN (7, 9, 10, 11) THEN strftime(o_orderdate, '%Y-%m-%d') END AS expiry FROM orders""",
    "mrz_parse_td2": f"""WITH c AS (SELECT c_custkey AS id, c_mktsegment FROM customer), p AS (SELECT *, {_BIRTH} AS birth, {_EXPIRY} AS expiry, 'C' || lpad(CAST(id AS VARCHAR), 7, '0') AS number FROM c)
      SELECT id, 'UTO' AS issuer, c_mktsegment AS surname, 'ANNA' AS given_names, number, CASE WHEN id % 5 = 0 THEN {_sql_digit('number')} = 0 ELSE true END AS number_ok, 'UTO' AS nationality,
        {_iso('birth', True)} AS date_of_birth, true AS birth_ok, 'F' AS sex, {_iso('expiry', False)} AS expiry_date, true AS expiry_ok FROM p""",
    "passport_field_map": f"""WITH p AS ({_PARSE_SQL}), u AS (SELECT id, unnest([
        {{'name': 'full_name', 'value': surname || ' ' || given_names, 'confidence': {_sql_conf(0.75, 5, 44)}, 'check_digit_ok': NULL::BOOLEAN}},
        {{'name': 'passport_number', 'value': number, 'confidence': {_sql_conf(0.9, 0, 9)}, 'check_digit_ok': number_ok}},
        {{'name': 'nationality', 'value': nationality, 'confidence': {_sql_conf(0.9, 10, 13)}, 'check_digit_ok': NULL::BOOLEAN}},
        {{'name': 'date_of_birth', 'value': date_of_birth, 'confidence': {_sql_conf(0.8, 13, 19)}, 'check_digit_ok': true}},
        {{'name': 'expiry_date', 'value': expiry_date, 'confidence': {_sql_conf(0.8, 21, 27)}, 'check_digit_ok': true}},
        {{'name': 'gender', 'value': 'Female', 'confidence': {_sql_conf(0.8, 20, 21)}, 'check_digit_ok': NULL::BOOLEAN}}]) AS f FROM p)
      SELECT id, f.name AS name, f.value AS value, f.confidence AS confidence, f.check_digit_ok AS check_digit_ok FROM u""",
    "visual_field_map": f"""WITH p AS ({_PARSE_SQL}), c AS (SELECT c_custkey AS id, c_mktsegment, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS digits,
        '19' || lpad(CAST(c_custkey % 60 + 30 AS VARCHAR), 2, '0') || '-05-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS day FROM customer),
      v AS (SELECT c.*, p.id IS NOT NULL AS zoned, p.number, p.nationality, p.date_of_birth, p.expiry_date FROM c LEFT JOIN p ON p.id = c.id AND c.id % 13 = 0),
      u AS (SELECT id, unnest([
        CASE WHEN zoned THEN {_sql_shown('full_name', "c_mktsegment || ' ANNA MARIA'", _sql_prior(5, 44))}
             WHEN id % 4 <> 0 THEN {_sql_shown('full_name', "c_mktsegment || ' ANNA MARIA'")} ELSE {_sql_shown('full_name', 'c_mktsegment', 0.72)} END,
        CASE WHEN zoned THEN {_sql_shown('document_number', 'number', _sql_prior(0, 9))}
             WHEN id % 3 = 1 THEN {_sql_shown('document_number', "'V' || digits")} WHEN id % 3 = 2 THEN {_sql_shown('document_number', "'P' || digits")} END,
        CASE WHEN zoned AND date_of_birth IS NOT NULL THEN {_sql_shown('date_of_birth', 'date_of_birth', _sql_prior(13, 19))}
             WHEN id % 5 <> 0 AND id % 2 = 0 THEN {_sql_shown('date_of_birth', 'day')}
             WHEN id % 5 <> 0 AND id % 7 <> 0 THEN {_sql_shown('date_of_birth', 'day')}
             WHEN id % 5 = 0 AND id % 7 = 0 THEN {_sql_shown('date_of_birth', "'2031-02-03'")} END,
        CASE WHEN zoned AND expiry_date IS NOT NULL THEN {_sql_shown('expiry_date', 'expiry_date', _sql_prior(13, 19))}
             WHEN id % 7 = 0 THEN {_sql_shown('expiry_date', "'2031-02-03'")}
             WHEN id % 5 <> 0 THEN {_sql_shown('expiry_date', 'day')} END,
        CASE WHEN zoned THEN {_sql_shown('gender', "'Female'", _sql_prior(20, 21))} ELSE {_sql_shown('gender', "'Female'")} END,
        CASE WHEN zoned THEN {_sql_shown('nationality', 'nationality', _sql_prior(10, 13))} WHEN id % 2 = 0 THEN {_sql_shown('nationality', "'UTOPIA'")} END]) AS f FROM v)
      SELECT id, f.name AS name, f.value AS value, f.confidence AS confidence FROM u WHERE f IS NOT NULL""",
    "extraction_routing": "SELECT c_custkey AS id, c_custkey % 4 = 0 OR c_custkey % 9 = 0 OR c_custkey % 3 = 0 AS review FROM customer",
    "line_cleanup_report": """SELECT doc_id, '<Name> ' || doc_id || '|plain|P<UTOERIKSSON<<ANNA<MARIA<<<I<<<<<<<<' || CASE WHEN doc_id % 2 = 0 THEN 'I' ELSE '' END AS lines,
      CAST(3 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS changed, CAST(4 AS INTEGER) AS removed FROM documents""",
}
