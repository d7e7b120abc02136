"""Text, dates, machine-readable zones and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mrz, numbers, text
from ..operators import validation
from ..sources.shared import spread
from ..sources.views import read

AS_OF = "2024-06-30"


def _as_of():
    return F.lit(AS_OF).cast("date")


def zones(s, d):
    """Two-line passport zones made of customers and nations; one check digit is wrong for each seventh customer."""
    c = spread(read(s, d, "customer"), "c_custkey").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    date = lambda y, m, day: F.concat(pad(y, 2), pad(m, 2), pad(day, 2))
    country = F.rpad(F.upper(F.left("n_name", F.lit(3))), 3, "<")
    number = F.rpad(F.concat(F.lit("P"), pad(k, 7)), 9, "<")
    birth, expiry = date(k * 7 % 100, k % 12 + 1, k % 28 + 1), date(k * 3 % 50, k % 12 + 1, k * 5 % 31 + 1)
    digit = lambda x, n: mrz.check_digit(x, n).cast("string")
    made = c.select(k.alias("id"), "c_mktsegment", country.alias("country"), number.alias("number"), birth.alias("birth"), expiry.alias("expiry"))
    made = made.withColumn("nd", F.when(F.col("id") % 7 == 0, ((mrz.check_digit(F.col("number"), 9) + 1) % 10).cast("string")).otherwise(digit(F.col("number"), 9)))
    personal = F.lit("<" * 14)
    front = F.concat("number", "nd", "country", "birth", digit(F.col("birth"), 6), F.lit("F"), "expiry", digit(F.col("expiry"), 6), personal, F.lit("<"))
    made = made.withColumn("front", front)
    composite = F.concat(mrz.at(F.col("front"), 0, 10), mrz.at(F.col("front"), 13, 20), mrz.at(F.col("front"), 21, 43))
    top = F.rpad(F.concat(F.lit("P<"), "country", "c_mktsegment", F.lit("<<ANNA<MARIA")), 44, "<")
    return made.select("id", top.alias("top"), F.concat("front", digit(composite, 39)).alias("bottom"))


def _sql_digit(x: str) -> str:
    return f"(list_sum(list_transform(string_split({x}, ''), lambda c, i: greatest(0, strpos('{mrz.ALPHABET}', c) - 1) * ([7, 3, 1])[(i - 1) % 3 + 1])) % 10)"


ZONES_SQL = f"""z0 AS (SELECT c_custkey AS id, c_mktsegment, rpad(upper(n_name[1:3]), 3, '<') AS country, rpad('P' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 9, '<') AS number,
    lpad(CAST(c_custkey * 7 % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS birth,
    lpad(CAST(c_custkey * 3 % 50 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey * 5 % 31 + 1 AS VARCHAR), 2, '0') AS expiry
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  z1 AS (SELECT *, CASE WHEN id % 7 = 0 THEN ({_sql_digit('number')} + 1) % 10 ELSE {_sql_digit('number')} END AS nd, {_sql_digit('birth')} AS bd, {_sql_digit('expiry')} AS ed FROM z0),
  z2 AS (SELECT *, number || CAST(nd AS INTEGER) || country || birth || CAST(bd AS INTEGER) || 'F' || expiry || CAST(ed AS INTEGER) || repeat('<', 15) AS front,
    rpad('P<' || country || c_mktsegment || '<<ANNA<MARIA', 44, '<') AS top FROM z1),
  z AS (SELECT *, front || CAST({_sql_digit("(front[1:10] || front[14:20] || front[22:43])")} AS INTEGER) AS bottom FROM z2)"""


def _parsed(s, d):
    z = zones(s, d)
    # inline() is a step of its own, so that each zone is parsed once however many fields are used later
    return z.select("id", F.inline(F.array(mrz.parse_td3(F.col("top"), F.col("bottom"), _as_of()))))


def _iso(digits: str, birth: bool) -> str:
    year = f"CAST({digits}[1:2] AS INTEGER)"
    full = f"(CASE WHEN {year} <= 49 THEN 2000 ELSE 1900 END + {year})"
    day = lambda y: f"try_cast({y} || '-' || {digits}[3:4] || '-' || {digits}[5:6] AS DATE)"
    if birth:
        return f"strftime(CASE WHEN {day(full)} > DATE '{AS_OF}' THEN {day(f'({full} - 100)')} ELSE {day(full)} END, '%Y-%m-%d')"
    return f"strftime({day(full)}, '%Y-%m-%d')"


_PARSE_SQL = f"""WITH {ZONES_SQL} SELECT id, 'P' AS document_code, replace(country, '<', '') AS issuer, c_mktsegment AS surname, 'ANNA MARIA' AS given_names, replace(number, '<', '') AS number,
  id % 7 <> 0 AS number_ok, replace(country, '<', '') AS nationality, {_iso('birth', True)} AS date_of_birth, true AS birth_ok, 'F' AS sex, {_iso('expiry', False)} AS expiry_date, true AS expiry_ok, true AS composite_ok FROM z"""


def _repair(s, d):
    z = zones(s, d)
    misread = F.when(F.col("id") % 2 == 0, F.translate(mrz.at(F.col("bottom"), 0, 9), "0158", "OISB")).otherwise(mrz.at(F.col("bottom"), 0, 9))
    digit = mrz.check_digit(mrz.at(F.col("bottom"), 0, 9), 9).cast("string")
    return z.select("id", misread.alias("read"), mrz.repair(misread, digit).alias("repaired"))


def _repaired_sql(read: str, want: str, of: str) -> str:
    """CTEs that end in rep: the rows of `of` with `fixed`, the text `read` repaired by the digit `want`, by a search over all exchanges."""
    value = lambda c: f"greatest(0, strpos('{mrz.ALPHABET}', {c}) - 1)"
    other = lambda c: f"translate({c}, '012568ODQILZSBG', 'OIZSGB000112586')"
    return f"""r0 AS (SELECT *, {_sql_digit(read)} AS have, string_split({read}, '') AS cs FROM {of}),
  r1 AS (SELECT *, list_filter(generate_series(1, len(cs)), lambda i: contains('ODQILZSBG015286', cs[i]))[1:8] AS places FROM r0),
  r2 AS (SELECT *, list_transform(places, lambda i: ({value(other('cs[i]'))} - {value('cs[i]')}) * ([7, 3, 1])[(i - 1) % 3 + 1]) AS changes FROM r1),
  r3 AS (SELECT *, list_filter(generate_series(1, (1 << len(places)) - 1), lambda m: (list_sum(list_transform(changes, lambda x, j: x * ((m >> (j - 1)) & 1))) + have - {want}) % 10 = 0)[1] AS mask FROM r2),
  rep AS (SELECT *, CASE WHEN have = {want} OR mask IS NULL THEN {read}
    ELSE array_to_string(list_transform(cs, lambda c, i: CASE WHEN (mask >> (list_position(places, i) - 1)) & 1 = 1 THEN {other('c')} ELSE c END), '') END AS fixed FROM r3)"""


_MISREAD_SQL = "CASE WHEN id % 2 = 0 THEN translate(bottom[1:9], '0158', 'OISB') ELSE bottom[1:9] END"


def _pages(s, d):
    """Cleaned lines of each customer's page: a heading, a line that is as long as a candidate, and the zone, misread for every other customer; every fifth page
    has lost the zone's second line."""
    z = zones(s, d)
    odd = F.col("id") % 2 == 0
    top, bottom = F.col("top"), F.col("bottom")
    issuer = F.when(odd, F.translate(mrz.at(top, 2, 5), "OISBGZ", "015862")).otherwise(mrz.at(top, 2, 5))
    number = F.when(odd, F.translate(mrz.at(bottom, 0, 9), "0158", "OISB")).otherwise(mrz.at(bottom, 0, 9))
    dates = lambda a, b: F.when(odd, F.translate(mrz.at(bottom, a, b), "0158", "OISB")).otherwise(mrz.at(bottom, a, b))
    second = F.concat(number, mrz.at(bottom, 9, 13), dates(13, 20), mrz.at(bottom, 20, 21), dates(21, 28), mrz.at(bottom, 28, 44))
    lines = F.array(F.lit("PASSPORT"), F.lit("X" * 34), F.concat(F.lit("P<"), issuer, mrz.at(top, 5, 44)), F.lit("NOTES"), F.when(F.col("id") % 5 != 0, second).otherwise(F.lit("NOTHING MORE")))
    return z.select("id", lines.alias("lines"))


def _zones_read(s, d):
    read_ = mrz.read_zone(F.col("found"), _as_of())
    # steps of their own, so that pages and zones are taken apart once
    found = _pages(s, d).select("id", F.explode(F.array(mrz.zone(F.col("lines")))).alias("found"))
    return found.select("id", F.explode(F.array(read_)).alias("z")).select("id", "z.*")


def _lines(s, d):
    lines = read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    clean = text.collapse(F.col("raw"))
    return lines.select("doc_id", "line", F.length(clean).alias("n"), (clean != F.col("raw")).alias("changed"), text.mrz_like(F.col("raw")).alias("mrz_like"))


def _date_tokens(s, d):
    o = read(s, d, "orders")
    day = F.col("o_orderdate")
    line = F.concat_ws(" ", F.lit("issued"), F.date_format(day, "dd/MM/yyyy"), F.lit("until"), F.date_format(day, "yyyy-MM-dd"), F.lit("ref 31.02.2001"))
    return o.select("o_orderkey", F.array_join(text.date_tokens(line), ",").alias("dates"))


def _checks(s, d):
    parsed = _parsed(s, d)
    # each thirteenth document has no zone
    there = F.col("id") % 13 != 0
    one = lambda name, v, ok: (F.lit(name), F.struct(v.alias("value"), ok.alias("check_digit_ok")))
    none = F.lit(None).cast("boolean")
    fields = [
        one("full_name", F.when(F.col("id") % 10 != 0, F.concat_ws(" ", "given_names", "surname")), none),
        one("passport_number", F.when(F.col("id") % 6 == 0, F.lower("number")).otherwise(F.col("number")), F.col("number_ok")),
        one("nationality", F.when(F.col("id") % 9 == 0, F.lit("XXX")).otherwise(F.col("nationality")), none),
        one("date_of_birth", F.col("date_of_birth"), F.col("birth_ok")),
        one("expiry_date", F.when(F.col("id") % 8 == 0, F.lit("12/08/2030")).otherwise(F.col("expiry_date")), F.when(F.col("id") % 5 != 0, F.col("expiry_ok"))),
    ]
    zone = [(F.lit(n), F.col(c)) for n, c in (("document_code", "document_code"), ("passport_number", "number"), ("nationality", "nationality"), ("date_of_birth", "date_of_birth"), ("expiry_date", "expiry_date"))]
    made = lambda pairs: F.map_from_arrays(F.array(*[p[0] for p in pairs]), F.array(*[p[1] for p in pairs]))
    df = parsed.select("id", made(fields).alias("fields"), F.when(there, made(zone)).alias("zone"), F.when(there, F.lit("zone")).alias("raw"), F.when(there, F.col("composite_ok")).alias("composite_ok"))
    rows = validation.validate(df, validation.ruleset_for("passport"), F.col("fields"), F.col("zone"), F.col("raw"), F.col("composite_ok"), F.lit("passport"), _as_of())
    out = rows.select("id", F.inline(F.array(validation.summary(F.col("checks")))), "checks")
    return out.select("id", "is_valid", "human_review_required", F.explode("checks").alias("c")).select("id", "is_valid", "human_review_required", "c.field", "c.status", "c.rule")


def _sql_check(name: str, status: str, rule: str) -> str:
    return f"{{'field': '{name}', 'status': {status}, 'rule': '{rule}'}}"


_CHECKS_SQL = f"""WITH p AS ({_PARSE_SQL}), f AS (SELECT *, CASE WHEN id % 8 = 0 THEN '12/08/2030' ELSE expiry_date END AS expiry, id % 13 <> 0 AS zone FROM p),
  c AS (SELECT id, unnest([
    {_sql_check('mrz', "CASE WHEN zone THEN 'PASS' ELSE 'WARNING' END", 'mrz_presence')}, {_sql_check('mrz', "CASE WHEN zone THEN 'PASS' ELSE 'WARNING' END", 'mrz_doc_code')},
    {', '.join(_sql_check(n, f"CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END", 'required_fields[full_name,passport_number,date_of_birth,expiry_date,nationality]') for n, ok in (('full_name', 'id % 10 <> 0'), ('passport_number', 'true'), ('date_of_birth', 'date_of_birth IS NOT NULL'), ('expiry_date', 'expiry IS NOT NULL'), ('nationality', 'true')))},
    {_sql_check('passport_number', "CASE WHEN id % 6 = 0 THEN 'FAIL' ELSE 'PASS' END", 'format[passport_number]')},
    {_sql_check('nationality', "CASE WHEN id % 9 = 0 OR regexp_full_match(nationality, '[A-Z]{3}') THEN 'PASS' ELSE 'FAIL' END", 'format[nationality]')},
    {_sql_check('date_of_birth', "CASE WHEN date_of_birth IS NULL THEN 'WARNING' ELSE 'PASS' END", 'date_format[date_of_birth,expiry_date]')},
    {_sql_check('expiry_date', "CASE WHEN expiry IS NULL THEN 'WARNING' WHEN id % 8 = 0 THEN 'FAIL' ELSE 'PASS' END", 'date_format[date_of_birth,expiry_date]')},
    {_sql_check('date_of_birth', f"CASE WHEN date_of_birth IS NULL OR date_diff('day', CAST(date_of_birth AS DATE), DATE '{AS_OF}') > 36500 THEN 'WARNING' ELSE 'PASS' END", 'dob_sanity')},
    {_sql_check('expiry_date', f"CASE WHEN id % 8 <> 0 AND expiry >= '{AS_OF}' THEN 'PASS' ELSE 'WARNING' END", 'expiry_validity[expiry_date]')},
    {_sql_check('passport_number', "CASE WHEN number_ok THEN 'PASS' ELSE 'FAIL' END", 'mrz_check_digit[passport_number]')},
    {_sql_check('date_of_birth', "CASE WHEN date_of_birth IS NULL THEN 'WARNING' ELSE 'PASS' END", 'mrz_check_digit[date_of_birth]')},
    {_sql_check('expiry_date', "CASE WHEN expiry IS NULL OR id % 5 = 0 THEN 'WARNING' ELSE 'PASS' END", 'mrz_check_digit[expiry_date]')},
    {_sql_check('mrz', "CASE WHEN zone THEN 'PASS' ELSE 'WARNING' END", 'mrz_composite')},
    CASE WHEN NOT zone THEN {_sql_check('mrz', "'WARNING'", 'mrz_consistency')} END,
    CASE WHEN zone THEN {_sql_check('passport_number', "'PASS'", 'mrz_consistency')} END,
    CASE WHEN zone THEN {_sql_check('nationality', "CASE WHEN id % 9 = 0 THEN 'FAIL' ELSE 'PASS' END", 'mrz_consistency')} END,
    CASE WHEN zone AND date_of_birth IS NOT NULL THEN {_sql_check('date_of_birth', "'PASS'", 'mrz_consistency')} END,
    CASE WHEN zone AND expiry_date IS NOT NULL THEN {_sql_check('expiry_date', "CASE WHEN id % 8 = 0 THEN 'FAIL' ELSE 'PASS' END", 'mrz_consistency')} END]) AS c FROM f),
  r AS (SELECT id, c.field AS field, c.status AS status, c.rule AS rule FROM c WHERE c IS NOT NULL)
  SELECT id, NOT bool_or(status = 'FAIL') OVER (PARTITION BY id) AS is_valid, bool_or(status <> 'PASS') OVER (PARTITION BY id) AS human_review_required, field, status, rule FROM r"""


def _headers(s, d):
    docs = read(s, d, "documents")
    made = F.concat_ws("\n", F.element_at(F.array(*[F.lit(x) for x in ("Passport", "entry visa", "no header", "Le PASSEPORT", "pasaporte")]), (F.col("doc_id") % 5 + 1).cast("int")), "text")
    hint = F.when(F.col("doc_id") % 7 == 0, F.lit("permit")).when(F.col("doc_id") % 7 == 1, F.lit("unknown"))
    return docs.select("doc_id", text.header_type(made, hint).alias("doc_type"))


_HEAD = "upper(array_to_string(string_split(t, chr(10))[1:6], ' '))"

QUERIES = {
    "mrz_check_digit": lambda s, d: read(s, d, "customer").select("c_custkey", mrz.check_digit(F.upper(F.regexp_replace("c_name", "[^A-Za-z0-9]", "<"))).alias("digit")),
    "mrz_parse_td3": _parsed,
    "mrz_repair": _repair,
    "mrz_zone_read": _zones_read,
    "ocr_line_clean": _lines,
    "pii_redact_digits": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(text.redact_digits(F.col("text")), 256).alias("redacted_sha256")),
    "date_tokens": _date_tokens,
    "doc_header_detect": _headers,
    "validation_checks": _checks,
    "client_hop": lambda s, d: read(s, d, "events").select("event_id", text.rightmost_hop(F.concat(F.lit("10.0.0.1, "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ", ,").otherwise(""))).alias("hop"), text.short_id(F.md5(F.col("event_id").cast("string"))).alias("short_id")),
    "age_labels": lambda s, d: read(s, d, "events").select("event_id", text.age_label(F.col("ts").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age")),
    "clamped_values": lambda s, d: read(s, d, "events").select("event_id", F.round(numbers.clamp(F.col("value") / 50 - 0.2), 9).alias("clamped")),
}

SQL = {
    "mrz_check_digit": f"SELECT c_custkey, {_sql_digit(chr(34) + 'n' + chr(34))} AS digit FROM (SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '<', 'g')) AS n FROM customer)",
    "mrz_parse_td3": _PARSE_SQL,
    "mrz_repair": f"""WITH {ZONES_SQL}, r AS (SELECT id, {_MISREAD_SQL} AS read, {_sql_digit('bottom[1:9]')} AS want FROM z), {_repaired_sql('read', 'want', 'r')} SELECT id, read, fixed AS repaired FROM rep""",
    "mrz_zone_read": f"""WITH {ZONES_SQL}, r AS (SELECT *, {_MISREAD_SQL} AS read, CAST(nd AS INTEGER) AS want FROM z), {_repaired_sql('read', 'want', 'r')},
      w AS (SELECT *, read || bottom[10:44] AS seen FROM rep)
      SELECT id, CASE WHEN there THEN format END AS format, CASE WHEN there THEN issuer END AS issuer, CASE WHEN there THEN surname END AS surname, CASE WHEN there THEN given_names END AS given_names,
        CASE WHEN there THEN replace(fixed, '<', '') END AS number, CASE WHEN there THEN number_ok END AS number_ok, CASE WHEN there THEN issuer END AS nationality, CASE WHEN there THEN {_iso('birth', True)} END AS date_of_birth,
        CASE WHEN there THEN true END AS birth_ok, CASE WHEN there THEN 'F' END AS sex, CASE WHEN there THEN {_iso('expiry', False)} END AS expiry_date, CASE WHEN there THEN true END AS expiry_ok,
        CASE WHEN there THEN CAST({_sql_digit("(seen[1:10] || seen[14:20] || seen[22:43])")} AS INTEGER) = CAST(bottom[44] AS INTEGER) END AS composite_ok, CAST(NULL AS VARCHAR) AS entries, CAST(NULL AS VARCHAR) AS stay
      FROM (SELECT *, id % 5 <> 0 AS there, 'TD3' AS format, replace(country, '<', '') AS issuer, c_mktsegment AS surname, 'ANNA MARIA' AS given_names, {_sql_digit('fixed')} = want AS number_ok FROM w)""",
    "ocr_line_clean": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line FROM documents),
      c AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS clean, regexp_replace(upper(raw), '\s', '', 'g') AS flat FROM l)
      SELECT doc_id, CAST(line AS INTEGER) AS line, length(clean) AS n, clean <> raw AS changed, length(flat) >= 28 AND length(regexp_replace(flat, '[^A-Z<]', '', 'g')) > 0.8 * length(flat) AND length(flat) - length(replace(flat, '<', '')) >= 3 AS mrz_like FROM c""",
    "pii_redact_digits": r"SELECT doc_id, sha256(regexp_replace(text, '\p{Nd}{6,}', '######', 'g')) AS redacted_sha256 FROM documents",
    "date_tokens": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate, '%Y-%m-%d') || ',2001-02-31' AS dates FROM orders",
    "doc_header_detect": f"""WITH x AS (SELECT doc_id, (['Passport', 'entry visa', 'no header', 'Le PASSEPORT', 'pasaporte'])[doc_id % 5 + 1] || chr(10) || text AS t FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'permit' WHEN contains({_HEAD}, 'PASSPORT') OR contains({_HEAD}, 'PASSEPORT') OR contains({_HEAD}, 'PASAPORTE') THEN 'passport' WHEN contains({_HEAD}, 'VISA') THEN 'visa' END AS doc_type FROM x""",
    "validation_checks": _CHECKS_SQL,
    "client_hop": "SELECT event_id, CAST(user_id AS VARCHAR) AS hop, md5(CAST(event_id AS VARCHAR))[1:12] || '…' AS short_id FROM events",
    "age_labels": """WITH a AS (SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 60 + 0.5) AS BIGINT) AS m FROM events), b AS (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM a)
      SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN h < 48 THEN h || 'h ago' ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || 'd ago' END AS age FROM b""",
    "clamped_values": "SELECT event_id, round(greatest(0.0, least(1.0, CAST(value AS DOUBLE) / 50 - CAST(0.2 AS DOUBLE))), 9) AS clamped FROM events",
}
