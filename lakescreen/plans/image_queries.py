"""Keypoints, peaks and blocks of images; what readers and models say of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataflow, fields, fusion, keypoints, search, suppression
from ..functions import text
from ..sources.shared import spread
from ..sources.views import INDICATORS_SQL, SCREENINGS_SQL, indicators, read, screenings
from .risk_queries import SQL as RISK_SQL


def _keypoints(s, d):
    """The table as one image whose keypoints lie 8 apart, 32 to a row. Codes have 64 bits in place of 256, of which 12 would be the same
    share as 48; the vectors are nowhere that near, so 20 are asked for."""
    e = read(s, d, "embeddings")
    points = e.select(F.lit(0).alias("image"), "vec_id", F.array(keypoints.sign_code(F.col("embedding"))).alias("code"), (F.col("vec_id") % 32 * 8).alias("x"), (F.floor(F.col("vec_id") / 32) * 8).alias("y"))
    return keypoints.hamming_neighbours(points, key="vec_id", at=20, apart=32).select("a", "b", "distance")


def _peaks(s, d):
    """Peaks of each user's events: value and minute of the day are the place, k is the strength."""
    e = read(s, d, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    points = e.select("user_id", "event_id", F.col("value").alias("x"), minute.alias("y"), F.get_json_object("props", "$.k").cast("int").alias("strength"))
    return suppression.suppress(points, 60.0, group="user_id", key="event_id", limit=12).select(F.col("group").alias("user_id"), F.col("id").alias("event_id"), F.col("strength").cast("int").alias("strength"), "rank")


def _blocks(s, d):
    """Each label's vectors are an image of their own."""
    e = read(s, d, "embeddings").withColumns({"x": F.col("vec_id") % 32 * 8, "y": F.floor(F.col("vec_id") / 32) * 8})
    return fusion.similar_blocks(e, "vec_id", "embedding", "x", "y", k=4, at=0.2, apart=32, image="label")


def _buckets(s, d):
    shifts = read(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("image"), (F.col("l_partkey") % 160 - 80).alias("dx"), (F.col("l_suppkey") % 97 - 48).alias("dy"))
    return fusion.shift_buckets(shifts, "image", least=40)


def _model(values):
    """A tampering model that raises on one key in 97."""
    keys = values.to_numpy()  # an operation on a series costs some 100 microseconds, whatever its length
    bad = keys[keys % 97 == 5]
    if len(bad):
        raise ValueError(f"no model for {bad[0]}")
    return keys % 9 / 8.0


def _modelled(s, d):
    dataflow.register_model("tampering", "by key", dataflow.isolated(_model, "double"))
    said = dataflow.model_indicators(read(s, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "by key", "id")
    both = indicators(s, d).select("id", "type", "severity", "confidence").unionByName(said.select("id", "type", "severity", "confidence"))
    return fusion.fuse(both, "id").select("id", "risk", F.array_join("agreeing", ",").alias("agreeing"), "verdict")


def _isolated(s, d):
    said = dataflow.isolated(_model, "double")(F.col("o_orderkey"))
    return read(s, d, "orders").select("o_orderkey", said.alias("m")).select("o_orderkey", "m.value", "m.error")


def _shapes(s, d):
    """Three shapes of one payload by turns, then broken ones."""
    c, k = spread(read(s, d, "customer"), "c_custkey"), F.col("c_custkey")
    name, number = F.concat(F.lit('"'), "c_mktsegment", F.lit('"')), k.cast("string")
    row = lambda n, v: F.concat(F.lit(f'{{"name": "{n}", "value": '), v, F.lit(', "confidence": 0.5}'))
    rows = F.concat(F.lit("["), row("surname", name), F.lit(", "), row("number", number), F.lit(', {"value": "nameless"}, {"name": ""}, 7, null]'))
    mapped = F.concat(F.lit('{"fields": {"number": '), number, F.lit(', "surname": {"value": '), name, F.lit(', "confidence": 0.5}}}'))
    payload = F.when(k % 5 == 0, rows).when(k % 5 == 1, F.concat(F.lit('{"ocr_fields": '), rows, F.lit(', "fields": [{"name": "other"}]}'))).when(k % 5 == 2, mapped).when(k % 5 == 3, F.concat(F.lit('{"number": '), number, F.lit("}"))).otherwise("{broken")
    listed = c.select(k.alias("id"), F.explode_outer(fields.ocr_rows(payload)).alias("r"))
    return listed.select("id", "r.name", "r.value", "r.confidence")


#: Lines with labels as readers give them; ~ stands for the row's value.
_LINES = {
    "nationality": ("N A T I O N A L I T Y : ~", "Nationality= ~", "nationality;_~", "NATION.ALITY-~"),
    "visa_number": ("Visa No - AB~", "VISA  NUMBER = AB~", "v i s a no.: AB~", "Visa Number;AB~"),
    "surname": ("Surname; ~", "S.U.R.N.A.M.E ~", "last   name_~", "LAST NAME: ~"),
}


def _labels(s, d):
    """Labels set apart, and anything of . : = ; _ - behind them."""
    c, k = spread(read(s, d, "customer"), "c_custkey"), F.col("c_custkey")
    out = [k.alias("id")]
    for key, lines in _LINES.items():
        value = F.lpad((k % 1000).cast("string"), 6, "1") if key == "visa_number" else F.col("c_mktsegment")
        line = F.replace(F.element_at(F.array(*[F.lit(x) for x in lines]), (k % 4 + 1).cast("int")), F.lit("~"), value)
        out.append(F.upper(F.regexp_extract(line, fields.visual_pattern(key), 1)).alias(key))
    return c.select(*out)


def _expiries(s, d):
    """Shapes and confusions of a day; Z and Q are letters that no digit stands for."""
    o, k, day = read(s, d, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    shape = (
        F.when(k % 5 == 0, F.upper(F.date_format(day, "dd MMM yyyy")))
        .when(k % 5 == 1, F.translate(F.date_format(day, "yyyy-MM-dd"), "0158", "OISB"))
        .when(k % 5 == 2, F.translate(F.date_format(day, "dd/MM/yyyy"), "01", "ol"))
        .when(k % 5 == 3, F.concat(F.lit("Z"), F.date_format(day, "yyyy-MM-dd")))
        .otherwise(F.date_format(day, "d MMMM yyyy"))
    )
    return o.select("o_orderkey", F.date_format(text.expiry_date(shape), "yyyy-MM-dd").alias("expiry"))


def _past(s, d):
    """A page behind the last one, beside a page with rows."""
    high = search.Filters(risk_band="high")
    pages = [search.page_with_total(screenings(s, d), high, "risk_desc", 10, at).select(F.lit(at).alias("page_from"), "id", "total") for at in (20, 10_000_000)]
    return pages[0].unionByName(pages[1])


QUERIES = {
    "similar_blocks_by_image": _blocks,
    "shift_buckets": _buckets,
    "model_verdict_fused": _modelled,
    "isolated_model": _isolated,
    "ocr_shapes": _shapes,
    "visual_labels": _labels,
    "expiry_shapes": _expiries,
    "page_past_the_end": _past,
    "keypoint_neighbours": _keypoints,
    "peak_suppression": _peaks,
}

_MODEL_SQL = """SELECT o_orderkey AS id, 'model_verdict' AS type, CASE WHEN o_orderkey % 97 = 5 THEN 'info' WHEN o_orderkey % 9 / 8 >= 0.8 THEN 'high' WHEN o_orderkey % 9 / 8 >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN o_orderkey % 97 = 5 THEN 0.0 ELSE abs(o_orderkey % 9 / 8 - 0.5) * 2 END AS confidence FROM orders"""

SQL = {
    "similar_blocks_by_image": """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 32 * 8 AS x, vec_id // 32 * 8 AS y FROM embeddings WHERE label IS NOT NULL),
      p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 4) AS similarity, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label, a ORDER BY similarity DESC, b) AS INTEGER) AS rank FROM p)
      SELECT label, a, b, similarity, rank FROM r WHERE rank <= 4 AND similarity >= 0.2 AND d2 >= 32 * 32""",
    "shift_buckets": """WITH s AS (SELECT l_orderkey % 50 AS image, CAST(round_even((l_partkey % 160 - 80) / 4, 0) AS BIGINT) AS qx, CAST(round_even((l_suppkey % 97 - 48) / 4, 0) AS BIGINT) AS qy FROM lineitem),
      c AS (SELECT image, qx, qy, count(*) AS n, greatest(1, gcd(abs(qx), abs(qy))) AS g FROM s GROUP BY ALL)
      SELECT image, qx, qy, n, coalesce(sum(n) FILTER (n >= 2) OVER (PARTITION BY image, abs(qx) // g, abs(qy) // g), 0) >= 40 AS suppressed FROM c""",
    "model_verdict_fused": RISK_SQL["fusion_verdict"].replace(INDICATORS_SQL, f"{INDICATORS_SQL.replace('ind AS', 'seen AS', 1)}, ind AS (SELECT * FROM seen UNION ALL {_MODEL_SQL})"),
    "isolated_model": "SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 5 THEN o_orderkey % 9 / 8 END AS value, CASE WHEN o_orderkey % 97 = 5 THEN 'ValueError: no model for ' || o_orderkey END AS error FROM orders",
    "ocr_shapes": """WITH r AS (SELECT c_custkey AS id, 'surname' AS name, c_mktsegment AS value, 0.5::DOUBLE AS confidence FROM customer WHERE c_custkey % 5 <= 2
        UNION ALL SELECT c_custkey, 'number', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 5 < 2 THEN 0.5::DOUBLE END FROM customer WHERE c_custkey % 5 <= 2)
      SELECT c_custkey AS id, name, value, confidence FROM customer LEFT JOIN r ON c_custkey = r.id""",
    "visual_labels": "SELECT c_custkey AS id, c_mktsegment AS nationality, 'AB' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '1') AS visa_number, c_mktsegment AS surname FROM customer",
    "expiry_shapes": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL
        WHEN 0 THEN CASE WHEN month(o_orderdate) IN (9, 10, 11, 2) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END
        WHEN 4 THEN CASE WHEN regexp_matches(strftime(o_orderdate, '%B'), '[OoIlSB]') THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS expiry FROM orders""",
    "page_past_the_end": f"""WITH {SCREENINGS_SQL}, m AS (SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY risk_score DESC NULLS LAST, created_at DESC, id DESC) AS k FROM scr WHERE risk_band = 'high')
      SELECT 20 AS page_from, id, total FROM m WHERE k BETWEEN 21 AND 30 UNION ALL SELECT 10000000, NULL, (SELECT max(total) FROM m)""",
    "keypoint_neighbours": """WITH c AS (SELECT vec_id AS id, vec_id % 32 * 8 AS x, vec_id // 32 * 8 AS y, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
      w AS (SELECT id, x, y, CAST(list_reduce(list_transform(bits, lambda b: CAST(b AS HUGEINT)), lambda a, b: a * 2 + b) AS UBIGINT) AS code FROM c),
      d AS (SELECT p.id, q.id AS other, bit_count(xor(p.code, q.code)) AS distance, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS d2 FROM w p JOIN w q ON p.id <> q.id),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS k FROM d)
      SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, CAST(distance AS INTEGER) AS distance FROM r WHERE k <= 2 AND distance <= 20 AND d2 >= 32 * 32""",
    "peak_suppression": """WITH RECURSIVE p AS (SELECT user_id, event_id, value AS x, hour(ts) * 60 + minute(ts) AS y, CAST(json_extract_string(props, '$.k') AS INTEGER) AS strength FROM events),
      o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, x DESC, y DESC, event_id DESC) AS k FROM p),
      g AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x DOUBLE, y BIGINT)[]) AS kept, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS INTEGER) AS strength FROM o WHERE k = 1
        UNION ALL SELECT o.user_id, o.k, CASE WHEN len(list_filter(g.kept, lambda q: (q.x - o.x) ** 2 + (q.y - o.y) ** 2 < 3600)) = 0 THEN list_append(g.kept, {'x': o.x, 'y': o.y}) ELSE g.kept END,
          CASE WHEN len(list_filter(g.kept, lambda q: (q.x - o.x) ** 2 + (q.y - o.y) ** 2 < 3600)) = 0 THEN o.event_id END, o.strength FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1),
      r AS (SELECT user_id, event_id, strength, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) AS INTEGER) AS rank FROM g WHERE event_id IS NOT NULL)
      SELECT * FROM r WHERE rank <= 12""",
}
