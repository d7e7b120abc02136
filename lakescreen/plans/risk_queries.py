"""Risk, forensic fusion, similarity and stage roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, vectors
from ..operators import fusion, pipeline_state, risk
from ..sources.views import INDICATORS_SQL, SCREENINGS_SQL, indicators, read, screenings

AS_OF = "1998-06-15"
#: A passport's field groups and their aliases.
GROUPS = {"name": ("full_name", "surname"), "number": ("passport_number", "document_number"), "birth": ("date_of_birth",), "expiry": ("expiry_date",), "nationality": ("nationality",)}


def _inputs(s, d):
    i = F.col("id")
    return screenings(s, d).select(
        "id", (i % 7).alias("n_rows"), (i % 5).alias("n_low"), (i % 3).alias("n_flagged"), F.when(i % 13 != 0, i % 4).alias("n_failures"), (i % 6).alias("n_warnings"),
        F.when(i % 17 == 0, "reported_lost").otherwise("active").alias("registry"), F.when(i % 11 == 0, None).when(i % 4 == 0, "suspicious").when(i % 4 == 1, "likely_manipulated").when(i % 4 == 2, "inconclusive").otherwise("no_obvious_manipulation").alias("verdict"),
        F.coalesce(F.col("risk_score"), F.lit(0)).alias("forensic"), F.when(i % 19 == 0, None).when(i % 3 == 0, "MATCH").when(i % 3 == 1, "NO_MATCH").otherwise("INCONCLUSIVE").alias("face"), ((i % 10) / 10.0).alias("face_confidence"),
        F.to_date("created_at").alias("expiry"), (i % 3).alias("n_bad"), (i % 2 + 1).alias("pages"))


def _contributions(s, d):
    c = F.col
    bucket = risk.expiry_bucket(c("expiry"), F.lit(AS_OF).cast("date"))
    parts = [*risk.ocr(c("n_rows"), c("n_low"), c("n_flagged")), *risk.validation(c("n_failures"), c("n_warnings"), c("registry")), *risk.tampering(c("verdict"), c("forensic")), *risk.face(c("face"), c("face_confidence")), *risk.expiry(bucket), *risk.stages(c("n_bad"), c("pages")), *risk.impostor(c("face"), c("n_failures"), c("verdict"))]
    return _inputs(s, d).select("id", risk.ledger(parts).alias("contributions"), "n_bad")


def _scores(s, d):
    scored = _contributions(s, d).withColumn("score", risk.score(F.col("contributions")))
    return scored.select("id", "score", risk.level(F.col("score")).alias("level"), F.round(numbers.verdict_confidence(F.col("score"), F.col("n_bad")), 9).alias("confidence"))


_RISK_SQL = f"""{SCREENINGS_SQL}, i AS (SELECT id, id % 7 AS n_rows, id % 5 AS n_low, id % 3 AS n_flagged, CASE WHEN id % 13 <> 0 THEN id % 4 END AS nf, id % 6 AS nw, id % 17 = 0 AS lost,
    CASE WHEN id % 11 = 0 THEN NULL WHEN id % 4 = 0 THEN 'suspicious' WHEN id % 4 = 1 THEN 'likely_manipulated' WHEN id % 4 = 2 THEN 'inconclusive' ELSE 'no_obvious_manipulation' END AS verdict,
    coalesce(risk_score, 0) AS forensic, CASE WHEN id % 19 = 0 THEN NULL WHEN id % 3 = 0 THEN 'MATCH' WHEN id % 3 = 1 THEN 'NO_MATCH' ELSE 'INCONCLUSIVE' END AS face, id % 10 AS fc,
    date_diff('day', DATE '{AS_OF}', CAST(created_at AS DATE)) AS days, id % 3 AS n_bad, id % 2 + 1 AS pages FROM scr),
  v AS (SELECT *, CASE verdict WHEN 'likely_manipulated' THEN 28 WHEN 'suspicious' THEN 18 WHEN 'inconclusive' THEN 10 ELSE 0 END AS floor_ FROM i),
  k AS (SELECT id, n_bad, 'ocr_empty' AS signal, CASE WHEN n_rows = 0 THEN 15.0 ELSE 0 END AS points FROM v
    UNION ALL SELECT id, n_bad, 'ocr_low_confidence', least(24, n_low * 3) FROM v UNION ALL SELECT id, n_bad, 'ocr_flagged', least(32, n_flagged * 4) FROM v
    UNION ALL SELECT id, n_bad, 'validation_absent', CASE WHEN nf IS NULL THEN 18 ELSE 0 END FROM v UNION ALL SELECT id, n_bad, 'validation_failures', CASE WHEN nf > 0 THEN least(22, 10 + 4 * (nf - 1)) ELSE 0 END FROM v
    UNION ALL SELECT id, n_bad, 'validation_warnings', least(9, nw * 3) FROM v UNION ALL SELECT id, n_bad, 'registry_adverse', CASE WHEN lost THEN 22 ELSE 0 END FROM v
    UNION ALL SELECT id, n_bad, 'tampering_verdict', CASE WHEN verdict IS NULL THEN 15 ELSE floor_ END FROM v
    UNION ALL SELECT id, n_bad, 'tampering_score', CASE WHEN CAST(forensic AS DOUBLE) / 100 * 20 - floor_ >= 0.5 THEN CAST(forensic AS DOUBLE) / 100 * 20 - floor_ ELSE 0 END FROM v
    UNION ALL SELECT id, n_bad, 'face', CASE WHEN face IS NULL THEN 15 WHEN face = 'NO_MATCH' THEN 35 WHEN face = 'INCONCLUSIVE' THEN 10 WHEN fc < 7 THEN 5 ELSE 0 END FROM v
    UNION ALL SELECT id, n_bad, 'expiry', CASE WHEN days < 0 THEN 25 WHEN days <= 90 THEN 8 ELSE 0 END FROM v
    UNION ALL SELECT id, n_bad, 'stage_outcomes', least(20, n_bad * 10) FROM v UNION ALL SELECT id, n_bad, 'multi_page', CASE WHEN pages > 1 THEN 10 ELSE 0 END FROM v
    UNION ALL SELECT id, n_bad, 'impostor', CASE WHEN face = 'NO_MATCH' AND nf = 0 AND verdict IN ('no_obvious_manipulation', 'inconclusive') THEN 16 ELSE 0 END FROM v)"""


def _missing(s, d):
    c = read(s, d, "customer")
    present = F.array_compact(F.array(F.when(F.col("c_custkey") % 2 == 0, F.lit("surname")), F.when(F.col("c_custkey") % 3 != 0, F.lit("passport_number")), F.when(F.col("c_custkey") % 5 != 0, F.lit("expiry_date")), F.lit("date_of_birth")))
    names = risk.missing(present, GROUPS)
    return c.select("c_custkey", F.array_join(names, ",").alias("missing"), F.least(F.lit(24), F.size(names) * 6).cast("long").alias("points"))


def _pairs(s, d):
    e = read(s, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("probe"), F.col("label").alias("probe_label"))
    both = e.join(other, "vec_id").withColumn("similarity", F.round(vectors.cosine(F.col("embedding"), F.col("probe")), 4))
    confidence = vectors.verdict_confidence(F.col("similarity"), (F.col("vec_id") % 3).cast("int"), (F.col("vec_id") % 2).cast("int"))
    return both.select("vec_id", "similarity", vectors.verdict(F.col("similarity")).alias("verdict"), F.round(confidence, 6).alias("confidence"))


def _top_neighbours(s, d):
    """Top four of each block, the table being one image whose blocks lie 8 apart, 32 to a row. Its vectors are nowhere as alike as 0.98, so 0.25 is asked for."""
    e = read(s, d, "embeddings").withColumn("x", F.col("vec_id") % 32 * 8).withColumn("y", F.floor(F.col("vec_id") / 32) * 8)
    return fusion.similar_blocks(e, "vec_id", "embedding", "x", "y", k=4, at=0.25, apart=32)


def _stages(s, d):
    li = read(s, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_quantity") < 3, "error").when(F.col("l_quantity") < 8, "skipped").when(F.col("l_quantity") < 12, "not_implemented").otherwise("ok")
    runs = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(status).alias("statuses"), F.collect_list(F.col("l_tax") > 0.07).alias("flags"), F.bool_or(F.col("l_quantity") == 50).alias("failed"))
    bad = F.size(F.filter("statuses", lambda x: x.isin("error", "skipped"))).cast("long")
    return runs.select("id", pipeline_state.final_status(F.col("statuses"), F.col("failed")).alias("final_status"), pipeline_state.needs_review(F.col("flags"), F.when(F.col("id") % 4 != 0, F.lit(False)), F.col("failed")).alias("review"), bad.alias("n_bad"))


QUERIES = {
    "risk_contributions": lambda s, d: _contributions(s, d).select("id", F.explode("contributions").alias("c")).select("id", "c.signal", F.round("c.points", 6).alias("points")),
    "risk_score_band": _scores,
    "expiry_buckets": lambda s, d: read(s, d, "orders").select("o_orderkey", risk.expiry_bucket(F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")),
    "missing_fields": _missing,
    "fusion_verdict": lambda s, d: fusion.fuse(indicators(s, d), "id").select("id", "risk", F.array_join("agreeing", ",").alias("agreeing"), "verdict"),
    "face_pair_verdict": _pairs,
    "topk_neighbours": _top_neighbours,
    "robust_outliers": lambda s, d: fusion.robust_outliers(read(s, d, "lineitem").select(F.col("l_suppkey").alias("tile"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "tile", "l_extendedprice", 1.5).select("tile", "l_orderkey", "l_linenumber", "l_partkey", F.round("z", 6).alias("z")),
    "shift_clusters": lambda s, d: fusion.shift_families(read(s, d, "lineitem").select((F.col("l_partkey") % 40 - 20).alias("dx"), (F.col("l_suppkey") % 24 - 12).alias("dy"))),
    "hue_circular": lambda s, d: fusion.circular(read(s, d, "events").withColumn("hue", F.col("value") * 7 % 360), "event_type", "hue").select("event_type", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread")),
    "final_status_rollup": _stages,
    "checkpoints_rollup": lambda s, d: screenings(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("risk_band").isin("low", "medium")).alias("met"), F.count_if(F.col("risk_band") == "critical").alias("failed"), F.count_if(F.col("risk_band").isNull()).alias("informational")),
    "operator_trailing_load": lambda s, d: screenings(s, d).groupBy("operator_id", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).select("operator_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("n").over(Window.partitionBy("operator_id").orderBy(F.unix_date("day")).rangeBetween(-13, 0)).alias("last_14_days")),
}

SQL = {
    "risk_contributions": f"WITH {_RISK_SQL} SELECT id, signal, round(CAST(points AS DOUBLE), 6) AS points FROM k WHERE points <> 0",
    "risk_score_band": f"""WITH {_RISK_SQL}, t AS (SELECT id, any_value(n_bad) AS n_bad, round_even(least(100.0, sum(CAST(points AS DOUBLE) ORDER BY signal)), 1) AS score FROM k GROUP BY id)
      SELECT id, score, CASE WHEN score <= 24 THEN 'LOW' WHEN score <= 49 THEN 'MEDIUM' WHEN score <= 74 THEN 'HIGH' ELSE 'CRITICAL' END AS level,
      round(greatest(0.1::DOUBLE, 0.55::DOUBLE - least(0.45::DOUBLE, 0.12::DOUBLE * n_bad) - CASE WHEN abs(score - 24) <= 2 OR abs(score - 49) <= 2 OR abs(score - 74) <= 2 THEN 0.08::DOUBLE ELSE 0::DOUBLE END), 9) AS confidence FROM t""",
    "expiry_buckets": f"SELECT CASE WHEN CAST(o_orderdate AS DATE) < DATE '{AS_OF}' THEN 'expired' WHEN CAST(o_orderdate AS DATE) <= DATE '{AS_OF}' + 90 THEN 'soon' ELSE 'valid' END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "missing_fields": """WITH m AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'expiry' END, CASE WHEN c_custkey % 2 <> 0 THEN 'name' END, 'nationality', CASE WHEN c_custkey % 3 = 0 THEN 'number' END], lambda x: x IS NOT NULL) AS g FROM customer)
      SELECT c_custkey, array_to_string(g, ',') AS missing, least(24, len(g) * 6) AS points FROM m""",
    "fusion_verdict": f"""WITH {INDICATORS_SQL}, w(type, weight) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in fusion.WEIGHTS.items())}),
      p AS (SELECT id, i.type, severity, confidence, least(34.0, weight * CASE severity WHEN 'low' THEN 0.35::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * (0.5 + 0.5 * confidence)) AS p FROM ind i JOIN w ON i.type = w.type WHERE severity <> 'info'),
      m AS (SELECT *, max(p) OVER (PARTITION BY id) AS mx FROM p),
      e AS (SELECT *, CAST(round(CAST(CAST(CASE WHEN p = mx THEN p ELSE p * (p / greatest(mx, 1.0)) END AS VARCHAR) AS DECIMAL(30, 20)), 1) AS DOUBLE) AS eff FROM m),
      g AS (SELECT id, CAST(round(CAST(CAST(least(98.0::DOUBLE, 4.0::DOUBLE + 10 * sqrt(sum(eff ORDER BY eff))) AS VARCHAR) AS DECIMAL(30, 20)), 1) AS DOUBLE) AS risk, array_to_string(coalesce(list_sort(list(DISTINCT type) FILTER (confidence >= 0.55)), []), ',') AS agreeing,
        count(DISTINCT type) FILTER (confidence >= 0.55) AS n, bool_or(severity IN ('medium', 'high')) AS strong FROM e GROUP BY id),
      a AS (SELECT i.id, coalesce(risk, 4.0) AS risk, coalesce(agreeing, '') AS agreeing, coalesce(n, 0) AS n, coalesce(strong, false) AS strong FROM (SELECT DISTINCT id FROM ind) i LEFT JOIN g ON i.id = g.id)
      SELECT id, risk, agreeing, CASE WHEN risk >= 55 OR n >= 3 THEN 'likely_manipulated' WHEN risk >= 20 OR strong THEN 'suspicious' ELSE 'no_obvious_manipulation' END AS verdict FROM a""",
    "face_pair_verdict": """WITH p AS (SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
      SELECT vec_id, similarity, CASE WHEN similarity >= 0.363 THEN 'MATCH' WHEN similarity <= 0.25 THEN 'NO_MATCH' ELSE 'INCONCLUSIVE' END AS verdict,
      round(greatest(0.0, least(0.95, 0.82 + 1.2 * CASE WHEN similarity >= 0.363 THEN similarity - 0.363 WHEN similarity <= 0.25 THEN 0.25 - similarity ELSE 0 END - least(0.35, 0.12 * (vec_id % 3) + 0.05 * (vec_id % 2)))), 6) AS confidence FROM p""",
    "topk_neighbours": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 32 * 8 AS x, vec_id // 32 * 8 AS y FROM embeddings),
      p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 4) AS similarity, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS INTEGER) AS rank FROM p)
      SELECT a, b, similarity, rank FROM r WHERE rank <= 4 AND similarity >= 0.25 AND d2 >= 32 * 32""",
    "robust_outliers": """WITH m AS (SELECT l_suppkey AS tile, median(l_extendedprice) AS median, mad(l_extendedprice) AS mad FROM lineitem GROUP BY 1),
      z AS (SELECT tile, l_orderkey, l_linenumber, l_partkey, (l_extendedprice - median) / greatest(0.05, 1.4826 * mad) AS z FROM lineitem JOIN m ON l_suppkey = tile) SELECT tile, l_orderkey, l_linenumber, l_partkey, round(z, 6) AS z FROM z WHERE abs(z) >= 1.5""",
    "shift_clusters": """WITH s AS (SELECT l_partkey % 40 - 20 AS dx, l_suppkey % 24 - 12 AS dy FROM lineitem), g AS (SELECT *, greatest(1, gcd(abs(dx), abs(dy))) AS g FROM s)
      SELECT dx // g AS fx, dy // g AS fy, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 3""",
    "hue_circular": """WITH a AS (SELECT event_type, radians((value * 7) % 360) AS a FROM events), g AS (SELECT event_type, avg(cos(a)) AS c, avg(sin(a)) AS s FROM a GROUP BY 1)
      SELECT event_type, round((degrees(atan2(s, c)) + 360) % 360, 6) AS mean, round(degrees(sqrt(greatest(0.0, -2 * ln(sqrt(c * c + s * s))))), 6) AS spread FROM g""",
    "final_status_rollup": """WITH s AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_quantity < 3 THEN 'error' WHEN l_quantity < 8 THEN 'skipped' WHEN l_quantity < 12 THEN 'not_implemented' ELSE 'ok' END AS status, l_tax > 0.07 AS flag, l_quantity = 50 AS failed FROM lineitem)
      SELECT id, CASE WHEN bool_or(failed) THEN 'error' WHEN bool_and(status = 'ok') THEN 'completed' WHEN bool_or(status = 'error') THEN 'completed_with_errors' WHEN bool_or(status = 'skipped') THEN 'completed_with_skips' ELSE 'completed_with_degraded_modules' END AS final_status,
      bool_or(flag) OR id % 4 = 0 OR bool_or(failed) AS review, count(*) FILTER (status IN ('error', 'skipped')) AS n_bad FROM s GROUP BY id""",
    "checkpoints_rollup": f"WITH {SCREENINGS_SQL} SELECT status, count(*) AS total, count(*) FILTER (risk_band IN ('low', 'medium')) AS met, count(*) FILTER (risk_band = 'critical') AS failed, count(*) FILTER (risk_band IS NULL) AS informational FROM scr GROUP BY 1",
    "operator_trailing_load": f"""WITH {SCREENINGS_SQL}, c AS (SELECT operator_id, CAST(created_at AS DATE) AS d, count(*) AS n FROM scr GROUP BY 1, 2)
      SELECT operator_id, strftime(d, '%Y-%m-%d') AS day, CAST(sum(n) OVER (PARTITION BY operator_id ORDER BY d RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS last_14_days FROM c""",
}
