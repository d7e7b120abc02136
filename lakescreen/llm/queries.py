"""The numbered queries: each runs one operator over its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, licenses, lmscore, mixing, near_dedup, pii, pipeline, runs, substring_dedup, toxicity, whitening
from .common import WORD_PATTERN, held_out, read_table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.teach(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents outside the held-out fold that are labelled as of good quality; background: all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out()).select("doc_id").distinct()
    # good ids go to all tasks while they take 64 MB at most, else both sides are shuffled; the background needs no join
    small = good.count() <= 4 << 20
    target = docs.join(F.broadcast(good) if small else good.hint("merge"), "doc_id", "left_semi")
    table = lmscore.losses(lmscore.count(docs, target))
    return lmscore.score(docs, table).select("doc_id", held_out().alias("held_out"), "n_tokens", "target_loss", "background_loss", "difference")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return substring_dedup.remove(docs, width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "representative", "links")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    counts = [_number(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    named = langid.identify(docs.drop("lang"), model)
    return named.select("doc_id", held_out().alias("held_out"), F.col("best").alias("lang_pred"), "score", F.col("identified"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", fixed), (-1, 1, "assistant", fixed)], "conv_id long, turn long, role string, text string")
    out = chat.format_chat(table.unionByName(more))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by a hash of its id) repeats its words from a place on with one period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    listed = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    at = F.when(n > 0, F.pmod(g, n)).cast("int")
    placed = listed.withColumn("a", at).withColumn("p", (F.floor((n - F.col("a")) / (g % 8 + 3)) + 1).cast("int"))
    once = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(once, F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    whole = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), n - F.col("a")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.collapse(planted_runs(read_table(spark, sf_dir, "documents")))
    best = F.aggregate("runs", F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select(
        "doc_id",
        "n_runs",
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return whitening.whiten(table, whitening.fit(table, components=4))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.index(docs))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _escaped(text: str) -> str:
    """DuckDB: the text with backslashes doubled and control strings broken."""
    out = f"replace({text}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('text')}) + length(replace({_escaped('role')}, chr(10), '\\' || chr(10))) + 9) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_OP4_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS p, w FROM words WHERE len(w) >= 20),
hashed AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM windows),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM hashed) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS p FROM later),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM words),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS t, count(*) AS n FROM placed k LEFT JOIN covered c ON k.doc_id = c.doc_id AND k.p = c.p WHERE c.p IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

#: crc32 of a short ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))))"""

_OP11_SQL = rf"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC32} AS h FROM documents),
placed AS (SELECT *, (h // 10) % len(w) AS a, 3 + (h // 10) % 8 AS k FROM listed),
planted AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
    THEN w[1:a] || list_transform(generate_series(0, len(w) - a - 1), lambda i: w[a + 1 + i % (1 + (len(w) - a) // k)]) ELSE w END AS w FROM placed),
grams AS (
  SELECT doc_id, i, n, md5(array_to_string(w[i + 1:i + 9], ' ')) AS g
  FROM (SELECT doc_id, w, len(w) AS n, unnest(generate_series(0, len(w) - 9)) AS i FROM planted WHERE len(w) >= 24)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS d FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND b.i - a.i <= a.n // 3),
islands AS (SELECT doc_id, d, i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, d, min(i) AS start, count(*) + 8 + d AS length FROM islands GROUP BY doc_id, d, island),
runs AS (SELECT doc_id, start, length, min(d) AS period FROM stretches WHERE length >= greatest(24, 3 * d) GROUP BY doc_id, start, length),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs),
told AS (
  SELECT doc_id, count(*) AS n_runs, min(start) FILTER (k = 1) AS start, min(length) FILTER (k = 1) AS length, min(period) FILTER (k = 1) AS period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM ranked GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM runs),
spread AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM planted WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM spread s WHERE NOT EXISTS (FROM dropped d WHERE d.doc_id = s.doc_id AND d.i = s.i) GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM planted p LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP1_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_toxicity": op2_toxicity,
        "op3_lm_score": op3_lm_score,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_pii": op7_pii,
        "op8_language": op8_language,
        "op9_mix": op9_mix,
        "op10_chat": op10_chat,
        "op11_runs": op11_runs,
        "op12_whiten": op12_whiten,
        "op13_licenses": op13_licenses,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_nearest": _OP1_SQL, "op4_substring_dedup": _OP4_SQL, "op10_chat": _OP10_SQL, "op11_runs": _OP11_SQL}
