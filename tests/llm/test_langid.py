"""Language models against a direct Kneser-Ney, and the bounds of what they learn from."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from lakescreen.llm import langid


def direct(texts, units):
    """A function of four characters: the interpolated Kneser-Ney probability of the last one, by dictionaries."""
    full = collections.Counter()
    for t in texts:
        padded = " " * 3 + "".join(chr(u) for u in langid.letters(t))
        full.update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
    tables = {4: full}
    for order in (3, 2, 1):
        tables[order] = collections.Counter(g[1:] for g in tables[order + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / units
        table = tables[n]
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(table[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return p


def test_entropies_equal_a_direct_model():
    teach = {"x": ["abra kadabra", "bra bra", "kad"], "y": ["banana band", "nab a ban"], "z": ["q"]}
    counts = {}
    for lang, texts in teach.items():
        keys, n = np.unique(np.concatenate([langid.grams(langid.letters(t), langid.ORDER) for t in texts]), return_counts=True)
        counts[lang] = keys, n
    model = langid.build(counts)
    units = round(1 / math.exp(model.floor))
    asked = ["abba", "banana", "", None, "zzz qq", "kadabra banana " * 40, "band"]
    for cells in (1 << 22, 30, 3):
        langid.CELLS = cells
        nats, size = langid.entropies(model, asked)
        for j, lang in enumerate(model.langs):
            p = direct(teach[lang], units)
            for i, t in enumerate(asked):
                chars = "".join(chr(u) for u in langid.letters(t))
                assert size[i] == len(chars)
                if chars:
                    padded = " " * 3 + chars
                    assert abs(nats[i, j] + sum(math.log(p(padded[k - 3 : k + 1])) for k in range(3, len(padded))) / len(chars)) < 1e-5
    langid.CELLS = 1 << 22


def test_every_language_is_taught(spark):
    """1,501 languages with one document each, and one that has half of all rows."""
    rng = np.random.default_rng(1)
    rows = [(i, "".join(chr(97 + c) for c in rng.integers(26, size=12)), f"l{i}") for i in range(1501 * 2) if langid_taught(i)][:1501]
    rows += [(10_000 + i, "common words of one language", "big") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn(docs, max_docs=500)
    assert set(model.langs) == {r[2] for r in rows}
    out = langid.identify(docs.where("doc_id < 10000").drop("lang"), model).collect()
    assert all(r.best == f"l{r.doc_id}" for r in out)


def langid_taught(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 != 2


def test_the_sample_is_bounded(spark):
    rows = [(i, "abc " * 250, f"l{i % 3}") for i in range(900)] + [(5000, "long " * 100_000, "l9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if not langid_taught(5000):
        docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 5000, 5001).otherwise(F.col("doc_id")))
    got = langid._sample(docs, 1500, 48_000, 80_000).groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.count(F.when(F.col("aside"), 1)).alias("aside"), F.count("*").alias("docs")).collect()
    by = {r.lang: r for r in got}
    assert set(by) == {"l0", "l1", "l2", "l9"} and all(by[f"l{k}"].n == 20_000 and by[f"l{k}"].aside == 2 for k in range(3))
    assert by["l9"].docs == 1 and by["l9"].aside == 0
    assert langid._sample(docs, 1500, 48, 1 << 30).groupBy("lang").count().where("count > 12").count() == 0
