"""Periodic runs, embedding whitening and license scans against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import os
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescreen.llm import licenses, queries, runs, whitening

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, runs string, score string, n_words string, label string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", "l") for i, t in texts], DOCS)


# ---- periodic runs


def brute_runs(w, least=24, power=3):
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def found_runs(texts, **how):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    return runs.find(np.frombuffer(b"".join(raw), np.uint8), at, **how)


def periodic(rng, letters, size):
    w = []
    while len(w) < size:
        unit = [letters[rng.integers(len(letters))] for _ in range(rng.choice([1, 2, 3, 7, 12, 30]))]
        w += unit * rng.choice([1, 1, 2, 3, 4, 6])
        if rng.random() < 0.3:
            w += w[-int(rng.integers(1, 60)) :]
    return " ".join(w)


@pytest.mark.parametrize("how", [{}, {"least": 8, "power": 2}, {"least": 5, "power": 3}])
def test_runs_equal_brute_force(how):
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 5):
        texts = [periodic(rng, "abcde"[:k], int(size)) for size in rng.choice([30, 100, 300], 24)]
        got = found_runs(texts, **how)
        for i, t in enumerate(texts):
            assert got.get(i, []) == brute_runs(t.split(), **how)


def test_runs_do_not_cross_documents():
    assert found_runs(["a " * 20, "a " * 20, "", "a " * 24]) == {3: [(0, 24, 1)]}


def test_small_blocks_of_end_positions(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 3)
    rng = np.random.default_rng(6)
    for _ in range(20):
        text = periodic(rng, "ab", 200)
        assert found_runs([text]).get(0, []) == brute_runs(text.split())


def test_long_texts_of_repeated_words():
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 20000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert found_runs(["a " * 100_000]) == {0: [(0, 100_000, 1)]}
    assert found_runs([" ".join(f"w{i % 6000}" for i in range(20000))]) == {0: [(0, 20000, 6000)]}
    assert len(found_runs([" ".join(fibonacci[1])])[0]) > 1000


def test_collapsed_texts(spark):
    rng = np.random.default_rng(7)
    texts = [(0, None), (1, ""), (2, " \n"), (3, "one"), (None, "x y " * 30), (5, "q " + "x  y\n" * 30 + "z"), (5, "q " + "x  y\n" * 30 + "z"), (6, periodic(rng, "abc", 400)), (7, periodic(rng, "ab", 300))]
    got = {(r.doc_id, r.collapsed): r for r in runs.collapse(documents(spark, texts)).collect()}
    assert len(got) == len(texts) - 1
    for i, t in texts:
        w = (t or "").split()
        found = brute_runs(w)
        rest = " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in found))
        r = got[i, rest]
        assert [tuple(x) for x in r.runs] == found and r.n_words == len(w) and r.n_words - r.n_dropped == len(rest.split())
    assert runs.collapse(documents(spark, []).where("false")).count() == 0


def test_runs_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(queries.oracle_sql()["op11_runs"])
    df = queries.op11_runs(spark, SF)
    names = [c[0] for c in cursor.description]
    assert names == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cursor.fetchall()))


# ---- whitening

VECTORS = "vec_id long, embedding array<{}>, component string, n string, x string, width string"


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], VECTORS.format(kind)).repartition(3)


def exact(rows):
    """n, sums and covariance of the distinct vectors, as fractions."""
    fit = sorted({tuple(int(np.floor(256 * c)) for c in v) for _, v in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[float(Fraction(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)]
    return n, sums, np.array(cov)


@pytest.mark.parametrize("scale", [0.4, 1.0, 3e4, 2e12])
def test_whitening_equals_brute_force(spark, scale):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 6)) * np.array([5, 4, 3, 2, 1.5, 1]) * scale + scale
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[3][1]), (5, rows[5][1])]
    none = [(-1, None), (-2, []), (-3, [1.0] * 5 + [None]), (-4, [1.0] * 5 + [float("nan")]), (-5, [float("inf")] + [1.0] * 5), (-6, [1.0, 2.0])]
    df = vectors(spark, rows + none)
    n, sums, cov = exact(rows)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    assert (model.n, model.sums) == (n, sums) and len(got) == 4 * len(rows)
    by = {(r.vec_id, r.component): r for r in got}
    for i, v in rows:
        x = [int(np.floor(256 * c)) for c in v]
        off = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(4):
            r = by[i, c + 1]
            want = off @ basis[:, c] / np.sqrt(values[c])
            assert abs(abs(r.whitened) - abs(want)) < 1e-6 and r.n == n
            assert r.deviation == (deviation if deviation < 2**63 else None)
            assert abs(r.explained / (values[c] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-6


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(3)
    for bits in (7, 15, 31, 62):
        x = rng.integers(-(1 << bits), 1 << bits, size=(500, 3))
        moduli = whitening.primes(2 * 500 * (1 << bits) ** 2)
        got = whitening.modular_scatter(x, moduli)
        y = x.astype(object)
        assert [whitening.remaindered([int(v) for v in got[:, c]], moduli) for c in range(6)] == [int((y[:, i] * y[:, j]).sum()) for i, j in zip(*np.triu_indices(3), strict=True)]
        assert np.array_equal(np.concatenate([np.frombuffer(b"".join(r.to_pylist()), f"<i{w}").astype(np.int64).reshape(-1, 3) for w, r in whitening.packed(x)]).sum(0), x.sum(0))


def test_whitening_without_variance(spark):
    df = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.001, 2.0])])
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in got)
    assert whitening.fit(df.where("false")) is None and whitening.whiten(df.where("false"), None).count() == 0


def test_ends_of_long(spark):
    df = vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])])
    model = whitening.fit(df)
    assert model.sums == [-1, 256] and {r.deviation for r in whitening.whiten(df, model).where("vec_id < 3").collect()} == {None}


def test_whitening_query_on_a_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, sums, cov = exact([(r.vec_id, r.embedding) for r in table])
    got = queries.op12_whiten(spark, SF).toPandas()
    assert len(got) == 4 * len(table) and set(got["n"]) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(4)).max() < 1e-4
    assert np.allclose(sorted(set(got["explained"])), np.linalg.eigvalsh(cov)[-4:] / np.trace(cov))
    assert {r.vec_id: sum((n * int(np.floor(256 * c)) - s) ** 2 for c, s in zip(r.embedding, sums, strict=True)) for r in table} == dict(zip(got["vec_id"], got["deviation"], strict=True))


# ---- licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(w):
    return sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def brute_share(w, words):
    """The largest share of the template's words at their positions, when all beginnings up to SLACK apart are joined."""
    best = 0.0
    hits = [b for b in range(-len(words), len(w)) if any(0 <= b + k < len(w) and w[b + k] == x for k, x in enumerate(words))]
    for i in range(len(hits)):
        union, last = np.zeros(len(words), bool), hits[i]
        for b in hits[i:]:
            if b - last > licenses.SLACK:
                break
            union |= np.array([0 <= b + k < len(w) and w[b + k] == x for k, x in enumerate(words)])
            last = b
        best = max(best, union.mean())
    return best


@pytest.fixture(scope="module")
def licensed(spark):
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join(f"w{rng.integers(50)}" for _ in range(n))
    notice = {t: t for _, t, _ in licenses.TEMPLATES}
    texts = [(0, None), (1, ""), (2, "?!"), (3, "All Rights Reserved. all rights-reserved ALL rights\x00reserved"), (3, "CC-BY CC BY"), (None, "é general public licensé general PUBLIC License")]
    texts += [(10 + i, f"{filler(30)}. {t.upper()}! {filler(9)}") for i, t in enumerate(notice)]
    w = licenses.TEMPLATES[2][1].split()
    texts += [(100, " ".join([*w[:12], "inserted", *w[12:20], *w[21:]])), (101, " ".join(w[:10])), (102, filler(20000) + " released under the MIT license " + filler(20000)), (103, "license " * 3000), (104, "licensed under cc by-nc 4.0"), (104, "licensed under cc by-nc 4.0")]
    return texts


def test_base_places_equal_brute_force(spark, licensed):
    df = documents(spark, licensed)
    got = licenses.scan(df, licenses.index(df)).collect()
    assert len(got) == len(licensed)
    want = sorted(repr((i, len(plain_words(t)), brute_base(plain_words(t)))) for i, t in licensed)
    assert sorted(repr((r.doc_id, r.n_words, sorted((p.start, p.label) for p in r.places))) for r in got) == want


def test_templates_edits_and_key_phrases(spark, licensed):
    df = documents(spark, licensed)
    got = {r.doc_id: r for r in licenses.scan(df, licenses.index(df)).collect() if r.doc_id is not None}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[10 + i].labels and got[10 + i].score == 1.0
    assert got[100].labels == ["mit"] and 0.9 < got[100].score < 1.0
    assert not got[101].labels and not got[103].labels and got[102].labels == ["mit"] and got[102].licences[0].start == 20000
    assert got[104].labels == ["cc-by", "cc-by-nc-4.0"] and got[0].score == got[1].score == got[2].score == 0.0
    assert licenses.scan(df.where("false"), licenses.index(df.where("false"))).count() == 0


def test_rare_words_lose_no_passage(spark):
    """Random edits of one template: found if and only if brute force over all beginnings has enough words."""
    rng = np.random.default_rng(9)
    listed = [("t", " ".join(f"t{k}" for k in rng.permutation(12)), [])]
    words = listed[0][1].split()
    texts = []
    for i in range(400):
        w = [x if rng.random() < 0.6 else f"w{rng.integers(9)}" for x in words]
        if i % 3 == 0:
            w.insert(int(rng.integers(12)), "new")
        texts.append((i, " ".join([*(f"t{rng.integers(12)}" for _ in range(rng.integers(4))), *w])))
    df = documents(spark, texts)
    got = {r.doc_id: r.score for r in licenses.scan(df, licenses.index(df, 0.6, listed, [])).collect()}
    enough = 0
    for i, t in texts:
        best = brute_share(t.split(), words)
        exact = max(np.mean([0 <= b + k < len(t.split()) and t.split()[b + k] == x for k, x in enumerate(words)]) for b in range(-11, len(t.split())))
        enough += exact >= 0.6
        assert got[i] >= 0.6 if exact >= 0.6 else got[i] == 0.0 or got[i] <= best + 1e-9
    assert 50 < enough < 350


def test_idf_orders_the_index(spark):
    df = documents(spark, [(i, "released under the license") for i in range(5)] + [(9, "mit")])
    found = licenses.index(df, 0.6, [("mit", "released under the mit license", [])], [])
    assert licenses.word_list("mit")[0] in found.hashes and len(found.hashes) == 3


def test_license_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_licenses(spark, SF).collect()}
    for doc_id, text in docs:
        w = plain_words(text)
        base, r = brute_base(w), got[doc_id]
        assert (r.n_words, r.n_base) == (len(w), len(base)) and r.base_labels == ",".join(sorted({b for _, b in base}))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not base


def test_planted_runs_are_as_defined(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "a b"), (7_000_000, None), (7_000_001, "")], "doc_id long, text string")
    made = {r.doc_id: r.text for r in queries.planted_runs(docs.select("doc_id", "text").union(extra)).collect()}
    assert made[None] == "a b"
    for doc_id, text in docs.select("doc_id", "text").collect():
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        assert hashlib.md5(" ".join(w).encode()).digest() == hashlib.md5(" ".join(re.findall(r"[^\x20\x09-\x0D]+", made[doc_id] or "")).encode()).digest()


def test_shared_folder_of_the_session_is_used(spark):
    df = vectors(spark, [(1, [1.0]), (2, [2.0])])
    assert whitening.fit_list(df.where(F.col("vec_id") > 0), "embedding", 256).count() == 2
