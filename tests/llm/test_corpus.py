"""Corpus operators against brute force, on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescreen.llm import ann, chat, decontam, langid, lmscore, mixing, near_dedup, pii, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    base = [prose(rng, int(rng.integers(3, 120))) for _ in range(60)]
    shared = prose(rng, 70)
    texts = [*base, None, "", " \n\t", "one", base[0], base[0], base[1] + " end", shared, "x " + shared + " y", prose(rng, 30) + " " + shared, "a " * 50, prose(rng, 20000), base[5] + " " + base[5]]
    long = base[2].split() + prose(rng, 60).split()
    texts += [" ".join(long), " ".join([*long[:20], "changed", *long[21:]])]
    return [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


# ---- nearest neighbours


@pytest.mark.parametrize("kind", ["double", "float"])
def test_nearest_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16))]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [None] * 16), (480, []), (500, [1.0, 2.0]), (520, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], f"vec_id long, embedding array<{kind}>, query_id string, score double")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5, tile_rows=64, tile_queries=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, x in good:
        if q % 20 == 0:
            scored = []
            for i, y in good:
                if i != q and len(x) == len(y):
                    total = 0.0
                    for a, b in zip(x, y, strict=True):
                        total += a * b
                    scored.append((-total, i))
            assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:5])]
    assert set(got) == {q for q, _ in good if q % 20 == 0}


def test_repeated_candidates_take_one_place(spark):
    """A table three times over, and one id with thirty vectors that are better than all others."""
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8)) for i in range(120)]
    vectors += [(500, vectors[0][1] * (5 + k)) for k in range(30)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors] * 3, "vec_id long, embedding array<double>")
    for tile_rows in (10000, 100):
        got = collections.defaultdict(list)
        for r in ann.nearest(df, F.col("vec_id").isin(0, 1), 6, tile_rows=tile_rows).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        for q in (0, 1):
            best = {}
            for i, v in vectors:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(v @ vectors[q][1]))
            assert got[q] == sorted(best, key=lambda i: -best[i])[:6]


def test_int8_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 70)), rng.normal(size=(60, 70)) * 10
    (a, s, n, e), (b, t, m, f) = ann.quantise(x), ann.quantise(y)
    near = ann.int8_product(a, b) * (s[:, None] * t)
    assert (np.abs(near - x @ y.T) <= n[:, None] * f + e[:, None] * (m + f)).all()


def test_nearest_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# ---- toxicity


def test_toxicity_learns_and_knows_misspellings(spark):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(800):
        words = [f"w{rng.integers(300)}" for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.integers(0, 40, 3):
                words[at] = ["horribleword", "nastyinsult"][at % 2]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None, "x"), (9001, "", "x"), (9002, "!!!", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (9000, 1, None), (None, 1, 1), (12345, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.teach(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(out[i] >= 0.3) == bool(t) for i, _, t in marks]
    assert np.mean(right) > 0.97 and all(0 <= s <= 1 for s in out.values()) and len(out) == 803
    more = spark.createDataFrame([(1, "w1 w2 w3 nastyinsultt horriblword w4 w5 w6 w7 w8"), (2, "w1 w2 w3 w9 w4 w5 w6 w7 w8 w10")], "doc_id long, text string")
    a, b = [r.score for r in toxicity.score(more, model).orderBy("doc_id").collect()]
    assert a > 0.3 > b


def test_long_documents_leave_room(spark, monkeypatch):
    """Texts larger than the whole budget, and labels without a document, do not empty the sample of their class."""
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, 30) + (" awful nasty words" if i % 2 else " kind gentle words")) for i in range(200)]
    rows += [(1000 + i, (prose(rng, 20) + (" awful nasty words " if i % 2 else " kind gentle words ")) * 400) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(5000 + i, i % 2) for i in range(400)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda documents, labels, prior: (documents, labels))
    documents, toxic = toxicity.teach(docs, labels, max_rows=40, max_bytes=32768)
    assert collections.Counter(toxic.tolist()) == {0: 20, 1: 20} and max(len(d) for d in documents) == 512
    # texts within the bound are taught whole
    assert {d.decode() for d in documents if len(d) < 512} <= {t for _, t in rows}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert 0 <= toxicity.score(docs, toxicity.teach(docs, empty)).first().score <= 1


# ---- LM scoring


def brute_losses(rows, target, wanted):
    """Mean losses of some texts, from counts of n-grams kept as tuples: background, then target."""
    counts = [collections.Counter(), collections.Counter()]
    for i, text in rows:
        if text:
            tokens = [*text.encode(), "end"]
            for end in range(1, len(tokens) + 1):
                for k in range(1, min(end, lmscore.ORDER) + 1):
                    for which in (0, 1) if i in target else (0,):
                        counts[which][tuple(tokens[end - k : end])] += 1
    total = [sum(n for g, n in c.items() if len(g) == 1) for c in counts]
    scale = [total[1] / total[0] if total[1] else 1.0, 1.0]
    if not total[1]:
        counts[1], total[1] = counts[0], total[0]

    def p(which, gram):
        if not gram:
            return 1 / 257
        context = counts[which][gram[:-1]] if len(gram) > 1 else total[which]
        return (counts[which][gram] * scale[which] + 8 * p(which, gram[1:])) / (context * scale[which] + 8)

    out = {}
    for i, text in wanted:
        tokens = list((text or "").encode())
        if tokens:
            out[i] = tuple(-np.mean([np.log(p(which, tuple(tokens[max(0, end - lmscore.ORDER) : end]))) for end in range(1, len(tokens) + 1)]) for which in (0, 1))
    return out


@pytest.mark.parametrize("source", ["src1", "none"])
def test_losses_equal_brute_force(spark, docs, corpus, source, monkeypatch):
    monkeypatch.setattr(lmscore, "PART_BYTES", 20_000)
    table = lmscore.losses(lmscore.count(docs, docs.where(F.col("source") == source)))
    more = docs.withColumn("_part", F.lit("p")).withColumn("n_tokens", F.lit("kept not"))
    got = {r.doc_id: r for r in lmscore.score(more, table).collect()}
    wanted = [r[:2] for r in corpus if r[1] is None or len(r[1]) < 2000]
    want = brute_losses([r[:2] for r in corpus], {r[0] for r in corpus if r[3] == source}, wanted)
    for i, _ in wanted:
        if i in want:
            assert (got[i].background_loss, got[i].target_loss) == pytest.approx(want[i], rel=1e-5)
            assert got[i].difference == pytest.approx(want[i][1] - want[i][0], abs=1e-5) and got[i]._part == "p"
        else:
            assert got[i].n_tokens == 0 and got[i].difference is None
    assert len(got) == len(corpus) and (source == "src1" or all(not r.difference for r in got.values()))


def test_probabilities_of_what_follows_sum_to_one():
    """After any context the probabilities of all bytes and of the end mark add up to one."""
    rows = [(1, "abcabcabd"), (2, "abcab"), (3, "b")]
    for context in ("", "a", "abc", "zzz", "bcabca"):
        for which in (0, 1):
            counts = collections.Counter()
            for i, text in rows:
                if which == 0 or i == 1:
                    tokens = [*text.encode(), "end"]
                    for end in range(1, len(tokens) + 1):
                        for k in range(1, min(end, 6) + 1):
                            counts[tuple(tokens[end - k : end])] += 1

            def p(gram, counts=counts):
                if not gram:
                    return 1 / 257
                seen = counts[gram[:-1]] if len(gram) > 1 else sum(n for g, n in counts.items() if len(g) == 1)
                return (counts[gram] + 8 * p(gram[1:])) / (seen + 8)

            assert sum(p((*context.encode()[-5:], t)) for t in [*range(256), "end"]) == pytest.approx(1)


def test_target_texts_rank_first(spark):
    """Held-out texts written like the target are told from others, and the amount of background does not matter."""
    rng = np.random.default_rng(21)
    words = [["".join(chr(97 + c) for c in rng.integers(13 * k, 13 * k + 13, 5)) for _ in range(60)] for k in (0, 1)]
    text = lambda k: " ".join(words[k][int(w)] if rng.random() < 0.8 else words[1 - k][int(w)] for w in rng.integers(60, size=40))
    rows = [(i, text(i % 2)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lmscore.losses(lmscore.count(docs, docs.where("doc_id < 60 AND doc_id % 2 = 0")))
    out = {r.doc_id: r.difference for r in lmscore.score(docs, table).collect()}
    held = [(out[i], i % 2) for i in range(60, 300)]
    pairs = [(a < b) for a, x in held for b, y in held if x == 0 and y == 1]
    assert np.mean(pairs) > 0.99


def test_losses_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.score(docs, lmscore.losses(lmscore.count(docs, docs))).count() == 0


# ---- substring deduplication


def brute_removal(rows, width):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = set()
        for i in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[i : i + width]), (doc_id, i)) != (doc_id, i):
                gone |= set(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width", [20, 8])
def test_removal_equals_brute_force(docs, corpus, width):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(docs, width).collect()}
    assert got == brute_removal([r[:2] for r in corpus], width)
    assert sum(g[1] for g in got.values()) > 200


@pytest.mark.parametrize("hot", [2, 10**9])
def test_removal_with_hot_seeds(spark, docs, corpus, monkeypatch, hot):
    """Windows of hot seeds go by their own hash: the result is the same whether all repeated seeds are hot or none."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(docs, 20).collect()}
    assert got == brute_removal([r[:2] for r in corpus], 20)


def test_two_texts_under_one_id_are_two_documents(spark):
    rng = np.random.default_rng(44)
    one, other = prose(rng, 40, 10**6), prose(rng, 40, 10**6)
    for name in (7, None):
        rows = [(name, one), (name, other), (name, one + " " + other)]
        got = {r.kept: r.n_removed for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
        # of the two places of each passage one stays, and what occurs once stays whole
        assert sum(got.values()) == 80 and all(len(k.split()) in (0, 40, 80) for k in got)


def test_removal_of_nothing_and_of_repeated_ids(spark):
    assert substring_dedup.remove(spark.createDataFrame([], DOCS)).count() == 0
    text = " ".join(f"v{i}" for i in range(30))
    twice = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 99, r.n_removed) for r in substring_dedup.remove(twice).collect()) == [(1, 0), (1, 0), (99, 30)]


# ---- decontamination


def test_copies_and_edits_are_found(spark, docs, corpus):
    items = [(1, corpus[10][1] + " unique tail of words here"), (2, prose(np.random.default_rng(77), 30, 5000)), (3, None), (4, ""), (5, "two words")]
    edited = items[1][1].split()
    edited[8], edited[20] = "other", "another"
    del edited[14]
    rows = [*corpus, (900, "start " + " ".join(edited) + " end", "en", "s", 1), (901, items[1][1], "en", "s", 1), (902, "here two words stand", "en", "s", 1), (901, items[1][1], "en", "s", 1)]
    found = decontam.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = collections.Counter((r.doc_id, r.item_id) for r in found)
    assert pairs[(900, 2)] == 1 and pairs[(901, 2)] == 2 and pairs[(902, 5)] == 1 and not any(i in (3, 4) for _, i in pairs)
    assert {d for d, i in pairs if i == 2} == {900, 901}
    assert all(r.score >= 0.5 for r in found) and max(r.score for r in found if r.doc_id == 901) == 1.0


def test_frequent_seeds_lose_nothing(spark):
    """A short item, an edit with one seed and edits of every fourth word, each in twenty documents."""
    rng = np.random.default_rng(31)
    item = [f"i{k}" for k in range(12)]
    one = ["x", *item[1:3], "y", *item[4:8], "z", *item[9:11], "u"]  # of four words, one n-gram is left
    fourth = [w if k % 4 != 3 else f"e{k}" for k, w in enumerate(item)]
    planted = {0: "quite short item", 1: " ".join(one), 2: " ".join(fourth), 3: " ".join(item[:3])}
    rows = [(100 * kind + k, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for kind, passage in planted.items() for k in range(20)]
    items = spark.createDataFrame([(1, "Quite short item."), (2, " ".join(item))], "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert collections.Counter((r.doc_id // 100, r.item_id) for r in found) == {(0, 1): 20, (1, 2): 20, (2, 2): 20}


def test_many_blocks_give_the_same(spark, docs, corpus):
    items = spark.createDataFrame([(i, corpus[i][1]) for i in range(5, 25)], "item_id long, text string")
    one = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect())
    many = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, block_bytes=2000).collect())
    assert one == many and one


def test_alignment_by_hand():
    plain = lambda s: np.array([hash(w) % 2**63 for w in s.split()], np.uint64)
    assert decontam.align(plain("a b c d"), plain("x a b c d y"))[0] == 1.0
    assert decontam.align(plain("a b c d"), plain("a b x c d"))[0] == pytest.approx(7 / 8)
    assert decontam.align(plain("a b c d"), plain("a b x d"))[0] == pytest.approx(5 / 8)


# ---- near duplicates


def shingle_counts(text):
    words = (text or "").split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute_classes(rows, threshold=0.8):
    bags = {i: shingle_counts(t) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= threshold:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(docs, corpus):
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == brute_classes([r[:2] for r in corpus])


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = prose(rng, 300, 3000).split()
    rows = [(i, prose(rng, 100, 3000)) for i in range(30)]
    for i in range(60):
        words = list(base)
        words[int(rng.integers(300))] = f"edit{i}"
        rows.append((100 + i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("whole", [1, 0])
def test_large_bucket_loses_no_link(spark, monkeypatch, whole):
    """Two families that only a pair of already linked members joins; every link counts. With whole = 0 each bucket has tiles of its own."""
    monkeypatch.setattr(near_dedup, "WHOLE", whole)
    monkeypatch.setattr(near_dedup, "PART", 16)
    rng = np.random.default_rng(18)
    base = [f"w{i}" for i in rng.integers(0, 100000, 400)]

    def text(edits, tag):
        out = list(base)
        for k in edits:
            out[k] = f"{tag}{k}"
        return " ".join(out)

    # five words apart, an edit takes five shingles: members of a family share its edits and have one of their own
    first, second = range(5, 30, 5), range(205, 230, 5)
    rows = [(i, text([*first, 300 + i], f"a{i}-" if i % 2 else "a")) for i in range(40)]
    rows += [(100 + i, text([*second, 300 + i], f"b{i}-" if i % 2 else "b")) for i in range(40)]
    rows += [(50, text([*list(first)[:3], 390], "a")), (150, text([*list(second)[:3], 391], "b"))]
    bags = {i: shingle_counts(t) for i, t in rows}
    want = collections.Counter()
    for k, (a, _) in enumerate(rows):
        for b, _ in rows[k + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
                want[a] += 1
                want[b] += 1
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert {r.doc_id: r.links for r in got} == {i: want[i] for i in bags} and max(want.values()) > 40


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    gram = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for k in range(40):
        row = np.concatenate([np.zeros(300, int), np.ones(300, int)])
        s = near_dedup.signatures(row, near_dedup.mix64(np.concatenate([gram, gram]) + np.uint64(k)), np.concatenate([a, b]), 2)
        got.append((s[0] == s[1]).mean())
    assert np.mean(got) == pytest.approx(want, abs=0.02)


def test_classes_of_nothing(spark):
    assert near_dedup.classes(spark.createDataFrame([], DOCS)).count() == 0


# ---- personal data


def plain_base(text):
    """The four patterns as they are written, with their conditions."""
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(6)
    pieces = ["a", "B7", "@", ".", "..", "x.y", "com", "+", "1", "12", "255", "256", "0", " ", "-", "(", ")", "4111111111111111", "é", "\n", "_", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 25))))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 400_000 + "1" * 300_000 + "+" * 1000) == []


def test_gate_opens_for_whatever_the_grammar_finds(monkeypatch):
    plain = ["write to john at example.com now", "call:five 5 5 1 2 3 4 1 2 3 4 5 6 7", "(plus one two zero two five five five zero one seven seven)"]
    assert [k for k, a, b in pii.disguised_spans(plain[0])] == ["email"]
    rng = np.random.default_rng(12)
    pieces = ["john", "example", "com", " at ", "\nat\t", " AT ", ".", " dot ", "[at]", "( dot )", "five", "SIX", "\u017fix", "f\u0131ve", "oh", "plus ", "5", "41", " ", "  ", "-", ":", ",", "\u0130", "\u00e9", "\u2013"]
    texts_ = plain + ["".join(rng.choice(pieces, 14)) for _ in range(20000)]
    gated = [pii.disguised_spans(t) for t in texts_]
    monkeypatch.setattr(pii, "_disguised", lambda lower: True)
    # without a rewrite, what is found is what the base patterns find
    for text, got in zip(texts_, gated, strict=True):
        want = pii.disguised_spans(text)
        assert got == want or (not got and want == pii.base_spans(text)), text


def test_disguised_spans_map_back(spark):
    text = "é write john [at] mail (dot) example dot com or call plus one two oh two five five five oh one seven seven ok"
    base, both = pii.all_spans(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in both] == [("email", "john [at] mail (dot) example dot com"), ("phone", "plus one two oh two five five five oh one seven seven")]
    assert [text2[a:b] for text2 in ["see аnna@ехаmple.org now"] for _, a, b in pii.all_spans(text2)[1]] == ["аnna@ехаmple.org"]
    for clean in ("we met at noon and one dot stayed", "look at that one two", "Thtion at eson dotted"):
        assert pii.all_spans(clean) == ([], [])
    docs = spark.createDataFrame([(1, "mail a@b.co now", 15, "k"), (2, None, 0, "k"), (3, "", 0, "k")], "doc_id long, text string, n_chars long, spans string")
    assert [(r.text, r.n_chars) for r in pii.redact(docs).orderBy("doc_id").collect()] == [("mail <EMAIL> now", 16), (None, None), ("", 0)]
    assert [len(r.spans) for r in pii.detect(docs).orderBy("doc_id").collect()] == [1, 0, 0]


# ---- language


def test_language_held_out(spark):
    rng = np.random.default_rng(9)
    parts = {"aa": "ka lo mi tu ren".split(), "bb": "sch ein ver ung ich".split(), "cc": "ção que ndo mos aria".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(2, 30)))), lang) for i in range(240) for lang in [list(parts)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", None), (None, "kalomi", "aa")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    out = {r.doc_id: r for r in langid.identify(docs.drop("lang").withColumn("best", F.lit("x")), model).collect()}
    assert np.mean([out[i].best == lang for i, _, lang in rows]) > 0.98
    assert (out[900].best, out[900].score, out[901].best) == ("und", 0.0, "und")
    assert langid.identify(spark.createDataFrame([(1, "жщц" * 40)], "doc_id long, text string"), model).first().identified == "und"
    assert langid.identify(docs.drop("lang"), None).first().best == "und"


def test_probabilities_sum_to_one():
    texts = ["abra kadabra", "banana band", "cab"]
    keys, n = np.unique(np.concatenate([langid.grams(langid.letters(t), 4) for t in texts]), return_counts=True)
    model = langid.build({"x": (keys, n), "y": (keys[:5], n[:5])})
    seen = {int(k) & 0xFFFF for k in keys}
    others = 2  # units kept for what was never seen
    for context in ("abr", "zzz", "  b"):
        key = 0
        for c in context:
            key = key << 16 | ord(c)
        every = np.array([key << 16 | u for u in [*seen, 0x7777]], np.uint64)
        p = np.exp(langid.log_probabilities(model, every))
        assert (p[:-1].sum(0) + others * p[-1]) == pytest.approx([1, 1], abs=1e-5)


# ---- mixing


def test_targets_by_hand(spark):
    sizes = [("a", 100), ("b", 10), (None, 50), ("c", 1000)]
    table = spark.createDataFrame([(s, n) for s, n in sizes], "source string, size long")
    got = {r.source: (r.rank, r.target) for r in mixing.targets(table).collect()}
    left, open_, want = 1160 * 1.5, {"a": 5, "b": 2, "c": 1, None: 5}, {}
    caps = {s: 2.0 * n for s, n in sizes}
    while True:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total > caps[s]]
        if not over:
            want |= {s: left * w / total for s, w in open_.items()}
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
            del open_[s]
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(want)
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1][0])] == ["a", "b", "c", None]


def test_mix_keeps_targets_and_reruns_agree(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    first = mixing.mix(docs).collect()
    assert len(first) == len(corpus)
    by = collections.defaultdict(list)
    for r in first:
        assert 0 <= r.copies <= 2 and r["size"] == len((corpus[r.doc_id][1] or "").split())
        by[r.source].append(r)
    for rows in by.values():
        assert abs(sum(r.copies * r["size"] for r in rows) - rows[0].target) <= max(r["size"] for r in rows)
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.copies) for r in first) == sorted((r.doc_id, r.copies) for r in again)


def test_rounding_keeps_expectations():
    rng = np.random.default_rng(12)
    sizes, start = np.array([7.0, 5, 3, 9, 2]), np.array([2.0, 4, 1, 6, 1])
    sums = np.zeros(5)
    for _ in range(4000):
        words = start.copy()
        left = mixing.settle(sizes, words, rng.random(6))
        assert words.sum() == pytest.approx(start.sum())
        assert all(w in (0, s) for i, (w, s) in enumerate(zip(words, sizes, strict=True)) if i != left)
        sums += words
    assert sums / 4000 == pytest.approx(start, abs=0.25)


# ---- chat


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "a\\b", "\\", "<s>user\nhi</s>\n", "<\\/s>", "", None, "line\nbreak", "é" * 50_000, "</s></s>\\</s>"]
    rows = [(c, t, ["user", "assistant", "sys\ntem</s>", None][(c + t) % 4], bad[(3 * c + t) % len(bad)]) for c in range(12) for t in range(4)]
    rows += [(None, 1, "assistant", "x"), (5, None, "assistant", "first"), (3, 2, rows[14][2], rows[14][3])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == 13
    for r in out:
        want = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [w[2:] for w in want]
        assert r.loss == "".join(w[3] for w in want if w[2] == "assistant")
        body = r.formatted.removeprefix("<s>")
        assert body.count("</s>") == len(want) and "[INST]" not in body
    assert chat.format_chat(df.limit(0)).count() == 0


# ---- further defined cases


def test_letters_of_all_planes():
    assert not len(langid.letters("123 \U0001f600!")) and len(langid.letters("\U00010400\U0001f600")) == 3 and not len(langid.letters(None))


def test_many_languages_are_all_learned(spark):
    """No number of languages is left out, and none needs an expression of its own."""
    rng = np.random.default_rng(71)
    marks = ["".join(chr(97 + c) for c in rng.integers(26, size=9)) for _ in range(400)]
    rows = [(i, f"{marks[i % 400]} {marks[i % 400]}", f"l{i % 400}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, max_docs=3000)
    assert len(model.langs) > 380
    out = langid.identify(docs.drop("lang").limit(800), model).collect()
    assert np.mean([r.best == f"l{r.doc_id % 400}" for r in out]) > 0.9


def test_language_on_held_out_rows_only(spark):
    """Accuracy on the fold that taught nothing, of the test tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 40")
    out = langid.identify(docs, langid.learn(docs)).where(langid.held_out()).collect()
    assert len(out) > 100 and np.mean([r.best == r.lang for r in out]) > 0.95


def test_toxicity_on_held_out_rows_only(spark):
    """Accuracy on labelled rows of the fold that taught nothing."""
    from lakescreen.llm.common import held_out

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(held_out()), toxicity.teach(docs, labels)).collect()
    assert len(out) > 100 and np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in out]) > 0.95


def test_many_spans_take_linear_time():
    import time

    text = "someone at example dot com " + " ".join(f"u{i}@host{i}.org" for i in range(20_000)) + " call five five five"
    began = time.perf_counter()
    base, spans = pii.all_spans(text)
    assert time.perf_counter() - began < 5 and len(base) == 20_000 and len(spans) == 20_001


def test_sizes_are_counted_whatever_the_input_says(spark):
    docs = spark.createDataFrame([(None, "a b c", "s", 100, "k"), (None, None, "s", 100, "k"), (None, "d", None, 100, "k")], "doc_id long, text string, source string, size long, key string")
    out = mixing.mix(docs, carry=("key",)).collect()
    assert sorted(r["size"] for r in out) == [0, 1, 3] and all(r.key == "k" and (r["size"] or not r.copies) for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_alignment_spans_are_exact(spark):
    docs = spark.createDataFrame([(None, "p q r alpha beta gamma delta epsilon s t", 1), (2, "alpha beta gamma", 2)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(9, "alpha beta gamma delta epsilon")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.score, r.start, r.end) for r in decontam.contaminated(docs, items).collect())
    assert got == [(0, 9, 1.0, 3, 8), (2, 9, 0.6, 0, 3)]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), items).count() == 0


def test_near_copies_count_every_link(spark):
    """60 copies of one text with one word edited in each: all 1,770 pairs are links."""
    rng = np.random.default_rng(60)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    rows = [(i, " ".join([*base[: 4 * i + 20], f"edit{i}", *base[4 * i + 21 :]])) for i in range(60)]
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in out} == {0} and {r.links for r in out} == {59} and sum(r.head for r in out) == 1


def test_near_duplicates_recall_on_a_table(spark):
    """Classes of the small test table against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    linked = [i for i in want if want[i] != i]
    assert linked and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked) and all(got[i] == want[i] or want[i] != i for i in want)


def test_equal_rows_are_spread(spark, monkeypatch):
    """20,000 equal rows are many groups, and their source comes near its target."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("s").alias("source"))
    more = spark.createDataFrame([(2, "other text", "t")], "doc_id long, text string, source string")
    sizes = []
    plain = PandasGroupedOpsMixin.applyInPandas

    def watched(self, func, schema):
        sizes.append(self._df.groupBy("rank", "bucket").count().agg(F.max("count")).first()[0])
        return plain(self, func, schema)

    monkeypatch.setattr(type(rows.groupBy()), "applyInPandas", watched)
    mixed = mixing.mix(rows.union(more)).where("source = 's'").collect()
    assert max(sizes) < 2 * mixing.GROUP and len(mixed) == 20_000
    taken = sum(r.copies for r in mixed) * 3
    assert abs(taken - mixed[0].target) < 3


def test_targets_of_many_sources(spark):
    """Levels by ranges equal one pass over all sources."""
    rng = np.random.default_rng(8)
    sized = spark.createDataFrame([(f"h{i:04}", int(rng.integers(1, 5000))) for i in range(3000)], "source string, size long").repartition(3)
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    size = {r.source: r.size for r in sized.collect()}
    names = sorted(size)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, open_, want = 1.5 * sum(size.values()), set(names), {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] > 2 * size[n]}
        if not full:
            want |= {n: level * weight[n] for n in open_}
            break
        want |= {n: 2.0 * size[n] for n in full}
        left -= sum(2.0 * size[n] for n in full)
        open_ -= full
    assert got == pytest.approx(want)


def test_ngrams_are_read_and_looked_up_with_little_work(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 12, 200)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = rng.integers(0, 256, at[-1]).astype(np.uint8)
    for end_marks in (False, True):
        want = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            tokens = [*raw[lo:hi].tolist(), *([lmscore.END] if end_marks and hi > lo else [])]
            for end in range(1, len(tokens) + 1):
                gram = tokens[max(0, end - lmscore.ORDER) : end]
                want.append((len(gram) << (lmscore.TOKEN * lmscore.ORDER)) + sum(t << (lmscore.TOKEN * k) for k, t in enumerate(reversed(gram))))
        assert lmscore.longest(raw, at, end_marks).tolist() == want
    grams = rng.permutation(np.unique(lmscore.longest(raw, at, False)))
    values = rng.random((len(grams), 2)).astype(np.float32)

    def refused(*_, **__):
        raise AssertionError("np.unique hashes, which takes several times as long as sorting")

    monkeypatch.setattr(np, "unique", refused)
    assert (lmscore.Table(grams, values).find(grams[::-1]) == values[::-1]).all()
    keys, n = lmscore._counted(np.concatenate([grams, grams[:5]]))
    assert keys.tolist() == sorted(grams.tolist()) and n.sum() == len(grams) + 5 and (n == 2).sum() == 5
    assert lmscore._distinct(np.concatenate([grams, grams])).tolist() == keys.tolist()
    tracemalloc.start()
    lmscore.longest(rng.integers(0, 256, 1 << 20).astype(np.uint8), np.arange(0, (1 << 20) + 1, 1 << 10), False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # 8 bytes an n-gram, and two such arrays beside them
