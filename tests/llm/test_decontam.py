"""Decontamination against the alignment of every item with every whole document."""

import collections

import numpy as np
import pytest

from lakescreen.llm import decontam


def brute_score(item, doc):
    """Smith-Waterman over whole texts: match 2, other word -1, gap -1."""
    above, best = [0] * (len(doc) + 1), 0
    for w in item:
        row = [0]
        for j, d in enumerate(doc):
            row.append(max(0, above[j] + (2 if w == d else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(item))


def edited(rng, words):
    """The passage under one of several kinds of edits."""
    kind = rng.integers(7)
    if kind == 0:  # a filler after every second word
        return [x for i, w in enumerate(words) for x in ([w, f"f{rng.integers(9)}"] if i % 2 else [w])]
    if kind == 1:  # every third word is another one
        return [f"f{rng.integers(9)}" if i % 3 == 2 else w for i, w in enumerate(words)]
    if kind == 2:  # a filler after every word
        return [x for w in words for x in (w, f"f{rng.integers(9)}")]
    if kind == 3:  # the first half only
        return words[: len(words) // 2 + int(rng.integers(3))]
    if kind == 4:  # fillers in its first part
        return [x for i, w in enumerate(words) for x in ([w, "f"] if i < 20 else [w])]
    share = rng.random() * 0.5
    return [w for w in words if rng.random() > share]


@pytest.mark.parametrize("common", [20, 400])
def test_pairs_and_scores_equal_brute_force(spark, common):
    rng = np.random.default_rng(common)
    word = lambda: f"w{min(common - 1, int(rng.exponential(common / 5)))}"
    items = [(i, " ".join(word() for _ in range(int(rng.choice([1, 2, 4, 6, 12, 40]))))) for i in range(14)]
    docs = []
    for i in range(120):
        words = [word() for _ in range(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(3))):
            at = int(rng.integers(len(words) + 1))
            words[at:at] = edited(rng, items[int(rng.integers(14))][1].split())
        docs.append((i, " ".join(words)))
    want = {}
    for i, text in docs:
        for k, item in items:
            n = len(item.split())
            score = brute_score(item.split(), text.split())
            if score >= max(0.5, min(1.0, 3 / n)) - 1e-9:
                want[i, k] = score
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == pytest.approx(want) and len(got) == len(want)
    texts = dict(docs)
    for r in got:  # the span alone scores as much
        assert brute_score(dict(items)[r.item_id].split(), texts[r.doc_id].split()[r.start : r.end]) == pytest.approx(r.score)
    assert len(want) > 60


def test_passages_that_leave_no_three_words_in_a_row(spark):
    item = [f"i{k}" for k in range(40)]
    filler = [x for i, w in enumerate(item) for x in ([w, f"f{i}"] if i % 2 else [w])]
    third = [f"f{i}" if i % 3 == 2 else w for i, w in enumerate(item)]
    early = [x for i, w in enumerate(item) for x in ([w, f"g{i}"] if i < 30 and i % 2 else [w])]
    rows = [(1, " ".join(["a"] * 30 + filler + ["b"] * 30)), (2, " ".join(["a"] * 30 + third + ["b"] * 30)), (3, " ".join(["a"] * 5 + early))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, items).collect()}
    assert {i: round(r.score, 2) for i, r in got.items()} == {1: 0.76, 2: 0.51, 3: 0.81} and [got[i].start for i in (1, 2, 3)] == [30, 30, 5]
    assert [r.doc_id for r in decontam.contaminated(docs, items, threshold=0.8).collect()] == [3]


def test_a_word_that_is_in_all_items(spark, monkeypatch):
    """Words that all items share are no seeds while the items have others; and pairs are looked at in parts of any size."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(["which", "of", "the", *(f"i{i}x{k}" for k in range(9))])) for i in range(300)]
    docs = [(i, " ".join(["which", "of", "the"] * 20 + [f"n{rng.integers(99)}" for _ in range(20)])) for i in range(40)] + [(100, "so " + items[7][1]), (101, None), (102, "")]
    found = decontam._block(spark.createDataFrame(docs, "doc_id long, text string"), [collections.namedtuple("R", "item_id text")(*i) for i in items], 0.5, 3)
    assert not np.isin(decontam.tokens(np.frombuffer(b"which of the", np.uint8), np.array([0, 12]))[0], found.hashes).any()
    for pairs in (1 << 17, 3):
        monkeypatch.setattr(decontam, "PAIRS", pairs)
        got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [(r.doc_id, r.item_id, r.score) for r in got] == [(100, 7, 1.0)]
