"""Keypoint neighbours, suppression and similar blocks against brute force."""

import itertools
import random

import pytest

from lakescreen.operators import keypoints, suppression
from lakescreen.sources.shared import written


def brute_neighbours(rows, k, at, apart):
    """rows: {(image, id): (code, x, y)}"""
    out = set()
    for (image, i), (code, x, y) in rows.items():
        near = sorted((sum((a ^ b).bit_count() for a, b in zip(code, c, strict=True)), j) for (m, j), (c, _, _) in rows.items() if m == image and j != i)
        for d, j in near[: k - 1]:
            _, u, v = rows[image, j]
            if d <= at and (x - u) ** 2 + (y - v) ** 2 >= apart * apart:
                out.add((image, min(i, j), max(i, j), d))
    return out


@pytest.mark.parametrize("each", [None, 1, 4, 7])
def test_keypoint_neighbours_equal_brute_force(spark, each):
    rng = random.Random(each or 0)
    rows = {}
    for image in ("a", "b"):
        base = [[rng.getrandbits(64), rng.getrandbits(64)] for _ in range(8)]
        for i in range(60):
            code = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 3, 12, 30])):
                code[rng.randrange(2)] ^= 1 << rng.randrange(64)
            rows[image, i] = (code, rng.randrange(60), rng.randrange(60))
        for i in range(60, 80):  # a third of an image under one code
            rows[image, i] = (base[0], i, i)
    signed = lambda c: [w - (1 << 64) if w >> 63 else w for w in c]
    data = [(m, i, signed(c), x, y, 0) for (m, i), (c, x, y) in rows.items()]
    data += [("a", None, [1, 2], 0, 0, 0), ("a", 900, None, 0, 0, 0), ("a", 901, [1], 0, 0, 0), ("a", 902, [1, None], 0, 0, 0), (None, 903, [1, 2], 0, 0, 0), ("a", 904, [1, 2], None, 0, 0)]
    df = spark.createDataFrame(data + data[:5], "image string, id long, code array<long>, x int, y int, distance int").repartition(3)
    for at, apart in ((3, 0), (2, 25)) if each == 1 else ((31, 0), (20, 25)):
        got = keypoints.hamming_neighbours(df, k=3, at=at, apart=apart, words=2, each=each).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_neighbours(rows, 3, at, apart)
    assert keypoints.hamming_neighbours(df.where("false"), words=2).count() == 0


def test_cost_of_pieces():
    assert all(keypoints.pieces(w, r, n) >= 1 and r // (w * keypoints.pieces(w, r, n)) <= 3 for w, r, n in itertools.product((1, 4), (0, 12, 48, 64), (1, 1000, 10**9)))
    assert keypoints.pieces(4, 48, 10**9) < keypoints.pieces(4, 48, 100)


def greedy(points, radius):
    kept = []
    for s, x, y, i in sorted(points, reverse=True):
        if all((x - u) ** 2 + (y - v) ** 2 >= radius * radius for _, u, v, _ in kept):
            kept.append((s, x, y, i))
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_suppression_equals_the_greedy_pass(spark, seed):
    rng = random.Random(seed)
    groups = {g: [(float(rng.randrange(6)), float(rng.randrange(-40, 40)), float(rng.randrange(40)), i) for i in range(n)] for g, n in (("a", 150), ("b", 1), ("c", 60))}
    groups["hot"] = [(float(rng.randrange(30)), rng.random(), rng.random(), i) for i in range(400)] + [(1.0, 9.0, 9.0, 400), (2.0, 9.0 + 7.0, 9.0, 401)]
    groups["ramp"] = [(float(i), float(2 * i), 0.0, i) for i in range(25)]
    rows = [(g, i, x, y, s, "x") for g, ps in groups.items() for s, x, y, i in ps]
    bad = [("a", None, 1.0, 1.0, 99.0, "x"), ("a", 1000, float("nan"), 1.0, 99.0, "x"), ("a", 1001, 1.0, None, 99.0, "x"), ("a", 1002, 1.0, 1.0, None, "x"), (None, 1, 1.0, 1.0, 9.0, "x")]
    df = spark.createDataFrame(rows + rows[:9] + bad, "group string, id long, x double, y double, strength double, rank string").repartition(3)
    got = {}
    for r in suppression.suppress(df, 7.0).orderBy("group", "rank").collect():
        got.setdefault(r.group, []).append((r.strength, r.x, r.y, r.id))
    assert got == {g: greedy(ps, 7.0) for g, ps in groups.items()}
    if seed == 0:
        assert suppression.suppress(df.where("false"), 7.0).count() == 0
        assert suppression.suppress(df, 7.0, limit=2).where("rank > 2").count() == 0
        assert suppression.suppress(df.where("group = 'c'"), 0.0).count() == 60


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_of_written_codes_are_never_gathered_on_the_driver(spark):
    """A written table is small in bytes, its look-ups are not."""
    codes = written(spark.createDataFrame([("a", [i * 7919], [i]) for i in range(50)], "image string, code array<long>, ids array<long>"))
    plan = _plan(keypoints.near_codes(codes, 20, 1, 7))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    points = written(spark.createDataFrame([(i, "a", [i * 7919], i, i) for i in range(50)], "id long, image string, code array<long>, x int, y int"))
    assert "Broadcast" not in _plan(keypoints.hamming_neighbours(points, at=20, apart=2.0))


def test_suppression_never_gathers_its_cells_on_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(suppression, "written", lambda df: plans.append(_plan(df)) or written(df))
    points = written(spark.createDataFrame([("a", i, float(i % 30), float(i % 7), float(i % 5)) for i in range(60)], "group string, id long, x double, y double, strength double"))
    assert suppression.suppress(points, 4.0).count() > 0
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
