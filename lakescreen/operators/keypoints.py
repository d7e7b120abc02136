"""Neighbours of binary codes by Hamming distance, inside one image.

Codes are hashed by pieces (multi-index hashing). Two codes that differ in at most r of their bits differ in at most floor(r / m) bits of
one of their m pieces at least. Each code is looked up under all values of each piece that near, and what shares a value is compared in
the join itself, so that only pairs that are near leave it, each under its first such piece. Equal codes are one code with its
first keys, so a code that a third of the rows have costs no more than another.

A look-up is many rows in place of a small one, which the sizes that plans know of do not show, so joins are asked to sort and never to gather a
side on the driver; the codes are written once and dealt out evenly before they are looked up.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread, written

WORD = 64


def sign_code(vector: Column) -> Column:
    """A 64-bit word with one bit for each of the first 64 entries of a vector, set where it is above 0."""
    return F.aggregate(F.slice(vector, 1, WORD), F.lit(0).cast("long"), lambda code, v: F.shiftleft(code, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("long")))


def pieces(words: int, radius: int, rows: int) -> int:
    """Pieces of each 64-bit word for which a code is expected to cost least, a look-up counting for ten comparisons. Results do not depend on it."""

    def cost(each: int) -> float:
        width, near = WORD // each, radius // (words * each)
        looks = words * each * sum(math.comb(width, k) for k in range(near + 1))
        return looks * (10 + rows / 2.0**width)

    return min((p for p in (1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 16, 32) if radius // (words * p) <= 3), key=cost, default=32)


def _flips(width: int, near: int) -> list[int]:
    """All values of that many bits with at most near of them set; the highest bit of a word is its sign."""
    return [sum(1 << b if b < WORD - 1 else -1 << b for b in chosen) for k in range(near + 1) for chosen in itertools.combinations(range(width), k)]


def _piece(word: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << width) - 1 if width < WORD else -1).cast("long"))


def near_codes(codes: DataFrame, at: int, words: int, each: int) -> DataFrame:
    """Pairs (image, acode, bcode, distance; acode < bcode) of the distinct codes (image, code) that are at most at bits apart, each once."""
    edges = [WORD * p // each for p in range(each + 1)]
    spans = [(w, lo, hi - lo) for w in range(words) for lo, hi in itertools.pairwise(edges)]
    near = at // len(spans)
    if near > 3:
        raise ValueError(f"{each} pieces a word are too few for {at} bits: each would be looked up with {near} bits changed")
    values = F.array(*[_piece(F.col("code")[w], lo, width) for w, lo, width in spans])
    listed = codes.select("image", F.col("code").alias("bcode"), F.posexplode(values).alias("piece", "value"))
    looked = codes.select("image", F.col("code").alias("acode"), F.posexplode(values).alias("piece", "own"))
    flips = F.lit(None).cast("array<bigint>")
    for width in {s[2] for s in spans}:
        flips = F.when(F.col("piece").isin([n for n, s in enumerate(spans) if s[2] == width]), F.array(*[F.lit(m).cast("long") for m in _flips(width, near)])).otherwise(flips)
    looked = looked.select("image", "acode", "piece", "own", F.explode(flips).alias("flip")).select("image", "acode", "piece", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
    differ = [F.col("acode")[w].bitwiseXOR(F.col("bcode")[w]) for w in range(words)]
    distance = sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0]))
    first = F.lit(None).cast("int")
    for n, (w, lo, width) in reversed(list(enumerate(spans))):
        first = F.when(F.bit_count(_piece(differ[w], lo, width)) <= near, n).otherwise(first)
    # compared where they meet: a row leaves the join only for a pair that is near, under its first piece
    met = looked.join(listed.hint("merge"), ["image", "piece", "value"]).where((F.col("acode") < F.col("bcode")) & (distance <= at) & (F.col("piece") == first))
    return met.select("image", "acode", "bcode", distance.cast("int").alias("distance"))


def hamming_neighbours(
    points: DataFrame, code: str = "code", key: str = "id", image: str = "image", x: str = "x", y: str = "y", k: int = 3, at: int = 48, apart: float = 0.0, words: int = 1, each: int | None = None
) -> DataFrame:
    """Unordered pairs (image, a, b, distance; a < b) where one point is among the k - 1 nearest others of the other in its image (ties: the
    smaller key), at most at bits away. Of these, pairs nearer than apart in the plane are left out. code is an array of ``words`` 64-bit words.

    Rows with a null key, image, code, word or place take no part, nor do codes of another length; of rows with one key and image the least code stands.
    """
    kept = points.select(F.col(image).alias("image"), F.col(key).cast("long").alias("id"), F.col(code).alias("code"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    kept = kept.where((F.size("code") == words) & ~F.exists("code", lambda w: w.isNull()))
    kept = kept.groupBy("image", "id").agg(F.min(F.struct("code", "x", "y")).alias("p")).select("image", "id", "p.*")
    turn = F.row_number().over(Window.partitionBy("image", "code").orderBy("id"))
    codes = kept.select("image", "code", "id").withColumn("turn", turn).where(F.col("turn") <= k).groupBy("image", "code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    codes = written(codes)
    pair = written(near_codes(spread(codes.select("image", "code"), "image", "code"), at, words, each or pieces(words, at, codes.count())))
    ways = (pair.select("image", F.col(f"{a}code").alias("code"), F.col(f"{b}code").alias("other"), "distance") for a, b in ("ab", "ba"))
    met = codes.select("image", "code", F.col("code").alias("other"), F.lit(0).alias("distance"))
    for way in ways:
        met = met.unionByName(way)
    held = codes.select("image", F.col("code").alias("other"), "ids").hint("merge")
    seen = met.join(held, ["image", "other"]).select("image", "code", "distance", F.explode("ids").alias("near"))
    # the k nearest keys of each code, its own among them: all that its rows can ask for
    place = F.row_number().over(Window.partitionBy("image", "code").orderBy("distance", "near"))
    nearest = seen.withColumn("place", place).where(F.col("place") <= k).groupBy("image", "code").agg(F.sort_array(F.collect_list(F.struct("distance", "near"))).alias("nearest"))
    others = F.slice(F.filter("nearest", lambda n: n["near"] != F.col("id")), 1, k - 1)
    found = kept.join(nearest.hint("merge"), ["image", "code"]).select("image", "id", F.explode(others).alias("n"))
    pairs = found.groupBy("image", F.least("id", "n.near").alias("a"), F.greatest("id", "n.near").alias("b")).agg(F.min("n.distance").alias("distance"))
    if not apart:
        return pairs
    at_a, at_b = (kept.select("image", F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")) for s in "ab")
    placed = pairs.join(at_a.hint("merge"), ["image", "a"]).join(at_b.hint("merge"), ["image", "b"])
    return placed.where((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 >= apart * apart).select("image", "a", "b", "distance")
