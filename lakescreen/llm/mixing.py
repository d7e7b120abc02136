"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken x = target / source size times, on average. The whole part of x is taken surely.
The fraction is settled by pivotal rounding on words: two undecided documents exchange expected words, one gaining what the
other loses, in a random direction chosen so that neither expectation changes, until one of them is taken wholly or not at
all. The other goes on to the next. Expected words of a source are kept exactly, so what it yields differs from its target by
less than one document.

Documents are dealt to groups of one source and one hash bucket, so a source with a third of all rows is many groups, and so is one
document that is repeated, as the bucket is that of its id, its text and its number among equal rows. Each
group is settled by one task and leaves one undecided document; what the groups leave is grouped again, level by level,
until one document of each source is left, which chance decides. All randomness is a hash of the seed, the source's rank,
the level and the bucket, so reruns agree.

Targets (``targets``): sources in order of code points, null last, have repeating weights and share ``share`` of all sizes by
weight; a target stops at ``cap`` times its source's size, and the excess is shared again by weight.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, after the others; repeated
rows are documents of their own, which rank by chance among each other; null ids are ids like others; an empty table gives no rows.
Sizes are always counted from the text: a column size of the input is not read, nor are others but those named in ``carry``,
which may have any name but those of the result and any type that can be grouped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, checkpoint

GROUP = 4096


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source: source, rank (from 0), docs, source_size, target.

    With all targets at min(cap * size, level * weight), the common level follows from the sources in order of cap * size / weight:
    those before the first that the level does not fill stand at their caps. Rows are one for each source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = _before(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).withColumn("fill", F.col("most") / F.col("weight"))
    summed = _before(ranked, ["fill", "rank"], {"capped": F.col("most"), "passed": F.col("weight")})
    every = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    left = (every[0] or 0) * share - F.col("capped")
    out = summed.withColumn("level", left / (F.lit(every[1] or 0.0) - F.col("passed")))
    # the level that holds is that of the first source which it does not fill
    first = out.agg(F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level")))).first()[0]
    target = F.col("most") if first is None else F.least("most", F.lit(first["level"]) * F.col("weight"))
    return out.select("source", "rank", "docs", "source_size", target.alias("target"))


def _before(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with running sums of all rows before each in an order without ties. Ranges of rows are summed side by side; the driver adds up one total a range."""
    slim = df.withColumns({f"_{n}": c for n, c in sums.items()})
    ranges = checkpoint(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranges.groupBy("_part").agg(*[F.sum(f"_{n}").alias(n) for n in sums]).orderBy("_part").collect()
    upto, offsets = {n: 0 for n in sums}, []
    for r in totals:
        offsets.append((r["_part"], *upto.values()))
        upto = {n: upto[n] + r[n] for n in sums}
    kinds = {n: slim.schema[f"_{n}"].dataType.simpleString() for n in sums}
    start = df.sparkSession.createDataFrame([(o[0], *[float(v) if k == "double" else v for v, k in zip(o[1:], kinds.values(), strict=True)]) for o in offsets], "_part int, " + ", ".join(f"_{n}_from {k}" for n, k in kinds.items()))
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranges.join(F.broadcast(start), "_part")  # one row a range
    return joined.select(*df.columns, *[(F.col(f"_{n}_from") + F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0).cast(k))).alias(n) for n, k in kinds.items()])


def settle(sizes: np.ndarray, words: np.ndarray, draws: np.ndarray) -> int:
    """Pivotal rounding of expected words (0 < words < sizes), in place: all become 0 or their size, but for the one returned."""
    held = 0
    for j in range(1, len(sizes)):
        a, b, s, t = words[held], words[j], sizes[held], sizes[j]
        up, down = min(s - a, b), min(a, t - b)  # what held may gain from j, or lose to it
        if draws[j] * (up + down) < down:
            if s - a <= b:
                words[held], words[j], settled = s, b - (s - a), held
            else:
                words[held], words[j], settled = a + b, 0.0, j
        elif a <= t - b:
            words[held], words[j], settled = 0.0, b + a, held
        else:
            words[held], words[j], settled = a - (t - b), t, j
        rest = j if settled == held else held
        if words[rest] <= 0.0 or words[rest] >= sizes[rest]:  # both settled at once: the next undecided goes on
            words[rest] = 0.0 if words[rest] <= 0.0 else sizes[rest]
        held = rest
    return held


def _settler(seed: int, level: int, last: bool):
    """The task that settles one group of a level; the last level leaves nothing open."""

    def settle_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "content", "turn"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(group["rank"][0]), int(group["bucket"][0])])
        sizes, words = group["size"].to_numpy(float), group["words"].to_numpy(float).copy()
        draws = rng.random(len(group) + 1)
        left = settle(sizes, words, draws)
        if last:
            words[left] = sizes[left] if draws[-1] * sizes[left] < words[left] else 0.0
        group["words"] = words
        group["more"] = (words >= sizes).astype(np.int32)
        group["open"] = (words > 0) & (words < sizes)
        return group.drop(columns="bucket")

    return settle_group


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 11, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document), and the columns in carry."""
    sized = with_sizes(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("content"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    # equal rows are counted, then told one by one again, so that each has a number of its own
    known = checkpoint(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("times")))
    slim = known.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
    goals = checkpoint(targets(slim, weights, share, cap))
    largest = goals.agg(F.max("docs")).first()[0] or 0
    mixed = slim.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "rank", "docs", "source_size", "target")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    mixed = mixed.withColumn("base", F.floor(rate).cast("int")).withColumn("words", (rate - F.floor(rate)) * F.col("size"))
    sure = (F.col("words") <= 0) | (F.col("words") >= F.col("size"))
    done = [mixed.where(sure).withColumn("more", F.lit(0))]
    open_ = mixed.where(~sure)
    levels = max(1, math.ceil(math.log(max(largest, 2), GROUP)))
    for level in range(levels):
        last = level == levels - 1
        rest = F.ceil(F.col("docs") / float(GROUP ** (level + 1)))
        bucket = F.lit(0) if last else F.pmod(F.xxhash64("doc_id", "content", "turn", F.lit(seed)), rest)
        grouped = open_.withColumn("bucket", bucket.cast("long"))
        schema = grouped.drop("bucket").withColumn("more", F.lit(0)).withColumn("open", F.lit(False)).schema

        settled = checkpoint(grouped.groupBy("rank", "bucket").applyInPandas(_settler(seed, level, last), schema))
        done.append(settled.where("NOT open").drop("open"))
        open_ = settled.where("open").drop("open", "more")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("more")).alias("copies"), *[F.col("carried")[c].alias(c) for c in carry])
