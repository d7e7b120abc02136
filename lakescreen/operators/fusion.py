"""Fusion of forensic indicators into a risk and a verdict, and robust outliers of tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

# Weights of indicator kinds and factors of severities.
WEIGHTS = {
    "metadata_anomaly": 14.0,
    "ela_inconsistency": 22.0,
    "noise_inconsistency": 20.0,
    "compression_inconsistency": 16.0,
    "copy_paste_inconsistency": 26.0,
    "image_editing_artifact": 18.0,
    "region_anomaly": 15.0,
    "model_verdict": 30.0,
}
SEVERITIES = {"low": 0.35, "medium": 0.7, "high": 1.0}
DEFAULT_WEIGHT = 10.0
TOP = 34.0
BASE = 4.0
CAP = 98.0
AGREE = 0.55


def _of(key: Column, table: dict[str, float], other: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other))


def points(kind: Column, severity: Column, confidence: Column) -> Column:
    return F.least(F.lit(TOP), _of(kind, WEIGHTS, DEFAULT_WEIGHT) * _of(severity, SEVERITIES, 0.0) * (0.5 + 0.5 * confidence))


def fuse(indicators: DataFrame, key: str) -> DataFrame:
    """key, risk, agreeing kinds and verdict. Indicators below the strongest count by points * points / strongest, each to one decimal.

    Optional columns coverage and failures (one value for each key) route to 'inconclusive'.
    """
    rated = F.col("severity") != "info"
    p = F.when(rated, points(F.col("type"), F.col("severity"), F.col("confidence")))
    routed = {"coverage", "failures"} <= set(indicators.columns)
    more = [F.min("coverage").alias("_c"), F.max("failures").alias("_f")] if routed else []
    # one pass: rows of no weight only tell that the key is there
    out = indicators.groupBy(key).agg(
        F.collect_list(p).alias("ps"),
        F.array_sort(F.collect_set(F.when(rated & (F.col("confidence") >= AGREE), F.col("type")))).alias("agreeing"),
        F.bool_or(F.col("severity").isin("medium", "high")).alias("strong"),
        *more,
    )
    most = F.array_max("ps")
    total = F.aggregate(F.array_sort(F.transform("ps", lambda p: F.when(p == most, F.round(p, 1)).otherwise(F.round(p * (p / F.greatest(most, F.lit(1.0))), 1)))), F.lit(0.0), lambda a, x: a + x)
    risk = F.when(F.size("ps") > 0, F.bround(F.least(F.lit(CAP), BASE + 10 * F.sqrt(total)), 1)).otherwise(F.lit(BASE))
    out = out.withColumn("risk", risk)
    verdict = (
        F.when((F.col("risk") >= 55) | (F.size("agreeing") >= 3), "likely_manipulated")
        .when((F.col("risk") >= 20) | F.coalesce("strong", F.lit(False)), "suspicious")
        .otherwise("no_obvious_manipulation")
    )
    if routed:
        verdict = F.when((F.col("_f") >= 3) | (F.col("_c") < 0.45), "inconclusive").otherwise(verdict)
    return out.withColumn("verdict", verdict).select(key, "risk", "agreeing", "verdict")


# What makes an outlier of the error level an indicator, and of how much of the page a strong claim of copying has to be sure.
ELA_CONTRAST, ELA_STRONG, ELA_AREA, ELA_CAP = 2.0, 3.5, 900, 0.6
COPY_BULK = 0.02
SMALL_SHARE = 0.2
# Confidence in a verdict.
UNSURE, CLEAN_CAP, SURE_CAP = 0.2, 0.85, 0.95
MODEL_POINTS, MODEL_SHARE = 30.0, 0.3


def detected(ela: Column, copies: Column) -> Column:
    """ARRAY<STRUCT<type, severity, confidence>> of two detectors' results: ela STRUCT<contrast, area> of the strongest region, and copies STRUCT<severity,
    confidence, agreement>. A null struct is a detector without a finding. Copies on less than 2 % of the page are medium at most."""
    row = lambda kind, severity, confidence: F.struct(F.lit(kind).alias("type"), severity.alias("severity"), confidence.cast("double").alias("confidence"))
    over = ela["contrast"] - ELA_CONTRAST
    level = row("ela_inconsistency", F.when(ela["contrast"] >= ELA_STRONG, "high").otherwise("medium"), F.round(F.least(F.lit(ELA_CAP), 0.3 + over * 0.08), 3))
    thin = (copies["severity"] == "high") & (F.coalesce(copies["agreement"], F.lit(0.0)) < COPY_BULK)
    copied = row("copy_paste_inconsistency", F.when(thin, "medium").otherwise(copies["severity"]), copies["confidence"])
    return F.array_compact(F.array(F.when((over >= 0) & (ela["area"] >= ELA_AREA), level), F.when(copies["severity"].isNotNull(), copied)))


def coverage(usable: Column, small: Column) -> Column:
    """The share of an image that detectors can use; all of it where that is not known, a fifth of that for a small image."""
    return F.coalesce(usable, F.lit(1.0)) * F.when(small, SMALL_SHARE).otherwise(1.0)


def judged(indicators: Column, covered: Column, failures: Column, probability: Column) -> Column:
    """STRUCT<risk, verdict, confidence, tampering_detected, human_review_required, agreeing, contributions> of one image's indicators (type, severity, confidence),
    beside each other in a row, so nothing is shuffled. failures are names of detectors that broke down, probability is a model's or null; an array that is null is
    empty. fuse() does the same for indicators in rows of their own, without a model. Points have one decimal, halves
    (of the number as it is written) rounded up.

    The confidence is one in the verdict: .2 if inconclusive, else it grows with coverage and, unless nothing was found, with the kinds that agree.
    """
    found = F.filter(F.coalesce(indicators, F.array().cast("array<struct<type:string,severity:string,confidence:double>>")), lambda i: i["severity"] != "info")
    sure = lambda i: F.coalesce(i["confidence"], F.lit(0.0))
    rated = F.transform(found, lambda i: F.struct(i["type"].alias("type"), i["severity"].alias("severity"), sure(i).alias("confidence"), points(i["type"], i["severity"], sure(i)).alias("p")))

    def damped(rows: Column) -> Column:
        most = F.array_max(F.transform(rows, lambda r: r["p"]))
        share = lambda p: F.when(p >= most, p).otherwise(p * (p / F.greatest(most, F.lit(1.0))))
        return F.transform(rows, lambda r: F.struct(r["type"].alias("type"), r["severity"].alias("severity"), r["confidence"].alias("confidence"), F.round(share(r["p"]), 1).alias("points")))

    def ruled(rows: Column) -> Column:
        total = 10 * F.sqrt(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["points"]))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability))
        moved = F.when(probability.isNotNull(), total * (1 - MODEL_SHARE) + (total + MODEL_POINTS * clamped) * MODEL_SHARE).otherwise(total)
        agreeing = F.array_sort(F.array_distinct(F.transform(F.filter(rows, lambda r: r["confidence"] >= AGREE), lambda r: r["type"])))
        return F.struct(F.bround(F.least(F.lit(CAP), BASE + moved), 1).alias("risk"), agreeing.alias("agreeing"), F.exists(rows, lambda r: r["severity"].isin("medium", "high")).alias("strong"), rows.alias("rows"))

    def told(r: Column) -> Column:
        broken = F.coalesce(F.greatest(F.size(failures), F.lit(0)), F.lit(0))
        verdict = (
            F.when((broken >= 3) | (covered < 0.45), "inconclusive")
            .when((r["risk"] >= 55) | (F.size(r["agreeing"]) >= 3), "likely_manipulated")
            .when((r["risk"] >= 20) | r["strong"], "suspicious")
            .otherwise("no_obvious_manipulation")
        )
        return F.struct(verdict.alias("verdict"), r.alias("r"))

    def reported(v: Column) -> Column:
        verdict, r = v["verdict"], v["r"]
        agreed = F.least(F.lit(SURE_CAP), (0.45 + 0.12 * F.size(r["agreeing"])) * (0.6 + 0.4 * covered))
        confidence = F.when(verdict == "inconclusive", UNSURE).when(verdict == "no_obvious_manipulation", F.least(F.lit(CLEAN_CAP), 0.5 + covered * 0.35)).otherwise(agreed)
        return F.struct(
            r["risk"].alias("risk"), verdict.alias("verdict"), F.bround(confidence, 3).alias("confidence"), verdict.isin("suspicious", "likely_manipulated").alias("tampering_detected"),
            (verdict != "no_obvious_manipulation").alias("human_review_required"), r["agreeing"].alias("agreeing"), r["rows"].alias("contributions"))

    out = rated
    for step in (damped, ruled, told, reported):
        out = F.element_at(F.transform(F.array(out), step), 1)  # each step's value is computed once
    return out


def medians(df: DataFrame, group: str, value: str, name: str = "median", bins: int = 1024) -> DataFrame:
    """The exact median of each group, written once. A histogram of at most bins rows a group tells the bin of each middle rank; only rows of that bin are
    shuffled, as counts of their values, and ranked. Spans and counts are combined before they are shuffled, so no group's values are held in one place. Nulls and
    NaN take no part."""
    v = F.col(value).cast("double")
    rows = df.select(F.col(group).alias("_g"), v.alias("_v")).where(F.col("_g").isNotNull() & v.isNotNull() & ~F.isnan("_v"))
    span = written(rows.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_all")))
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    placed = rows.join(span, "_g").withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor(share * bins))).otherwise(0).cast("int"))
    # whether rows up to here, and not those before, reach the lower or the upper middle rank
    upto, here = F.col("_upto"), F.col("_n")
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)

    def holds(rank: Column) -> Column:
        return (upto > rank) & (upto - here <= rank)

    histogram = placed.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    middle = histogram.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_g").orderBy("_bin"))).where(holds(low) | holds(high))
    middle = written(middle.select("_g", "_bin", (upto - here).alias("_before"), "_all"))
    inside = placed.select("_g", "_bin", "_v").join(middle, ["_g", "_bin"]).groupBy("_g", "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"))
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_bin").orderBy("_v")))
    return written(ranked.groupBy(F.col("_g").alias(group)).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name)))


def robust_outliers(df: DataFrame, group: str, value: str, at: float = 4.0, floor: float = 0.05) -> DataFrame:
    """Rows whose robust z, (x - median) / (1.4826 * MAD), reaches at; rows with a null group or value, or NaN, are not returned."""
    df = df.where(~F.isnan(F.col(value).cast("double")))
    center = medians(df, group, value)
    spread = medians(df.join(center, group).select(group, F.abs(F.col(value) - F.col("median")).alias("apart")), group, "apart", "mad")
    z = (F.col(value) - F.col("median")) / F.greatest(F.lit(floor), 1.4826 * F.col("mad"))
    return df.join(center, group).join(spread, group).withColumn("z", z).where(F.abs("z") >= at)


def shift_families(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Shifts (dx, dy) counted by direction, reduced by their greatest common divisor."""
    from ..functions.numbers import gcd

    g = F.greatest(F.lit(1).cast("long"), gcd(F.col("dx"), F.col("dy")))
    return pairs.select((F.col("dx") / g).cast("long").alias("fx"), (F.col("dy") / g).cast("long").alias("fy")).groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def circular(df: DataFrame, group: str, degrees: str) -> DataFrame:
    """Circular mean and spread of angles in degrees."""
    a = F.radians(degrees)
    sums = df.groupBy(group).agg(F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    return sums.select(group, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean"), F.degrees(F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(r)))).alias("spread"))


def _best_of_tile(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int, at: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a and b and the similarity of each a's k most similar b; b is in order of ids, so ties go to the smaller one."""
    out = []
    for start in range(0, len(a), 256):
        alike = np.round(a[start : start + 256] @ b.T, 4)
        alike[a_ids[start : start + 256, None] == b_ids] = -2
        rows, cols = np.nonzero(alike >= at)
        values = alike[rows, cols]
        order = np.lexsort((cols, -values, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out.append((rows[turn < k] + start, cols[turn < k], values[turn < k]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def similar_blocks(df: DataFrame, block: str, vector: str, x: str, y: str, k: int = 4, at: float = 0.98, apart: float = 32.0, tile_rows: int = 4096, image: str | None = None) -> DataFrame:
    """Each block's k most similar other blocks of its image (a, b, similarity to 4 decimals, rank; and image, if one is named), of which pairs below
    at or nearer than apart are left out. Without image the table is one.

    All pairs of an image are compared, in one tile, or for an image of more than tile_rows blocks in tiles of about that many by that many, which give
    back k a block; so pairs are neither shuffled nor gathered. Vectors keep their type until a tile reads them. Rows with a null id, vector or image take
    no part; a zero vector is like none; of rows with one id the one with the least place, then the least vector, is the block.
    """
    of = F.lit(0) if image is None else F.col(image)
    kept = df.select(of.alias("image"), F.col(block).cast("long").alias("id"), F.col(vector).alias("v"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kept = kept.where(F.col("image").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull())
    sizes = kept.groupBy("image").agg(F.count(F.lit(1)).alias("n")).select("image", F.greatest(F.lit(1), F.ceil(F.col("n") / tile_rows)).cast("int").alias("stripes"))
    dealt = kept.join(sizes, "image")
    own, every = F.pmod(F.xxhash64("id"), F.col("stripes")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))
    asks = dealt.select(F.lit(True).alias("asks"), "image", own.alias("row"), every.alias("col"), "id", "v", "x", "y")
    rest = dealt.select(F.lit(False).alias("asks"), "image", every.alias("row"), own.alias("col"), "id", "v", "x", "y")

    def once(side: pd.DataFrame) -> pd.DataFrame:
        if side["id"].duplicated().any():
            side = side.assign(_v=[tuple(v) for v in side["v"]]).sort_values(["id", "x", "y", "_v"]).drop(columns="_v")
        return side.drop_duplicates("id").sort_values("id")

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (once(group[group["asks"]]), once(group[~group["asks"]])):
            if side.empty:
                return pd.DataFrame(columns=["image", "a", "b", "similarity", "d2"])
            v = np.stack(side["v"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            sides.append((side["id"].to_numpy(), v / np.where(norm > 0, norm, 1), side["x"].to_numpy(), side["y"].to_numpy()))
        (a_ids, a, ax, ay), (b_ids, b, bx, by) = sides
        i, j, similarity = _best_of_tile(a, b, a_ids, b_ids, k, at)
        return pd.DataFrame({"image": group["image"].iloc[0], "a": a_ids[i], "b": b_ids[j], "similarity": similarity, "d2": (ax[i] - bx[j]) ** 2 + (ay[i] - by[j]) ** 2})

    kind = kept.schema["image"].dataType.simpleString()
    found = asks.unionByName(rest).groupBy("image", "row", "col").applyInPandas(tile, f"image {kind}, a LONG, b LONG, similarity DOUBLE, d2 DOUBLE")
    rank = F.row_number().over(Window.partitionBy("image", "a").orderBy(F.desc("similarity"), "b"))
    ranked = found.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("d2") >= apart * apart))
    return ranked.select(*([] if image is None else [F.col("image").alias(image)]), "a", "b", "similarity", "rank")


def shift_buckets(pairs: DataFrame, image: str, tolerance: float = 4.0, least: int = 6) -> DataFrame:
    """Shifts (dx, dy) of an image's pairs in buckets of tolerance pixels: image, qx, qy, n, and whether the bucket is suppressed, as repeated layouts are.

    Buckets of two pairs or more that lie on one line through the origin, whichever way, are a family; one of ``least`` pairs together is periodic, and all
    buckets on its line are suppressed, whatever their own size. Halves go to the even bucket.
    """
    from ..functions.numbers import gcd

    bucket = lambda c: F.bround(F.col(c) / tolerance, 0).cast("long")
    counted = pairs.select(image, bucket("dx").alias("qx"), bucket("dy").alias("qy")).groupBy(image, "qx", "qy").agg(F.count(F.lit(1)).alias("n"))
    g = F.greatest(F.lit(1).cast("long"), gcd(F.abs("qx"), F.abs("qy")))
    lined = counted.withColumns({"fx": F.floor(F.abs("qx") / g), "fy": F.floor(F.abs("qy") / g)})
    family = Window.partitionBy(image, "fx", "fy")
    return lined.withColumn("suppressed", F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))).over(family), F.lit(0)) >= least).select(image, "qx", "qy", "n", "suppressed")
