"""Exact nearest neighbours by a block matrix join with quantised tiles.

Vectors are dealt to tiles by hashes of their ids: queries to columns, candidates to rows, so that a tile holds a bounded part of
both whatever the tables' sizes. In a tile, vectors are quantised to int8 with one scale each. The product of two int8 blocks
gives approximate inner products, and the norms of the quantisation errors bound how far each is from the true one:
|<x, y> - <x', y'>| <= |x'| e(y) + e(x) |y'| + e(x) e(y). A pair survives if its upper bound reaches the query's k-th best so far;
survivors are recomputed from the original vectors in double precision, component after component, and kept in heaps of k.
Each tile returns its heaps, and the k best of all tiles are the result, so nothing is lost to quantisation.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows with a null
id; vectors of different length are not compared; ties go to the smaller id; a query is not its own candidate, whatever rows repeat
its id; repeated candidate rows count once, and an id with several vectors by the best of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

BLOCK = 2048  # candidates of one int8 product


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of what the codes stand for, and norm of the error, for each row."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    # a little is added for rounding in these sums themselves
    return codes, scale, np.linalg.norm(back, axis=1) * (1 + 1e-9), np.linalg.norm(x - back, axis=1) * (1 + 1e-9) + 1e-12 * scale


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of int8 matrices: float32 holds sums of up to 1,000 products of 7-bit numbers without rounding."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1000):
        out += a[:, at : at + 1000].astype(np.float32) @ b[:, at : at + 1000].astype(np.float32).T
    return out


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of components."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def search_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best candidates as (score, -id), in no order."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    if not len(q_ids) or not len(c_ids):
        return heaps
    least = np.full(len(q_ids), -np.inf)
    q_codes, q_scale, q_norm, q_error = quantise(q)
    for at in range(0, len(c), BLOCK):
        ids, part = c_ids[at : at + BLOCK], c[at : at + BLOCK]
        codes, scale, norm, error = quantise(part)
        near = int8_product(q_codes, codes) * (q_scale[:, None] * scale)
        slack = q_norm[:, None] * error + q_error[:, None] * (norm + error)
        low, high = near - slack, near + slack
        other = q_ids[:, None] != ids
        floor = least
        if part.shape[0] > k:  # k candidates of this block are surely as good as their lower bounds
            low[~other] = -np.inf
            floor = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
        rows, cols = np.nonzero((high >= floor[:, None]) & other)
        for start in range(0, len(rows), 1 << 15):
            r, j = rows[start : start + (1 << 15)], cols[start : start + (1 << 15)]
            for query, value, name in zip(r.tolist(), exact(q[r], part[j]).tolist(), ids[j].tolist(), strict=True):
                heap = heaps[query]
                if len(heap) < k:
                    heapq.heappush(heap, (value, -name))
                elif (value, -name) > heap[0]:
                    heapq.heapreplace(heap, (value, -name))
        least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", tile_rows: int = 8192, tile_queries: int = 2048) -> DataFrame:
    """query_id, rank (from 1), the id and score of the k nearest of each query by inner product."""
    # float vectors are sent as they are, at half the size, and widened in the tile without loss
    kind = "array<float>" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    counted = rows.agg(F.count("*"), F.count_if("asks")).first()
    stripes, columns = max(1, -(-counted[0] // tile_rows)), max(1, -(-counted[1] // tile_queries))

    def places(asks: bool, stripe: Column, col: Column) -> Column:
        return F.struct(F.lit(asks).alias("asks"), stripe.cast("int").alias("stripe"), col.cast("int").alias("col"))

    # a row is a candidate in one stripe of every column, and a query, if it asks, in one column of every stripe
    stripe, col = F.pmod(F.xxhash64("id", "v"), F.lit(stripes)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(columns))
    offered = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: places(False, stripe, c))
    asked = F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: places(True, s, col))
    once = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    tiles = once.select("id", "v", F.inline(F.when(F.col("asks"), F.concat(offered, asked)).otherwise(offered))).withColumn("size", F.size("v"))

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in group.groupby("size"):
            asks, rest = same[same["asks"]].drop_duplicates("id"), same[~same["asks"]]
            ids, q_ids = rest["id"].to_numpy(), asks["id"].to_numpy()
            if not len(asks) or not len(rest):
                continue
            q, v = np.stack(asks["v"].to_numpy()).astype(np.float64), np.stack(rest["v"].to_numpy()).astype(np.float64)
            # an id's first vectors, then the second ones and so on: in each search an id has one vector, so that floors count ids
            turn = rest.groupby("id").cumcount().to_numpy()
            for t in range(turn.max() + 1):
                one = np.flatnonzero(turn == t)
                by = one[np.argsort(ids[one], kind="stable")]
                heaps = search_tile(q_ids, q, ids[by], v[by], k)
                out += [(name, -n, s) for name, heap in zip(q_ids.tolist(), heaps, strict=True) for s, n in heap]
        return pd.DataFrame(out, columns=["query_id", "near", "score"])

    found = tiles.groupBy("stripe", "col").applyInPandas(tile, "query_id LONG, near LONG, score DOUBLE")
    found = found.groupBy("query_id", "near").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "near")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("near").alias(id_col), "score")
