"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, verified multiset overlap, connected classes.

A text is the multiset of its five-word shingles (all its words, if fewer). Two texts are linked if their weighted Jaccard
similarity, sum of least counts over sum of greatest counts, is at least ``threshold``.

Signature. Over (time, weight) each shingle has a Poisson process of points, one for each unit of time and weight, seeded by the shingle
alone; a point below the shingle's count belongs to the text. The process is laid out in weight levels (0, 1], (1, 2], (2, 4],
(4, 8] and so on, discretised to whole weights, so a count of w needs about log2(w) processes, the highest one thinned at w. Each point falls
on one of ``SIGNATURE`` components, and a component keeps its earliest point. Two texts agree in a component with
probability equal to their weighted Jaccard similarity. Points are made in order of time up to a horizon at which
nearly all components are filled; texts with empty components go on to the double horizon, so most shingles cost one hash.

Search. Equal texts become one representative first, however many there are. Signatures are cut into BANDS bands of ROWS components;
representatives with an equal band share a bucket, and each pair that shares a bucket is compared, once. In a bucket of at most ``SMALL``
the pairs are rows, without those whose sizes alone keep them below the threshold. Members of larger buckets meet in tiles of at most about
``PART`` by ``PART`` texts and ``ELEMENTS`` shingles a side: a tile counts the shingles that its texts share by one matrix product, compares
the pairs that share a larger bucket and no small one, and gives back a number of links for each text and a star of each class that it saw, so
that what leaves it grows with its texts and not with its pairs. Tiles are cut from all texts that larger buckets join, or from each such
bucket by itself where that is fewer pairs; a pair then belongs to the first larger bucket that it shares. Comparing a group of n texts takes
about n * n / 2 comparisons, and each text is sent to n / PART tiles.
Candidates are verified on the full shingle multisets. Texts linked directly or through others form a class,
named by its smallest doc_id.

Defined cases: a text without words (null, empty, blank) is a class of its own, also beside equal ones; a null doc_id takes no part
and is returned with a null class; equal rows have one class; a doc_id that stands beside several texts names each of them, and a
class in which no other doc_id stands is named by it; of the rows of a class exactly one distinct (doc_id, text) is its head; an empty
table gives no rows; other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, chunks, fresh, mix64, texts, window_hashes, word_hashes, words

SHINGLE, BANDS, ROWS, SMALL = 5, 25, 5, 32
PART, ELEMENTS, WHOLE = 256, 1 << 19, 1
#: Rows of one bucket are dealt to this many tasks while buckets are counted and joined.
SALTS = 32
#: Names of texts whose doc_id another text has already; above all doc_ids.
SURROGATE = 1 << 62
SIGNATURE = BANDS * ROWS
_SEED = np.uint64(0x5851F42D4C957F2D)


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each different shingle, sorted by row."""
    start, end, row = words(raw, at)
    hashes = word_hashes(raw, start, end)
    grams, whole = window_hashes(hashes, row, SHINGLE)
    rows, found = [row[: len(grams)][whole]], [grams[whole]]
    n_words = np.bincount(row, minlength=len(at) - 1)
    for n in range(1, SHINGLE):
        short = n_words == n
        if short.any():
            gram, inside = window_hashes(hashes, row, n)
            pick = inside & short[row[: len(gram)]]
            rows.append(row[: len(gram)][pick])
            found.append(gram[pick])
    r, g = np.concatenate(rows), np.concatenate(found)
    by = np.lexsort((g, r))
    r, g = r[by], g[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    return r[first], g[first], np.diff(np.append(first, len(g)))


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, gram: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """rows x SIGNATURE, the earliest time of each component; infinity in rows without shingles."""
    level = np.zeros(len(count), np.int64)
    parts = [(row, gram, np.zeros(len(row), np.int64), count)]
    most = int(count.max()) if len(count) else 0
    k = 1
    while (1 << (k - 1)) < most:
        many = np.flatnonzero(count > (1 << (k - 1)))
        parts.append((row[many], gram[many], np.full(len(many), k), count[many]))
        k += 1
    row, gram, level, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)  # a process covers the weights (low, low + rate]
    rate = np.maximum(low, 1).astype(np.float64)
    key = mix64(gram ^ (_SEED * (level + 1).astype(np.uint64)))
    weight = np.bincount(row, np.minimum(count, low + rate) - low, rows)  # points that count, for each unit of time
    horizon = SIGNATURE * (np.log(SIGNATURE) + 2) / np.maximum(weight, 1)
    out = np.full((rows, SIGNATURE), np.inf)
    time, state, live = np.zeros(len(key)), key.copy(), np.arange(len(key))
    time = -np.log(_uniform(mix64(state))) / rate
    wanted = np.bincount(row, minlength=rows) > 0
    while len(live):
        due = live[time[live] <= horizon[row[live]]]
        while len(due):
            here = mix64(state[due] + np.uint64(1))
            component = (here % np.uint64(SIGNATURE)).astype(np.int64)
            above = low[due] + np.ceil(_uniform(mix64(here)) * rate[due])  # the point's weight, in whole numbers
            kept = above <= count[due]
            np.minimum.at(out, (row[due][kept], component[kept]), time[due][kept])
            state[due] = mix64(state[due] + _SEED)
            time[due] -= np.log(_uniform(mix64(state[due]))) / rate[due]
            due = due[time[due] <= horizon[row[due]]]
        unfilled = wanted & np.isinf(out).any(1)
        horizon[unfilled] *= 2
        live = live[unfilled[row[live]]]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS hashes of the bands."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.full((len(signature), BANDS), _SEED) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out ^ bits[:, :, k])
    return out


def coded(row: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each copy of a shingle as an element of its own, so that set overlap is multiset overlap; rows and elements."""
    copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(row, count), mix64(np.repeat(gram, count) + copy.astype(np.uint64) * _SEED)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, size (its shingles, copies counted) and bands (empty for a text without words)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts(batch.column(2))
            for lo, hi in chunks(at):
                row, gram, count = shingles(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                rows = hi - lo
                values = bands(signatures(row, gram, count, rows))
                has = np.bincount(row, minlength=rows) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[has].ravel().view(np.int64)))
                size = pa.array(np.bincount(row, count, rows).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), size, lists], ["doc_id", "digest", "size", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("digest"), "text").mapInArrow(emit, "doc_id LONG, digest STRING, size LONG, bands ARRAY<LONG>")


def _elements(texts_: DataFrame) -> DataFrame:
    """id and elements of (id, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts(batch.column(1))
            for lo, hi in chunks(at):
                row, value = coded(*shingles(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))], ["id", "elements"])

    return texts_.mapInArrow(emit, "id LONG, elements ARRAY<LONG>")


def verified(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """a, b and similarity of the pairs that reach the threshold."""
    left = elements.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = elements.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", (shared / (F.size("ea") + F.size("eb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each text of left shares with each of right.

    Elements that many texts hold are columns of a matrix product, 1,024 at a time; the pairs of texts that hold a rarer one are counted one by one.
    """
    sides = []
    for side in (left, right):
        sizes = np.array([len(e) for e in side])
        sides.append((np.concatenate(side), np.repeat(np.arange(len(side)), sizes)))
    (le, lr), (re_, rr) = sides
    shape = len(left), len(right)
    both = np.intersect1d(le, re_)
    if not len(both):
        return np.zeros(shape)

    def place(e: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(both, e)
        at[at == len(both)] = 0
        hit = both[at] == e
        by = np.argsort(at[hit], kind="stable")
        return at[hit][by], r[hit][by]

    (lc, lr), (rc, rr) = place(le, lr), place(re_, rr)
    ln, rn = np.bincount(lc, minlength=len(both)), np.bincount(rc, minlength=len(both))
    many = ln * rn > shape[0] * shape[1] // 100 + 1
    out = np.zeros(shape, np.float64)
    for at in range(0, int(many.sum()), 1024):
        columns = np.flatnonzero(many)[at : at + 1024]
        rank = np.full(len(both), -1)
        rank[columns] = np.arange(len(columns))
        dense = []
        for c, r, n in ((lc, lr, shape[0]), (rc, rr, shape[1])):
            one = np.zeros((n, len(columns)), np.float32)
            pick = rank[c] >= 0
            one[r[pick], rank[c[pick]]] = 1
            dense.append(one)
        out += dense[0] @ dense[1].T
    pick = ~many[lc]
    lc, lr = lc[pick], lr[pick]
    first = np.cumsum(rn) - rn
    for at in range(0, len(lc), 1 << 14):
        c, r = lc[at : at + (1 << 14)], lr[at : at + (1 << 14)]
        n = rn[c]
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[c], n)
        out += np.bincount(np.repeat(r, n) * shape[1] + rr[index], minlength=shape[0] * shape[1]).reshape(shape)
    return out


def _stars(linked: np.ndarray, names: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(name, least name of its class) for the classes that the links of a tile join; names: those of the rows, then those of the columns."""
    rows = linked.shape[0]
    label = names.copy()
    while True:
        top = np.minimum(label[:rows], np.where(linked, label[None, rows:], SURROGATE * 2 - 1).min(1))
        side = np.minimum(label[rows:], np.where(linked, top[:, None], SURROGATE * 2 - 1).min(0))
        if same:
            top = side = np.minimum(top, side)
        new = np.concatenate([top, side])
        if (new == label).all():
            break
        label = new
    apart = np.flatnonzero(label != names)
    return list(dict.fromkeys(zip(names[apart].tolist(), label[apart].tolist(), strict=True)))


def _tile(threshold: float):
    """Links of one tile by exact multiset overlap: (id, id, number of its links), and (id, least id of its class in the tile, 0)."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, y, cell, by_bucket = (group[c].iloc[0] for c in ("x", "y", "cell", "by_bucket"))
        left, right = group[group["part"] == x], group[group["part"] == y]
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            mine, theirs = left["elements"].to_list(), right["elements"].to_list()
            shared = overlaps(mine, theirs)
            sizes = np.array([len(e) for e in mine])[:, None] + np.array([len(e) for e in theirs])
            linked = shared / (sizes - shared) >= threshold
            if x == y:
                linked = np.triu(linked, 1)
            # of the linked pairs, those that meet in a large bucket and in no small one, here and nowhere else
            a, b = np.nonzero(linked)
            lb, rb = np.stack(left["bands"].to_numpy()), np.stack(right["bands"].to_numpy())
            for at in range(0, len(a), 1 << 14):
                i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                same = lb[i] == rb[j]
                large = same & ((lb[i] & 1) == 1)
                here = large.any(1) & (large == same).all(1)
                if by_bucket:
                    here &= lb[i, large.argmax(1)] == cell
                linked[i[~here], j[~here]] = False
            names = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
            links_ = np.concatenate([linked.sum(1), linked.sum(0)])
            counts = pd.Series(links_).groupby(names).sum()
            out += [(k, k, n) for k, n in counts.items() if n]
            out += [(k, root, 0) for k, root in _stars(linked | linked.T if x == y else linked, names, x == y)]
        return pd.DataFrame(out, columns=["a", "b", "n"])

    return compare


def _in_tiles(members: DataFrame, large: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """What the tiles give of all pairs that share a bucket of large (bucket, id, n, hub, held) and no small one."""
    joined = components(large.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    size = members.select("id", "size")
    named = checkpoint(large.join(joined, "id").join(size, "id").select("bucket", "id", "n", "held", "root", "size"))
    # the sum of n over a group's slots is the sum of the squares of its buckets
    of_ids = named.groupBy("root", "id").agg(F.sum("n").alias("squares"), F.first("size").alias("size"))
    cost = of_ids.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("squares").alias("squares"), F.sum("size").alias("all"))
    named = named.join(cost.withColumn("by_bucket", F.col("m") * F.col("m") > F.col("squares") * WHOLE), "root")
    by_bucket = F.col("by_bucket")
    n, weight = F.when(by_bucket, F.col("n")).otherwise(F.col("m")), F.when(by_bucket, F.col("held")).otherwise(F.col("all"))
    cells = named.select(
        "id", "by_bucket", F.when(by_bucket, F.col("bucket").bitwiseOR(F.lit(1))).otherwise(F.col("root")).alias("cell"), F.greatest(F.ceil(n / PART), F.ceil(weight / ELEMENTS)).alias("parts")
    ).distinct()
    part = cells.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    tiles = part.select("id", "by_bucket", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k"))
    tiles = tiles.select("id", "by_bucket", "cell", "part", F.least("part", "k").alias("x"), F.greatest("part", "k").alias("y"))
    # the lowest bit of a band says whether its bucket is large
    own = members.join(large.groupBy("id").agg(F.collect_list("bucket").alias("large")), "id")
    marked = own.select("id", F.transform("bands", lambda b: F.when(F.array_contains("large", b), b.bitwiseOR(F.lit(1))).otherwise(b.bitwiseAND(F.lit(-2)))).alias("bands"))
    full = tiles.join(marked.join(elements, "id"), "id")
    return full.groupBy("cell", "by_bucket", "x", "y").applyInPandas(_tile(threshold), "a LONG, b LONG, n LONG")


def _crowded(members: DataFrame) -> DataFrame:
    """bucket, id, n, hub (least id) and held (sum of sizes) of each slot whose bucket has several members; no bucket's rows meet in one task."""
    slots = members.select("id", "size", F.explode("bands").alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = slots.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"), F.sum("size").alias("held"))
    whole = salted.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("hub").alias("hub"), F.sum("held").alias("held"), F.collect_list("salt").alias("salts")).where("n > 1")
    return slots.join(whole.select("bucket", F.explode("salts").alias("salt"), "n", "hub", "held"), ["bucket", "salt"]).select("bucket", "id", "n", "hub", "held", "size")


def links(members: DataFrame, docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of the verified links between representatives: (a, b) of enough of them to join the classes, and (id, links), how many each has.

    members: doc_id, digest, id, size and bands of each representative; docs: the rows that hold their texts.
    """
    slots = checkpoint(_crowded(members))
    # what is compared at all is read once more, as shingle multisets; copies of a text stay apart by their doc_ids
    some = members.join(slots.select("id").distinct(), "id").select("doc_id", "digest", "id")
    rows = docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("digest"), "text")
    elements = checkpoint(_elements(rows.join(some, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("id", "text")))
    small = slots.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("ids"))
    near = lambda a: F.filter("ids", lambda b: (b["id"] > a["id"]) & (F.least(a["size"], b["size"]) >= threshold * F.greatest(a["size"], b["size"]) - 1e-9))
    pair = F.flatten(F.transform("ids", lambda a: F.transform(near(a), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")))))
    pairs = small.select(F.explode(pair).alias("p")).select("p.a", "p.b").distinct()
    found = checkpoint(verified(pairs, elements, threshold).select("a", "b"))
    counted = found.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n"))
    large = slots.where(F.col("n") > SMALL).select("bucket", "id", "n", "hub", "held")
    if not large.isEmpty():
        tiled = checkpoint(_in_tiles(members, large, elements, threshold))
        found = found.unionByName(tiled.where("a <> b").select("a", "b"))
        counted = counted.unionByName(tiled.where("a = b").select(F.col("a").alias("id"), "n"))
    return found, counted.groupBy("id").agg(F.sum("n").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id that it is linked to, through any number of links) of each end of an edge (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"))
    both = checkpoint(both)
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = state.join(near, state["id"] == near["a"]).select("id", F.least("root", "near").alias("next"), "root")
        jump = state.select(F.col("id").alias("next"), F.col("root").alias("far"))
        moved = checkpoint(hooked.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("new"), "root"))
        changed = not moved.where("new != root").isEmpty()
        state = moved.select("id", F.col("new").alias("root"))
        if not changed:
            return state


def representatives(rows: DataFrame) -> DataFrame:
    """digest, salts, doc_id (the smallest), id, size and bands of each different text; id is the doc_id, or for further texts of one doc_id a name of its own."""
    exact = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.collect_set("salt").alias("salts"))
    first = Window.partitionBy("doc_id").orderBy("digest")
    own = F.row_number().over(first)
    # a written column: what names a text has to stay the same when a task is run again
    return checkpoint(exact.withColumn("id", F.when(own == 1, F.col("doc_id")).otherwise(F.lit(SURROGATE) + F.monotonically_increasing_id())))


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest doc_id of the class), representative of its exact text, links of that text, digest and head.

    links counts the other different texts that are similar enough; head says whether the row is the (doc_id, text) that stays of its class.
    """
    all_rows = checkpoint(sketch(docs))
    worded = all_rows.where(F.size("bands") > 0).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    exact = representatives(worded.where("doc_id IS NOT NULL"))
    edges, degree = links(exact.drop("salts"), docs, threshold)
    root = components(edges)
    named = exact.select("digest", "salts", "doc_id", "id").join(root, "id", "left").join(degree, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.withColumn("class_id", F.when(F.col("root") < SURROGATE, F.col("root")))
    # a class of further texts only takes the doc_id of its root
    alone = named.where((F.col("root") >= SURROGATE) & (F.col("id") == F.col("root"))).select("root", F.col("doc_id").alias("alone"))
    named = named.join(alone, "root", "left")
    named = named.select(
        "digest",
        F.explode("salts").alias("salt"),
        F.col("doc_id").alias("representative"),
        F.coalesce("class_id", "alone").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (F.col("id") == F.col("root")).alias("first"),
    )
    out = worded.select("doc_id", "digest", "salt").join(named, ["digest", "salt"], "left")
    lost = F.col("doc_id").isNull()
    out = out.select(
        "doc_id",
        F.when(~lost, F.col("class_id")).alias("class_id"),
        F.when(~lost, F.col("representative")).alias("representative"),
        F.when(~lost, F.col("links")).otherwise(0).cast("long").alias("links"),
        "digest",
        (lost | (F.col("first") & (F.col("doc_id") == F.col("representative")))).alias("head"),
    )
    blank = all_rows.where(F.size("bands") == 0)
    blank = blank.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("representative"), F.lit(0).cast("long").alias("links"), "digest", F.lit(True).alias("head"))
    return out.unionByName(blank)


def heads(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each class the row that names it, once; rows with a null doc_id stay, equal ones once.

    Which rows stay is settled on ids and digests; texts are shuffled once.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    name = fresh("_row", docs.columns)
    stay = classes(docs, threshold).where("head").select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("digest", F.lit(""))).alias(name)).distinct()
    return docs.withColumn(name, key).join(stay, name).dropDuplicates([name]).drop(name)
