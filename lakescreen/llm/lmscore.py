"""Cross-entropy difference: each document is scored by two n-gram models, one of the target texts and one of all texts.

Both models have the same vocabulary (the 256 byte values of UTF-8 and an end mark), the same orders, the same smoothing and the same
weight of evidence: background counts are scaled to the target's number of tokens, so that the models differ in what they have seen and not in
how much. The loss of a token is -log p(token | ORDER - 1 tokens before), where p interpolates each order's count with the order below:
(count + STRENGTH * lower) / (context + STRENGTH). A document's score is the mean over its bytes of target loss minus background
loss; the lower, the more the document is like the target texts. At a text's start the context is what there is of it.

Everything that is counted is a table in Spark, keyed by the n-gram itself, so it is exact and grows with the corpus:

1. ``count``: each task sorts the longest n-gram that ends at each byte and sends each different one once; Spark adds them up. All documents
   count; of the target rows a second count is kept.
2. ``losses``: the counts of shorter n-grams are the sums over the longer ones that end with them. Order by order each n-gram is
   joined to its context and to the order below, which gives the losses of both models for each n-gram of the corpus.
3. ``score``: documents are dealt to parts of about ``PART_BYTES`` of text; a part asks for the losses of its different n-grams and is
   grouped with them, one look-up for each byte. Texts are shuffled once. A task holds one part and the losses of its n-grams.

Defined cases: a null or empty text has no tokens and null scores; without target rows (or with null for the flag) the target model is the
background's, and all differences are 0; repeated rows count as often as they are there; other columns pass through ``score``; columns of
its result's names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, fresh, mix64, texts

ORDER, STRENGTH = 6, 8.0
END, TOKEN = 256, 9  # the end mark; bits of a token in a packed n-gram
VOCABULARY = 257
PART_BYTES = 32 << 20
_FLUSH = 1 << 21  # n-grams that a task holds before it sends what it has
_STEP_BYTES = 1 << 18  # text that one numpy step works on: an n-gram has eight times the bytes of its last token


def longest(raw: np.ndarray, at: np.ndarray, end_marks: bool) -> np.ndarray:
    """For each byte (and each row's end, if asked for) the n-gram of up to ORDER tokens that ends there, packed: order, then tokens."""
    sizes = np.diff(at)
    sizes = sizes[sizes > 0] + (1 if end_marks else 0)
    last = np.cumsum(sizes) - 1
    begin = last - sizes + 1
    tokens = np.full(int(sizes.sum()), END, np.uint64)
    if end_marks:
        inside = np.ones(len(tokens), bool)
        inside[last] = False
        tokens[inside] = raw
    else:
        tokens[:] = raw
    gram = tokens  # ORDER tokens are three pairs; those of a row's start have tokens of the row before, which are cut off
    gram[1:] += tokens[:-1] << np.uint64(TOKEN)
    pair = gram.copy()
    for k in range(2, ORDER, 2):
        gram[k:] += pair[:-k] << np.uint64(TOKEN * k)
    gram += np.uint64(ORDER << (TOKEN * ORDER))
    for k in range(1, ORDER):
        short = begin[sizes >= k] + k - 1
        gram[short] = (gram[short] & np.uint64((1 << (TOKEN * k)) - 1)) + np.uint64(k << (TOKEN * ORDER))
    return gram


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each different key of sorted keys begins."""
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return np.flatnonzero(first)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """np.unique by sorting: its own hashing takes several times as long for n-grams."""
    keys = np.sort(keys)
    return keys[_firsts(keys)]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = _firsts(keys)
    return keys[first], np.diff(first, append=len(keys))


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(keys)
    keys = keys[order]
    n = n[order]
    del order
    first = _firsts(keys)
    return keys[first], np.add.reduceat(n, first)


def _count(docs: DataFrame) -> DataFrame:
    """gram and n: how often each longest n-gram occurs in the texts of docs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                keys, n = _add(held)
                for k in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["gram", "n"])

        for batch in batches:
            raw, at = texts(batch.column(0))
            for lo, hi in chunks(at, _STEP_BYTES):
                if at[hi] > at[lo]:
                    held.append(_counted(longest(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], True)))
                if sum(len(h[0]) for h in held) > _FLUSH:
                    held[:] = [_add(held)]
                    if len(held[0][0]) > _FLUSH // 2:
                        yield from send()
        yield from send()

    return docs.select("text").mapInArrow(add, "gram LONG, n LONG").groupBy("gram").agg(F.sum("n").alias("n"))


def count(docs: DataFrame, target: DataFrame) -> DataFrame:
    """gram, background and target: the counts of each longest n-gram over all rows of docs, and over those of target."""
    all_ = _count(docs).select("gram", F.col("n").alias("background"), F.lit(0).cast("long").alias("target"))
    some = _count(target).select("gram", F.lit(0).cast("long").alias("background"), F.col("n").alias("target"))
    return all_.unionByName(some).groupBy("gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def _suffix(order: Column, gram: Column, drop_last: bool) -> Column:
    """The n-gram one token shorter: without its first token, or as the context, without its last."""
    tokens = gram.bitwiseAND((1 << (TOKEN * ORDER)) - 1)
    if drop_last:
        return F.shiftrightunsigned(tokens, TOKEN)
    width = F.element_at(F.array(*[F.lit((1 << (TOKEN * k)) - 1).cast("long") for k in range(ORDER)]), order.cast("int"))
    return tokens.bitwiseAND(width)


def losses(counts: DataFrame) -> DataFrame:
    """gram, background and target: both models' losses of the last token of each longest n-gram.

    The end mark is a token, so the counts of what follows a context add up to the context's own count and probabilities add up to one.
    """
    tokens = F.col("gram").bitwiseAND((1 << (TOKEN * ORDER)) - 1)
    order = F.shiftrightunsigned("gram", TOKEN * ORDER).cast("int")
    start = checkpoint(counts.select(order.alias("order"), tokens.alias("key"), "background", "target"))
    levels, sums = {}, None
    for k in range(ORDER, 0, -1):
        here = start.where(F.col("order") == k).select("key", "background", "target", F.lit(True).alias("asked"))
        if sums is not None:
            shorter = sums.select(_suffix(F.lit(k + 1), F.col("key"), False).alias("key"), "background", "target", F.lit(False).alias("asked"))
            here = here.unionByName(shorter)
        sums = checkpoint(here.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"), F.max("asked").alias("asked")))
        levels[k] = sums
    total = levels[1].agg(F.sum("background").alias("b"), F.sum("target").alias("t")).first()
    all_, some = float(total.b or 0), float(total.t or 0)
    scale = some / all_ if some else 1.0
    background, target = F.col("background") * scale, F.col("target") if some else F.col("background")

    def mixed(n: Column, lower: Column, context: Column) -> Column:
        return (n + STRENGTH * lower) / (context + STRENGTH)

    size = all_ * scale
    below = levels[1].select("key", "asked", background.alias("b"), target.cast("double").alias("t"))
    below = below.select("key", "asked", "b", "t", *[mixed(F.col(c), F.lit(1 / VOCABULARY), F.lit(size)).alias(f"p{c}") for c in "bt"])
    out = []
    for k in range(1, ORDER + 1):
        if k > 1:
            here = levels[k].select("key", "asked", background.alias("b"), target.cast("double").alias("t"), _suffix(F.lit(k), F.col("key"), False).alias("tail"), _suffix(F.lit(k), F.col("key"), True).alias("head"))
            lower = below.select(F.col("key").alias("tail"), F.col("pb").alias("lb"), F.col("pt").alias("lt"))
            context = below.select(F.col("key").alias("head"), F.col("b").alias("cb"), F.col("t").alias("ct"))
            joined = here.join(lower, "tail").join(context, "head")
            below = checkpoint(joined.select("key", "asked", "b", "t", *[mixed(F.col(c), F.col(f"l{c}"), F.col(f"c{c}")).alias(f"p{c}") for c in "bt"]))
        gram = F.col("key").bitwiseOR(F.lit(k << (TOKEN * ORDER)).cast("long"))
        out.append(below.where("asked").select(gram.alias("gram"), (-F.log("pb")).cast("float").alias("background"), (-F.log("pt")).cast("float").alias("target")))
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return table


class Table:
    """n-grams and their losses for look-up: open addressing, at least half of the slots empty."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(grams)).bit_length())
        slots = 1 << self.bits
        # the two losses of a slot are read as one number, which takes half as long as a row of two
        self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        pairs = np.ascontiguousarray(values, np.float32).view(np.uint64)[:, 0]
        slot, left = self.slot(grams), np.arange(len(grams))
        while len(left):
            here = left[self.keys[slot[left]] == 0]  # no n-gram is packed as 0
            self.keys[slot[here]] = grams[here]  # of several for one slot one stays
            left = left[self.keys[slot[left]] != grams[left]]
            slot[left] = (slot[left] + 1) & (slots - 1)
        self.values[slot] = pairs

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return (mix64(grams) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """A row of two losses for each n-gram; all are in the table."""
        slot = self.slot(grams)
        left = np.flatnonzero(self.keys.take(slot) != grams)
        at, wanted = slot[left], grams[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            other = self.keys.take(at) != wanted
            slot[left[~other]] = at[~other]
            left, at, wanted = left[other], at[other], wanted[other]
        return self.values.take(slot).view(np.float32).reshape(-1, 2)


def score(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with n_tokens, target_loss and background_loss (means) and difference, of every whole text; table: the losses of docs' n-grams."""
    names = ["n_tokens", "background_loss", "target_loss", "difference"]
    columns = docs.drop(*names)
    total = columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    kept = columns.columns
    part = fresh("_part", kept)
    dealt = columns.withColumn(part, F.pmod(F.xxhash64("text", *[c for c in ("doc_id",) if c in kept]), F.lit(parts)).cast("int")).repartition(parts, part)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for of, found in held.items():
                keys = _distinct(np.concatenate(found))
                for k in range(0, len(keys), 1 << 16):
                    some = keys[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), of, np.int32)), pa.array(some.view(np.int64))], ["part", "gram"])
            held.clear()

        for batch in batches:
            of = batch.column(batch.num_columns - 1).to_numpy()
            for p in np.unique(of).tolist():
                raw, at = texts(batch.column(batch.schema.get_field_index("text")).filter(pa.array(of == p)))
                for lo, hi in chunks(at, _STEP_BYTES):
                    if at[hi] > at[lo]:
                        held.setdefault(p, []).append(_distinct(longest(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], False)))
            if sum(len(g) for found in held.values() for g in found) > _FLUSH:
                for p, found in held.items():
                    held[p] = [_distinct(np.concatenate(found))]
                if sum(len(found[0]) for found in held.values()) > _FLUSH // 2:
                    yield from send()
        yield from send()

    # all columns go in, so that this reads the very shuffle that the groups below read
    asked = dealt.mapInArrow(ask, "part INT, gram LONG").distinct()
    given = asked.join(table, "gram").repartition(parts, "part")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields)

    def apply(rows: pa.Table, known: pa.Table) -> pa.Table:
        grams = known.column("gram").to_numpy().view(np.uint64)
        values = Table(grams, np.stack([known.column("background").to_numpy(), known.column("target").to_numpy()], 1))
        out = []
        for batch in rows.select(kept).to_batches(max_chunksize=1 << 12):
            raw, at = texts(batch.column(batch.schema.get_field_index("text")))
            n = np.diff(at)
            sums = np.zeros((2, len(n)))
            for lo, hi in chunks(at, _STEP_BYTES):
                if at[hi] > at[lo]:
                    row = np.repeat(np.arange(hi - lo), n[lo:hi])
                    found = values.find(longest(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], False))
                    for which in (0, 1):
                        sums[which, lo:hi] = np.bincount(row, found[:, which], hi - lo)
            background, target = sums / np.maximum(n, 1)
            no = n == 0
            out.append(pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), *[pa.array(x, mask=no) for x in (background, target, target - background)]], [*kept, *names]))
        return pa.Table.from_batches(out)

    both = dealt.groupBy(part).cogroup(given.groupBy("part"))
    return both.applyInArrow(apply, f"{schema}, n_tokens LONG, background_loss DOUBLE, target_loss DOUBLE, difference DOUBLE")
