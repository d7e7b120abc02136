"""Benchmark decontamination: rare n-gram seeds point to test items, then Smith-Waterman alignment scores the passages.

1. Words are lower-cased and without outer punctuation. How often each word of the items occurs is counted over all documents in Spark.
2. A passage is a leak if its best local alignment with the item (match +2, other word -1, gap -1) has ``threshold`` of what the whole item scores with
   itself, and not less than ``least`` words have, or the whole item if it is shorter. Such a passage may lack a known number of the item's
   words and is of bounded length. So of the item's r rarest words it holds r less that number, close together. Each item's r is chosen by the
   counts. These words are the seeds: n-grams of one word, as edits of every other word leave no longer one.
3. Documents look their words up among the seeds. Where enough seeds of one item stand close enough, the whole stretch that a passage with
   them can reach is aligned with the item. No passage above the threshold is lost.

Test items are sent to the tasks in blocks of at most ``block_bytes`` of text, or one longer item; a larger test set takes as many times two passes
over the corpus as it has blocks, so its size is never bounded by memory. Documents are not shuffled at all.

Defined cases: null and empty texts and items match nothing; repeated rows are reported each; documents and items with a null id take part
under it; items that are repeated are reported each; of several best alignments of a pair the first that is found counts; empty tables give no pairs; other
columns are not read by ``contaminated`` and pass through ``flagged``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts, word_hashes, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[[c for c in range(128) if not chr(c).isalnum()]] = 0x20  # outer and inner punctuation parts words
MATCH, MISS, GAP = 2, -1, -1
#: Pairs of a rare word and an item that are looked at together.
PAIRS = 1 << 17


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    plain = _LOWER[raw]
    start, end, row = words(plain, at)
    return word_hashes(plain, start, end), row


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best Smith-Waterman score over its maximum 2 * len(item), and the end of that alignment in the passage."""
    steps = np.arange(1, len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISS), above[1:] + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row - GAP * steps) + GAP * steps  # gaps in the item
        above = np.concatenate([[0], np.maximum(row, 0)])
        k = int(above.argmax())
        if above[k] > best:
            best, end = above[k], k
    return best / (MATCH * max(1, len(item))), end


@dataclass
class Item:
    """A test item: its words, the least score points of a passage, how many of its rare words such a passage holds, and within how many words."""

    item_id: object
    words: np.ndarray
    needed: float
    hits: int
    window: int
    kinds: np.ndarray  # its different words, and how often it has each
    has: np.ndarray


@dataclass
class Block:
    """Items, and their rare words: sorted hashes with the items of each, items[of[first[i]:first[i + 1]]]."""

    items: list[Item]
    hashes: np.ndarray
    first: np.ndarray
    of: np.ndarray


def _expected(rates: np.ndarray, hits: int, window: int) -> float:
    """About how often by chance, a word of the corpus, a window begins with a hit and has as many as asked for; a hit alone costs a thousandth of that."""
    mean, term, below = rates.sum() * window, math.exp(-min(700.0, rates.sum() * window)), 0.0
    for k in range(hits - 1):
        below += term
        term *= mean / (k + 1)
    return rates.sum() * (0.001 + max(0.0, 1.0 - below))


def _prepared(item_id: object, w: np.ndarray, rate: np.ndarray, threshold: float, least: int) -> tuple[Item, np.ndarray]:
    """The item, and those of its words that are looked up.

    A passage of score s (of MATCH points a word) has s * n of the item's n words at least, and is no longer than (3 - 2 * s) * n words, as each further word
    takes a point. It may lack n less that many; so of the item's r rarest words it holds r less what it may lack. r is chosen to make alignments rare.
    """
    n = len(w)
    share = max(threshold, min(1.0, least / n))
    lack = n - math.ceil(share * n - 1e-9)
    window = max(1, math.floor((3 - 2 * share) * n + 1e-9))
    rare = np.lexsort([np.arange(n), w, rate])
    sizes = sorted({lack + 1 + (n - lack - 1) * k // 11 for k in range(12)})
    r = min(sizes, key=lambda r: (_expected(rate[rare[:r]], r - lack, window), r))
    return Item(item_id, w, share * MATCH * n - 1e-9, r - lack, window, *np.unique(w, return_counts=True)), np.unique(w[rare[:r]])


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each word of the (sorted) vocabulary occurs in all documents, and the number of all words."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            raw, at = texts(batch.column(0))
            for lo, hi in chunks(at):
                hashes, _ = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                k = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                total[:size] += np.bincount(k[vocabulary[k] == hashes], minlength=size)
                total[size] += len(hashes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["word", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "word INT, n BIGINT").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.word] = r.n
    return out[:size], int(out[size])


def _block(docs: DataFrame, rows: list, threshold: float, least: int) -> Block:
    """The items' words, and those that are rare in docs."""
    listed = [(r.item_id, tokens(np.frombuffer(t := (r.text or "").encode(), np.uint8), np.array([0, len(t)]))[0]) for r in rows]
    listed = [(i, w) for i, w in listed if len(w)]
    if not listed:
        return Block([], np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    vocabulary = np.unique(np.concatenate([w for _, w in listed]))
    counts, total = _counts(docs, vocabulary)
    rate = counts / max(1, total)
    items, hashes, of = [], [], []
    for item_id, w in listed:
        item, rare = _prepared(item_id, w, rate[np.searchsorted(vocabulary, w)], threshold, least)
        hashes.append(rare)
        of.append(np.full(len(rare), len(items)))
        items.append(item)
    h, k = np.concatenate(hashes), np.concatenate(of)
    by = np.lexsort([k, h])
    keys, first = np.unique(h[by], return_index=True)
    return Block(items, keys, np.append(first, len(by)), k[by])


def _windows(block: Block, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Item, row, first and last word (exclusive) of the stretches of documents where a passage may lie."""
    k = np.searchsorted(block.hashes, hashes)
    k[k == len(block.hashes)] = 0
    hit = np.flatnonzero(block.hashes[k] == hashes) if len(block.hashes) else np.zeros(0, np.int64)
    need, reach = np.array([i.hits for i in block.items]), np.array([i.window for i in block.items])
    lo = 0
    while lo < len(hit):  # as many hits at once as make PAIRS with their items, in whole rows
        count = block.first[k[hit[lo:]] + 1] - block.first[k[hit[lo:]]]
        hi = lo + max(1, int(np.searchsorted(np.cumsum(count), PAIRS, "right")))
        hi = int(np.searchsorted(row[hit], row[hit[hi - 1]], "right"))
        part, count = hit[lo:hi], count[: hi - lo]
        lo = hi
        item = block.of[np.repeat(block.first[k[part]] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        place = np.repeat(part, count)
        by = np.lexsort([place, row[place], item])
        item, place = item[by], place[by]
        last = np.arange(len(place)) + need[item] - 1
        whole = last < len(place)
        last[~whole] = 0
        good = np.flatnonzero(whole & (item[last] == item) & (row[place[last]] == row[place]) & (place[last] - place < reach[item]))
        if not len(good):
            continue
        of, start, stop = item[good], place[last[good]] - reach[item[good]] + 1, place[good] + reach[item[good]]
        cut = np.flatnonzero((of[1:] != of[:-1]) | (row[place[good]][1:] != row[place[good]][:-1]) | (start[1:] > stop[:-1])) + 1
        for a, z in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(good)]]), strict=True):
            r = int(row[place[good[a]]])
            yield int(of[a]), r, int(start[a]), int(stop[z - 1])


def _passage(item: Item, hashes: np.ndarray, first: int) -> tuple[float, int, int] | None:
    """Score, start and end of the best alignment of an item in a stretch that begins at word first of its document."""
    # a word matches as often as both sides have it, so this bounds the score
    k = np.minimum(np.searchsorted(item.kinds, hashes), len(item.kinds) - 1)
    seen = np.bincount(k[item.kinds[k] == hashes], minlength=len(item.kinds))
    if MATCH * np.minimum(seen, item.has).sum() < item.needed:
        return None
    value, to = align(item.words, hashes)
    if value * MATCH * len(item.words) < item.needed:
        return None
    # the same alignment read backwards ends where it begins
    back = align(item.words[::-1], hashes[:to][::-1])[1]
    return value, first + to - back, first + to


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float, least: int, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of block_bytes of text; the driver holds one block at a time. There is one block at least."""
    rows, held, made = [], 0, False
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator(prefetchPartitions=False):
        size = len(r.text)
        if rows and held + size > block_bytes:
            yield _block(docs, rows, threshold, least)
            rows, held, made = [], 0, True
        rows.append(r)
        held += size
    if rows or not made:
        yield _block(docs, rows, threshold, least)


def _found(block: Block, column: pa.Array) -> tuple[list[tuple], list[int]]:
    """The pairs of one batch of texts (item, score, start, end), and the row of each."""
    raw, at = texts(column)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for lo, hi in chunks(at):
        hashes, row = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        for k, r, start, stop in _windows(block, hashes, row):
            first, end = np.searchsorted(row, [r, r + 1])
            start, stop = max(int(first), start), min(int(end), stop)
            found = _passage(block.items[k], hashes[start:stop], start - int(first))
            if found and found[0] > best.get((lo + r, k), (0.0,))[0]:
                best[lo + r, k] = found
    return [(block.items[k].item_id, *v) for (_, k), v in best.items()], [r for r, _ in best]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 3, threshold: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, score (0 to 1), start and end (words of the document, end exclusive) of the best alignment of each pair that aligns."""
    slim = docs.select("doc_id", "text")
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for block in _blocks(docs, benchmark, threshold, least, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, ids = _found(shared.value, batch.column(1))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(ids)), pa.array([f[0] for f in found]), pa.array([float(f[1]) for f in found]), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                        ["doc_id", "item_id", "score", "start", "end"],
                    )

        one = slim.mapInArrow(search, f"doc_id {kinds[0]}, item_id {kinds[1]}, score DOUBLE, start INT, end INT")
        out = one if out is None else out.unionByName(one)
    return out


def flagged(docs: DataFrame, benchmark: DataFrame, name: str = "leak", least: int = 3, threshold: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with a boolean column name: whether any item aligns with the text. Rows stay where they are: nothing is joined or shuffled."""
    out = docs.withColumn(name, F.lit(False))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for block in _blocks(docs, benchmark, threshold, least, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flag = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).copy()
                flag[_found(shared.value, batch.column(batch.schema.get_field_index("text")))[1]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(flag, pa.bool_())], batch.schema.names)

        out = out.mapInArrow(mark, schema)
    return out
