"""Substring deduplication: repeated windows of words are found by Rabin-Karp hashes and merged into removal intervals.

A window is ``width`` consecutive words of one document. It is repeated if the same words also start earlier, in a smaller
doc_id or earlier in the same document; every word that a repeated window covers is removed.

1. Each window has a seed: the least hash among the ``seed`` words long windows inside it. Equal windows have equal seeds,
   and neighbouring windows mostly share theirs, so there are far fewer seeds than windows. Seeds are counted in Spark; what
   occurs twice or more goes into a bitmap, which tasks receive. It has 8 bits or more for each repeated seed, up to ``MAX_BITS`` (32 MB).
2. Windows whose seed is not in the bitmap occur once. The others are told apart by 128 bits, their seed's hash and their own. A bit
   that is set by chance, or a full bitmap, only lets more windows through to this exact step. Each task settles what it holds: of
   equal windows all but the first are later for sure and leave as intervals of words. The first ones are shuffled by seed, neighbours
   with one seed as one row, and ranked among those of the other tasks. Windows of a hot seed go by their own hash instead, so
   that no seed brings more than a 2**-20 share of all to one task.
3. All later places are sent to their documents as intervals of words and merged.

A passage that a third of all documents share is thus one row for each window and batch of a task, and never one row for each
document in one group. Documents are known by doc_id and a hash of their text.

Defined cases: a null text has no words; documents of fewer than width words lose nothing; a null doc_id comes after all
others; texts that share one doc_id are documents of their own, in order of that hash; equal rows are one document told again, so each
gets its intervals and none is counted as a repeat of the other; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, mix64, texts, window_hashes, word_hashes, words

#: The bitmap of repeated seeds has at most 2**MAX_BITS bits.
MAX_BITS = 28
#: A seed is hot from this count on, or from a 2**-20 share of all counts, if that is more; so there are at most 2**20 hot seeds.
HOT = 4096
_BLOCK = 1 << 16  # bits of one row of the bitmap's table


def _seeds(raw: np.ndarray, at: np.ndarray, width: int, seed: int):
    """Hashes and rows of the words; of each window of width words in one row, its start and its seed's place; the seeds' hashes."""
    start, end, row = words(raw, at)
    hashes = word_hashes(raw, start, end)
    grams, _ = window_hashes(hashes, row, seed)
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes, row, np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    # place of the leftmost least gram among the span grams from each place on, by doubling
    span, size = width - seed + 1, 1
    least = np.arange(len(grams))
    while size * 2 <= span:
        least = _smaller(grams, least[:-size], least[size:])
        size *= 2
    least = _smaller(grams, least[:n], least[span - size : span - size + n])
    whole = np.flatnonzero(row[width - 1 :] == row[:n])
    return hashes, row, whole, least[whole], grams


def _smaller(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.where(values[right] < values[left], right, left)


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def repeated_seeds(docs: DataFrame, width: int, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of bits and bitmap of the seeds that occur at two places or more, and the sorted hashes of the hot ones."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts(batch.column(0))
            for lo, hi in chunks(at):
                _, _, whole, least, grams = _seeds(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width, seed)
                if len(whole):
                    new = np.ones(len(whole), bool)  # windows that share a seed at one place count it once
                    new[1:] = least[1:] != least[:-1]
                    yield pa.RecordBatch.from_arrays([pa.array(grams[least[new]].view(np.int64))], ["seed"])

    twice = checkpoint(docs.select("text").mapInArrow(emit, "seed BIGINT").groupBy("seed").count().where("count > 1"))
    kinds, places = twice.agg(F.count(F.lit(1)), F.sum("count")).first()
    bits = min(max(20, int(8 * kinds).bit_length()), MAX_BITS)
    hot = twice.where(F.col("count") >= max(HOT, (places or 0) >> 20)).select("seed").toPandas()["seed"].to_numpy()
    bit = F.shiftrightunsigned("seed", 64 - bits)
    per_block = twice.select(F.floor(bit / _BLOCK).cast("int").alias("block"), F.pmod(bit, F.lit(_BLOCK)).cast("int").alias("bit")).distinct()
    packed = per_block.groupBy("block").agg(F.collect_list("bit").alias("bits"))  # at most _BLOCK bits each

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for marks in batch.column(1):
                block = np.zeros(_BLOCK, np.uint8)
                block[marks.values.to_numpy()] = 1
                out.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "bits"])

    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in packed.mapInArrow(pack, "block INT, bits BINARY").toLocalIterator():
        bitmap[r.block * _BLOCK // 8 : (r.block + 1) * _BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return bits, bitmap, np.sort(hot.astype(np.int64).view(np.uint64))


def _later(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows that are equal in all keys, the first in the given order, and those that differ from it in place: they start later."""
    by = np.lexsort([*reversed(order), *reversed(keys)])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    differs = np.zeros(len(by), bool)
    for k in order:
        differs |= k[by] != k[head]  # equal rows are the same place
    return np.sort(by[new]), np.sort(by[differs])


def _stretches(row: np.ndarray, place: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the stretches of one row whose places are at most gap apart."""
    cut = np.flatnonzero((row[1:] != row[:-1]) | (np.diff(place) > gap)) + 1
    return np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(row)]]).astype(np.int64) - 1


_PLACES = "doc_id BIGINT, content BIGINT, start INT, stop INT"


def _interval_rows(ids: pa.Array, content: pa.Array, row: np.ndarray, place: np.ndarray, width: int) -> list[pa.Array]:
    """doc_id, content, start and stop of the words that windows at these places cover."""
    a, z = _stretches(row, place, width)
    of = pa.array(row[a])
    return [ids.take(of), content.take(of), pa.array(place[a].astype(np.int32)), pa.array((place[z] + width).astype(np.int32))]


def later_intervals(docs: DataFrame, width: int = 20, seed: int = 6) -> DataFrame:
    """doc_id, content (a hash of the text), start and stop (words): stretches that windows cover which also start earlier."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_seeds(docs, width, seed))
    names = ["key", "doc_id", "content", "start", "stop", "hashes"]

    def settle(ids: pa.Array, content: pa.Array, parts: list) -> Iterator[pa.RecordBatch]:
        """What one task knows of its windows: later ones leave as intervals, the first of each kind goes on to be ranked."""
        key, other, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = pa.compute.fill_null(ids, 0).to_numpy()[row]
        first, later = _later([key, other], [ids.is_null().to_numpy(zero_copy_only=False)[row], doc, content.to_numpy()[row], place])
        if len(later):
            columns = _interval_rows(ids, content, row[later], place[later], width)
            spread = mix64(columns[2].to_numpy().astype(np.uint64) + columns[1].to_numpy().view(np.uint64)).view(np.int64)
            none = pa.nulls(len(spread), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(spread), *columns, none], names)
        k, o, r, p = key[first], other[first], row[first], place[first]
        cut = np.flatnonzero((r[1:] != r[:-1]) | (np.diff(p) != 1) | (k[1:] != k[:-1])) + 1
        begin = np.concatenate([[0], cut])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(k)).astype(np.int32)), pa.array(o.view(np.int64)))
        of, start = pa.array(r[begin]), p[begin].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k[begin].view(np.int64)), ids.take(of), content.take(of), pa.array(start), pa.array(start), lists], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, bitmap, hot = shared.value
        for batch in batches:
            raw, at = texts(batch.column(2))
            parts, held = [], 0
            for lo, hi in chunks(at):
                hashes, row, whole, least, grams = _seeds(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width, seed)
                key = grams[least]
                bit = _bit(key, bits)
                pick = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                whole, key = whole[pick], key[pick]
                if not len(whole):
                    continue
                other = window_hashes(hashes, row, width)[0][whole]
                if len(hot):
                    k = np.searchsorted(hot, key)
                    k[k == len(hot)] = 0
                    is_hot = hot[k] == key
                    key, other = np.where(is_hot, other, key), np.where(is_hot, key, other)
                first = np.searchsorted(row, np.arange(hi - lo), "left")  # of each row's words
                parts.append((key, other, lo + row[whole], whole - first[row[whole]]))
                held += len(whole)
                if held > 1 << 21:
                    yield from settle(batch.column(0), batch.column(1), parts)
                    parts, held = [], 0
            if parts:
                yield from settle(batch.column(0), batch.column(1), parts)

    def rank_seeds(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of whole keys: intervals pass, windows that are not the first of their kind become intervals."""
        t = t.combine_chunks()
        known = t.column("hashes").is_null()
        done = t.filter(known)
        yield from done.select(["doc_id", "content", "start", "stop"]).to_batches()
        t = t.filter(pa.compute.invert(known))
        if not t.num_rows:
            return
        key, start, ids, content = (t.column(c).combine_chunks() for c in ("key", "start", "doc_id", "content"))
        lists = t.column("hashes").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start.to_numpy()[row]
        doc = pa.compute.fill_null(ids, 0).to_numpy()[row]
        _, later = _later([key.to_numpy()[row], lists.flatten().to_numpy()], [ids.is_null().to_numpy(zero_copy_only=False)[row], doc, content.to_numpy()[row], place])
        if len(later):
            yield pa.RecordBatch.from_arrays(_interval_rows(ids, content, row[later], place[later], width), ["doc_id", "content", "start", "stop"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key; the last key of a batch waits for the next one."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))
            if last or (held and held[-1].column(0)[0].as_py() != key[0]):
                yield from rank_seeds(pa.Table.from_batches([*held, batch.slice(0, last)], batch.schema))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from rank_seeds(pa.Table.from_batches(held))

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("content"), "text")
    runs = rows.mapInArrow(emit, "key BIGINT, doc_id BIGINT, content BIGINT, start INT, stop INT, hashes ARRAY<BIGINT>")
    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(rank, _PLACES)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals (end exclusive) of words that these cover."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the rest joined by one space."""
    all_words = text.split()
    if not spans:
        return len(all_words), 0, b" ".join(all_words)
    kept, done = [], 0
    for start, end in spans:
        kept += all_words[done:start]
        done = end
    kept += all_words[done:]
    return len(all_words), len(all_words) - len(kept), b" ".join(kept)


def remove(docs: DataFrame, width: int = 20, seed: int = 6) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_removed, removed (intervals of words, end exclusive), kept (text) and its SHA-256."""
    later = later_intervals(docs, width, seed).groupBy(F.col("doc_id").alias("of"), "content").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    joined = rows.join(later, (F.col("hash") == F.col("content")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    interval = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(x["start"], x["stop"]) for x in s or []]) for s in batch.column(2).to_pylist()]
            out = [kept_words(t or b"", s) for t, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], interval),
                    pa.array([x[2].decode() for x in out], pa.string()),
                    pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "removed", "kept", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words BIGINT, n_removed BIGINT, removed ARRAY<STRUCT<start: INT, end: INT>>, kept STRING, kept_sha256 STRING"
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, schema)
