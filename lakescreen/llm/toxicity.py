"""Toxicity: bags of subword embeddings averaged into a linear softmax.

The character n-grams of a text's words (3 to 6 bytes, lower-cased, boundaries included) are hashed into buckets; the text is
the mean of its buckets' embeddings, and a linear softmax over the two classes gives its probability. Embeddings and softmax
are trained jointly in numpy, by Adagrad; rows set aside choose the epoch. Misspelt words share most n-grams with the words
they stand for. For scoring, embedding and softmax are multiplied into one weight for each bucket.

Bounds: the model is fitted on at most ``max_rows`` labelled documents and ``max_bytes`` of text, chosen by a hash of doc_id,
toxic and other rows alike up to half each, with weights that give back the share of toxic ones. A document teaches by its
first ``max_bytes`` / ``LONG`` bytes at most, so that no single one takes the room of the others; only rows that have a text are chosen.
Scoring covers every document and its whole text.

Defined cases: a text that is null, or has no n-gram, gets the score of the bias alone; a label that is null, or a labelled
document that is missing, teaches nothing; without both labels among the rows that teach, all scores are the share of
toxic rows (0 without any). Repeated rows are scored each; in teaching, a doc_id counts once. Further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, held_out, mix64, texts

BITS, DIM, SIZES, SCALE, DECAY = 17, 4, (3, 4, 5, 6), 100.0, 1e-4
BUCKETS = 1 << BITS
LONG = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20  # anything in ASCII but letters and digits ends a word
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def subwords(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram of each word, boundaries included."""
    n, rows = len(raw), len(at) - 1
    row_of = np.repeat(np.arange(rows), np.diff(at))
    spaced = np.full(n + rows + 1, 0x20, np.uint8)  # a boundary before and after each row
    spaced[np.arange(n) + row_of + 1] = _FOLD[raw]
    row_of = np.repeat(np.arange(rows + 1), np.append(np.diff(at) + 1, 1))
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 0x20) | (spaced[:-1] != 0x20)
    text, row = spaced[keep], row_of[keep]
    edge = text == 0x20
    word = np.cumsum(edge)
    codes = text.astype(np.uint64) + np.uint64(1)
    gram, buckets, places = codes, [], []
    for size in range(2, max(SIZES) + 1):
        gram = gram[:-1] * np.uint64(0x100000001B3) + codes[size - 1 :]
        if size in SIZES and len(gram):
            ok = np.flatnonzero(word[: len(gram)] == word[size - 2 : size - 2 + len(gram)])  # no boundary inside
            buckets.append((mix64(gram[ok]) >> np.uint64(64 - BITS)).astype(np.int32))
            places.append(row[ok + 1])  # the first may be the boundary of the row before
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(places)


def logits(weights: np.ndarray, bias: float, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The difference of the two classes' logits for each row; a row without n-grams has the bias."""
    bucket, row = subwords(raw, at)
    rows = len(at) - 1
    return np.bincount(row, weights[bucket], rows) / np.maximum(np.bincount(row, minlength=rows), 1) + bias


@dataclass
class Model:
    """Per bucket, the difference of the two classes' logits: the embedding times the softmax weights."""

    weights: np.ndarray
    bias: float


def fit(documents: list[bytes], labels: np.ndarray, prior: float, epochs: int = 10, rate: float = 0.15, seed: int = 7) -> Model:
    """Joint training by Adagrad. prior is the share of label 1 before rows were chosen."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        p = min(max(prior, 1e-4), 1 - 1e-4)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    weight_of = np.array([(1 - prior) / (1 - y.mean()), prior / y.mean()])
    at = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    raw = np.frombuffer(b"".join(documents), np.uint8)
    size, parts, seen_in = np.zeros(len(y)), [], np.zeros(BUCKETS, np.int64)
    for lo, hi in chunks(at):
        bucket, row = subwords(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        size[lo:hi] = np.bincount(row, minlength=hi - lo)
        cell, count = np.unique(row * BUCKETS + bucket, return_counts=True)
        row, bucket = cell // BUCKETS, cell % BUCKETS
        seen_in += np.bincount(bucket, minlength=BUCKETS)
        parts.append(((row + lo).astype(np.int32), bucket.astype(np.int32), (count / size[row + lo]).astype(np.float32)))
    # an n-gram says something only if it occurs in several documents; the others have weight 0
    common = seen_in >= max(2, min(8, len(y) // 200))
    for k, (row, bucket, value) in enumerate(parts):
        keep = common[bucket]
        parts[k] = row[keep], bucket[keep], value[keep]
    columns = [list(x) for x in zip(*parts, strict=True)]
    parts.clear()
    joined = []
    for column in columns:  # one at a time, so that little is held twice
        joined.append(np.concatenate(column))
        column.clear()
    row, bucket, value = joined
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    embed = rng.normal(0, 0.01, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    sums = [np.full_like(embed, 1e-8), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)]
    aside = np.arange(len(y)) % 6 == 5  # these rows choose the epoch
    taught = np.flatnonzero(~aside)
    best, least = Model(np.zeros(BUCKETS), 0.0), np.inf
    for _ in range(epochs):
        order = rng.permutation(taught)
        for k in range(0, len(order), 64):
            chosen = order[k : k + 64]
            lengths = begin[chosen + 1] - begin[chosen]
            of = np.repeat(np.arange(len(chosen)), lengths)
            index = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin[chosen], lengths)
            b, v = bucket[index], value[index] * SCALE
            mean = np.stack([np.bincount(of, embed[b, d] * v, len(chosen)) for d in range(DIM)], 1)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.eye(2)[y[chosen]]) * weight_of[y[chosen]][:, None] / len(chosen)
            back = error @ soft.T
            grads = [np.stack([np.bincount(b, back[of, d] * v, BUCKETS) for d in range(DIM)], 1) + DECAY * embed, mean.T @ error, error.sum(0)]
            for parameter, total, grad in zip((embed, soft, bias), sums, grads, strict=True):
                total += grad**2
                parameter -= rate * grad / np.sqrt(total)
        folded, shift = (embed @ (soft[:, 1] - soft[:, 0])) * common * SCALE, float(bias[1] - bias[0])
        logit = np.bincount(row, folded[bucket] * value, len(y)) + shift
        loss = (np.logaddexp(0, np.where(y == 1, -logit, logit)) * weight_of[y])[aside].mean() if aside.any() else 0.0
        if loss < least:
            best, least = Model(folded, shift), loss
    return best


def teach(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 8 << 20) -> Model:
    """Fit on the rows of labels outside the held-out fold, within the bounds of the module's description."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.agg(F.count("*"), F.avg((F.col("toxic") == 1).cast("double"))).first()
    prior = total[1] or 0.0
    order = F.xxhash64("doc_id")
    half = max_rows // 2
    bound = max(1, max_bytes // LONG)
    taught = docs.where("text is not null").select("doc_id", F.least(F.octet_length("text"), F.lit(bound)).alias("bytes")).join(known, "doc_id")
    taught = taught.groupBy("doc_id", "toxic").agg(F.max("bytes").alias("bytes"))
    picked = taught.where("toxic = 1").orderBy(order).limit(half).unionByName(taught.where("toxic != 1").orderBy(order).limit(half))
    fits = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = picked.withColumn("sum", F.sum("bytes").over(fits)).where(F.col("sum") <= max_bytes // 2).select("doc_id", "toxic")
    # so many characters hold so many bytes at least
    rows = docs.select("doc_id", F.substring("text", 1, bound).alias("text")).join(F.broadcast(fitting), "doc_id").where("text is not null").collect()
    rows = sorted({r.doc_id: r for r in rows}.values(), key=lambda r: r.doc_id)
    return fit([r.text.encode()[:bound] for r in rows], np.array([int(r.toxic == 1) for r in rows]), prior)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column score (or named otherwise; one of that name is replaced): the probability of label 1, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            raw, at = texts(batch.column(batch.schema.get_field_index("text")))
            parts = [logits(weights, bias, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in chunks(at, 1 << 19)]
            z = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, name])

    columns = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields)
    return columns.mapInArrow(apply, f"{schema}, `{name}` DOUBLE")
