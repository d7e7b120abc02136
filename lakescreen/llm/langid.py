"""Language identification by interpolated Kneser-Ney character models, one for each language.

Text is lower-cased and everything but letters becomes one space. For every language the model holds the probability of a
character after the ORDER - 1 before it, with one absolute discount at each order and continuation counts below the highest.
All languages share sorted arrays of n-gram hashes, beside which stand the log-probabilities of those languages that have the n-gram; what a
language lacks is derived from the order below as it is asked for. A text goes to the language of least cross-entropy per character. The
rejection is calibrated: above the entropy that ``calibrate_at`` of the learned documents stay under, ``identified`` is ``und``; ``best`` always
names the nearest language.

Bounds: learning takes whole documents, the first of each language by a hash of doc_id: ``docs_per_lang`` at most, max_docs / languages at most and
max_bytes / languages of text at most, but one of each language in any case. So every language is taught, and the sample has
``max_bytes`` and one document of each language at most. N-grams are counted in Spark; the model has at most ORDER entries for each character
of the sample, whatever the number of languages. Every eighth document of a language teaches nothing and calibrates the rejection.
Prediction covers every document and its whole text.

Defined cases: a null text, or one without letters (of any plane of Unicode), is ``und`` with score 0; without any learned language all are
``und``; without documents to calibrate by nothing is rejected; documents with a null lang or doc_id teach nothing; repeated rows are
predicted each; an empty table gives no rows; further columns pass through, those of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, held_out, mix64

ORDER = 4
#: Log-probabilities of n-grams in languages that are held at once.
CELLS = 1 << 22
_BITS = np.uint64(16)
UNKNOWN = "und"
_LETTER = np.zeros(1 << 16, bool)
for _c in range(1 << 16):
    _LETTER[_c] = chr(_c).isalpha()


def letters(text: str | None) -> np.ndarray:
    """Code units of the normalised text: letters, one space between words and at both ends; empty if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    ok = _LETTER[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    units = codes.astype(np.uint64)
    if len(high):  # outside the basic plane: letters are folded into 16 bits
        kinds, where = np.unique(codes[high], return_inverse=True)
        ok[high] = np.array([chr(c).isalpha() for c in kinds])[where]
        units[high] = 0xE000 + codes[high] % 0x1000
    if not ok.any():
        return np.zeros(0, np.uint64)
    units[~ok] = 0x20
    units = np.concatenate([[np.uint64(0x20)], units, [np.uint64(0x20)]])
    keep = np.ones(len(units), bool)
    keep[1:] = (units[1:] != 0x20) | (units[:-1] != 0x20)
    return units[keep]


def grams(units: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each unit, units packed by 16 bits; the text is padded with spaces at its start."""
    padded = np.concatenate([np.full(order - 1, 0x20, np.uint64), units])
    out = np.zeros(len(units), np.uint64)
    for k in range(order):
        out = (out << _BITS) | padded[k : k + len(units)]
    return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def kneser_ney(keys: np.ndarray, counts: np.ndarray, units: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For orders 1 to ORDER of one language: sorted n-grams, their probability, sorted contexts, the weight left to the order below."""
    tables: list = [None] * ORDER
    k, c = keys, counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        tables[order - 1] = (k, c)
        if order > 1:  # how many different units come before each shorter n-gram
            k, c = np.unique(k & _mask(order - 1), return_counts=True)
            c = c.astype(np.float64)
    out = []
    for order, (k, c) in enumerate(tables, 1):
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = k >> _BITS if order > 1 else np.zeros(len(k), np.uint64)
        contexts, where, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(where, c)
        left = discount * kinds / total
        if order == 1:
            lower = np.full(len(k), 1.0 / units)
        else:
            below, p = out[-1][:2]
            lower = p[np.searchsorted(below, k & _mask(order - 1))]
        out.append((k, (c - discount) / total[where] + left[where] * lower, contexts, left))
    return out


@dataclass
class Sparse:
    """Sorted hashes, and the languages and values of each: entries first[i]:first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of wanted, language and value of all entries that these keys have."""
        hashed = mix64(wanted)
        at = np.searchsorted(self.hashes, hashed)
        at[at == len(self.hashes)] = 0
        row = np.flatnonzero(self.hashes[at] == hashed)
        n = self.first[at[row] + 1] - self.first[at[row]]
        entry = np.repeat(self.first[at[row]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(row, n), self.lang[entry], self.value[entry]


@dataclass
class Model:
    """For each order the log-probabilities of n-grams and the log-weights that contexts leave to the order below, as far as each language has them."""

    langs: list[str]
    grams: list[Sparse]
    contexts: list[Sparse]
    floor: float
    reject_above: float = np.inf
    sharpness: float = 20.0


def _sparse(tables: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
    """The keys and values of each language, by hash and language."""
    keys = mix64(np.concatenate([k for k, _ in tables]))
    lang = np.repeat(np.arange(len(tables), dtype=np.int32), [len(k) for k, _ in tables])
    by = np.lexsort([lang, keys])
    hashes, first = np.unique(keys[by], return_index=True)
    return Sparse(hashes, np.append(first, len(by)), lang[by], np.concatenate([np.log(v) for _, v in tables]).astype(np.float32)[by])


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: for each language, sorted n-grams of the highest order and how often they occur."""
    langs = sorted(counts)
    units = 2 + len(np.unique(np.concatenate([np.unique(k & _mask(1)) for k, _ in counts.values()])))
    tables = [kneser_ney(*counts[lang], units) for lang in langs]
    of = lambda order, a, b: _sparse([(t[order][a], t[order][b]) for t in tables])
    return Model(langs, [of(o, 0, 1) for o in range(ORDER)], [of(o, 2, 3) for o in range(ORDER)], float(np.log(1 / units)))


def log_probabilities(model: Model, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A row for each n-gram: its log-probability in each language. What a language lacks is what the context leaves times the shorter n-gram."""
    if order == 0:
        return np.full((len(keys), len(model.langs)), model.floor)
    shorter, where = np.unique(keys & _mask(order - 1), return_inverse=True)
    out = log_probabilities(model, shorter, order - 1)[where]
    row, lang, value = model.contexts[order - 1].of(keys >> _BITS)
    out[row, lang] += value
    row, lang, value = model.grams[order - 1].of(keys)
    out[row, lang] = value
    return out


def entropies(model: Model, documents: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character of each document in each language, and the number of characters."""
    out, size = np.full((len(documents), len(model.langs)), np.inf), np.zeros(len(documents), np.int64)
    parts, held, total = [], [], 0
    step = max(1, CELLS // len(model.langs))

    def flush() -> None:
        nonlocal parts, held, total
        if parts:
            keys, where = np.unique(np.concatenate(parts), return_inverse=True)  # a text has few different n-grams
            doc = np.repeat(np.array(held), [len(p) for p in parts])
            sums = np.zeros((len(documents), len(model.langs)))
            for lo in range(0, len(keys), step):
                logs = log_probabilities(model, keys[lo : lo + step])
                mine = np.flatnonzero((where >= lo) & (where < lo + step))
                for a in range(0, len(mine), step):
                    some = mine[a : a + step]
                    begin = np.concatenate([[0], np.flatnonzero(np.diff(doc[some])) + 1])
                    sums[doc[some][begin]] += np.add.reduceat(logs[where[some] - lo], begin, axis=0)
            out[held] = -sums[held] / size[held][:, None]
        parts, held, total = [], [], 0

    for i, text in enumerate(documents):
        units = letters(text)
        size[i] = len(units)
        if len(units):
            parts.append(grams(units, ORDER))
            held.append(i)
            total += len(units)
            if total > 1 << 18:
                flush()
    flush()
    return out, size


def _sample(docs: DataFrame, docs_per_lang: int, max_docs: int, max_bytes: int) -> DataFrame:
    """Text, lang and aside (whether the row only calibrates) of the documents to learn from: the first of each language by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = checkpoint(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    langs = max(1, sizes.count())
    each = max(1, min(docs_per_lang, max_docs // langs))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "bytes")
    # ids alone are ranked. A language of very many documents leaves those of low hashes only, several times more than are wanted
    share = sizes.select("lang", F.least(F.lit(1.0), (4.0 * each + 100) / F.col("n")).alias("share"))
    slim = known.select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    slim = slim.join(F.broadcast(share) if langs <= 1 << 16 else share, "lang").where(F.col("h") < F.col("share") * (1 << 30)).drop("share")
    ranked = slim.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= each)
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("turn") == 1) | (F.col("before") + F.col("bytes") <= max_bytes // langs))
    # every eighth teaches nothing, so never a language's first seven
    taken = chosen.groupBy("doc_id", "lang").agg((F.min("turn") % 8 == 0).alias("aside"))
    few = max(max_docs, langs) <= 1 << 20
    return known.join(F.broadcast(taken) if few else taken, ["doc_id", "lang"]).select("text", "lang", "aside")


def learn(docs: DataFrame, docs_per_lang: int = 1500, calibrate_at: float = 0.999, max_docs: int = 48_000, max_bytes: int = 32 << 20) -> Model | None:
    """The models of all languages in docs; None without any."""
    sample = checkpoint(_sample(docs, docs_per_lang, max_docs, max_bytes))
    teaching = sample.where("NOT aside").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(letters(text), ORDER))
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    summed = teaching.mapInArrow(count, "lang STRING, gram BIGINT, n BIGINT").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(summed):
        return None
    counts = {}
    for lang, part in summed.groupby("lang"):
        keys = part["gram"].to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(keys)
        counts[lang] = keys[by], part["n"].to_numpy()[by]
    model = build(counts)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nats, size = entropies(Model(**shared.value), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(nats.min(1)[size > 0])], ["nats"])

    at = sample.where("aside").select("text").mapInArrow(measure, "nats DOUBLE").agg(F.percentile_approx("nats", calibrate_at, 1000)).first()[0]
    model.reject_above = (at if at is not None else np.inf) * 1.05
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with best, lang (und where rejected), score of best (0 to 1) and nats per character."""
    names = ["best", "identified", "score", "nats"]
    columns = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value) if shared.value else None
        for batch in batches:
            rows = batch.num_rows
            best, lang, score, least = [UNKNOWN] * rows, [UNKNOWN] * rows, np.zeros(rows), [None] * rows
            if m is not None:
                nats, size = entropies(m, batch.column(batch.schema.get_field_index("text")).to_pylist())
                for i in np.flatnonzero(size):
                    j = int(nats[i].argmin())
                    p = np.exp(-m.sharpness * (nats[i] - nats[i, j]))
                    best[i], score[i], least[i] = m.langs[j], 1 / p.sum(), float(nats[i, j])
                    lang[i] = best[i] if nats[i, j] <= m.reject_above else UNKNOWN
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(lang), pa.array(score), pa.array(least, pa.float64())], [*batch.schema.names, *names])

    return columns.mapInArrow(apply, f"{schema}, best STRING, identified STRING, score DOUBLE, nats DOUBLE")
