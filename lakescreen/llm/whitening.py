"""Embedding whitening from an exact scatter matrix in residue numbers.

Entries are quantised to x = floor(scale * c), a long. The fit list holds each distinct x vector once.

1. Quantised vectors are packed into the fewest bytes that hold them (1, 2, 4 or 8 an entry), made distinct in Spark and written once.
2. Residue-number scatter: each task takes its vectors, with an entry 1 in front, modulo several primes below 2**21, as centred residues.
   Blocks of ``ROWS`` rows are multiplied as doubles, which is exact, as no sum reaches 2**53. Tasks return their sums modulo each
   prime, Spark adds them, and Chinese remaindering gives the integers: the number of vectors, their sums and the scatter matrix.
   There are as many primes as the widest entry and the number of vectors ask for, so nothing is ever rounded or overflows.
3. n * n * V = n * scatter - sums * sums' is exact too; its quotient in double goes to eigh. What reaches the driver has the size of that
   matrix, and of nothing that grows with the rows.
4. Rows are projected where they lie. ``identity_error`` is measured: the whitened fit list's covariance, added up over all tasks.

Defined cases: null and empty vectors and those with null or non-finite entries take no part; nor do vectors of another length than most of
the distinct ones have (ties: the longer); entries beyond a long stand at its ends; equal vectors count once in the fit and each row is
returned; rows with a null id are rows like others. A component without variance (an eigenvalue up to 1e-12 of the trace) has a null
whitened value and no part in identity_error, which is null if no component has any; explained is null if the trace is 0. A
deviation that no long holds is null. An empty table gives no rows; columns but the id and the vector are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

#: Rows of one exact product: ROWS * 2**20 * 2**20 = 2**53.
ROWS = 8192
_LONG = np.iinfo(np.int64)


@dataclass
class Whitener:
    """n fit vectors with per-dimension sums (integers); eigenvalues and unit eigenvectors (columns), falling; trace of the covariance; the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    identity_error: float | None = None

    def varies(self) -> np.ndarray:
        return self.values > 1e-12 * self.trace

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened components of quantised rows, and their deviations."""
        widest = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums))
        if len(self.sums) * widest**2 <= _LONG.max:
            off = self.n * x - np.array(self.sums, np.int64)
            deviation = (off * off).sum(1).tolist()
        else:
            off = self.n * x.astype(object) - np.array(self.sums, object)
            deviation = [int(v) if v <= _LONG.max else None for v in (off * off).sum(1)]
        flat = (off / self.n).astype(np.float64) @ self.vectors
        ok = self.varies()
        out = np.full(flat.shape, np.nan)
        out[:, ok] = flat[:, ok] / np.sqrt(self.values[ok])
        return out, deviation


def primes(over: int) -> list[int]:
    """The largest primes below 2**21, as many as make a product above this."""
    found, product, p = [], 1, (1 << 21) - 1
    small = [q for q in range(2, 1449) if all(q % r for r in range(2, int(q**0.5) + 1))]
    while product <= over:
        if all(p % q for q in small):
            found.append(p)
            product *= p
        p -= 2
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size that has these residues."""
    product = 1
    for p in moduli:
        product *= p
    x = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % product
    return x - product if 2 * x > product else x


def modular_scatter(x: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The upper triangle of X'X modulo each prime."""
    upper = np.triu_indices(x.shape[1])
    out = np.zeros((len(moduli), len(upper[0])), np.int64)
    for k, p in enumerate(moduli):
        for lo in range(0, len(x), ROWS):
            centred = np.mod(x[lo : lo + ROWS], p)
            centred = np.where(centred > p // 2, centred - p, centred).astype(np.float64)
            out[k] = (out[k] + (centred.T @ centred)[upper].astype(np.int64)) % p
    return out


def quantised(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: the rows of that length that take part, and their entries as longs."""
    length = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy().astype(np.int64)
    values = pa.compute.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy()
    at = np.concatenate([[0], np.cumsum(length)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (length > 0) & (bad[at[1:]] == bad[at[:-1]])
    for d in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == d))
        with np.errstate(over="ignore"):
            x = np.floor(values[at[rows][:, None] + np.arange(d)] * scale)
        held = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        yield rows, np.where(x >= 2.0**63, _LONG.max, held)


def packed(x: np.ndarray) -> Iterator[tuple[int, pa.Array]]:
    """Rows as bytes, each in the least width of 1, 2, 4 or 8 bytes an entry that holds it."""
    low, high = x.min(1), x.max(1)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(low >= np.iinfo(f"i{w}").min) & (high <= np.iinfo(f"i{w}").max)] = w
    for w in np.unique(width).tolist():
        part = np.ascontiguousarray(x[width == w].astype(f"<i{w}"))
        size = part.shape[1] * w
        offsets = np.arange(len(part) + 1, dtype=np.int32) * size
        yield w, pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(part.tobytes())])


def unpacked(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The rows of (x, width) as longs."""
    width = batch.column(1).to_numpy()
    parts = [np.zeros((0, d), np.int64)]
    for w in np.unique(width):
        of = batch.column(0).filter(pa.array(width == w))
        parts.append(np.frombuffer(b"".join(of.to_pylist()), f"<i{w}").reshape(-1, d).astype(np.int64))
    return np.concatenate(parts)


def fit_list(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """x (bytes), width and d (entries) of each distinct quantised vector, written to the shared folder."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in quantised(batch.column(0), scale):
                for w, rows in packed(x):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([rows, pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, x.shape[1], np.int32))], ["x", "width", "d"])

    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    vectors.select(vector).mapInArrow(quantise, "x BINARY, width INT, d INT").distinct().write.parquet(folder)
    return spark.read.parquet(folder)


def scatter(rows: DataFrame, d: int, moduli: list[int]) -> list[list[int]]:
    """The exact matrix [1 X]'[1 X] of packed rows with d entries."""
    cells = (d + 1) * (d + 2) // 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = unpacked(batch, d)
            part = modular_scatter(np.hstack([np.ones((len(x), 1), np.int64), x]), moduli)
            total = part if total is None else (total + part) % np.array(moduli)[:, None]
        if total is not None:
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cells, k, np.int32)), pa.array(np.arange(cells, dtype=np.int32)), pa.array(total[k])], ["prime", "cell", "residue"])

    summed = rows.mapInArrow(add, "prime INT, cell INT, residue BIGINT").groupBy("prime", "cell").agg(F.sum("residue").alias("residue"))
    table = np.zeros((len(moduli), cells), object)
    for r in summed.toLocalIterator():
        table[r.prime, r.cell] = int(r.residue)
    full = [[0] * (d + 1) for _ in range(d + 1)]
    for i, j, c in zip(*np.triu_indices(d + 1), range(cells), strict=True):
        full[i][j] = full[j][i] = remaindered([int(v) for v in table[:, c]], moduli)
    return full


def identity_error(rows: DataFrame, d: int, model: Whitener) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components that vary."""
    ok = np.flatnonzero(model.varies())
    if not len(ok):
        return None
    k = len(ok)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = shared.value.project(unpacked(batch, d))[0][:, ok]
            total += w.T @ np.hstack([np.ones((len(w), 1)), w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    summed = rows.mapInArrow(add, "cell INT, value DOUBLE").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(k * (k + 1))
    for r in summed:
        total[r.cell] = r.value
    total = total.reshape(k, k + 1) / model.n
    mean = total[:, :1]  # as good as 0: what project gives is centred
    return float(np.abs(total[:, 1:] - mean @ mean.T - np.eye(k)).max())


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> Whitener | None:
    """The whitener of the distinct quantised vectors; None without any."""
    rows = fit_list(vectors, vector, scale)
    kinds = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"))
    most = kinds.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most.d, most.n
    rows = rows.where(F.col("d") == d).select("x", "width")
    full = scatter(rows, d, primes(2 * n * (1 << (8 * most.width - 1)) ** 2))
    assert full[0][0] == n
    sums = full[0][1:]
    covariance = np.array([[(n * full[i + 1][j + 1] - sums[i] * sums[j]) / n**2 for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(covariance)
    take = np.argsort(-values, kind="stable")[:components]
    basis = basis[:, take]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    model = Whitener(n, sums, np.maximum(values[take], 0.0), basis, float(np.trace(covariance)), scale)
    model.identity_error = identity_error(rows, d, model)
    return model


def whiten(vectors: DataFrame, model: Whitener | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each row that takes part and each component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, x in quantised(batch.column(1), m.scale) if m else ():
                if x.shape[1] != len(m.sums):
                    continue
                white, deviation = m.project(x)
                size, k = white.shape
                explained = np.tile(m.values / m.trace if m.trace > 0 else np.full(k, np.nan), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, m.n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(explained, from_pandas=True),
                        pa.array([m.identity_error] * (size * k), pa.float64()),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"
    return vectors.select(key, vector).mapInArrow(apply, schema.replace(f"`{key}`", "key", 1)).withColumnRenamed("key", key)
