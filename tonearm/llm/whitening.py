"""Embedding whitening over an exact scatter matrix from bit slices.

Vectors are whole numbers (fixed point). In blocks of rows each dimension is shifted by its least value there, so all numbers are
non-negative, and cut into bit planes; a plane's bits are packed across rows into 64-bit words. For planes p of dimension d and q of
dimension e, 2^(p+q) popcount(plane AND plane) sums to the exact cross-product of the shifted numbers, from which the shift is taken out
again in whole numbers. Spark adds the blocks' sums, in limbs that cannot overflow; n xx' - SS' is centred as integers and only
then goes to eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.vectors import fixed_point, matrix, whole
from tonearm.llm.worker import tidy
from tonearm.storage import materialize

#: Rows whose bits a task packs at a time: 256 words a plane.
BLOCK = 1 << 14
#: Sums travel as limbs of 32 bits, the last one signed: 224 bits hold any sum of products of longs.
LIMBS = 7
#: Largest whole number that decimal(38, 0) holds.
_MOST = 10**38 - 1


def planes(shifted: np.ndarray) -> np.ndarray:
    """(dims, bits, words) of 64-bit words out of (rows, dims) of non-negative numbers."""
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    rows, dims = shifted.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for p in range(bits):
        packed = np.packbits(((shifted >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=0)
        out[:, p, : len(packed)] = packed.T
    return out.view(np.uint64)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sum of x_d, sum of x_d x_e) of (rows, dims) longs, as Python integers; ``e < d`` mirrors ``d < e``."""
    rows, dims = x.shape
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, so exact for any two longs
    sliced = planes(shifted)
    bits = sliced.shape[1]
    flat = sliced.reshape(dims * bits, -1)
    weight = np.array([1 << k for k in range(bits)], object)
    ones = np.bitwise_count(flat).sum(axis=1, dtype=np.int64).reshape(dims, bits)
    sums = ones.astype(object) @ weight
    # A block's sums of narrow numbers fit a long with room to spare.
    number = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    weight, both = weight.astype(number), np.zeros((dims, dims), number)
    for d in range(dims):
        rest = flat[d * bits :]
        for p in range(bits):
            counts = np.bitwise_count(rest & flat[d * bits + p]).sum(axis=1, dtype=np.int64).reshape(dims - d, bits)
            both[d, d:] += (counts.astype(number) @ weight) * (1 << p)
    both = (np.triu(both) + np.triu(both, 1).T).astype(object)
    low = low.astype(object)
    plain = both + np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + rows * np.multiply.outer(low, low)
    return sums + rows * low, plain


def limbs(value: int) -> list[int]:
    return [*((value >> (32 * k)) & 0xFFFFFFFF for k in range(LIMBS - 1)), value >> (32 * (LIMBS - 1))]


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, sum of xx') of the rows of ``fit`` (a column x of long arrays), exact. Each task sends one row for each pair of dimensions."""
    schema = "d int, e int, " + ", ".join(f"l{k} long" for k in range(LIMBS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = matrix(batch.column(0).slice(at, BLOCK), dims)
                s, c = cross_products(x)
                n, first, second = n + len(x), first + s, second + c
        if n:
            # Row d = -1 has the sums, and the count at e = -1.
            cells = [(-1, -1, n), *[(-1, d, first[d]) for d in range(dims)], *[(d, e, second[d, e]) for d in range(dims) for e in range(d, dims)]]
            d, e, value = zip(*cells)
            parts = list(zip(*map(limbs, map(int, value))))
            yield pa.record_batch([pa.array(d, pa.int32()), pa.array(e, pa.int32()), *[pa.array(p, pa.int64()) for p in parts]], names=["d", "e", *[f"l{k}" for k in range(LIMBS)]])

    sums = fit.mapInArrow(tidy(run), schema).groupBy("d", "e").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    n, first, second = 0, [0] * dims, np.zeros((dims, dims), object)
    for r in sums.toLocalIterator():
        value = sum(r[f"l{k}"] << (32 * k) for k in range(LIMBS))
        if r.d >= 0:
            second[r.d, r.e] = second[r.e, r.d] = value
        elif r.e >= 0:
            first[r.e] = value
        else:
            n = value
    return n, first, second


def components(n: int, first: list[int], second: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, the ``keep`` largest first."""
    s = np.array(first, object)
    centred = n * second - np.multiply.outer(s, s)
    square = n * n
    v = np.array([[int(c) / square for c in row] for row in centred], float)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:keep]
    return values[order], vectors[:, order], sum(int(centred[d, d]) for d in range(len(s))) / square


class Whitener:
    """What the tasks need: the sums, and the projections of the components that have any variance."""

    def __init__(self, n: int, first: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.first, self.vectors, self.values, self.trace = n, first, vectors, values, trace
        self.live = values > max(trace, 0.0) * len(first) * np.finfo(float).eps
        self.scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, values, 1.0)), np.nan)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """((rows, components) of whitened numbers, the exact squared deviation of each row)."""
        reach = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.first), default=0)
        fits = len(self.first) * reach * reach < 1 << 63
        y = (x if fits else x.astype(object)) * self.n - np.array(self.first, np.int64 if fits else object)
        return (y / self.n).astype(float) @ self.vectors * self.scale, (y * y).sum(axis=1).tolist()


def _identity_error(fit: DataFrame, model, dims: int, kept: int) -> float | None:
    """Largest entry of whitened's covariance over the fit list minus the identity, measured from the numbers themselves."""
    names = [f"s{i}" for i in range(kept)] + [f"c{i}_{j}" for i in range(kept) for j in range(i, kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                w, _ = model.value.project(matrix(batch.column(0).slice(at, BLOCK), dims))
                total += [*w.sum(axis=0), *(np.dot(w[:, i], w[:, j]) for i in range(kept) for j in range(i, kept))]
        yield pa.record_batch([pa.array([t]) for t in total], names=names)

    r = fit.mapInArrow(tidy(run), ", ".join(f"`{c}` double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    live, n = [i for i in range(kept) if model.value.live[i]], model.value.n
    gaps = [abs(r[f"c{i}_{j}"] / n - r[f"s{i}"] / n * r[f"s{j}"] / n - (i == j)) for i in live for j in live if i <= j]
    return max(gaps, default=None)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 4) -> DataFrame:
    """One row per row of ``vectors`` and component up to ``keep``: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has a null or non-finite component have no rows. Components are fitted to each different vector once; ``n`` is how many there are;
    ``deviation`` is the exact sum of (n x - S)^2, a decimal(38, 0), null where it has more digits. Of vectors of different lengths the shorter ones count as
    filled up with zeros; entries beyond a long count as its limit; there are no more components than dimensions. A component
    without variance has a null ``whitened`` and takes no part in ``identity_error``; without any variance ``explained`` and ``identity_error`` are null too.
    Repeated rows come back repeated, null ids null; an empty table gives no rows; other columns are not read. The driver holds
    matrices of dims x dims, whatever the number of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(whole(F.col(vector_col))).select(F.col(id_col).alias("id"), fixed_point(F.col(vector_col)).alias("x"))
    kind = T.StructType([vectors.schema[id_col], *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], kind)
    # Trailing zeros and none at all are one vector.
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    fit = materialize(rows.select(padded.alias("x")).distinct(), "whitening-fit")
    n, first, second = scatter(fit, dims)
    values, basis, trace = components(n, first, second, keep)
    kept = len(values)
    model = spark.sparkContext.broadcast(Whitener(n, first, values, basis, trace))
    error = _identity_error(fit, model, dims, kept)
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                w, far = model.value.project(matrix(part.column(1), dims))
                far = pa.array([Decimal(int(d)) if d <= _MOST else None for d in far], pa.decimal128(38, 0))
                for k in range(kept):
                    column = pa.array(w[:, k], mask=np.isnan(w[:, k]))
                    each = lambda value, t: pa.array([value] * part.num_rows, t)
                    yield pa.record_batch([part.column(0), each(k + 1, pa.int32()), each(n, pa.int64()), far, column, each(explained[k], pa.float64()), each(error, pa.float64())], names=kind.names)

    return rows.mapInArrow(tidy(run), kind)
