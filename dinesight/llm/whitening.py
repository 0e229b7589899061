"""Operator 12: embedding whitening with mixed-precision eigenvectors.

Entries become integers, so sums, the covariance and every row's distance from the mean
are exact: tasks multiply centred integers in float64 blocks that cannot round, Spark adds the
products, and the driver holds one d x d matrix whatever the number of rows. Its eigenvectors
start in float32 and are corrected by matrix-multiplication iterations (Ogita and Aishima) in
extended precision; eigenvalues closer than the iteration can tell apart are a cluster, whose
vectors are turned by the eigenvectors of the small matrix that remains after the cluster's
mean is taken off, and the iteration goes on. Where numpy's ``longdouble`` is a double, so is the precision.

Rows whose vector is null or holds a null or a value that is not finite are dropped; so are, as they have no
covariance with the others, vectors whose length is not the most frequent one (of equally frequent the longest), and rows
with an entry beyond the range of long. Repeated rows count as often as they stand, and a null id stays null. A component
without variance (equal rows, linear dependence) has ``whitened`` 0 and counts as an error of 1 in
``identity_error``. A ``deviation`` beyond the range of long is null. Equal eigenvalues may take any basis of their
space. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import small_batches

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
#: Entries of this size and more are no longs after scaling.
LARGEST = float(1 << 62)
#: Products of 20-bit limbs summed over this many rows stay under 2**53.
LIMB_BITS, BLOCK_ROWS = 20, 4_096
ITERATIONS, ROUNDS = 8, 6
#: Eigenvalues that differ by less than this share of the largest are separated by sub-solves alone.
CLUSTER = 1e-9
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that take part, scaled, still as doubles."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(scale))
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths["d"] if lengths else -1))


def _integers(batch: pa.RecordBatch, offset: int) -> np.ndarray:
    """The vectors of a batch, rounded down; all have one length."""
    flat = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    return flat.reshape(batch.num_rows, len(flat) // max(batch.num_rows, 1)) + offset


def _summed(rows: DataFrame, kind: str) -> dict[tuple[int, int], int | float]:
    """Partial sums of all tasks, added by Spark: at most one number per pair of dimensions comes back."""
    total = rows.groupBy("i", "j").agg(F.sum("v").cast(kind).alias("v")).collect()
    return {(r["i"], r["j"]): int(r["v"]) if kind.startswith("decimal") else r["v"] for r in total}


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers, exactly, as Python integers: limbs are multiplied in float64 without rounding."""
    limbs, rest = [], y
    while True:
        low = rest & ((1 << LIMB_BITS) - 1)
        low = np.where(low >= 1 << (LIMB_BITS - 1), low - (1 << LIMB_BITS), low)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB_BITS
        if not rest.any():
            break
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            total += (left.T @ right).astype(np.int64).astype(object) << (LIMB_BITS * (a + b))
    return total


@dataclass(frozen=True)
class Moments:
    """Exact count, sums and covariance numerators of integer rows: covariance is ``products / n**2``."""
    n: int
    sums: list[int]
    products: np.ndarray

    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        high = [[v / square for v in row] for row in self.products.tolist()]
        low = [[float(Fraction(v, square) - Fraction(h)) for v, h in zip(row, hs, strict=True)] for row, hs in zip(self.products.tolist(), high, strict=True)]
        return np.array(high, np.longdouble) + np.array(low, np.longdouble)


def moments(rows: DataFrame, offset: int = OFFSET) -> Moments | None:
    """Two passes: sums, then products of the rows less the integer mean; the fraction left is taken off exactly."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _integers(batch, offset)
            if x.size:
                high, low = np.divmod(x, 1 << 31)
                part = [(int(h) << 31) + int(w) for h, w in zip(high.sum(0), low.sum(0), strict=True)]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                n += batch.num_rows
        if total is not None:
            values = [n, *total]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(total)), pa.int32()), "j": pa.array([0] * len(values), pa.int32()),
                                              "v": pa.array(map(Decimal, values), pa.decimal128(38, 0))})

    first = _summed(rows.select("v").mapInArrow(sums, "i int, j int, v decimal(38,0)"), "decimal(38,0)")
    if not first:
        return None
    n, total = first[-1, 0], [first[i, 0] for i in range(len(first) - 1)]
    d = len(total)
    mean = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d), object)
        for batch in batches:
            y = _integers(batch, offset) - mean
            for a in range(0, len(y), BLOCK_ROWS):
                gram = gram + exact_products(y[a:a + BLOCK_ROWS])
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(map(Decimal, gram[i, j].tolist()), pa.decimal128(38, 0))})

    second = _summed(rows.select("v").mapInArrow(products, "i int, j int, v decimal(38,0)"), "decimal(38,0)")
    left = [s - n * int(m) for s, m in zip(total, mean, strict=True)]
    numerators = np.empty((d, d), object)
    for (i, j), v in second.items():
        numerators[i, j] = numerators[j, i] = n * v - left[i] * left[j]
    return Moments(n, total, numerators)


def _norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(np.float64), 2))


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """One iteration: new vectors, eigenvalues and ``x.T a x`` of the old ones, what tells eigenvalues apart, the size of the change."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    size = _norm(a)
    # Nearer values are a cluster however well their vectors are known: dividing by so small a gap would bring noise in.
    apart = max(2 * (_norm(s - np.diag(values)) + size * _norm(r)), CLUSTER * size)
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > apart
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    return x + x @ e, values, s, apart, float(np.abs(e).max())


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to its own precision."""
    d = len(covariance)
    size = float(np.abs(covariance).max())
    if not size:
        return np.zeros(d, covariance.dtype), np.eye(d, dtype=covariance.dtype)
    scale = np.ldexp(covariance.dtype.type(1), int(np.frexp(size)[1]))
    a = covariance / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    noise = d * float(np.finfo(a.dtype).eps) * _norm(a)
    for _ in range(ROUNDS):
        for _ in range(ITERATIONS):
            x, values, s, apart, change = _corrected(a, x)
            if change <= noise:
                break
        # The vectors have moved since: take their values anew and look for clusters among them.
        _, values, s, apart, _ = _corrected(a, x)
        order = np.argsort(-values, kind="stable")
        x, values, s = x[:, order], values[order], s[np.ix_(order, order)]
        groups = np.split(np.arange(d), np.flatnonzero(-np.diff(values) > apart) + 1)
        turned = False
        for group in groups:
            inner = s[np.ix_(group, group)] - np.diag(np.full(len(group), values[group].mean()))
            if len(group) > 1 and np.abs(inner - np.diag(np.diag(inner))).max() > noise:
                most = np.abs(inner).max()
                w = np.linalg.eigh((inner / most).astype(np.float64))[1][:, ::-1]
                x[:, group] = x[:, group] @ w.astype(a.dtype)
                turned = True
        if not turned:
            break
    for _ in range(2):
        x = x + x @ (np.eye(d, dtype=a.dtype) - x.T @ x) / 2
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(d)])
    values = np.where(np.abs(values) > noise, values, 0) * scale
    return values, x * np.where(sign == 0, 1, sign)


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors (vec_id, embedding)``.

    ``deviation`` is the sum over dimensions of ``(n x - S)**2`` of the integer vector ``x``; ``explained`` the component's share
    of the variance; ``identity_error`` is measured on the whitened rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = integer_rows(vectors, scale)
    known = moments(rows, offset)
    if known is None:
        return spark.createDataFrame([], RESULT)
    n = known.n
    values, basis = eigenvectors(known.covariance())
    k = min(components, len(values))
    trace = np.trace(known.covariance())
    shares = [float(v / trace) if trace else 0.0 for v in values[:k]]
    spread = np.sqrt(np.maximum(values[:k], 0))
    turn = np.where(spread > 0, basis[:, :k] / np.where(spread > 0, spread, 1), 0).astype(np.float64)
    mean = np.array([(2 * s + n) // (2 * n) for s in known.sums], np.int64)
    left = [s - n * int(m) for s, m in zip(known.sums, mean, strict=True)]

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        """``n x - S`` as exact integers, of 64 bits where squares and their sums fit."""
        y = _integers(batch, offset) - mean
        bound = n * int(np.abs(y).max(initial=0)) + max(map(abs, left))
        exact = bound * bound * len(mean) < 1 << 62
        return y * n - np.array(left, np.int64) if exact else y.astype(object) * n - np.array(left, object)

    def projected(z: np.ndarray) -> np.ndarray:
        return (z / n).astype(np.float64) @ turn

    def covariances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = np.column_stack([projected(centred(batch)), np.ones(batch.num_rows)])
            gram += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(gram[i, j])})

    sums = _summed(rows.select("v").mapInArrow(covariances, "i int, j int, v double"), "double")
    error = max(abs(sums[i, j] / n - sums[i, k] / n * sums[j, k] / n - (i == j)) for i in range(k) for j in range(i, k))

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(batch)
            deviation = [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()] if batch.num_rows else []
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "deviation": pa.array(deviation, pa.int64()),
                                              "w": pa.array(list(projected(z)), pa.list_(pa.float64()))})

    def share(at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, shares)), at)

    each = rows.mapInArrow(output, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("p", "whitened"))
    return each.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       share(F.col("p") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
