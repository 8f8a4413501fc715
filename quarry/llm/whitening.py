"""Embedding whitening by shifted CholeskyQR.

Rows become integers, so that their sums are exact, and are centred before anything is multiplied.
Each pass sums the Gram matrix of the rows, after the triangular solves of the passes before, and
takes its Cholesky factor; the first adds a shift of the size of its rounding errors, later ones only
if they must. After PASSES of them the rows are orthonormal to the last digits, and the product of
the factors is the R of the centred rows. R has d x d numbers: the driver takes its singular values and right vectors, which are the
rows' deviations and components. Each pass reads the rows once, where they are, and moves one matrix
a task; sums of matrices form by entry. Components are numbered by falling eigenvalue, their largest
entry positive.

Rows are left out if their vector is null, empty, or holds null or non-finite entries, or if it has
another length than the most frequent one (of equally frequent, the longest). Entries that pass
2**52 after scaling count as 2**52. Components without variance, to rounding, are not given: of equal
rows, or of one row, there are none, and the result is empty, as for an empty table. Repeated rows
and keys are rows like any other; null keys stay. `deviation` is null where a long can't hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import releasing, stash

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
PASSES = 3
_MOST = float(1 << 52)
_MOST_SHIFT = 1e-8
#: Sums of integers travel as two parts, so that neither passes a long.
_LOW_BITS = 26
_EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """n rows; their sums by dimension; components as columns, eigenvalues of V, and V's trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Its whole numbers and its fractions."""
        return np.array([s // self.n for s in self.sums], dtype=np.float64), np.array([(s % self.n) / self.n for s in self.sums])


def integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch as whole numbers."""
    lists = batch.column("v")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), d)
    return np.clip(np.floor(flat * SCALE), -_MOST, _MOST).astype(np.int64) + OFFSET


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """x less the mean, which comes as whole numbers and fractions so that no digit is lost."""
    return (x - mean[0].astype(np.int64)).astype(np.float64) - mean[1]


def _solve(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor in turn, by back substitution column by column."""
    out = np.ascontiguousarray(rows.T)
    for r in factors:
        for k in range(len(r)):
            out[k] = (out[k] - r[:k, k] @ out[:k]) / r[k, k]
    return out.T


def _entries(total: np.ndarray, name: str = "x") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], names=["k", name])


def _sum_of_rows(d: int):
    """Per task: rows, high and low parts of the sums."""

    @releasing
    def run(batches):
        total = np.zeros(1 + 2 * d, dtype=np.int64)
        for batch in batches:
            x = integers(batch, d)
            total[0] += len(x)
            total[1 : d + 1] += (x >> _LOW_BITS).sum(axis=0)
            total[d + 1 :] += (x & ((1 << _LOW_BITS) - 1)).sum(axis=0)
        yield _entries(total)

    return run


def _gram(d: int, mean, factors: list[np.ndarray], axes: np.ndarray | None = None):
    """Per task: the sum of outer products of the centred rows, solved by the factors; or of their places on axes."""

    @releasing
    def run(batches):
        size = d if axes is None else axes.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            rows = _centred(integers(batch, d), mean)
            rows = _solve(rows, factors) if axes is None else rows @ axes
            total += rows.T @ rows
        yield _entries(total)

    return run


def _summed(rows: DataFrame, step, size: int, kind: str = "double") -> np.ndarray:
    got = rows.mapInArrow(step, f"k long, x {kind}").groupBy("k").agg(F.sum("x").alias("x")).toPandas()  # a row per entry of a matrix
    out = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    out[got["k"].to_numpy()] = got["x"].to_numpy()
    return out


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The Cholesky factor R (gram = R' R) after that shift, or after the least greater one that will do: gram may lack full rank."""
    least = _EPS * np.trace(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def usable(vectors: DataFrame, key: str, embedding: str) -> tuple[DataFrame, int]:
    """(rows (id, v) that take part, their dimension)."""
    v = F.col(embedding)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(fine).select(F.col(key).alias("id"), v.cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.filter(F.size("v") == d), d


def learn(rows: DataFrame, d: int, components: int = COMPONENTS, passes: int = PASSES) -> Whitening | None:
    """Components of rows (v) of d entries; None if there is no variance."""
    total = _summed(rows, _sum_of_rows(d), 2 * d + 1, "long").tolist()
    n, sums = total[0], tuple((total[k + 1] << _LOW_BITS) + total[d + k + 1] for k in range(d))
    if n < 2:
        return None
    fit = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []
    r, trace = np.eye(d), 0.0
    for k in range(passes):
        gram = _summed(rows, _gram(d, fit.mean, factors), d * d).reshape(d, d)
        if k == 0:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                return None
        shift = min(11 * (n * d + d * (d + 1)) * (_EPS / 2), _MOST_SHIFT) * n * trace if k == 0 else 0.0  # bounds the Gram matrix's rounding errors
        factors.append(_factor((gram + gram.T) / 2, shift))
        r = factors[-1] @ r
    _, sigma, right = np.linalg.svd(r)
    known = int((sigma > sigma[0] * d * 1e-12).sum())
    axes = right[: min(components, known)].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitening(n, sums, axes, sigma[: axes.shape[1]] ** 2 / n, trace)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)^2; None past a long."""
    mean = np.array([s / n for s in sums])
    near = (((x - mean) * float(n)) ** 2).sum(axis=1)
    if n * float(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, sums)) < 1 << 61 and near.max(initial=0) < 1 << 61:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one per row and component."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = usable(vectors, key, embedding)
    fit = None
    if d:
        rows = stash(rows)
        fit = learn(rows, d, components)
    if fit is None or not len(fit.values):
        return rows.sparkSession.createDataFrame([], schema)
    scaled = fit.axes / np.sqrt(fit.values)
    m = len(fit.values)
    covariance = _summed(rows, _gram(d, fit.mean, [], scaled), m * m).reshape(m, m) / fit.n
    error = float(np.abs(covariance - np.eye(m)).max())

    @releasing
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = integers(part, d)
                places = _centred(x, fit.mean) @ scaled
                size = len(x)
                deviation = _deviations(x, fit.n, fit.sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(np.repeat(np.arange(size), m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * m, fit.n, dtype=np.int64)),
                        pa.array([v for v in deviation for _ in range(m)], pa.int64()),
                        pa.array(places.ravel()),
                        pa.array(np.tile(fit.values / fit.trace, size)),
                        pa.array(np.full(size * m, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
