"""Whitening of embeddings with eigenvectors refined in mixed precision.

Sums and the covariance come from one distributed pass each (a d x d partial per task, added up by
Spark). The covariance is solved in single precision; Ogita-Aishima steps, matrix products in extended precision,
double the right digits of the eigenvectors each time. Eigenvalues closer than a step can part
form a cluster: its columns are turned by the eigenvectors of their own small, shifted matrix, then refined on.
The fit holds d x d numbers on the driver, never rows.

An entry c is the long x = floor(1024 * c) + 100000; deviations n * x - S are exact integers and are divided by n only
where a double is asked for, so nothing large is subtracted in floating point.

Rows: vectors that are null, empty, hold null or non-finite entries or entries of 2^35 and above, or have another
length than the commonest (equal counts: the shortest) take no part and are not returned; a null vec_id
stays, repeated rows stay rows and weigh as often as they stand; a component without variance (an eigenvalue below 1e-12 of the largest)
has whitened 0 and stays out of the identity error; ``deviation`` is null where it passes a long. Fewer dimensions
than components: one component each. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelens.llm.common import importable, schema

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: rows of a slice, so that 64-bit sums of entries below LIMIT * SCALE stay exact
SLICE, LIMIT = 8_192, 2.0**35
#: eigenvalues at most this part of the largest count as no variance
FLAT = 1e-12
#: eigenvalues this close, relative to the largest, are left to the sub-solve: a step would divide rounding by their distance
CLOSE = 1e-9


@dataclass(frozen=True)
class Whitening:
    """What a fit learns: rows, exact sums per dimension, falling eigenvalues and unit eigenvectors (columns), trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double, from exact integers where they fit."""
        return scaled(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        e = self.values[:components]
        with np.errstate(divide="ignore"):
            root = np.where(e > FLAT * max(self.values[0], 0.0), 1.0 / np.sqrt(np.maximum(e, 0.0)), 0.0)
        return self.centred(x) @ self.vectors[:, :components] * root


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors whose entries are all usable; lengths may still differ."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(LIMIT), F.lit(False)))  # NaN is above every number
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def entries(column, dim: int) -> np.ndarray:
    """The long entries of an Arrow list column, one row per vector."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def scaled(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, in 64 bits where that is exact, else in Python integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    if most < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(t: np.ndarray) -> list[int | None]:
    """Exact sum of squares per row; None where it passes a long."""
    most = int(max(abs(t.max(initial=0)), abs(t.min(initial=0))))
    if most * most * t.shape[1] < 2**63:
        return (t * t).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in ((t.astype(object) ** 2).sum(axis=1)).tolist()]


def _slices(batches: Iterator) -> Iterator:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _sums(dim: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in _slices(batches):
            s = entries(b.column("v"), dim).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(s)], ["at", "s"])

    return run


def _products(model: Whitening, components: int | None, dim: int):
    """Sums of products of centred entries, or of whitened values, over a task."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        width = components or dim
        total = np.zeros((width, width))
        for b in _slices(batches):
            x = entries(b.column("v"), dim)
            y = model.whitened(x, components) if components else model.centred(x)
            total += y.T @ y
        i, j = np.indices((width, width))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def _summed(rows: DataFrame, model: Whitening, components: int | None, dim: int) -> np.ndarray:
    parts = rows.mapInArrow(_products(model, components, dim), schema("i long, j long, s double"))
    width = components or dim
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d x d numbers
        out[r.i, r.j] = r.s
    return (out + out.T) / (2 * model.n)


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: better eigenvectors, eigenvalues, and the gap below which two eigenvalues count as one."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding over a small distance of eigenvalues would cost orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: np.sqrt((m * m).sum())
    gap = 2 * (norm(s - np.diag(values)) + np.abs(values).max() * norm(r))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > max(gap, CLOSE * np.abs(values).max())
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, float(gap)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of at least two falling eigenvalues whose neighbours lie within the gap."""
    cut = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    return [c for c in np.split(np.arange(len(values)), cut) if len(c) > 1]


def _parted(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """Turn the columns of each cluster by the eigenvectors of its own matrix, shifted by its mean eigenvalue."""
    for c in _clusters(values, gap):
        own = x[:, c]
        small = own.T @ (a @ own) - values[c].mean() * (own.T @ own)
        most = np.abs(small).max()
        if most > 0:
            _, turn = np.linalg.eigh(((small + small.T) / (2 * most)).astype(np.float64))
            x[:, c] = own @ turn[:, ::-1].astype(a.dtype)
    return x


def eigenvectors(v: np.ndarray, most_steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors of a symmetric matrix, to double precision."""
    scale = np.abs(v).max()
    if not scale > 0:
        return np.zeros(len(v)), np.eye(len(v))
    a = (v / scale).astype(np.longdouble)
    x = np.linalg.eigh((v / scale).astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    before, refined = np.inf, False
    for _ in range(most_steps):
        x, values, gap = _step(a, x)
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        if gap < 0.5 * before and gap > 1e-18 * len(a):  # still gaining digits
            before = gap
        elif refined:
            break
        else:
            x, before, refined = _parted(a, x, values, max(gap, CLOSE * np.abs(values).max())), np.inf, True
    x = x / np.sqrt((x * x).sum(axis=0))
    values = ((x * (a @ x)).sum(axis=0)).astype(np.float64) * scale
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])  # the largest entry is positive
    return values[order], x * sign


def fit(vectors: DataFrame) -> tuple[DataFrame, Whitening] | None:
    """The rows that take part, (vec_id, v), and what is learnt from all of them; None without rows."""
    importable(vectors.sparkSession)
    rows = valid(vectors)
    found = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not found:
        return None
    dim, n = found[0].dim, found[0].n
    rows = rows.where(F.size("v") == dim)
    parts = rows.mapInArrow(_sums(dim), schema("at long, s long")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = tuple(int(r.s) for r in parts.orderBy("at").collect())  # d numbers
    start = Whitening(n, sums, np.zeros(dim), np.eye(dim), 0.0)
    v = _summed(rows, start, None, dim)
    values, x = eigenvectors(v)
    return rows, Whitening(n, sums, values, x, float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity; components without variance stay out."""
    c = _summed(rows, model, components, len(model.sums))
    there = np.flatnonzero(model.values[:components] > FLAT * max(model.values[0], 0.0))
    return float(np.abs(c[np.ix_(there, there)] - np.eye(len(there))).max(initial=0.0))


def _transform(model: Whitening, components: int, dim: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in _slices(batches):
            x = entries(b.column("v"), dim)
            w = model.whitened(x, components)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, components, dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(squares(scaled(x, model.n, model.sums)), pa.int64()), flat], ["vec_id", "deviation", "whitened"])

    return run


def transform(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of rows that ``fit`` returned."""
    return rows.mapInArrow(_transform(model, components, len(model.sums)), schema("vec_id long, deviation long, whitened array<double>"))


def op11(vectors: DataFrame) -> DataFrame:
    """One row per vector and component."""
    out = schema("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fitted = fit(vectors)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows, model = fitted
    k = min(COMPONENTS, len(model.sums))
    share = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values[:k]])
    error = identity_error(rows, model, k)
    wide = transform(rows, model, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return wide.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
