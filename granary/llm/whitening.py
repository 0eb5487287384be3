"""Whitening of embeddings by shifted CholeskyQR.

A component c becomes the integer x = floor(64 c) + 1000000. Sums over rows are exact, so rows are centred by one rounding
of (n x - S) / n. The centred matrix A (a row for each vector) is orthogonalised by repeated Gram passes (Fukaya, Kannan,
Nakatsukasa, Yamamoto & Yanagisawa, 2020): G = Q'Q is summed over all rows, R = chol(G + shift), and the next pass takes
Q R^-1 by triangular solves from the rows, never stored. The first shift keeps the factorisation from breaking down at any
condition number. Passes go on until Q'Q is the identity to ORTHOGONAL. The R factors are composed, A = Q R, and the singular
values and right vectors of R are A's: components without ever squaring A's condition number.

A pass reads the integers once and sends each task's Gram matrix, a square of the dimensions, through a shuffle that adds
them up; only sums reach the driver (dimensions squared). Rows never meet.

Edge cases. A vector that is null or holds a null or non-finite entry is dropped. Vectors of unequal length count as padded
with zeros. Null ids stay; repeated ids and rows all count. Components without variance (e at most LEAST of the largest)
can't be whitened and are left out, so constant tables, a single row and an empty table give no components. A deviation
beyond 64 bits is null; entries whose integers exceed 2**52 are an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
ORTHOGONAL, MOST_PASSES, LEAST = 1e-13, 8, 1e-20
_UNIT = 2.0**-53


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the usable vectors, written."""
    v = F.col("v")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(usable(v))
    big = F.exists(v, lambda e: F.abs(e) * SCALE > F.lit(float(1 << 52)))
    x = F.transform(v, lambda e: F.floor(e * SCALE).cast("long") + OFFSET)
    return materialize(rows.select("id", F.when(big, F.raise_error(F.lit("an entry is too large for exact integers"))).otherwise(x).alias("x")), "whitening-integers")


def _matrix(column, dim: int) -> np.ndarray:
    """A batch's lists as rows of integers, padded with the integer of zero."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.full((len(lengths), dim), OFFSET, dtype=np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(k) for k in lengths])
    out[at] = flat
    return out


def _summed(x: DataFrame, of: Callable[[object], np.ndarray], kind: str) -> np.ndarray:
    """of(batch's x) added over all rows: each task sends its own sum, a shuffle adds them. kind: of the entries."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                got = of(batch.column(0))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], ["at", "v"])

    sums = x.select("x").mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    return sums["v"].to_numpy()


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for upper triangular R, column by column."""
    out = np.empty_like(a)
    for j in range(r.shape[0]):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


@dataclass
class Whitening:
    """n vectors of integers with these sums; components as columns, by falling eigenvalue; trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n if self.n * int(np.abs(x).max(initial=0)) < 1 << 62 else x - self.sums / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of integers."""
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S)**2, None beyond 64 bits."""
        most = int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0)) // self.n + 1
        if (self.n * most) < 1 << 62:
            d = self.n * x - self.sums
            if int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
                return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - self.sums.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper R with R'R = gram + shift; a larger shift if that breaks down."""
    step = max(shift, _UNIT * float(np.trace(gram)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift, step = shift + step, step * 10


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the integers (x); None if there are none."""
    n, dim = x.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n == 0 or dim == 0:
        return None
    # sums of x - OFFSET are small; each task adds in 64 bits, the shuffle in decimals
    low = _summed(x, lambda c: (_matrix(c, dim) - OFFSET).sum(axis=0), "long")
    sums = low.astype(np.int64) + n * OFFSET
    found = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, 0)
    factors: list[np.ndarray] = []

    def gram(column):
        q = found.centred(_matrix(column, dim))
        for r in factors:
            q = solve(q, r)
        return q.T @ q

    for k in range(MOST_PASSES):
        g = _summed(x, gram, "double").reshape(dim, dim)
        if k == 0:
            found.trace = float(np.trace(g)) / n
            if not found.trace:
                return None
        off = np.abs(g - np.diag(np.diag(g) > 0.5)).max()
        if k > 1 and off < ORTHOGONAL * dim:
            break
        # the published shift: 11 (m n + n (n + 1)) u ||A||^2, with the norm bounded by the trace
        shift = 11 * (float(n) * dim + dim * (dim + 1)) * _UNIT * float(np.linalg.norm(g, 2)) if k == 0 else 0.0
        factors.append(_factor(g, min(shift, float(np.linalg.norm(g, 2)) * 1e-2)))
    whole = np.eye(dim)
    for r in factors:
        whole = r @ whole
    _, s, vt = np.linalg.svd(whole)
    e = s**2 / n
    keep = int((e > LEAST * e[0]).sum())
    m = min(components, keep)
    found.components, found.eigenvalues, found.passes = vt[:m].T, e[:m], len(factors)
    return found


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, from a pass over all rows."""
    dim, m = model.components.shape
    mean = _summed(x, lambda c: model.apply(_matrix(c, dim)).sum(axis=0), "double") / model.n

    def square(c):
        w = model.apply(_matrix(c, dim)) - mean
        return w.T @ w

    return float(np.abs(_summed(x, square, "double").reshape(m, m) / model.n - np.eye(m)).max())


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of the integers (id, x); whitened: an array, a number for each component."""
    dim, m = model.components.shape
    kind = dict(x.dtypes)["id"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1), dim)
                w = pa.FixedSizeListArray.from_arrays(pa.array(model.apply(rows).ravel()), m).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(rows), pa.int64()), w], ["id", "deviation", "whitened"])

    return x.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    model = fit(x)
    if model is None:
        none = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return x.limit(0).select(F.col("id").alias("vec_id"), *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in none.split(", ")])
    error = identity_error(x, model)
    rows = whiten(x, model).select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
