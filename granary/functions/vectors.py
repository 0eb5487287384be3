"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def as_vector(df: DataFrame, cols: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Each component over the norm, which is reckoned once."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / F.greatest(n, F.lit(EPS))))[0]


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def column_moments(df: DataFrame, vec: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each component: one row for each component comes to the driver."""
    parts = df.select(F.posexplode(vec).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("k").collect()
    return [r.m for r in parts], [r.s for r in parts]


def zscore(vec: str | Column, mean: list[float], sd: list[float], least: float = EPS) -> Column:
    """Standardised components; a deviation below `least` (or of zero) counts as 1."""
    v = F.col(vec) if isinstance(vec, str) else vec
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(1.0 if x == 0 or x < least else float(x)) for x in sd])
    return F.zip_with(F.zip_with(v, m, lambda x, y: x - y), s, lambda x, y: x / y)
