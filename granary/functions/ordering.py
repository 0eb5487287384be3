"""Total orders and ranks that hold at any size.

No rank here needs all rows in one task: a seeded shuffle is cut into 4,096 hash buckets whose sizes are summed on their
own; any other order is range-partitioned and each part's rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import fresh, materialize

BUCKET_DIGITS = 3


def shuffle_key(seed: int | Column, id_col: str | Column) -> Column:
    """md5 of seed:id, the seeded random order of this package."""
    c = F.col(f"`{id_col}`") if isinstance(id_col, str) else id_col
    told = F.concat(seed.cast("string"), F.lit(":")) if isinstance(seed, Column) else F.lit(f"{seed}:")
    return F.md5(F.concat(told, F.coalesce(c.cast("string"), F.lit(""))).cast("binary"))


def shuffle_rank(df: DataFrame, seed: int | Column, id_col: str, within: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """df with its rank from 1 in the seeded shuffle, or in that of each value of `within` (which isn't null)."""
    key, bucket, ahead = (fresh(df, n) for n in ("shuffle_key", "shuffle_bucket", "shuffle_ahead"))
    keyed = df.withColumn(key, shuffle_key(seed, id_col)).withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS))
    by = [*within, bucket]
    before = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy(*by).agg(F.count("*").alias(name)).select(*by, F.coalesce(F.sum(name).over(before), F.lit(0)).alias(ahead))
    here = F.row_number().over(W.partitionBy(*by).orderBy(key, id_col))
    return keyed.withColumn(name, here).join(offsets, by).withColumn(name, (F.col(name) + F.col(ahead)).cast("long")).drop(key, bucket, ahead)


def order_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its rank from 1 in a total order, by range partitions and their sizes (a number for each partition)."""
    part, nth, before = (fresh(df, n) for n in ("part", "nth", "before"))
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = materialize(
        sorted_.withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered"
    )
    sizes, at = [], 0
    for r in sorted_.groupBy(part).count().orderBy(part).collect():
        sizes.append((r[part], at))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(sizes, f"`{part}` int, `{before}` long")
    return sorted_.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(nth) + 1).drop(part, nth, before)


def even_slice(rank: Column, n: Column | int, k: int) -> Column:
    """The slice 0..k-1 of a rank from 1 among n rows: sizes differ by one at most, the first n mod k are larger."""
    n = F.lit(n) if isinstance(n, int) else n
    small, larger = F.floor(n / k), n % k
    cut = larger * (small + 1)
    r = rank - 1
    return F.when(r < cut, F.floor(r / (small + 1))).otherwise(larger + F.floor((r - cut) / F.greatest(small, F.lit(1)))).cast("int")


def shuffle_counts(df: DataFrame, seed: int, id_col: str, sums: dict[str, Column]) -> DataFrame:
    """df with further columns: for each of sums, its sum over the rows that precede in the seeded shuffle."""
    key, bucket = (fresh(df, n) for n in ("shuffle_key", "shuffle_bucket"))
    keyed = df.withColumn(key, shuffle_key(seed, id_col)).withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS))
    ahead = {name: f"{bucket}_{k}" for k, name in enumerate(sums)}
    before = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)  # over the buckets' sums, 4,096 rows
    totals = keyed.groupBy(bucket).agg(*[F.sum(x).alias(ahead[n]) for n, x in sums.items()])
    offsets = totals.select(bucket, *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(a) for a in ahead.values()])
    here = W.partitionBy(bucket).orderBy(key, id_col).rowsBetween(W.unboundedPreceding, -1)
    within = keyed.withColumns({n: F.coalesce(F.sum(x).over(here), F.lit(0)) for n, x in sums.items()})
    out = within.join(F.broadcast(offsets), bucket)
    return out.withColumns({n: (F.col(n) + F.col(a)).cast("long") for n, a in ahead.items()}).drop(key, bucket, *ahead.values())
