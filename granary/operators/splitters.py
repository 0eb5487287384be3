"""Train, validation and test splits, and k folds: an order over rows or groups, cut by counts.

A split is one DataFrame with a column `split` (train, val, test); folds are one DataFrame with a column `fold` (0..k-1,
null for rows that only ever train). Randomness is the seeded md5 order of ids, so reruns agree. Sizes follow the usual
conventions: half-even rounding of n x test for random, time and distance splits; ceil for stratified and grouped ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ordering as O
from ..functions import vectors as V
from ..functions.selection import select_quantiles
from ..roles import Columns
from ..storage import materialize
from .reducers import Homology, check_ids, descriptor_columns


@dataclass
class SplitResult:
    assigned: DataFrame
    strategy: str
    params: dict[str, Any]
    labels: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)
    #: Further figures, each computed from the assigned rows when statistics are asked for.
    more: tuple[Callable[[DataFrame], dict[str, Any]], ...] = ()

    def part(self, name: str) -> DataFrame:
        return self.assigned.where(F.col("split") == name).drop("split")

    train = property(lambda self: self.part("train"))
    test = property(lambda self: self.part("test"))
    val = property(lambda self: self.part("val"))

    def stats(self, sizes: dict[str, int] | None = None) -> dict[str, Any]:
        """Counts of each part (sizes, where they are known), of labels and groups in parts, of groups that two parts share, and
        the strategy's own figures."""
        n = sizes or {r.split: r["count"] for r in self.assigned.groupBy("split").count().collect()}
        out: dict[str, Any] = {"n_total": sum(n.values())} | {f"n_{s}": n.get(s, 0) for s in ("train", "val", "test")} | self.extra
        for c in self.labels:
            out[f"{c}_counts"] = {}
            for r in self.assigned.groupBy("split", F.col(f"`{c}`").cast("string").alias("v")).count().collect():
                out[f"{c}_counts"].setdefault(r.split, {})[r.v] = r["count"]
        for c in self.groups:
            row = _group_counts(self.assigned, c).first()
            out |= {f"{c}_leak_{k}": row[k] for k in ("train_test", "train_val", "val_test")}
            out |= {f"{c}_n_{k}": row[f"n_{k}"] for k in ("total", "train", "val", "test")}
        for figures in self.more:
            out |= figures(self.assigned)
        return out


def leaks(assigned: DataFrame, group_col: str) -> DataFrame:
    """One row: how many groups each pair of parts shares."""
    return _group_counts(assigned, group_col).select("train_test", "train_val", "val_test")


def _group_counts(assigned: DataFrame, group_col: str) -> DataFrame:
    """One row: how many groups each pair of parts shares, and how many there are in all and in each part."""
    has = lambda s: F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s)
    g = assigned.groupBy(F.col(f"`{group_col}`").alias("g")).agg(has("train"), has("val"), has("test"))
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"{a}_{b}")
    held = [F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(f"n_{s}") for s in ("train", "val", "test")]
    return g.agg(both("train", "test"), both("train", "val"), both("val", "test"), F.count("*").alias("n_total"), *held)


@dataclass
class FoldResult:
    assigned: DataFrame
    strategy: str
    params: dict[str, Any]
    id_col: str
    k: int
    val_size: float = 0.0
    seed: int = 13
    labels: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)
    more: tuple[Callable[[DataFrame], dict[str, Any]], ...] = ()

    def fold(self, i: int) -> SplitResult:
        """Fold i as test; of the others a seeded share is validation, ceil(val x their number)."""
        if not 0 <= i < self.k:
            raise ValueError(f"fold {i} of {self.k}")
        is_test = F.coalesce(F.col("fold") == i, F.lit(False))
        rest = self.assigned.where(~is_test)
        n_val = math.ceil(rest.count() * self.val_size) if self.val_size else 0
        if n_val:
            rest = O.shuffle_rank(rest, self.seed + i, self.id_col, name="__r").withColumn("split", F.when(F.col("__r") <= n_val, "val").otherwise("train")).drop("__r")
        else:
            rest = rest.withColumn("split", F.lit("train"))
        out = rest.unionByName(self.assigned.where(is_test).withColumn("split", F.lit("test"))).drop("fold")
        return SplitResult(out, self.strategy, self.params, self.labels, self.groups, {"fold_index": i} | self.extra, self.more)

    def expanded(self) -> DataFrame:
        """All folds as one table: each row once for each fold_index, with the column split that fold(fold_index) gives it. All
        folds' validation rows come from one ranking."""
        held = {r.fold: r["count"] for r in self.assigned.groupBy("fold").count().collect()}  # a row for each fold
        total = sum(held.values())
        rows = self.assigned.withColumn("fold_index", F.explode(F.sequence(F.lit(0), F.lit(self.k - 1))))
        is_test = F.coalesce(F.col("fold") == F.col("fold_index"), F.lit(False))
        if not self.val_size:
            return rows.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("fold")
        n_val = F.array(*[F.lit(math.ceil((total - held.get(i, 0)) * self.val_size)) for i in range(self.k)])
        rest = O.shuffle_rank(rows.where(~is_test), F.lit(self.seed) + F.col("fold_index"), self.id_col, ("fold_index",), "__r")
        rest = rest.withColumn("split", F.when(F.col("__r") <= F.get(n_val, F.col("fold_index")), "val").otherwise("train")).drop("__r")
        return rest.unionByName(rows.where(is_test).withColumn("split", F.lit("test"))).drop("fold")

    def folds(self) -> list[SplitResult]:
        return [self.fold(i) for i in range(self.k)]

    def stats(self) -> dict[str, Any]:
        return {"n_splits": self.k, "fold_sizes": {r.fold: r["count"] for r in self.assigned.groupBy("fold").count().collect()}}


@dataclass
class Splitter:
    name: ClassVar[str]

    def params(self) -> dict[str, Any]:
        return {f.name: v for f in fields(self) if not isinstance(v := getattr(self, f.name), DataFrame)}

    def validate(self) -> None:
        test, val = getattr(self, "test_size", None), self.val_size
        if test is not None and not 0 < test < 1:
            raise ValueError(f"test_size must lie between 0 and 1, not {test}")
        if not 0 <= val < 1 or (test is not None and test + val >= 1):
            raise ValueError(f"val_size {val} leaves no training rows")
        if hasattr(self, "n_splits") and self.n_splits < 2:
            raise ValueError("n_splits must be 2 or more")

    def run(self, df: DataFrame, cols: Columns | None = None) -> SplitResult | FoldResult:
        cols = cols or Columns()
        self.validate()
        check_ids(df, cols.id)
        if clash := sorted(c for c in df.columns if c.lower() in ("split", "fold") or c.startswith("__")):
            raise ValueError(f"the dataset has columns {clash}, whose names are taken here")
        return self.assign(df, cols)

    def assign(self, df: DataFrame, cols: Columns):
        raise NotImplementedError


def need(df: DataFrame, *cols: str | None) -> None:
    if missing := [c for c in cols if c is None or c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def by_rank(rank: Column, n_train: int, n_val: int) -> Column:
    return F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")


def counts(n: int, test: float, val: float) -> tuple[int, int, int]:
    """(train, val, test) by half-even rounding; no part that is asked for may be empty."""
    n_test, n_val = round(n * test), round(n * val)
    n_train = n - n_test - n_val
    if n_train < 1 or n_test < 1 or (val and n_val < 1):
        raise ValueError(f"{n} rows are too few for test {test} and val {val}")
    return n_train, n_val, n_test


def ceil_counts(n: int, test: float, val: float) -> tuple[int, int, int]:
    """(train, val, test): ceil of the test share, then ceil of val's share of the rest."""
    n_test = math.ceil(n * test)
    n_val = math.ceil((n - n_test) * (val / (1 - test))) if val else 0
    if n - n_test - n_val < 1:
        raise ValueError(f"{n} are too few for test {test} and val {val}")
    return n - n_test - n_val, n_val, n_test


@dataclass
class Random(Splitter):
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    name = "random"

    def assign(self, df, cols):
        n_train, n_val, _ = counts(df.count(), self.test_size, self.val_size)
        ranked = O.shuffle_rank(df, self.seed, cols.id, name="__r")
        return SplitResult(ranked.withColumn("split", by_rank(F.col("__r"), n_train, n_val)).drop("__r"), self.name, self.params())


@dataclass
class RandomKFold(Splitter):
    n_splits: int = 5
    shuffle: bool = True
    seed: int = 13
    val_size: float = 0.0
    name = "random_kfold"

    def assign(self, df, cols):
        n = df.count()
        if n < self.n_splits:
            raise ValueError(f"{n} rows are too few for {self.n_splits} folds")
        ranked = O.shuffle_rank(df, self.seed, cols.id, name="__r") if self.shuffle else O.order_rank(df, F.col(f"`{cols.id}`"), name="__r")
        folds = ranked.withColumn("fold", O.even_slice(F.col("__r"), n, self.n_splits)).drop("__r")
        return FoldResult(folds, self.name, self.params(), cols.id, self.n_splits, self.val_size, self.seed)


def drop_null(df: DataFrame, col: str, dropna: bool) -> DataFrame:
    c = F.col(f"`{col}`")
    null = c.isNull() | F.isnan(c) if dict(df.dtypes)[col] in ("double", "float") else c.isNull()
    if dropna:
        return df.where(~null)
    if n := df.where(null).count():
        raise ValueError(f"{n} rows have no {col!r}")
    return df


def largest_remainder(classes: DataFrame, size: str, total: int, name: str) -> DataFrame:
    """classes with `total` shared out in proportion to `size`: floors, then one more by largest remainder, ties by class."""
    exact = F.col(size) / F.sum(size).over(W.partitionBy()) * F.lit(float(total))
    out = classes.withColumn("__x", exact).withColumn("__f", F.floor(F.round("__x", 9)))
    more = F.lit(total) - F.sum("__f").over(W.partitionBy())
    nth = F.row_number().over(W.orderBy(F.round(F.col("__x") - F.col("__f"), 9).desc(), "cls"))
    return out.withColumn(name, (F.col("__f") + F.when(nth <= more, 1).otherwise(0)).cast("long")).drop("__x", "__f")


def stratify(df: DataFrame, cls: Column, id_col: str, seed: int, n_first: int, names: tuple[str, str]) -> DataFrame:
    """df with a column split: n_first rows get the first name, in proportion to classes; the others the second."""
    keyed = df.withColumn("__cls", cls.cast("string"))
    classes = keyed.groupBy(F.col("__cls").alias("cls")).agg(F.count("*").alias("n"))
    share = largest_remainder(classes, "n", n_first, "take").select(F.col("cls").alias("__cls"), F.col("take").alias("__take"))
    ranked = O.shuffle_rank(keyed, seed, id_col, ("__cls",), "__r").join(share, "__cls")
    return ranked.withColumn("split", F.when(F.col("__r") <= F.col("__take"), names[0]).otherwise(names[1])).drop("__cls", "__take", "__r")


def check_classes(df: DataFrame, cls: Column, least: int, parts: tuple[int, ...]) -> None:
    row = df.groupBy(cls.alias("c")).count().agg(F.min("count"), F.count("*")).first()
    if (row[0] or 0) < least:
        raise ValueError(f"every class needs {least} rows or more; the smallest has {row[0] or 0}")
    if any(0 < p < row[1] for p in parts):
        raise ValueError(f"a part of {min(parts)} rows can't hold all {row[1]} classes")


@dataclass
class Stratified(Splitter):
    label_col: str | None = None
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    dropna: bool = True
    name = "stratified"

    def assign(self, df, cols):
        label = self.label_col or cols.label
        need(df, label)
        df = drop_null(df, label, self.dropna)
        n = df.count()
        parts = ceil_counts(n, self.test_size, self.val_size)
        cls = F.col(f"`{label}`")
        check_classes(df, cls, 2, parts)
        out = stratify(df, cls, cols.id, self.seed, n - parts[2], ("train", "test"))
        if parts[1]:
            rest = stratify(out.where("split = 'train'").drop("split"), cls, cols.id, self.seed + 1, parts[0], ("train", "val"))
            out = rest.unionByName(out.where("split = 'test'"))
        return SplitResult(out, self.name, self.params(), (label,))


def deal(df: DataFrame, cls: Column, id_col: str, seed: int | None, k: int) -> DataFrame:
    """df with a column fold: rows sorted by class, shuffled within, are dealt round robin."""
    keyed = df.withColumn("__cls", cls.cast("string"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__cls").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = keyed.groupBy("__cls").agg(F.count("*").alias("n")).select("__cls", before.alias("__o"))
    if seed is None:  # all rows in one order, so that a class of any size is spread; deal positions count from the class's first
        ranked = O.order_rank(keyed, F.col("__cls"), F.col(f"`{id_col}`"), name="__all").join(offset.withColumnRenamed("__o", "__b"), "__cls")
        ranked = ranked.withColumn("__r", F.col("__all") - F.col("__b")).drop("__all", "__b")
    else:
        ranked = O.shuffle_rank(keyed, seed, id_col, ("__cls",), "__r")
    return ranked.join(offset, "__cls").withColumn("fold", ((F.col("__o") + F.col("__r") - 1) % k).cast("int")).drop("__cls", "__o", "__r")


@dataclass
class StratifiedKFold(Splitter):
    label_col: str | None = None
    n_splits: int = 5
    shuffle: bool = True
    seed: int = 13
    val_size: float = 0.0
    dropna: bool = True
    cast_to_str: bool = False
    name = "stratified_kfold"

    def assign(self, df, cols):
        label = self.label_col or cols.label
        need(df, label)
        df = drop_null(df, label, self.dropna)
        cls = F.col(f"`{label}`")
        check_classes(df, cls, self.n_splits, ())
        folds = deal(df, cls, cols.id, self.seed if self.shuffle else None, self.n_splits)
        return FoldResult(folds, self.name, self.params(), cols.id, self.n_splits, self.val_size, self.seed, (label,))


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float]:
    """Exact quantiles by linear interpolation."""
    return select_quantiles(df, value, shares)[None]


def bin_edges(df: DataFrame, value: Column, n_bins: int, binning: str) -> list[float]:
    return binnings(df, value, [n_bins], binning)[0]


def binnings(df: DataFrame, value: Column, numbers: list[int], binning: str) -> list[list[float]]:
    """Edges for each number of bins, all from the same scans."""
    if binning == "quantile":
        shares = [[i / n for i in range(n + 1)] for n in numbers]
        flat = sorted({x for s in shares for x in s})
        at = dict(zip(flat, quantiles(df, value, flat)))
        return [[at[x] for x in s] for s in shares]
    low, high = df.agg(F.min(value), F.max(value)).first()
    return [[low + (high - low) * i / n for i in range(n + 1)] for n in numbers]


def bin_of(value: Column, edges: list[float]) -> Column:
    """The number of inner edges strictly below the value."""
    inner = [F.when(value > F.lit(e), 1).otherwise(0) for e in edges[1:-1]]
    out = F.lit(0)
    for e in inner:
        out = out + e
    return out.cast("int")


def label_stats(rows: DataFrame, value: Column) -> dict[str, dict[str, float]]:
    """n, min, max, mean, sample deviation (0 of one row) and median of a numeric label, for all rows ("global") and each part."""
    of = (F.count(value), F.min(value), F.max(value), F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0)))
    median = {g or "global": m[0] for g, m in select_quantiles(rows, value, [0.5], F.col("split")).items()}
    out = {}
    for r in rows.rollup("split").agg(*of).collect():  # a row for each part
        part = r[0] or "global"
        out[part] = dict(zip(("n", "min", "max", "mean", "std"), r[1:])) | {"median": median.get(part)}
    return out


def bin_counts(value: Column, edges: list[float]) -> Callable[[DataFrame], dict[str, Any]]:
    """How many rows of each part fall into each bin, and the label's figures in all and in each part."""

    def figures(assigned: DataFrame) -> dict[str, Any]:
        rows = materialize(assigned.select("split", value.alias("value")), "labels")
        out: dict[str, Any] = {"n_bins": len(edges) - 1, "bin_counts": {}, "label_stats": label_stats(rows, F.col("value"))}
        for r in rows.groupBy("split", bin_of(F.col("value"), edges).alias("bin")).count().collect():  # a row for each bin and part
            out["bin_counts"].setdefault(r.split, {})[r.bin] = r["count"]
        return out

    return figures


@dataclass
class _Numeric(Splitter):
    def bins(self, df: DataFrame, value: Column, least: int) -> list[float]:
        """Unique edges of as many bins as have `least` rows each, one fewer at a time if auto_reduce_bins."""
        numbers = list(range(self.n_bins, 1, -1)) if self.auto_reduce_bins else [self.n_bins]
        found = binnings(df, value, numbers, self.binning)
        unique = [sorted(set(raw)) for raw in found]
        # the rows up to each inner edge of any binning, in one scan: bins hold the differences
        inner = sorted({e for edges in unique for e in edges[1:-1]})
        total, *upto = df.agg(F.count("*"), *[F.count_if(value <= F.lit(e)) for e in inner]).first()
        below = dict(zip(inner, upto))
        for raw, edges in zip(found, unique):
            if len(edges) < len(raw) and self.duplicates == "raise":
                raise ValueError("bin edges coincide")
            cuts = [0, *[below[e] for e in edges[1:-1]], total]
            full = [b - a for a, b in zip(cuts, cuts[1:]) if b > a]
            if len(edges) >= 3 and len(full) >= 2 and min(full) >= least:
                return edges
        raise ValueError(f"no binning gives every bin {least} rows")

    def prepare(self, df: DataFrame, cols: Columns) -> tuple[DataFrame, Column]:
        need(df, self.label_col)
        if self.binning not in ("quantile", "uniform"):
            raise ValueError(f"binning must be quantile or uniform, not {self.binning!r}")
        if self.n_bins < 2 or self.duplicates not in ("drop", "raise"):
            raise ValueError("n_bins must be 2 or more, duplicates drop or raise")
        value = F.col(f"`{self.label_col}`").try_cast("double")
        bad = value.isNull() | F.isnan(value)
        if self.dropna:
            df = df.where(~bad)
        elif n := df.where(bad).count():
            raise ValueError(f"{n} rows have no numeric {self.label_col!r}")
        return df, value


@dataclass
class StratifiedNumeric(_Numeric):
    label_col: str = "y"
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    n_bins: int = 10
    binning: str = "quantile"
    dropna: bool = True
    duplicates: str = "drop"
    auto_reduce_bins: bool = True
    min_bin_count: int = 2
    report_bin_edges: bool = False
    name = "stratified_numeric"

    def assign(self, df, cols):
        df, value = self.prepare(df, cols)
        n = df.count()
        parts = ceil_counts(n, self.test_size, self.val_size)
        edges = self.bins(df, value, self.min_bin_count)
        out = stratify(df, bin_of(value, edges), cols.id, self.seed, n - parts[2], ("train", "test"))
        if parts[1]:  # bins anew, on what isn't test
            rest = out.where("split = 'train'").drop("split")
            rest = stratify(rest, bin_of(value, self.bins(rest, value, self.min_bin_count)), cols.id, self.seed + 1, parts[0], ("train", "val"))
            out = rest.unionByName(out.where("split = 'test'"))
        extra = {"bin_edges": edges} if self.report_bin_edges else {}
        return SplitResult(out, self.name, self.params(), extra=extra, more=(bin_counts(value, edges),))


@dataclass
class StratifiedNumericKFold(_Numeric):
    label_col: str = "y"
    n_splits: int = 5
    shuffle: bool = True
    seed: int = 13
    val_size: float = 0.0
    n_bins: int = 10
    binning: str = "quantile"
    dropna: bool = True
    duplicates: str = "drop"
    auto_reduce_bins: bool = True
    min_bin_count: int = 2
    report_bin_edges: bool = False
    name = "stratified_numeric_kfold"

    def assign(self, df, cols):
        df, value = self.prepare(df, cols)
        edges = self.bins(df, value, max(self.min_bin_count, self.n_splits))
        folds = deal(df, bin_of(value, edges), cols.id, self.seed if self.shuffle else None, self.n_splits)
        extra = {"bin_edges": edges} if self.report_bin_edges else {}
        return FoldResult(folds, self.name, self.params(), cols.id, self.n_splits, self.val_size, self.seed, extra=extra, more=(bin_counts(value, edges),))


def split_groups(df: DataFrame, group: Column, seed: int, test: float, val: float) -> DataFrame:
    """df with a column split, cut by groups: shares are of groups, not of rows."""
    keyed = df.withColumn("__g", group.cast("string"))
    names = keyed.select("__g").distinct()
    n = names.count()
    if n < 2:
        raise ValueError("fewer than two groups")
    n_train, n_val, _ = ceil_counts(n, test, val)
    cut = O.shuffle_rank(names, seed, "__g", name="__r").select("__g", by_rank(F.col("__r"), n_train, n_val).alias("split"))
    return keyed.join(cut, "__g").drop("__g")


@dataclass
class Group(Splitter):
    group_col: str | None = None
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    name = "group"

    def assign(self, df, cols):
        group = self.group_col or cols.group or "group"
        need(df, group)
        out = split_groups(drop_null(df, group, False), F.col(f"`{group}`"), self.seed, self.test_size, self.val_size)
        return SplitResult(out, self.name, self.params(), groups=(group,))


def deal_sizes(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """How groups go one by one into the lightest of k folds, the lowest on ties. sizes: (n, how many groups have it), largest
    first. For each size (n, starts, orders): from the rank starts[i] on, ranks from 0 over all groups, folds recur as in
    orders[i]."""
    loads, rank, out = [0] * k, 0, []
    for n, left in sizes:
        starts, orders = [], []
        while left:
            folds = sorted(range(k), key=lambda f: (loads[f], f))
            turn = [f for f in folds if (loads[f], f) < (loads[folds[0]] + n, folds[0])]
            rounds = left // len(turn) + 1
            if len(turn) < k:  # until the next fold's turn comes before that of the last of these
                last, other = turn[-1], folds[len(turn)]
                ahead = loads[other] - loads[last]
                rounds = -(-ahead // n) + (ahead % n == 0 and last < other)
            took = min(left, rounds * len(turn))
            starts.append(rank)
            orders.append(turn)
            for i, f in enumerate(turn):
                loads[f] += n * (took // len(turn) + (i < took % len(turn)))
            rank, left = rank + took, left - took
        out.append((n, starts, orders))
    return out


def pack_groups(sizes: DataFrame, k: int) -> DataFrame:
    """(g, fold): the largest group first into the lightest fold, the lowest on ties. sizes: (g, n).

    Groups of one size take folds in a recurring order, so the driver needs the sizes that occur only: they are fewer than
    the square root of twice the rows."""
    held = sizes.groupBy("n").count().orderBy(F.desc("n")).collect()
    dealt = sizes.sparkSession.createDataFrame(deal_sizes([(r["n"], r["count"]) for r in held], k), "n long, starts array<long>, orders array<array<int>>")
    ranked = O.order_rank(sizes, F.desc("n"), F.col("g"), name="__r").join(F.broadcast(dealt), "n").withColumn("__r", F.col("__r") - 1)
    at = F.size(F.filter("starts", lambda x: x <= F.col("__r"))) - 1
    order = F.col("orders")[at]
    return ranked.select("g", order[F.pmod(F.col("__r") - F.col("starts")[at], F.size(order)).cast("int")].alias("fold"))


@dataclass
class GroupKFold(Splitter):
    group_col: str | None = None
    n_splits: int = 5
    val_size: float = 0.0
    seed: int = 13
    dropna: bool = True
    name = "group_kfold"

    def assign(self, df, cols):
        group = self.group_col or cols.group or "group"
        need(df, group)
        keyed = drop_null(df, group, self.dropna).withColumn("__g", F.col(f"`{group}`").cast("string"))
        sizes = materialize(keyed.groupBy(F.col("__g").alias("g")).agg(F.count("*").alias("n")), "groups")
        if sizes.count() < self.n_splits:
            raise ValueError(f"fewer groups than {self.n_splits} folds")
        folds = keyed.join(pack_groups(sizes, self.n_splits).withColumnRenamed("g", "__g"), "__g").drop("__g")
        return FoldResult(folds, self.name, self.params(), cols.id, self.n_splits, self.val_size, self.seed, groups=(group,))


@dataclass
class Time(Splitter):
    time_col: str | None = None
    test_size: float = 0.2
    val_size: float = 0.0
    parse_datetime: bool = True
    time_format: str | None = None
    ascending: bool = True
    name = "time"

    def assign(self, df, cols):
        col = self.time_col or cols.date or "time"
        need(df, col)
        t = F.col(f"`{col}`")
        if self.parse_datetime and dict(df.dtypes)[col] == "string":
            t = F.to_timestamp(t, self.time_format) if self.time_format else F.to_timestamp(t)
        df = df.withColumn("__t", t)
        n, missing = df.agg(F.count("*"), F.count_if(F.col("__t").isNull())).first()
        if missing:
            raise ValueError(f"{missing} rows have no {col!r}")
        n_train, n_val, _ = counts(n, self.test_size, self.val_size)
        ranked = O.order_rank(df, F.col("__t").asc() if self.ascending else F.col("__t").desc(), F.col(f"`{cols.id}`"), name="__r")
        out = ranked.withColumn("split", by_rank(F.col("__r"), n_train, n_val)).drop("__t", "__r")

        def ranges(assigned: DataFrame) -> dict[str, Any]:
            found = assigned.groupBy("split").agg(F.min(t).alias("first"), F.max(t).alias("last")).collect()
            return {"time_ranges": {r["split"]: {"first": str(r["first"]), "last": str(r["last"])} for r in found}}

        return SplitResult(out, self.name, self.params(), more=(ranges,))

    @staticmethod
    def ranges(result: SplitResult, time_col: str) -> DataFrame:
        return result.assigned.groupBy("split").agg(F.count("*").alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))


def with_clusters(df: DataFrame, cols: Columns, clusters: DataFrame | None, id_col: str, cluster_col: str, own: str | None, singletons: bool) -> DataFrame:
    """df with a column cluster_id: its own column, else the map's cluster (the greatest on repeated ids), else singleton:id."""
    text = F.col(f"`{cols.id}`").cast("string")
    if own and own in df.columns:
        found = df.withColumn("__c", F.col(f"`{own}`").cast("string"))
    elif clusters is not None:
        by_id = clusters.groupBy(F.col(f"`{id_col}`").cast("string").alias("__m")).agg(F.max(F.col(f"`{cluster_col}`").cast("string")).alias("__c"))
        found = df.join(by_id, text == F.col("__m"), "left").drop("__m")
    else:
        raise ValueError("neither a cluster column nor a cluster map")
    if not singletons and (n := found.where("__c is null").count()):
        raise ValueError(f"{n} rows have no cluster")
    return found.withColumn("__c", F.coalesce("__c", F.concat(F.lit("singleton:"), text)))


def singletons(cluster_col: str) -> Callable[[DataFrame], dict[str, Any]]:
    """How many rows no cluster names."""
    return lambda assigned: {"n_missing_clusters": assigned.where(F.col(f"`{cluster_col}`").startswith("singleton:")).count()}


@dataclass
class ClusterAware(Splitter):
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    cluster_col: str | None = None
    clusters: DataFrame | None = None
    map_id_col: str = "id"
    map_cluster_col: str = "cluster_id"
    assign_singletons_for_missing: bool = True
    name = "cluster_aware"

    def assign(self, df, cols):
        own = self.cluster_col or cols.cluster or "cluster_id"
        found = with_clusters(df, cols, self.clusters, self.map_id_col, self.map_cluster_col, own, self.assign_singletons_for_missing)
        out = split_groups(found, F.col("__c"), self.seed, self.test_size, self.val_size)
        out = out.drop(own) if own in df.columns else out
        source = "column" if own in df.columns else "map"
        return SplitResult(out.withColumnRenamed("__c", own), self.name, self.params(), groups=(own,), extra={"cluster_source": source}, more=(singletons(own),))


@dataclass
class HomologyAware(Splitter):
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    mode: str = "native"
    clusters: DataFrame | None = None
    member_col: str = "member"
    cluster_col: str = "representative"
    min_seq_id: float = 0.9
    coverage: float = 0.8
    cov_mode: int = 0
    # accepted for compatibility: the plan, not a parameter, decides how work is spread
    mmseqs_bin: str | None = None
    threads: int = 8
    work_dir: str | None = None
    keep_work: bool = False
    name = "homology_aware"

    def assign(self, df, cols):
        if self.mode not in ("native", "mmseqs2", "precomputed") or (self.mode == "precomputed" and self.clusters is None):
            raise ValueError("mode must be native, or precomputed with clusters")
        clusters, member, cluster = self.clusters, self.member_col, self.cluster_col
        if self.mode != "precomputed":
            got = Homology(min_seq_id=self.min_seq_id, coverage=self.coverage, cov_mode=self.cov_mode).run(df, cols)
            own = got.kept.select(F.col(f"`{cols.id}`").cast("string").alias("member"), F.col(f"`{cols.id}`").cast("string").alias("representative"))
            clusters = own.unionByName(got.mapping.select(F.col("removed_id").alias("member"), F.col("representative_id").alias("representative")))
            member, cluster = "member", "representative"
        found = with_clusters(df, cols, clusters, member, cluster, None, True)
        out = split_groups(found, F.col("__c"), self.seed, self.test_size, self.val_size).withColumnRenamed("__c", "homology_cluster_id")
        return SplitResult(out, self.name, self.params(), groups=("homology_cluster_id",), extra={"cluster_source": self.mode}, more=(singletons("homology_cluster_id"),))


@dataclass
class _Distance(Splitter):
    def distances(self, df: DataFrame, cols: Columns) -> DataFrame:
        """df with a column __d, each featured row's distance from the centroid, rounded to nine places; null elsewhere."""
        if self.metric not in ("cosine", "euclidean") or self.feature_mode not in ("embeddings", "descriptors"):
            raise ValueError("metric must be cosine or euclidean, feature_mode embeddings or descriptors")
        if self.feature_mode == "embeddings":
            if self.embeddings is None:
                raise ValueError("feature_mode embeddings needs embeddings")
            store = self.embeddings.select(F.col(f"`{self.embedding_id}`").alias("__e"), F.col(f"`{self.embedding_col}`").cast("array<double>").alias("__v"))
            base = df.join(store.dropDuplicates(["__e"]), F.col(f"`{cols.id}`") == F.col("__e"), "left").drop("__e")
        else:
            base = df.withColumn("__v", V.as_vector(df, descriptor_columns(df, self.descriptor_prefix, self.descriptor_cols)))
            if self.standardize:
                base = base.withColumn("__v", V.zscore("__v", *V.column_moments(base, "__v"), least=0.0))
        if self.metric == "cosine":
            base = base.withColumn("__v", F.when(F.col("__v").isNotNull(), V.unit(F.col("__v"))))
        mean, _ = V.column_moments(base.where("__v is not null"), "__v")
        if not mean:
            raise ValueError("no row has features")
        centre = F.array(*[F.lit(float(x)) for x in mean])
        d = 1 - V.dot(F.col("__v"), V.unit(centre)) if self.metric == "cosine" else V.euclidean(F.col("__v"), centre)
        return base.withColumn("__d", F.round(d, 9)).drop("__v")


@dataclass
class DistanceAware(_Distance):
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    feature_mode: str = "embeddings"
    metric: str = "cosine"
    embeddings: DataFrame | None = None
    embedding_id: str = "id"
    embedding_col: str = "embedding"
    descriptor_prefix: str = "desc_"
    descriptor_cols: list[str] | None = None
    standardize: bool = True
    val_method: str = "random"
    test_method: str = "farthest"
    name = "distance_aware"

    def assign(self, df, cols):
        if self.test_method != "farthest" or self.val_method not in ("random", "farthest_next"):
            raise ValueError("test_method must be farthest, val_method random or farthest_next")
        base = self.distances(df, cols)
        n, featured = base.agg(F.count("*"), F.count("__d")).first()
        _, n_val, n_test = counts(n, self.test_size, self.val_size)
        if featured < n_test + n_val:
            raise ValueError(f"{featured} rows with features are too few for {n_test + n_val}")
        ranked = O.order_rank(base, F.col("__d").desc_nulls_last(), F.col(f"`{cols.id}`"), name="__r")
        out = ranked.withColumn("split", F.when(F.col("__r") <= n_test, "test").otherwise("train"))
        if n_val and self.val_method == "farthest_next":
            out = out.withColumn("split", F.when((F.col("split") == "train") & (F.col("__r") <= n_test + n_val), "val").otherwise(F.col("split")))
        elif n_val:
            rest = O.shuffle_rank(out.where("split = 'train' and __d is not null"), self.seed, cols.id, name="__s").where(F.col("__s") <= n_val).select(F.col(f"`{cols.id}`").alias("__v"))
            out = out.join(rest, F.col(f"`{cols.id}`") == F.col("__v"), "left").withColumn("split", F.when(F.col("__v").isNotNull(), "val").otherwise(F.col("split"))).drop("__v")
        return SplitResult(out.drop("__r").withColumnRenamed("__d", "centroid_distance"), self.name, self.params(), more=(distance_figures,))

    @staticmethod
    def distance_stats(result: SplitResult) -> DataFrame:
        """A row for each part, and one (global) for all: n, min, max, mean and sample deviation of distances."""
        d = F.col("centroid_distance")
        aggs = [F.count(d).alias("n"), F.min(d).alias("min"), F.max(d).alias("max"), F.round(F.avg(d), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(d), F.lit(0.0)), 6).alias("std")]
        held = result.assigned.where(d.isNotNull())
        return held.groupBy("split").agg(*aggs).unionByName(held.agg(*aggs).withColumn("split", F.lit("global")))


def distance_figures(assigned: DataFrame) -> dict[str, Any]:
    found = DistanceAware.distance_stats(SplitResult(assigned, "", {})).collect()
    return {"distance_stats": {r.split: {k: r[k] for k in ("n", "min", "max", "mean", "std")} for r in found}}


@dataclass
class DistanceAwareKFold(_Distance):
    n_splits: int = 5
    seed: int = 13
    shuffle_ties: bool = True
    val_size: float = 0.0
    feature_mode: str = "embeddings"
    metric: str = "cosine"
    embeddings: DataFrame | None = None
    embedding_id: str = "id"
    embedding_col: str = "embedding"
    descriptor_prefix: str = "desc_"
    descriptor_cols: list[str] | None = None
    standardize: bool = True
    standardize_descriptors: bool | None = None  # another name of standardize
    drop_internal_index: bool = True
    name = "distance_aware_kfold"

    def assign(self, df, cols):
        if self.standardize_descriptors is not None:
            self.standardize = self.standardize_descriptors
        base = self.distances(df, cols)
        featured = base.agg(F.count("__d")).first()[0]
        if featured < self.n_splits:
            raise ValueError(f"{featured} rows with features are too few for {self.n_splits} folds")
        ties = [O.shuffle_key(self.seed, cols.id)] if self.shuffle_ties else []
        ranked = O.order_rank(base, F.col("__d").desc_nulls_last(), *ties, F.col(f"`{cols.id}`"), name="__r")
        fold = F.when(F.col("__d").isNotNull(), O.even_slice(F.col("__r"), featured, self.n_splits))
        folds = ranked.withColumn("fold", fold).drop("__r").withColumnRenamed("__d", "centroid_distance")
        return FoldResult(folds, self.name, self.params(), cols.id, self.n_splits, self.val_size, self.seed, more=(distance_figures,))


STRATEGIES: dict[str, type[Splitter]] = {
    c.name: c for c in (Random, RandomKFold, Stratified, StratifiedKFold, StratifiedNumeric, StratifiedNumericKFold, Group, GroupKFold, Time, ClusterAware, HomologyAware, DistanceAware, DistanceAwareKFold)
}
