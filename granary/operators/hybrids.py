"""Splits that keep more than one promise: structure-aware, stratified by label within groups, nested folds."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..storage import materialize
from .components import components
from .splitters import FoldResult, SplitResult, Splitter, counts, drop_null, need


@dataclass
class StructureAware(Splitter):
    """No listed edge within the threshold crosses two parts: connected components are the units.

    Components, in a seeded order, are laid end to end by their rows; the part in which a component's middle lies gets it. So
    a part's size is off by less than half of each of the two components at its ends. Rows without edges are components.
    A component may be so large that nothing is left for a part: that is an error, unless allow_empty.
    """

    edges: DataFrame | None = None
    test_size: float = 0.2
    val_size: float = 0.0
    seed: int = 13
    mode: str = "distance"
    threshold: float = 0.5
    id1_col: str = "id1"
    id2_col: str = "id2"
    value_col: str = "distance"
    allow_empty: bool = False
    name = "structure_aware"
    unit = "structure_component"

    def validate(self) -> None:
        super().validate()
        if self.mode not in ("distance", "similarity"):
            raise ValueError(f"mode must be distance or similarity, not {self.mode!r}")
        if self.edges is None:
            raise ValueError("structure_aware needs edges")

    def assign(self, df, cols):
        need(self.edges, self.id1_col, self.id2_col, self.value_col)
        if self.unit in df.columns:
            raise ValueError(f"the dataset has a column {self.unit!r}, whose name is taken here")
        kind, value = dict(df.dtypes)[cols.id], F.col(f"`{self.value_col}`").cast("double")
        ids = df.select(F.col(f"`{cols.id}`").alias("__i"))
        near = self.edges.where(value <= self.threshold if self.mode == "distance" else value >= self.threshold)
        near = near.select(F.col(f"`{self.id1_col}`").cast(kind).alias("a"), F.col(f"`{self.id2_col}`").cast(kind).alias("b"))
        near = near.join(ids.withColumnRenamed("__i", "a"), "a", "left_semi").join(ids.withColumnRenamed("__i", "b"), "b", "left_semi")
        found = components(near).withColumnRenamed("node", "__i")
        units = materialize(ids.join(found, "__i", "left").select("__i", F.coalesce("root", "__i").alias("__u")), "units")
        n_train, n_val, _ = counts(units.count(), self.test_size, self.val_size)
        sizes = units.groupBy("__u").agg(F.count("*").alias("__n"))
        laid = O.shuffle_counts(sizes, self.seed, "__u", {"__before": F.col("__n")})
        middle = 2 * F.col("__before") + F.col("__n")
        part = F.when(middle <= 2 * n_train, "train").when(middle <= 2 * (n_train + n_val), "val").otherwise("test")
        cut = materialize(laid.select("__u", part.alias("split")), "unit-parts")
        parts = {r.split for r in cut.select("split").distinct().collect()}
        if (missing := {"train", "test", *(["val"] if self.val_size else [])} - parts) and not self.allow_empty:
            raise ValueError(f"components are too large: nothing is left for {sorted(missing)}")
        out = df.join(units.join(cut, "__u"), F.col(f"`{cols.id}`") == F.col("__i")).drop("__i").withColumnRenamed("__u", self.unit)
        return SplitResult(out, self.name, self.params(), groups=(self.unit,))


def place_vectors(vectors: list[tuple[tuple[int, ...], int]], k: int) -> list[list[int]]:
    """Folds of the groups that are left over once each vector's groups are dealt evenly to k folds.

    vectors: (label counts, groups that have them). A left-over group goes where its labels are rarest so far: to the fold of
    least sum over labels of counts x load x 10**12 // total**2, the lowest on ties. Evenly dealt groups weigh alike in all.
    """
    labels = range(len(vectors[0][0])) if vectors else ()
    total = [sum(v[i] * m for v, m in vectors) for i in labels]
    weight = [10**12 // max(1, t) ** 2 for t in total]
    loads, out = [[0] * len(total) for _ in range(k)], []
    for v, m in vectors:
        chosen = []
        for _ in range(m % k):
            f = min((f for f in range(k)), key=lambda f: (sum(v[i] * loads[f][i] * weight[i] for i in labels), f))
            chosen.append(f)
            loads[f] = [x + y for x, y in zip(loads[f], v)]
        out.append(chosen)
    return out


@dataclass
class StratifiedGroupKFold(Splitter):
    """k folds of whole groups in which labels are spread as evenly as groups allow.

    Groups with the same label counts are dealt to all folds in equal numbers; only what is left over of each kind, fewer
    than k groups, is placed one by one. The driver sees the distinct label counts, not the groups.
    """

    group_col: str | None = None
    label_col: str | None = None
    n_splits: int = 5
    val_size: float = 0.0
    seed: int = 13
    dropna: bool = True
    name = "stratified_group_kfold"

    def assign(self, df, cols):
        group, label = self.group_col or cols.group or "group", self.label_col or cols.label
        need(df, group, label)
        keyed = drop_null(drop_null(df, group, self.dropna), label, self.dropna)
        keyed = keyed.withColumn("__g", F.col(f"`{group}`").cast("string")).withColumn("__l", F.col(f"`{label}`").cast("string"))
        names = [r[0] for r in keyed.select("__l").distinct().orderBy("__l").collect()]  # a row for each label
        held = F.array(*[F.count_if(F.col("__l") == x) for x in names])
        groups = materialize(keyed.groupBy("__g").agg(held.alias("__v")), "group-labels")
        kinds = groups.groupBy("__v").agg(F.count("*").alias("m")).collect()
        if sum(r.m for r in kinds) < self.n_splits:
            raise ValueError(f"fewer groups than {self.n_splits} folds")
        # large and lopsided ones first, as they are the hardest to make up for
        kinds = sorted(((tuple(r["__v"]), r.m) for r in kinds), key=lambda x: (-max(x[0]), -sum(x[0]), x[0]))
        rest = place_vectors(kinds, self.n_splits)
        dealt = df.sparkSession.createDataFrame([(list(v), m, f) for (v, m), f in zip(kinds, rest)], "__v array<long>, __m long, __rest array<int>")
        # ranks among groups of one kind, however many those are
        kind = groups.withColumn("__k", F.col("__v").cast("string"))
        ranked = O.shuffle_rank(kind, self.seed, "__g", ("__k",), "__r").join(dealt, "__v")
        even = F.col("__m") - F.col("__m") % self.n_splits
        fold = F.when(F.col("__r") <= even, (F.col("__r") - 1) % self.n_splits).otherwise(F.get("__rest", (F.col("__r") - even - 1).cast("int")))
        out = keyed.join(ranked.select("__g", fold.cast("int").alias("fold")), "__g").drop("__g", "__l")
        return FoldResult(out, self.name, self.params(), cols.id, self.n_splits, self.val_size, self.seed, (label,), (group,))


@dataclass
class NestedResult:
    """assigned: fold, and inner, an array with the row's inner fold in the training set of each outer fold (null in its own)."""

    assigned: DataFrame
    strategy: str
    params: dict[str, Any]
    k: int
    inner: int
    groups: tuple[str, ...] = ()

    def part(self, outer: int, inner: int) -> DataFrame:
        """A column split: test is the outer fold, val an inner fold of the others, train the rest."""
        if not (0 <= outer < self.k and 0 <= inner < self.inner):
            raise ValueError(f"no fold {outer} with {inner} inside")
        at = F.get("inner", F.lit(outer))
        return self.assigned.withColumn("split", F.when(at.isNull(), "test").when(at == inner, "val").otherwise("train")).drop("fold", "inner")

    def leaks(self, group_col: str) -> DataFrame:
        """For each outer fold: groups that are both in it and outside it, and groups with more than one inner fold."""
        at = self.assigned.select(F.col(f"`{group_col}`").alias("g"), "fold", F.posexplode("inner").alias("outer", "at"))
        held = at.groupBy("outer", "g").agg(F.count_if(F.col("fold") == F.col("outer")).alias("inside"), F.count("*").alias("n"), F.count_distinct("at").alias("folds"))
        both = F.count_if((F.col("inside") > 0) & (F.col("inside") < F.col("n")))
        return held.groupBy("outer").agg(both.cast("long").alias("outer_leaks"), F.count_if(F.col("folds") > 1).cast("long").alias("inner_leaks"))


@dataclass
class NestedKFold(Splitter):
    """Outer folds, and inner folds of each outer training set, for choosing models inside and judging them outside.

    Units are rows, or groups if group_col is given: whole groups move, on both levels. One more shuffle orders all units;
    a unit's rank in a training set is its rank in that order less the units of the outer fold before it, so all training
    sets are ranked in one pass.
    """

    n_splits: int = 5
    inner_splits: int = 3
    group_col: str | None = None
    val_size: float = 0.0
    seed: int = 13
    name = "nested_kfold"

    def validate(self) -> None:
        super().validate()
        if self.inner_splits < 2:
            raise ValueError("inner_splits must be 2 or more")

    def assign(self, df, cols):
        k = self.n_splits
        if self.group_col:
            need(df, self.group_col)
            df = drop_null(df, self.group_col, False)
        keyed = df.withColumn("__u", F.col(f"`{self.group_col or cols.id}`").cast("string"))
        units = materialize(keyed.select("__u").distinct(), "units")
        n = units.count()
        if n < k or n - -(-n // k) < self.inner_splits:
            raise ValueError(f"{n} units are too few for {k} folds of {self.inner_splits}")
        outer = O.shuffle_rank(units, self.seed, "__u", name="__r").select("__u", O.even_slice(F.col("__r"), n, k).alias("fold"))
        before = {"__all": F.lit(1)} | {f"__f{j}": (F.col("fold") == j).cast("int") for j in range(k)}
        ranked = O.shuffle_counts(materialize(outer, "outer-folds"), self.seed + 1, "__u", before)
        size = lambda j: n // k + (j < n % k)
        inside = [F.when(F.col("fold") != j, O.even_slice(F.col("__all") - F.col(f"__f{j}") + 1, n - size(j), self.inner_splits)) for j in range(k)]
        cut = ranked.select("__u", "fold", F.array(*inside).alias("inner"))
        out = keyed.join(cut, "__u").drop("__u")
        return NestedResult(out, self.name, self.params(), k, self.inner_splits, (self.group_col,) if self.group_col else ())


STRATEGIES: dict[str, type[Splitter]] = {c.name: c for c in (StructureAware, StratifiedGroupKFold, NestedKFold)}
