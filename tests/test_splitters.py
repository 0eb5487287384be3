"""Sizes, disjointness, stratification and determinism of all splits."""

import random

import pytest

from granary.functions import ordering
from granary.operators import splitters as P
from granary.plans import runner
from granary.roles import Columns

COLS = Columns(group="group", date="date")


def how(name, vectors):
    base = {"stratified": {}, "stratified_numeric": {"n_bins": 4}, "stratified_numeric_kfold": {"n_bins": 4}, "homology_aware": {"min_seq_id": 0.8}}.get(name, {})
    return base | ({"embeddings": vectors} if name.startswith("distance") else {})


SINGLE = sorted(n for n in P.STRATEGIES if not n.endswith("kfold"))
FOLDS = sorted(n for n in P.STRATEGIES if n.endswith("kfold"))


@pytest.mark.parametrize("name", SINGLE)
def test_single(peptides, vectors, name):
    got = runner.split(peptides, name, COLS, test_size=0.25, val_size=0.15, **how(name, vectors))
    parts = {s: {r.id for r in got.part(s).collect()} for s in ("train", "val", "test")}
    assert all(parts.values()) and sum(map(len, parts.values())) == 60 == len(set().union(*parts.values()))
    again = runner.split(peptides, name, COLS, test_size=0.25, val_size=0.15, **how(name, vectors))
    assert {r.id for r in again.test.collect()} == parts["test"]
    stats = got.stats()
    assert (stats["n_train"], stats["n_val"], stats["n_test"]) == tuple(len(parts[s]) for s in ("train", "val", "test"))
    assert all(v == 0 for k, v in stats.items() if "_leak_" in k)
    if name in ("random", "time", "distance_aware"):
        assert (len(parts["val"]), len(parts["test"])) == (9, 15)


@pytest.mark.parametrize("name", FOLDS)
def test_folds(peptides, vectors, name):
    got = runner.split(peptides, name, COLS, n_splits=4, val_size=0.1, **how(name, vectors))
    folds = got.folds()
    tests = [{r.id for r in f.test.collect()} for f in folds]
    assert len(tests) == 4 and all(tests)
    n = 50 if name.startswith("distance") else 60
    assert sum(map(len, tests)) == n == len(set().union(*tests))
    for f, t in zip(folds, tests):
        train, val = {r.id for r in f.train.collect()}, {r.id for r in f.val.collect()}
        assert not train & t and not val & t and not train & val and len(train | val | t) == 60
        assert len(val) == -(-(60 - len(t)) // 10)
    if name != "group_kfold":
        assert max(map(len, tests)) - min(map(len, tests)) <= 1


def test_group_folds_keep_groups_whole(peptides):
    got = runner.split(peptides, "group_kfold", COLS, n_splits=3)
    assert got.assigned.select("group", "fold").distinct().count() == 7


def test_time_order(peptides):
    got = runner.split(peptides, "time", COLS)
    assert max(r.date for r in got.train.collect()) <= min(r.date for r in got.test.collect())
    back = runner.split(peptides, "time", COLS, ascending=False)
    assert min(r.date for r in back.train.collect()) >= max(r.date for r in back.test.collect())


def test_stratified_shares(peptides):
    got = runner.split(peptides, "stratified", COLS, test_size=0.3)
    assert {r.label: r["count"] for r in got.test.groupBy("label").count().collect()} == {0: 6, 1: 12}


def test_seed_matters(peptides):
    a, b = (runner.split(peptides, "random", seed=s) for s in (1, 2))
    assert {r.id for r in a.test.collect()} != {r.id for r in b.test.collect()}


def test_half_even_and_ceil():
    assert P.counts(25, 0.1, 0.1) == (21, 2, 2) and P.ceil_counts(10, 0.25, 0.1) == (6, 1, 3)


def test_ranks_and_slices(spark):
    df = spark.range(103)
    assert sorted(r.rank for r in ordering.shuffle_rank(df, 3, "id").collect()) == list(range(1, 104))
    from pyspark.sql import functions as F

    ranked = ordering.order_rank(df, F.desc("id"))
    assert all(r.rank == 103 - r.id for r in ranked.collect())
    sizes = ranked.withColumn("f", ordering.even_slice(F.col("rank"), 103, 5)).groupBy("f").count().orderBy("f").collect()
    assert [r["count"] for r in sizes] == [21, 21, 21, 20, 20]


@pytest.mark.parametrize(
    "name,bad",
    [("random", {"test_size": 1.0}), ("random", {"test_size": 0.6, "val_size": 0.5}), ("random_kfold", {"n_splits": 1}), ("random_kfold", {"n_splits": 61}), ("stratified", {"label_col": "nope"}), ("stratified", {"label_col": "id"}),
     ("stratified_numeric", {"binning": "odd"}), ("stratified_numeric", {"n_bins": 40, "auto_reduce_bins": False}), ("group_kfold", {"n_splits": 8}), ("distance_aware", {"test_method": "nearest"}), ("homology_aware", {"mode": "precomputed"})],
)
def test_errors(peptides, vectors, name, bad):
    with pytest.raises(ValueError):
        runner.split(peptides, name, COLS, **how(name, vectors) | bad)


def test_few_features(peptides, vectors):
    with pytest.raises(ValueError):
        runner.split(peptides, "distance_aware", embeddings=vectors.limit(2))


def test_missing_clusters(spark, peptides):
    clusters = spark.createDataFrame([("p001", "a"), ("p002", "a"), ("p003", "b")], "id string, cluster_id string")
    bare = peptides.drop("cluster_id")
    got = runner.split(bare, "cluster_aware", clusters=clusters)
    assert got.assigned.where("cluster_id like 'singleton:%'").count() == 57
    with pytest.raises(ValueError):
        runner.split(bare, "cluster_aware", clusters=clusters, assign_singletons_for_missing=False)


def test_groups_are_packed_at_every_size(spark):
    """One group outweighs the rest; 200,000 and more others never join its fold before the loads are even."""
    sizes = spark.range(200_100).selectExpr("cast(id as string) as g", "case when id = 7 then 120000 when id < 300 then 1 + id % 40 else 1 end as n")
    got = {r.g: r.fold for r in P.pack_groups(sizes, 3).collect()}
    loads, want = [0, 0, 0], {}
    for n, g in sorted(((r.n, r.g) for r in sizes.collect()), key=lambda x: (-x[0], x[1])):
        want[g] = min(range(3), key=lambda f: (loads[f], f))
        loads[want[g]] += n
    assert got == want


def test_deal_sizes():
    rng = random.Random(3)
    for _ in range(300):
        k, top = rng.randint(1, 6), rng.choice([3, 10, 60])
        sizes = [(n, rng.choice([1, 1, 2, 7, 50])) for n in sorted(rng.sample(range(1, top + 1), rng.randint(1, 3)), reverse=True)]
        loads, want, rank, got = [0] * k, [], 0, []
        for n, m in sizes:
            for _ in range(m):
                want.append(min(range(k), key=lambda f: (loads[f], f)))
                loads[want[-1]] += n
        for (_, starts, orders), (_, m) in zip(P.deal_sizes(sizes, k), sizes):
            for r in range(rank, rank + m):
                i = sum(s <= r for s in starts) - 1
                got.append(orders[i][(r - starts[i]) % len(orders[i])])
            rank += m
        assert got == want
