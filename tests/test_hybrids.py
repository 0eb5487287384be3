"""Structure-aware splits, stratified groups and nested folds."""

import random

import pytest

from granary.operators import components as C
from granary.operators import hybrids as H
from granary.operators.components import components
from granary.plans import registry
from granary.roles import Columns


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges for x in e}


@pytest.mark.parametrize("small", [10**6, 0, 1200])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    rng = random.Random(3)
    edges = [(0, x) for x in range(10, 1500)] + [(5000, x) for x in range(1490, 2500)] + [(x, x + 1) for x in range(7000, 7040)] + [(1, 1)]
    edges += [(9000 + 2 * x, 9001 + 2 * x) for x in range(50)] + [(7, 7040)]
    edges = [e[:: rng.choice((1, -1))] for e in edges]
    want = {x: r for x, r in roots(edges).items() if x != 1}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    text = [(f"n{a}", f"n{b}") for a, b in edges[-40:]]
    assert {r.node: r.root for r in components(spark.createDataFrame(text, "a string, b string")).collect()} == roots(text)


@pytest.mark.parametrize("mode", ["distance", "similarity"])
def test_structure_aware(spark, mode):
    rng, n = random.Random(5), 300
    edges = [(f"r{rng.randrange(n):03d}", f"r{rng.randrange(n):03d}", rng.random()) for _ in range(260)] + [("r000", "elsewhere", 0.5)]
    df = spark.createDataFrame([(f"r{i:03d}", i) for i in range(n)], "id string, extra int").repartition(3)
    near = [(a, b) for a, b, v in edges if (v <= 0.5 if mode == "distance" else v >= 0.5) and "elsewhere" not in (a, b)]
    got = H.StructureAware(edges=spark.createDataFrame(edges, "id1 string, id2 string, distance double"), mode=mode, threshold=0.5, test_size=0.25, val_size=0.1).run(df)
    part = {r.id: r.split for r in got.assigned.collect()}
    assert len(part) == n == got.assigned.count() and all(part[a] == part[b] for a, b in near)
    root = roots(near)
    largest = max(sum(r == x for r in root.values()) for x in set(root.values()))
    for name, share in (("test", 0.25), ("val", 0.1)):
        assert abs(sum(p == name for p in part.values()) - share * n) <= largest
    assert got.stats()["structure_component_leak_train_test"] == 0
    assert {r.id: r.split for r in H.StructureAware(edges=spark.createDataFrame(edges, "id1 string, id2 string, distance double"), mode=mode, threshold=0.5, test_size=0.25, val_size=0.1).run(df).assigned.collect()} == part


def test_structure_aware_with_an_empty_part(spark):
    """One component of nearly all rows: the split is still made where that is allowed, every row with its component."""
    df = spark.createDataFrame([(i,) for i in range(12)], "id long")
    chain = spark.createDataFrame([(i, i + 1, 0.1) for i in range(9)], "id1 long, id2 long, distance double")
    got = H.StructureAware(edges=chain, val_size=0.1, allow_empty=True).run(df).assigned.collect()
    assert sorted(r.id for r in got) == list(range(12)) and {r.structure_component for r in got} == {0, 10, 11}
    assert len({r.split for r in got if r.id < 10}) == 1 and len({r.split for r in got}) < 3


def test_structure_aware_errors(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long")
    chain = spark.createDataFrame([(i, i + 1, 0.1) for i in range(9)], "id1 long, id2 long, distance double")
    with pytest.raises(ValueError, match="too large"):
        H.StructureAware(edges=chain).run(df)
    with pytest.raises(ValueError, match="needs edges"):
        H.StructureAware().run(df)
    with pytest.raises(ValueError, match="missing columns"):
        H.StructureAware(edges=chain.drop("distance")).run(df)


def test_stratified_groups(spark):
    """No group in two folds, labels within two points of their shares, and sizes near each other; one group holds a sixth."""
    rng, rows = random.Random(7), []
    for g in range(400):
        lean = rng.choice("abc")
        rows += [(f"g{g}", lean if rng.random() < 0.7 else rng.choice("abc")) for _ in range(rng.randint(1, 12))]
    rows += [("hot", rng.choice("abc")) for _ in range(500)]
    df = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(rows)] + [(10**6, None, "a"), (10**6 + 1, "g1", None)], "id long, study string, label string").repartition(3)
    got = H.StratifiedGroupKFold(group_col="study").run(df)
    found = got.assigned.collect()
    assert len(found) == len(rows)
    fold = {}
    for r in found:
        assert fold.setdefault(r.study, r.fold) == r.fold
    sizes = [sum(r.fold == f for r in found) for f in range(5)]
    assert max(sizes) - min(sizes) < 0.1 * len(rows)
    for x in "abc":
        share = sum(r.label == x for r in found) / len(found)
        for f in range(5):
            assert abs(sum(r.fold == f and r.label == x for r in found) / sizes[f] - share) < 0.05
    assert got.fold(0).stats()["study_leak_train_test"] == 0


def test_place_vectors():
    """Equal kinds are dealt evenly, and what is left over goes where its labels are rarest."""
    assert H.place_vectors([((1, 0), 10)], 5) == [[]]
    assert H.place_vectors([((4, 0), 2), ((0, 4), 2)], 4) == [[0, 1], [0, 1]]
    assert H.place_vectors([((3, 0), 1), ((2, 0), 1), ((2, 0), 1)], 3) == [[0], [1], [2]]
    assert H.place_vectors([], 3) == []


@pytest.mark.parametrize("group", [None, "study"])
def test_nested(spark, group):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, f"g{rng.randrange(40)}", 1) for i in range(230)], "id long, study string, extra int").repartition(4)
    got = H.NestedKFold(n_splits=4, inner_splits=3, group_col=group).run(df)
    rows = got.assigned.collect()
    assert len(rows) == 230
    unit = (lambda r: r[group]) if group else (lambda r: r.id)
    units = {unit(r): (r.fold, tuple(r.inner)) for r in rows}
    assert all(units[unit(r)] == (r.fold, tuple(r.inner)) for r in rows)  # units are never torn, on any level
    for j in range(4):
        outside = [inner[j] for fold, inner in units.values() if fold != j]
        assert all(inner[j] is None for fold, inner in units.values() if fold == j) and None not in outside
        held = [outside.count(f) for f in range(3)]
        assert max(held) - min(held) <= 1 and sum(held) == len(outside)
    sizes = [sum(f == j for f, _ in units.values()) for j in range(4)]
    assert max(sizes) - min(sizes) <= 1
    part = got.part(2, 1)
    assert {r.split for r in part.collect()} == {"train", "val", "test"} and part.columns == ["id", "study", "extra", "split"]
    leaks = got.leaks("study").collect()
    if group:
        assert len(leaks) == 4 and all(r.outer_leaks == r.inner_leaks == 0 for r in leaks)
    else:  # rows of one study are torn, and the check says so
        assert all(r.outer_leaks > 0 and r.inner_leaks > 0 for r in leaks)
    assert {r.id: tuple(r.inner) for r in H.NestedKFold(n_splits=4, inner_splits=3, group_col=group).run(df.repartition(2)).assigned.collect()} == {r.id: tuple(r.inner) for r in rows}


def test_nested_errors(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "id long")
    for bad in ({"n_splits": 5}, {"n_splits": 2, "inner_splits": 3}, {"inner_splits": 1}, {"group_col": "nothing"}):
        with pytest.raises(ValueError):
            H.NestedKFold(**bad).run(df)


def test_registry():
    assert {"structure_aware", "stratified_group_kfold", "nested_kfold"} <= set(registry.KINDS["split"])
    assert registry.build("split", "nested_kfold", {"n_splits": 3}).n_splits == 3 and Columns().id == "id"
