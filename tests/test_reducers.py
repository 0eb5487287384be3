"""Invariants of all strategies, and a sequential model of each greedy policy."""

import math
import random

import pytest

from granary.functions import sequences as S
from granary.operators import greedy
from granary.operators import reducers as R
from granary.plans import runner
from granary.roles import Columns

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def edges_of(spark, peptides):
    ids = sorted(r.id for r in peptides.select("id").collect())
    rows = [(ids[i], ids[(i * 7 + 3) % len(ids)], (i * 13 % 100) / 100) for i in range(len(ids))]
    return spark.createDataFrame(rows, "id1 string, id2 string, distance double")


def params(name, spark, peptides, vectors):
    return {
        "exact": {}, "kmer_jaccard": {"threshold": 0.4}, "minhash_jaccard": {"threshold": 0.5, "num_perm": 32}, "identity_greedy": {"threshold": 0.8},
        "embedding_cosine": {"embeddings": vectors, "threshold": 0.9}, "descriptor_euclidean": {"threshold": 0.5},
        "structural_distance": {"edges": edges_of(spark, peptides), "threshold": 0.6}, "mmseqs2": {"min_seq_id": 0.8},
    }[name]


@pytest.mark.parametrize("name", sorted(R.STRATEGIES))
def test_invariants(spark, peptides, vectors, name):
    got = runner.reduce(peptides, name, **params(name, spark, peptides, vectors))
    ids = {r.id for r in peptides.collect()}
    kept = {r.id for r in got.kept.collect()}
    mapping = got.mapping.collect()
    assert got.mapping.schema.simpleString() == "struct<removed_id:string,representative_id:string,cluster_id:string,score:double>"
    removed = [m.removed_id for m in mapping]
    assert len(set(removed)) == len(removed) and set(removed) | kept == ids and not set(removed) & kept
    assert {m.representative_id for m in mapping} <= kept and all(m.representative_id < m.removed_id for m in mapping)
    assert 0 < len(kept) < len(ids)
    assert got.stats()["n_removed"] == len(removed)


def greedy_model(rows, alike):
    """rows: (id, ...) in id order; alike(p, c) -> (order key, score) or None."""
    kept, mapping = [], {}
    for c in rows:
        options = [(a[0], p[0], a[1]) for p in kept if (a := alike(p, c))]
        if options:
            best = min(options)
            mapping[c[0]] = (best[1], round(best[2], 9))
        else:
            kept.append(c)
    return mapping


def as_dict(mapping):
    return {m.removed_id: (m.representative_id, round(m.score, 9)) for m in mapping.collect()}


def test_kmer_jaccard_against_model(peptides):
    rows = sorted((r.id, S.kmer_set(r.sequence, 3)) for r in peptides.collect())

    def alike(p, c):
        shared = len(p[1] & c[1])
        return (-shared, S.jaccard(p[1], c[1])) if shared and S.jaccard(p[1], c[1]) >= 0.4 else None

    assert as_dict(R.KmerJaccard(threshold=0.4, k=3).run(peptides).mapping) == greedy_model(rows, alike)


def test_identity_against_model(peptides):
    rows = sorted((r.id, r.sequence, S.kmer_set(r.sequence, 5)) for r in peptides.collect())

    def alike(p, c):
        shared, score = len(p[2] & c[2]), S.positional_identity(p[1], c[1])
        near = abs(len(p[1]) - len(c[1])) / max(len(p[1]), len(c[1])) <= 0.15
        return (-shared, score) if shared and near and S.jaccard(p[2], c[2]) >= 0.2 and score >= 0.85 else None

    assert as_dict(R.IdentityGreedy(threshold=0.85).run(peptides).mapping) == greedy_model(rows, alike)


def test_cosine_against_model(peptides, vectors):
    rows = sorted((r.id, r.embedding) for r in vectors.collect())

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    def alike(p, c):
        s = cosine(p[1], c[1])
        return (0, s) if round(s, 9) >= 0.9 else None

    got = R.EmbeddingCosine(embeddings=vectors, threshold=0.9).run(peptides)
    assert as_dict(got.mapping).keys() == greedy_model(rows, alike).keys()
    assert {k: v[0] for k, v in as_dict(got.mapping).items()} == {k: v[0] for k, v in greedy_model(rows, alike).items()}
    assert {r.id for r in got.kept.collect() if r.embedding_cosine_cluster_id.startswith("singleton:")} == {f"p{i:03d}" for i in range(50, 60)}


def test_rounds_agree_with_the_sequential_end(spark, monkeypatch):
    import random

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(300)}
    edges = spark.createDataFrame(sorted(pairs), "p long, c long")
    one = {r.node for r in greedy.removed_rows(edges).collect()}
    monkeypatch.setattr(greedy, "SMALL", 0)
    assert {r.node for r in greedy.removed_rows(edges).collect()} == one


def test_dense_edges_are_settled_by_a_prefix(spark, monkeypatch):
    """Of 300 rows of which any two are alike by a fifth, a prefix leaves few edges for rounds; parallel edges and rows that the
    table lacks change nothing."""
    monkeypatch.setattr(greedy, "SMALL", 400)
    rng = random.Random(8)
    pairs = [(p, c) for p in range(300) for c in range(p + 1, 300) if rng.random() < 0.2]
    listed = [(p, c, 0.25) for p, c in pairs] + [(c, p, 0.125) for p, c in pairs[::3]] + [(-1, c, 0.0) for c in range(300)]
    written, materialize = [], greedy.materialize
    monkeypatch.setattr(greedy, "materialize", lambda df, label: (written.append((label, (t := materialize(df, label)).count())), t)[1])
    got = R.StructuralDistance(edges=spark.createDataFrame(listed, "id1 long, id2 long, distance double")).run(spark.range(300)).mapping.collect()
    near, half = set(pairs), set(pairs[::3])
    kept, want = [], {}
    for c in range(300):
        p = next((p for p in kept if (p, c) in near), None)
        if p is None:
            kept.append(c)
        else:
            want[str(c)] = (str(p), 0.125 if (p, c) in half else 0.25)
    assert {r.removed_id: (r.representative_id, r.score) for r in got} == want and len(got) == len(want)
    assert sum(n for label, n in written if label == "greedy-edges") < len(pairs) / 10


def test_exact_counts(peptides):
    assert R.Exact().run(peptides).stats() == {"n_total": 60, "n_kept": 55, "n_removed": 5, "reduction_ratio": 55 / 60}


@pytest.mark.parametrize("name,bad", [("kmer_jaccard", {"threshold": 1.5}), ("kmer_jaccard", {"k": 0}), ("minhash_jaccard", {"num_perm": 1}), ("descriptor_euclidean", {"metric": "cosine"}), ("descriptor_euclidean", {"threshold": -1}), ("structural_distance", {}), ("embedding_cosine", {})])
def test_bad_parameters(peptides, name, bad):
    with pytest.raises(ValueError):
        runner.reduce(peptides, name, **bad)


def test_bad_rows(spark, peptides):
    with pytest.raises(ValueError):
        runner.reduce(peptides.unionByName(peptides), "exact")
    with pytest.raises(ValueError):
        runner.reduce(spark.createDataFrame([("a", "NaN")], "id string, sequence string"), "kmer_jaccard")
    with pytest.raises(ValueError):
        runner.reduce(peptides, "exact", Columns(sequence="nope"))
    with pytest.raises(ValueError):
        runner.reduce(peptides, "exact", nonsense=1)
    with pytest.raises(KeyError):
        runner.reduce(peptides, "nonsense")


def test_caps_are_refused(peptides):
    import pytest

    from granary.plans import runner

    with pytest.raises(ValueError):
        runner.reduce(peptides, "kmer_jaccard", max_candidates=80)
    with pytest.warns(UserWarning):
        runner.reduce(peptides, "mmseqs2", min_seq_id=0.9, threads=8)
