"""Sets, buckets, quantiles and policies against plain models."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import sequences as S
from granary.functions.selection import select_quantiles
from granary.operators import greedy
from granary.operators import reducers as R
from granary.roles import Columns


def sequences(n, seed, letters="ACGT"):
    rng, out = random.Random(seed), []
    for _ in range(n):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(3, 60)))
        if out and rng.random() < 0.6:
            s = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                s[rng.randrange(len(s))] = rng.choice(letters)
            s = "".join(s) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))
        out.append(s)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("threshold,margin,rows", [
    (0.0, 0.05, 4096), (0.03, 0.0, 3), (0.3, 0.05, 4096), (0.3, 0.4, 10), (0.7, 0.05, 4096), (0.7, 0.0, 3), (0.95, 0.05, 10), (1.0, 0.05, 4096),
])
def test_alike_sets(spark, monkeypatch, threshold, margin, rows):
    """Whatever the prefixes' margin and the salts, all pairs and no others."""
    monkeypatch.setattr(S, "MARGIN", margin)
    monkeypatch.setattr(S, "TOKEN_ROWS", rows)
    seqs = sequences(70, 3)
    sets = [S.kmer_set(s, 3) for s in seqs]
    want = {(i, j): len(sets[i] & sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] & sets[j] and S.jaccard(sets[i], sets[j]) >= threshold}
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string")
    got = S.alike_sets(S.kmers(df, 3, "id", "sequence"), threshold).collect()
    assert {(r.p, r.c): r.shared for r in got} == want and len(got) == len(want)
    assert all(abs(r.score - S.jaccard(sets[r.p], sets[r.c])) < 1e-12 for r in got)


@pytest.mark.parametrize("threshold,rows", [(0.5, 16384), (0.7, 16384), (0.7, 7), (0.95, 3), (1.0, 16384)])
def test_alike_sequences(spark, monkeypatch, threshold, rows):
    """Sketches lose no pair, whatever the parts; sets of one k-mer, of short sequences and beyond the BMP too."""
    monkeypatch.setattr(S, "SKETCH_ROWS", rows)
    monkeypatch.setattr(S, "SKETCH_BITS", 1 << 40)
    seqs = sequences(160, 3) + ["a", "ab", "aaaaaa", "aaaaaaa", "\U0001f600é漢字xyzxyzq", "\U0001f600é漢字xyzxyzqx"]
    seqs += ["".join(random.Random(i).choice("ACGT") for _ in range(3000)) + "T" * i for i in (1, 1, 2, 2)]
    sets = [S.kmer_set(s, 3) for s in seqs]
    want = {(i, j): len(sets[i] & sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] & sets[j] and S.jaccard(sets[i], sets[j]) >= threshold}
    got = S.alike_sequences(spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string"), 3, "id", "sequence", threshold).collect()
    assert {(r.p, r.c): r.shared for r in got} == want and len(got) == len(want)
    assert all(abs(r.score - S.jaccard(sets[r.p], sets[r.c])) < 1e-12 for r in got)


def test_documents_make_no_row_for_each_kmer(spark, monkeypatch):
    """Whole texts are sketched: no table of k-mers is written at the threshold of documents."""
    monkeypatch.setattr(S, "kmers", lambda *a: pytest.fail("a row for each k-mer"))
    df = spark.createDataFrame([(1, "the quick brown fox " * 9), (2, "the quick brown fox " * 9 + "j"), (3, "jumps over")], "id long, sequence string")
    assert sorted(r.id for r in R.KmerJaccard(threshold=0.7).run(df).kept.collect()) == [1, 3]


@pytest.mark.parametrize("small", [10**6, 0])
def test_kept_in_buckets(spark, monkeypatch, small):
    monkeypatch.setattr(greedy, "SMALL", small)
    rng = random.Random(1)
    held = {i: {rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9)) for _ in range(3)} | ({"hot"} if rng.random() < 0.3 else set()) for i in range(300)}
    taken, want = set(), set()
    for i in sorted(held):
        if taken.isdisjoint(held[i]):
            want.add(i)
            taken |= held[i]
    rows = [(b, i) for i, bs in held.items() for b in bs]
    rng.shuffle(rows)
    got = greedy.kept_in_buckets(spark.createDataFrame(rows, "bucket string, id long")).collect()
    assert {r.id for r in got} == want and len(got) == len(want)


def test_a_hot_bucket_makes_no_pairs(spark, monkeypatch):
    """100,000 rows in one bucket take a round of as many rows."""
    monkeypatch.setattr(greedy, "SMALL", 1000)
    rows = spark.range(100_000).select(F.lit("hot").alias("bucket"), "id").unionByName(spark.range(100_000).select(F.concat(F.lit("own"), "id").alias("bucket"), "id"))
    assert [r.id for r in greedy.kept_in_buckets(rows).collect()] == [0]


def test_signatures(spark):
    seqs = sequences(20, 5) + ["a", "é漢字 text", "x" * 5000 + "".join(map(str, range(3000)))]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string")
    perms = S.permutations(16, 7)
    for r in S.signatures(df, 4, "id", "sequence", 16, 7).collect():
        hashes = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % S.PRIME for t in S.kmer_set(seqs[r.id], 4)]
        assert r.sig == [min((a * h + b) % S.PRIME for h in hashes) for a, b in perms]


@pytest.mark.parametrize("values,hashes,letters", [(1 << 12, 1 << 10, 1 << 12), (64, 128, 1 << 12), (1 << 12, 0, 1 << 12), (1 << 12, 1 << 10, 20)])
def test_kept_values_change_no_signature(monkeypatch, values, hashes, letters):
    """With room for all k-mers, for some, for none, and with letters beyond those numbered; what is kept is not reckoned anew."""
    monkeypatch.setattr(S, "KEPT_VALUES", values)
    monkeypatch.setattr(S, "KEPT_HASHES", max(hashes, 1))
    made, reckon = [], S._values
    monkeypatch.setattr(S, "_values", lambda a, b, h: (made.append(len(h)), reckon(a, b, h))[1])
    perms, signer = S.permutations(4, 3), S._Signer(5, 4, 3)
    signer.code = signer.code[:letters]
    for seq in sequences(12, 5) + ["", "a", "é漢字 text", "abcde", "the quick brown fox " * 3, "the lazy dog and the quick brown fox"]:
        want = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % S.PRIME for t in S.kmer_set(seq, 5)]
        for _ in range(2):
            made.clear()
            assert signer.sign(seq).tolist() == [min((a * h + b) % S.PRIME for h in want) for a, b in perms]
        assert values < 1 << 12 or hashes < 1 << 10 or letters == 20 or len(seq) < 5 or not sum(made)


@pytest.mark.parametrize("verify", [False, True])
def test_minhash_model(spark, verify):
    """Kept rows, representatives and scores as one row after the other would give."""
    seqs = sequences(60, 9)
    seqs += seqs[:6]
    df = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(seqs)], "id string, sequence string")
    strategy = R.MinhashJaccard(threshold=0.6, k=3, num_perm=32, verify=verify)
    sigs = {r.id: tuple(r.sig) for r in S.signatures(df, 3, "id", "sequence", 32, 42).collect()}
    b, rows = S.bands(0.6, 32)
    alike = lambda x, y: sum(u == v for u, v in zip(sigs[x], sigs[y])) / 32
    kept, want = [], {}
    for i in sorted(sigs):
        near = [k for k in kept if any(sigs[i][j * rows : (j + 1) * rows] == sigs[k][j * rows : (j + 1) * rows] for j in range(b)) and (not verify or alike(i, k) >= 0.6)]
        if near:
            best = min(near, key=lambda k: (-alike(i, k), k))
            want[i] = (best, alike(i, best))
        else:
            kept.append(i)
    got = strategy.run(df)
    assert {r.id for r in got.kept.collect()} == set(kept)
    assert {r.removed_id: (r.representative_id, r.score) for r in got.mapping.collect()} == want


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501) * 1e5, "b": np.repeat([1.5, -2.0, 0.0, -0.0], 25), "c": np.array([7.0]), "d": np.array([1e-300, -1e300, np.inf, 3.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("b", math.nan), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = select_quantiles(df, F.col("v"), shares, F.col("g"))
    assert set(got) == {"a", "b", "c", "d", None}
    for g in "abc":
        assert got[g] == pytest.approx(list(np.quantile(data[g], shares)), rel=1e-12)
    assert got["d"][0] == -1e300 and got["d"][-1] == math.inf
    whole = np.sort(np.concatenate(list(data.values())))
    assert got[None][0] == whole[0] and got[None][3] == pytest.approx(np.quantile(whole, 0.5))
    assert select_quantiles(df.limit(0), F.col("v"), shares) == {}


@pytest.mark.parametrize("keep,key", [
    ("longest_sequence", lambda r: (-len(r[1]), r[0])),
    ("best_quality", lambda r: (r[2] is None, -(r[2] or 0), r[0])),
    ("earliest_time", lambda r: (r[3] is None, r[3] or "", r[0])),
    ("greatest_label", lambda r: (-r[4], r[0])),
])
def test_policies(spark, keep, key):
    """Each policy on two strategies, each strategy under two policies, against the greedy model in that order."""
    rng = random.Random(12)
    seqs = sequences(40, 8)
    seqs += [rng.choice(seqs) for _ in range(15)]
    data = [(f"p{i:02d}", s, rng.choice([None, 1.0, 2.5, 9.0]), rng.choice([None, "2020-01-02", "2019-05-01"]), rng.randint(0, 3)) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(data, "id string, sequence string, quality double, date string, label int").repartition(3)
    edges = [(rng.choice(data)[0], rng.choice(data)[0], rng.random()) for _ in range(120)]
    edge_df = spark.createDataFrame(edges, "id1 string, id2 string, distance double")
    vectors = {r[0]: [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)] for r in data}
    vec_df = spark.createDataFrame(list(vectors.items()), "id string, embedding array<double>")
    cols = Columns(date="date")

    def cosine(x, y):
        a, b = np.array(vectors[x]), np.array(vectors[y])
        return round(float(a @ b / max(np.linalg.norm(a), 1e-12) / max(np.linalg.norm(b), 1e-12)), 9)

    text = {r[0]: r[1] for r in data}
    near = {(a, b) for x, y, d in edges if d <= 0.5 and x != y for a, b in ((x, y), (y, x))}
    models = {
        R.Exact: ({}, lambda x, y: text[x] == text[y]),
        R.KmerJaccard: ({"threshold": 0.5, "k": 3}, lambda x, y: S.jaccard(S.kmer_set(text[x], 3), S.kmer_set(text[y], 3)) >= 0.5),
        R.StructuralDistance: ({"edges": edge_df}, lambda x, y: (x, y) in near),
        R.EmbeddingCosine: ({"embeddings": vec_df, "threshold": 0.9}, lambda x, y: cosine(x, y) >= 0.9),
    }
    own = {"longest_sequence": (R.Exact, R.KmerJaccard), "best_quality": (R.StructuralDistance, R.Exact), "earliest_time": (R.EmbeddingCosine, R.StructuralDistance), "greatest_label": (R.KmerJaccard, R.EmbeddingCosine)}
    for cls, (params, alike) in models.items():
        if cls not in own[keep]:
            continue
        kept = []
        for r in sorted(data, key=key):
            if not any(alike(r[0], k) for k in kept):
                kept.append(r[0])
        got = cls(keep=keep, **params).run(df, cols)
        assert sorted(r.id for r in got.kept.collect()) == sorted(kept), cls.name
        for m in got.mapping.collect():
            assert m.representative_id in kept and alike(m.removed_id, m.representative_id)


def test_policy_errors(spark):
    df = spark.createDataFrame([("a", "x")], "id string, sequence string")
    with pytest.raises(ValueError, match="keep must be"):
        R.Exact(keep="loudest").run(df)
    with pytest.raises(ValueError, match="needs a column"):
        R.Exact(keep="best_quality").run(df)
