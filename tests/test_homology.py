"""Alignments against plain dynamic programming, and homology clusters against a model that runs pair by pair."""

import hashlib
import random

import numpy as np
import pytest

from granary.functions import alignment as A
from granary.operators import reducers as R
from granary.operators import splitters as P
from granary.roles import Columns

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def plain_gapped(a, b):
    """(score, identical, columns) cell by cell; more score, then more identical, then fewer columns."""
    low = (-(10**9), 0, 0)
    add = lambda x, s, i: (x[0] + s, x[1] + i, x[2] - 1)
    row, down, best = [(0, 0, 0)] * (len(b) + 1), [low] * (len(b) + 1), (0, 0, 0)
    for x in a:
        new, right = [], low
        for j in range(len(b) + 1):
            down[j] = max(add(row[j], A.OPEN, 0), add(down[j], A.EXTEND, 0))
            cell = max((0, 0, 0), down[j])
            if j:
                cell = max(cell, add(row[j - 1], *((A.MATCH, 1) if x == b[j - 1] else (A.MISMATCH, 0))))
                right = max(add(new[j - 1], A.OPEN, 0), add(right, A.EXTEND, 0))
                cell = max(cell, right)
            new.append(cell)
        row, best = new, max(best, max(new))
    return best[0], best[1], -best[2]


def plain_ungapped(a, b, diagonal):
    best = (0, 0, 0)
    at = [(i, i + diagonal) for i in range(len(a)) if 0 <= i + diagonal < len(b)]
    for x in range(len(at)):
        run = (0, 0, 0)
        for i, j in at[x:]:
            same = a[i] == b[j]
            run = (run[0] + (A.MATCH if same else A.MISMATCH), run[1] + same, run[2] - 1)
            best = max(best, run)
    return best[0], best[1], -best[2]


def pairs(n, seed, letters="ACG", most=25):
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
        b = list(a) if rng.random() < 0.7 else [rng.choice(letters) for _ in range(rng.randint(0, most))]
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 3)] = [rng.choice(letters) for _ in range(rng.randint(0, 3))]
        out.append((a, "".join(b)))
    return out


def test_gapped():
    rows = pairs(150, 1) + [("", ""), ("A", ""), ("", "C"), ("é漢", "é漢字")]
    packed = A.gapped(A.codes([a for a, _ in rows], -1), A.codes([b for _, b in rows], -2))
    assert [tuple(map(int, x)) for x in zip(*A.unpack(packed))] == [plain_gapped(a, b) for a, b in rows]


def test_ungapped():
    rng = random.Random(4)
    rows = [(a, b, rng.randint(-6, 6)) for a, b in pairs(150, 2)] + [("", "", 0), ("ACG", "ACG", 50), ("ACG", "ACG", -3)]
    packed = A.ungapped(A.codes([r[0] for r in rows], -1), A.codes([r[1] for r in rows], -2), np.array([r[2] for r in rows]))
    assert [tuple(map(int, x)) for x in zip(*A.unpack(packed))] == [plain_ungapped(*r) for r in rows]


def test_affine_gaps():
    one = lambda a, b: tuple(int(x[0]) for x in A.unpack(A.gapped(A.codes([a], -1), A.codes([b], -2))))
    assert one("ACDEFGHIK", "ACDEFGHIK") == (9, 9, 9)
    assert one("ACDEFGHIKLMNPQ", "ACDEFGHLMNPQ") == (9, 12, 14)  # a gap of two columns costs three
    assert one("WWWWWACDEFGHIK", "ACDEFGHIKYYYY") == (9, 9, 9) and one("ACD", "WYV") == (0, 0, 0)


def family(seed, n=60):
    """Sequences of which many are another's, with letters changed, left out and put in."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        if out and rng.random() < 0.65:
            s = list(rng.choice(out))
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(s))
                s[at : at + rng.choice([0, 1, 1, 3])] = [rng.choice(LETTERS) for _ in range(rng.choice([0, 1, 1, 2]))]
            s = s[rng.choice([0, 0, 5]) :]
        else:
            s = [rng.choice(LETTERS) for _ in range(rng.randint(12, 70))]
        out.append("".join(s) or "A")
    return out + out[:4]


def model(rows, need, cover, mode, k=5, centres=20, floor=0):
    """Kept ids: seeds, links and the greedy order, pair by pair."""
    first = {}
    for i, s in sorted(rows):
        first.setdefault(s, i)
    text = {i: s for s, i in first.items()}
    lead = {}
    for i, s in text.items():
        places = {}
        for at in range(max(1, len(s) - k + 1)):
            places.setdefault(s[at : at + k], at)
        lead[i] = sorted((int(hashlib.md5(t.encode()).hexdigest()[:15], 16), at) for t, at in places.items())[:centres]
    groups = {}
    for i, kms in lead.items():
        for key, at in kms:
            groups.setdefault(key, []).append((-len(text[i]), i, at))
    hits = {}
    for members in groups.values():
        _, centre, there = min(members)
        for _, i, at in members:
            if i != centre:
                p, c = min(i, centre), max(i, centre)
                d = there - at if i < centre else at - there
                hits.setdefault((p, c, centre), {}).setdefault(d, 0)
                hits[p, c, centre][d] += 1
    links = set()
    for (p, c, centre), of in hits.items():
        diagonal = min(of, key=lambda d: (-of[d], d))
        a, b = text[p], text[c]
        member = b if centre == p else a
        over = {0: (a, b), 1: (member,), 2: (text[centre],)}[mode]

        def meets(found):
            _, same, columns = found
            return columns > 0 and same >= need * columns - 1e-9 and all(min(columns, len(x)) >= cover * len(x) - 1e-9 for x in over)

        if mode == 0 and min(len(a), len(b)) < need * cover * max(len(a), len(b)) - 1e-9:
            assert not meets(plain_gapped(a, b)) and not meets(plain_ungapped(a, b, diagonal))  # the lengths' bound loses nothing
            continue
        flat = plain_ungapped(a, b, diagonal)
        if meets(flat) or (flat[0] >= floor and meets(plain_gapped(a, b))):
            links.add((p, c))
    kept = []
    for i in sorted(text):
        if not any((q, i) in links for q in kept):
            kept.append(i)
    return kept, links


@pytest.mark.parametrize("need,cover,mode,floor", [(0.6, 0.6, 0, 0), (0.9, 0.8, 0, 0), (0.5, 0.7, 1, 0), (0.7, 0.9, 2, 0), (0.5, 0.5, 0, 15)])
def test_clusters(spark, monkeypatch, need, cover, mode, floor):
    monkeypatch.setattr(A, "CELLS", 3000)  # several batches
    rows = [(f"s{i:03d}", s) for i, s in enumerate(family(int(need * 10) + mode))]
    df = spark.createDataFrame(rows, "id string, sequence string").repartition(3)
    strategy = R.Homology(min_seq_id=need, coverage=cover, cov_mode=mode, min_ungapped=floor)
    kept, links = model(rows, need, cover, mode, floor=floor)
    _, first = strategy.classes(df, Columns())
    assert {(r.p, r.c) for r in strategy.aligned(strategy.seeds(first).drop("hits"), first).collect()} == links
    assert sorted(r.id for r in strategy.run(df).kept.collect()) == kept
    assert 0 < len(kept) < len(rows)


def test_split_keeps_clusters_together(spark):
    rows = [(f"s{i:03d}", s) for i, s in enumerate(family(7))]
    df = spark.createDataFrame(rows, "id string, sequence string")
    part = {r.id: r.split for r in P.HomologyAware(min_seq_id=0.6, coverage=0.6, test_size=0.3).run(df).assigned.collect()}
    got = R.Homology(min_seq_id=0.6, coverage=0.6).run(df)
    assert all(part[m.removed_id] == part[m.representative_id] for m in got.mapping.collect())
    assert set(part.values()) == {"train", "test"}
