"""Exact top-k search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from granary.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, q int"


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(ok):
        if q % 10 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(ok) if j != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("n,dim", [(0, 3), (5, 3), (400, 4), (700, 16)])
def test_against_brute_force(spark, n, dim):
    import numpy as np

    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.choice([rng.gauss(0, 1), 0.25]))) for _ in range(dim)], 1, 1, "x", 1) for i in range(n)]
    rows += [(1000, None, 1, 1, "x", 1), (1010, [1.0, None], 1, 1, "x", 1), (1020, [math.nan], 1, 1, "x", 1), (1030, [math.inf], 1, 1, "x", 1), (None, [1.0], 1, 1, "x", 1)]
    if n:
        rows += [(2000, rows[1][1], 1, 1, "x", 1), (2001, rows[1][1], 1, 1, "x", 1), (2010, [], 1, 1, "x", 1), (2011, [1.0], 1, 1, "x", 1)]
        rows += [rows[0], (0, rows[2][1], 1, 1, "x", 1), (2000, rows[3][1], 1, 1, "x", 1)]  # repeated rows and ids
    got = topk_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, shard=100, block=16, group=2)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, 10)


def test_tree_prunes():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(0, 10, (20, 4))
    m = np.concatenate([c + rng.normal(0, 0.1, (400, 4)) for c in centres])
    tree = topk_search.Tree(np.floor(1024 * m), np.arange(len(m)))
    opened = []

    class Counted(list):
        def __getitem__(self, k):
            opened.append(k)
            return super().__getitem__(k)

    tree.span = Counted(tree.span)
    best = []
    q = np.floor(1024 * m[5])
    tree.search(q, 5, tree.bounds(q[None])[0], 10, best)
    s = tree.vectors @ q
    want = sorted(((int(s[i]), -int(tree.ids[i])) for i in range(len(m)) if tree.ids[i] != 5), reverse=True)[:10]
    assert sorted(best, reverse=True) == want and len(opened) < len(tree.kids) / 4


def test_trees_are_built_once(spark):
    """Each shard's tree is written once, however many blocks of queries meet it."""
    from granary.storage import recorded

    df = spark.range(900).selectExpr("id as vec_id", "array(cast(id % 17 as float), cast(id % 5 as float)) as embedding")
    with recorded() as made:
        topk_search.top_k(df, F.col("vec_id") % 3 == 0, shard=100, block=50, group=3).collect()
    trees = next(p for p in made if "/trees-" in p)
    assert spark.read.parquet(trees).count() == 9
