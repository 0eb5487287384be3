"""Whitening against numpy on the whole table."""

import math
import random

import numpy as np
import pytest

from granary.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, id string, x int, label int"


def rows_of(n, dim, rank=None, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, rank or dim)) @ rng.normal(size=(rank or dim, dim)) * rng.uniform(0.01, 3, dim)
    return [(i, [float(np.float32(v)) for v in r], "s", 1, 2) for i, r in enumerate(base)]


def integers(rows):
    ok = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in ok)
    return [i for i, _ in ok], np.array([[math.floor(64 * x) + 1_000_000 for x in v] + [1_000_000] * (dim - len(v)) for _, v in ok], dtype=np.int64)


@pytest.mark.parametrize("n,dim", [(300, 5), (2000, 40), (400, 64)])
def test_against_numpy(spark, n, dim, tmp_path):
    rows = rows_of(n, dim)
    rows += [rows[3], (None, rows[4][1], None, None, None), (7, None, "", 1, 1), (8, [None] * dim, "", 1, 1), (9, [math.nan] * dim, "", 1, 1), (10, [math.inf] * dim, "", 1, 1), (11, [1.0], "", 1, 1), (12, [], "", 1, 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = w.op11_whitening(spark, str(tmp_path)).toPandas()
    ids, x = integers(rows)
    m = min(32, dim)
    assert len(got) == len(ids) * m and set(got["n"]) == {len(ids)}
    s = x.sum(axis=0)
    d = len(ids) * x - s
    dev = sorted(str((int(i) if i is not None else None, int(v))) for i, v in zip(ids, (d.astype(object) ** 2).sum(axis=1)))
    first = got[got["component"] == 1]
    assert sorted(str((None if math.isnan(i) else int(i), int(v))) for i, v in zip(first["vec_id"], first["deviation"])) == dev
    cov = (d / len(ids)).T @ (d / len(ids)) / len(ids)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:m], u[:, ::-1][:, :m]
    want = (d / len(ids)) @ u / np.sqrt(e)
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, e / np.trace(cov), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    at = {i: k for k, i in enumerate(ids) if ids.count(i) == 1 and i is not None}
    wide = got[got["vec_id"].isin(at)].pivot(index="vec_id", columns="component", values="whitened")
    ours, theirs = wide.to_numpy(), want[[at[i] for i in wide.index]]
    sign = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours - theirs * sign).max() < 1e-6


@pytest.mark.parametrize("rows,rank", [
    (rows_of(200, 12, 4), None),
    ([(i, [float(i), float(i), 5.0, -2.0 * i], "", 1, 1) for i in range(50)], 1),
    ([(i, [random.Random(i * 7 + k).gauss(0, 1) for k in range(30)], "", 1, 1) for i in range(10)], 9),
    ([(i, [1.0, 2.0], "", 1, 1) for i in range(10)], 0),
    ([(1, [1.0, 2.0], "", 1, 1)], 0),
    ([], 0),
])
def test_components_without_variance_are_left_out(spark, rows, rank, tmp_path):
    """Copies, constant and dependent dimensions, fewer rows than dimensions, one row, none."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = w.op11_whitening(spark, str(tmp_path)).toPandas()
    if rank is None:  # the integers' own rank
        _, x = integers(rows)
        e = np.linalg.eigvalsh(np.cov(x.T, bias=True))
        rank = int((e > 1e-9 * e.max()).sum())
    assert len(got) == len(rows) * rank
    if rank:
        assert got["identity_error"][0] < 1e-6 and got["explained"].groupby(got["component"]).first().sum() == pytest.approx(1, abs=1e-9)


def test_ill_conditioned(spark):
    """Singular values over nine orders of magnitude come out to a relative error that a Gram matrix alone can't give."""
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(500, 6)) * 10.0 ** np.arange(10, 4, -1)).astype(np.int64)
    x[:, 5] = x[:, 0] + np.rint(rng.normal(size=500) * 4).astype(np.int64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<long>").repartition(4)
    model = w.fit(df, 6)
    d = len(x) * x.astype(object) - x.astype(object).sum(axis=0)
    s = np.linalg.svd((d / len(x)).astype(float), compute_uv=False)
    assert np.allclose(model.eigenvalues, s**2 / len(x), rtol=1e-6) and model.passes >= 2


def test_deviations_beyond_64_bits(spark):
    model = w.Whitening(3, np.array([3 * 10**15]), np.eye(1), np.ones(1), 1.0, 1)
    assert model.deviations(np.array([[10**15], [10**15 + 5], [10**16]])) == [0, 225, None]


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        w.integers(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), "vec_id", "embedding").count()
