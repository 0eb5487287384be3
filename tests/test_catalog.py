"""Queries against their SQL on the smallest tables, where these are installed; and the driver contract."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from granary.plans import catalog

DATA = os.environ.get("GRANARY_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def same(rows):
    def text(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(want.columns) == cols
    assert same(df.select(cols).toPandas().itertuples(index=False)) == same(want[cols].itertuples(index=False))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "cluster_id"]


def odd_documents(spark, path):
    """Documents with near and exact copies, and null, empty, blank and 'nan' texts; as a query's folder and as rows."""
    import random

    rng = random.Random(4)
    words = [" ".join(rng.choice(["here", "there", "other", "and", "ines", "tion"]) for _ in range(30)) for _ in range(6)]
    texts = [None, "", "nan", *words, None, "", "NaN", " ", "abc", *(w + "s" for w in words), "nan", None, words[0], "", "\n"]
    rows = [(100 + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_kmer_documents_without_text(spark, tmp_path):
    """Null, empty and 'nan' texts are no errors; null ones are one class."""
    from granary.functions import sequences as S

    path, rows = odd_documents(spark, tmp_path)
    kept = []
    for i, text, *_ in rows:
        if not any(t == text if None in (t, text) else S.jaccard(S.kmer_set(t, 5), S.kmer_set(text, 5)) >= 0.7 for _, t in kept):
            kept.append((i, text))
    got = catalog.QUERIES["reduce_kmer_jaccard_documents"](spark, path).collect()
    assert sorted(map(tuple, got)) == [(i, f"kmer:{i}") for i, _ in kept]
    assert {None, "", "nan", "NaN", " "} <= {t for _, t in kept} and len(kept) < len(rows) - 6


@pytest.mark.parametrize("name", ["reduce_minhash_jaccard", "minhash_signatures", "reduce_minhash_jaccard_mapping"])
def test_minhash_documents_without_text(spark, tmp_path, name):
    """Null, empty and 'nan' texts are what the SQL makes of them."""
    duckdb = pytest.importorskip("duckdb")
    path, _ = odd_documents(spark, tmp_path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, path)
    want = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert same(df.select(want.columns).collect()) == same(want.fetchall()) != []
