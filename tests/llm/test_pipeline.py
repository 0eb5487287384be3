"""The pipeline's stages on the smallest tables, each held against what it must leave."""

import os
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from granary.llm import toxicity
from granary.llm.tokens import Encoder, default_path

DATA = os.environ.get("GRANARY_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), [spark.read.parquet(f"{DATA}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_toxicity(spark, steps):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    known = steps[0].where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    scores = {r.doc_id: r.score for r in toxicity.score(steps[0], toxicity.learn(known, labels)).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {i for i, s in scores.items() if s < 0.5}


def test_exact(steps):
    before, after = steps[1].collect(), steps[2].collect()
    keys = lambda rows: [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows]
    assert set(keys(before)) == set(keys(after)) and len(set(keys(after))) == len(after)


def test_near(steps):
    before, after = {r.doc_id: r.text for r in steps[2].collect()}, {r.doc_id for r in steps[3].collect()}
    sets = {i: shingles(t) for i, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for gone in set(before) - after:
        assert max(alike(gone, i) for i in before if i != gone) > 0.5
    ids = sorted(after)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(a, b) >= 0.9]


def test_mixing_and_packing(steps):
    mixed, packed = Counter(r.doc_id for r in steps[4].collect()), steps[5].collect()
    assert set(mixed) <= {r.doc_id for r in steps[3].collect()} and max(mixed.values()) <= 3
    texts, encode = {r.doc_id: r.text for r in steps[4].collect()}, Encoder(default_path("byte_bpe_50k.json"))
    want = Counter()
    for i, n in mixed.items():
        data = encode(texts[i] or "") + bytes(4)
        head = len(data) // 4 % 2048 or 2048
        for k, (at, m) in enumerate([(0, min(head, len(data) // 4)), *((a, 2048) for a in range(head, len(data) // 4, 2048))]):
            want[i, k, zlib.crc32(data[4 * at : 4 * (at + m)])] += n
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == want


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, DATA)
    key = lambda df: Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(got) == key(steps[-1])
