"""Line dedup against brute force, and the levels of its runs."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import line_dedup

SCHEMA = "doc_id long, text string, row_id long, h long, g long, gone string, n_lines string, key string, at int, often int"
SPACE = "[\\x20\\x09-\\x0D]+"


def key(line):
    bare = re.sub(f"^{SPACE}|{SPACE}$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(rows, least):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    docs = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    out = []
    for i, lines in split:
        stay = [x for x in lines if not key(x) or docs[key(x)] < least]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def texts(rng, n):
    common = ["All rights reserved", " all RIGHTS reserved\t", "Ünïcode Läne", "É only here", "same \x0b", "\xa0no-break\xa0"]
    for _ in range(n):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randint(0, 60)}" for _ in range(rng.randint(1, 8))]
        lines += [""] * rng.randint(0, 2) + ["footer"] * rng.randint(0, 2)
        rng.shuffle(lines)
        yield "\n".join(lines)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", "y", "z", 4, 5) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("hot,fanout", [(line_dedup.HOT, 4), (5, 2), (10**9, 3)])
def test_against_brute_force(spark, monkeypatch, hot, fanout):
    """hot: from no key to nearly every key is told by the broadcast table."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(4)
    rows = list(enumerate(texts(rng, 80)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "footer"), (None, "footer\nmine"), rows[0], rows[0], (None, None), (104, "footer\n" * 3)]
    rows += [(105, "\n".join(["long"] * 3 + [f"own {k}" for k in range(5000)] + ["footer"])), (106, "one\r\ntwo\r\n\nfooter \r")]
    df = table(spark, rows)
    got, n_lines, n_dropped = line_dedup.drop_lines(df, min_docs=7, batches=5, fanout=fanout)
    assert got.columns == [*df.columns, n_lines, n_dropped] and n_lines != "n_lines"
    assert sorted([(r.doc_id, r.text, r[n_lines], r[n_dropped]) for r in got.collect()], key=str) == brute(rows, 7)
    assert {tuple(r) for r in got.select(*df.columns[2:]).distinct().collect()} == {(1, 2, 3, "x", "y", "z", 4, 5)}


def test_empty_and_single(spark):
    assert line_dedup.drop_lines(table(spark, []))[0].count() == 0
    only = line_dedup.drop_lines(table(spark, [(1, "a\nb")]), min_docs=1)[0].first()
    assert only.text == ""


def test_runs_are_levelled(spark):
    """Settled keys are not added again; levels hold fewer runs than fanout; counts are those of all batches."""
    rng, runs, want = random.Random(2), line_dedup.Runs(5, fanout=2), Counter()
    for k in range(7):
        batch = {(h, h * 7): rng.randint(1, 3) for h in rng.sample(range(40), 15)} | {(-1, 0): 9}
        want.update(batch)
        runs.add(spark.createDataFrame([(h, g, n) for (h, g), n in batch.items()], "h long, g long, n long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert runs.compactions == 4 and [len(x) for x in runs.levels] == [1, 1, 1]
    assert {(r.h, r.g) for r in runs.frequent().collect()} == {k for k, n in want.items() if n >= 5}
    assert sum(t.where("h = -1").agg(F.sum("n")).first()[0] or 0 for t in runs.tables()) == 9  # settled by its first batch
    runs.discard()


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = list(enumerate(texts(rng, 60))) + [(70, None)]
    table(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in line_dedup.op12_line_dedup(spark, str(tmp_path)).select("doc_id", "kept_sha256", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=str) == sorted([(i, hashlib.sha256(t.encode()).hexdigest(), n, d) for i, t, n, d in brute(rows, 10)], key=str)
    assert sum(r[3] for r in got)
