"""Operators on documents: hard cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import exact_dedup, importance, language_id, lm_scoring, mixing, packing, simhash, token_files, toxicity
from granary.llm.common import components
from granary.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, row_id long, score double, key string, id string, word string, h long"
WORDS = "the of and to in is that for it was on are as with his they at be this from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty, blank and very long texts, exact and near copies, repeated rows, clashing columns."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(30)]
    long = prose(rng, 30_000)
    texts = [None, "", " \t\n", "a", "A b", *base, base[0], base[0] + " ", " ".join(base[1]), long, long + " x", base[2], "ß Éa 'tis 　 x"]
    rows = [(k, t, "en" if k % 3 else None, [None, "a", "b", "c"][k % 4], 7, 0.5, "k", "i", "w", 3) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base[3], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(hard):
    got, groups = exact_dedup.exact_dedup(hard).collect(), defaultdict(list)
    for i, t in rows_of(hard):
        groups[bare(t)].append((-len(t or ""), i is None, i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (len(v), min(v)[2]) for k, v in groups.items()}
    assert len(got) == hard.count()
    for r in got:
        assert (r.group_size, r.keep_id) == want[r.text_sha256]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(want.keys())
    kept = exact_dedup.keep_first(hard)
    assert kept.columns == hard.columns and kept.count() == len(groups)


def test_directory_doubles(spark):
    heads = spark.range(2000).selectExpr("xxhash64(id) as h")
    depth, buckets = exact_dedup.directory(heads, 100)
    assert depth >= 5 and sum(2.0**-d for _, d, _ in buckets) == 1
    h = [r.h & (1 << 64) - 1 for r in heads.collect()]
    assert all(sum(x >> (64 - d) == p for x in h) <= 100 for _, d, p in buckets)
    depth, buckets, held = exact_dedup._directory(heads, 100, 3, F.lit(1))
    assert depth == 3 and sum(held) == 2000
    small = exact_dedup.exact_dedup(spark.range(500).selectExpr("id as doc_id", "cast(id % 300 as string) as text"), capacity=20)
    assert small.where("kept").count() == 300


@pytest.mark.parametrize("capacity", [1, 200, 5000, None])
def test_owners_chain_hot_texts(spark, capacity):
    """A text of a third of all rows, pairs, and unique ones: whatever the capacity, with overflow chains or without."""
    rows = [(f"d{k:04d}" if k % 50 else None, " hot  text" if k % 3 == 0 else f"pair {k // 6}" if k % 3 == 1 else f"own {k}", k) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, text string, h long")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[bare(t)].append((-len(t), i is None, i))
    got = exact_dedup.exact_dedup(df, capacity=capacity).collect()
    assert len(got) == 600 and all((r.group_size, r.keep_id) == (len(v), min(v, key=lambda x: (x[0], x[1], x[2] or ""))[2]) for r in got for v in [next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)])
    kept = exact_dedup.keep_first(df, capacity=capacity).collect()
    assert Counter(bare(r.text) for r in kept) == Counter(groups.keys())
    assert {(bare(r.text), r.doc_id) for r in kept} == {(bare(t), next(x.keep_id for x in got if x.text_sha256 == hashlib.sha256(bare(t).encode()).hexdigest())) for t in {r[1] for r in rows}}


def test_owners_take_ranges(spark):
    """Every row of a bucket is in its owner's partition, owners hold rising ranges of hashes, and the directory decides which."""
    df = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    index = exact_dedup.Index(df, "text", 2000)
    rows, owner = index.deal(df.select(F.xxhash64(exact_dedup.without_space(F.col("text"))).alias("h")), "h")
    got = rows.select(F.spark_partition_id().alias("p"), F.col(owner).alias("o"), F.shiftrightunsigned("h", 48).alias("at")).collect()
    assert index.depth >= 5 and all(r.p == r.o for r in got) and len({r.o for r in got}) == index.owners
    spans = sorted((min(r["at"] for r in got if r.o == o), max(r["at"] for r in got if r.o == o)) for o in range(index.owners))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_mix(rows, seed=7):
    """(doc_id, text, source) to targets by source and words taken by (doc_id, text): the whole queue in one list."""
    total, flows = Counter(), defaultdict(list)
    for i, t, s in rows:
        total[s] += size_of(t)
        flows[s].append((hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i is not None, i, size_of(t), t))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, budget = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(total.values())
    capped, target = set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(3 * total[s] for s in capped)
        target = {s: 3 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * total[s] + 1e-9}
        if not over:
            break
        capped |= over
    queue, taken = [], Counter()
    for s in names:
        at, quantum = 0, max(1, int(target[s] // 256))
        for copy in range(3):
            for _, known, i, size, t in sorted(flows[s], key=lambda x: x[:2] + ((x[2],) if x[1] else ()) + (x[3],)):
                for k, j in enumerate(range(0, size, quantum)):
                    words = min(quantum, size - j)
                    at += words
                    queue.append((at / target[s], known, i, copy, k, words, (i, t)))
    for *_, words, doc in sorted(queue, key=lambda x: x[:2] + ((x[2],) if x[1] else ()) + x[3:5]):
        taken[doc] += max(0, min(words, budget))
        budget -= words
    return target, taken


def test_mixing(spark, hard):
    docs = [(r.doc_id, r.text, r.source) for r in hard.collect()]
    target, want = brute_mix(docs)
    got = mixing.taken(mixing.fair_queue(hard)).join(hard.select("doc_id", "text", "source").distinct(), "doc_id", "left").collect()
    assert sorted(round(r.target, 6) for r in got if r.doc_id is not None) == sorted(round(target[s], 6) for i, _, s in docs if i is not None)
    by_doc, by_target = Counter(), Counter()
    for r in mixing.taken(mixing.fair_queue(hard)).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        by_doc[r.doc_id] += r.taken
        by_target[round(r.target, 6)] += r.taken
    brute = Counter()
    for (i, _), n in want.items():
        brute[i] += n
    assert +by_doc == +brute
    for s, t in target.items():
        assert abs(by_target[round(t, 6)] - t) <= max(1, t / 256) + 1
    again = mixing.taken(mixing.fair_queue(hard.repartition(5))).groupBy("doc_id", "size", "target").sum("taken").collect()
    first = mixing.taken(mixing.fair_queue(hard)).groupBy("doc_id", "size", "target").sum("taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, first))


def test_mix_order_decides(spark):
    """Which documents of a source are taken is decided by the queue's order, not by size or id."""
    rng = random.Random(12)
    docs = [(k, prose(rng, rng.randint(1, 300)), "abc"[k % 7 % 3]) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    _, want = brute_mix(docs)
    got = {r.doc_id: r.taken for r in mixing.taken(mixing.fair_queue(df)).collect()}
    assert got == {i: want[i, t] for i, t, _ in docs}
    _, other = brute_mix(docs, seed=8)
    assert got != {i: other[i, t] for i, t, _ in docs}


def test_mix(spark, hard):
    """Rows are taken as often as the queue serves them, a cut copy by its half; columns stay, a hot source is no exception."""
    docs = [(r.doc_id, r.text, r.source) for r in hard.collect()]
    _, want = brute_mix(docs)
    mixed = mixing.mix(hard)
    assert mixed.columns == hard.columns
    got, repeated = Counter((r.doc_id, r.text) for r in mixed.collect()), Counter((i, t) for i, t, _ in docs)
    for (i, t), n in repeated.items():
        size = size_of(t)
        if n == 1:
            assert got[i, t] == (int(want[i, t] / size + 0.5) if size else 0)
        else:
            assert got[i, t] % n == 0


def test_packing(hard):
    encode = Encoder(default_path("byte_bpe_50k.json"))
    got, seqs = packing.pack(hard, capacity=64, with_ids=True).collect(), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted(len(encode(t or "")) // 4 + 1 for _, t in rows_of(hard))
    ends = Counter()
    for r in got:
        assert r.length == 64 or r.piece == 0
        ends[r.doc_id, r.start + r.length] += 1
    assert sum(r.length for r in got) == sum(want)
    assert len(seqs) <= -(-sum(want) // 64) * 1.1 + 1


def test_pieces_are_the_librarys(hard):
    """Every piece's place and checksum, by the tokenizers library on whole texts."""
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(default_path("byte_bpe_50k.json")), Counter()
    for i, t in rows_of(hard):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        head, at = len(ids) % 64 or 64, 0
        for k, n in enumerate([head, *[64] * ((len(ids) - head) // 64)]):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(hard, capacity=64).collect()) == want


def test_every_underfull_bin_takes_part(spark):
    """Nodes so small that bins are dealt out again and again pack about as tightly, and lose nothing."""
    rng = random.Random(7)
    df = spark.createDataFrame([(f"d{k}", " ".join("word" for _ in range(rng.choice([5, 9, 13, 21])))) for k in range(400)], "doc_id string, text string").repartition(16)
    loads = lambda got: [sum(r.length for r in got if r.sequence_id == s) for s in {r.sequence_id for r in got}]
    one, many = (loads(packing.pack(df, capacity=64, node_bins=n).collect()) for n in (packing.NODE_BINS, 7))
    assert sum(one) == sum(many) and max(one + many) <= 64 and len(many) <= len(one) * 1.1 + 1


def test_best_fit_is_tight():
    rng = random.Random(4)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    where, place, loads = packing.best_fit(sizes, 100)
    assert max(loads) <= 100 and sum(loads) == sum(sizes) and len(loads) <= -(-sum(sizes) // 100) + 3


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(hard):
    short = hard.where("text is null or length(text) < 5000")
    got = simhash.near_duplicates(short).collect()
    docs = rows_of(short)
    assert sorted(str((i, f"{brute_fingerprint(t):016x}")) for i, t in docs) == sorted(str((r.doc_id, r.fingerprint)) for r in got)
    fps = sorted({brute_fingerprint(t) for _, t in docs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for i, t in docs:
        if i is not None:
            low[find(brute_fingerprint(t))].append(i)
    for r in got:
        assert r.component_id == min(low[find(int(r.fingerprint, 16))], default=None)


@pytest.mark.parametrize("run", [8, 64, 2048])
def test_pigeonring_loses_no_link(monkeypatch, run):
    """Dense and sparse fingerprints, with runs cut so short that they are dealt out again and again."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "RUN", run)
    rng = random.Random(run)
    centres = [rng.getrandbits(64) for _ in range(5)]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for c in centres for _ in range(40)}
    fps = np.array(sorted(fps | {rng.getrandbits(64) for _ in range(50)}), dtype=np.uint64)
    rows = []
    for start in range(8):
        turned = [(int(f) << 8 * start | int(f) >> 64 - 8 * start) & (1 << 64) - 1 for f in fps]
        for half, shift in ((0, 36), (1, 24)):
            mask = sum(1 << (63 - b - 8 * start) % 64 for b in [*range(16), *(range(16, 28) if half == 0 else range(28, 40))])
            rows += [((2 * start + half) << 28 | t >> 48 << 12 | t >> shift & 0xFFF, start, mask - (1 << 64) if mask >> 63 else mask, f) for t, f in zip(turned, fps)]
    found = set()
    for _ in range(12):
        rows.sort(key=lambda r: (r[0], r[2], r[3]))
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2)] + [pa.array(np.array([r[3] for r in rows], dtype=np.uint64).view(np.int64))]
        batch = pa.RecordBatch.from_arrays(cols, ["key", "start", "mask", "fp"])
        rows = []
        for out in simhash._search(batch.slice(at, 37) for at in range(0, batch.num_rows, 37)):
            for r in out.to_pylist():
                a, b = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
                if r["kind"] == 0:
                    found.add((a, b))
                else:
                    rows.append((r["key"], r["start"], r["mask"], np.uint64(a)))
        if not rows:
            break
    assert not rows

    def parts(pairs):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(int(a))] = find(int(b))
        out = defaultdict(set)
        for f in root:
            out[find(f)].add(f)
        return sorted(map(sorted, out.values()))

    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 3]
    assert len(near) > 50 and parts(found) == parts(near)


@pytest.mark.parametrize("similarity, least", [(0.8, 0.9), (0.85, 0.95), (0.9, 0.97)])
def test_recall_of_planted_pairs(spark, similarity, least):
    """Pairs planted just above a similarity are found; pairs just below 0.8 are not taken for it."""
    rng, rows, pairs, n = random.Random(int(100 * similarity)), [], [], 400
    for g in range(100):
        text = [f"{rng.getrandbits(32):x}" for _ in range(n)]
        shared = lambda cut: (n - 4 - cut) / (n - 4 + cut)
        cut = max(c for c in range(n) if shared(c) >= similarity) if g < 70 else min(c for c in range(n) if shared(c) < 0.795)
        other = [f"{rng.getrandbits(32):x}" for _ in range(cut)] + text[cut:]
        sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (text, other)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        pairs.append((2 * g, 2 * g + 1, alike))
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(other))]
    near = {r.node: r.root for r in simhash.similar(spark.createDataFrame(rows, "row long, text string"), "row").collect()}
    found = lambda a, b: near.get(a, -a - 1) == near.get(b, -b - 1)
    above, below = [p for p in pairs if p[2] >= 0.8], [p for p in pairs if p[2] < 0.8]
    assert sum(found(a, b) for a, b, _ in above) >= least * len(above) > 50 and len(below) >= 25
    assert not any(found(a, b) for a, b, _ in below)


@pytest.mark.parametrize("block", [1024, 100])
def test_recall_in_a_family(spark, monkeypatch, block):
    """800 texts of one template, mostly below 0.8 of each other: pairs from 0.8 on are found even where both resemble a third
    text that isn't linked, and no component joins texts that alike pairs don't connect."""
    monkeypatch.setattr(simhash, "FAMILY_ROWS", block)
    rng, n = random.Random(5), 220
    base = [f"{rng.getrandbits(32):x}" for _ in range(n)]
    texts = []
    for k in range(800):
        t = list(base)
        for at in rng.sample(range(n), 4):
            t[at] = f"{rng.getrandbits(32):x}"
        if k % 10 == 9:  # a nearer copy of a text before it
            t = list(texts[rng.randrange(k)])
            for at in rng.sample(range(n), rng.randint(2, 4)):
                t[at] = f"{rng.getrandbits(32):x}"
        texts.append(t)
    sets = [{tuple(t[k : k + 5]) for k in range(n - 4)} for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    every = {(a, b): alike(a, b) for a in range(800) for b in range(a + 1, 800)}
    above = [p for p, s in every.items() if s >= 0.8]
    near = {r.node: r.root for r in simhash.similar(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "row long, text string"), "row").collect()}
    assert 0.55 < sorted(every.values())[len(every) // 2] < 0.75 and len(above) >= 60
    assert sum(near.get(a, -a - 1) == near.get(b, -b - 1) for a, b in above) >= 0.95 * len(above)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (a, b), s in every.items():
        if s >= 0.77:  # the full Hamming check links without shingles only what is surely above
            up[find(a)] = find(b)
    assert all(find(a) == find(r) for a, r in near.items())


def test_similar_texts(spark):
    """At a shingle similarity of 0.85 and more pairs are found, below 0.5 none."""
    rng = random.Random(8)
    rows, groups = [], []
    for g in range(12):
        text = [f"{rng.getrandbits(30):x}" for _ in range(300)]
        members = [list(text)]
        for _ in range(3):
            t = list(text)
            for _ in range(4):
                t[rng.randrange(300)] = "changed"
            members.append(t)
        far = list(text)
        for k in range(0, 300, 12):
            far[k] = f"{rng.getrandbits(30):x}"
        groups.append([len(rows) + k for k in range(4)])
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate([*members, far])]
    near = {r.node: r.root for r in simhash.similar(spark.createDataFrame(rows, "row long, text string"), "row").collect()}
    linked = sum(len({near.get(i, -i) for i in g}) == 1 for g in groups)
    assert linked >= 11
    assert not any(near.get(g[3] + 1, -1) == near.get(g[0], -2) for g in groups)
    kept = simhash.keep_one(spark.createDataFrame(rows, "row_id long, text string"), "row_id")
    assert kept.count() == len(rows) - sum(len(g) - len({near.get(i, -i) for i in g}) for g in groups)


def test_token_files(hard):
    manifest = token_files.write_shards(hard, shards=3)
    encode, at = Encoder(default_path("word_bpe_49k.json")), 0
    got = sorted(token_files.read_shards(manifest).collect(), key=lambda r: r.start)
    docs = rows_of(hard)
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((i, zlib.crc32(encode(t or "") + b"\x01\0\0\0")) for i, t in docs)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_perfect_hash(n):
    hashes, _ = token_files.key_hashes(list(range(n)))
    mph = token_files.PerfectHash.build(hashes)
    assert sorted(mph(hashes).tolist()) == list(range(n))


def test_index_refuses_foreign_keys():
    keys, lengths = [None, *range(0, 4000, 2), 4000, 4000], [3] * 2003
    shard = token_files.Shard(token_files.pack_index(keys, lengths, 2), np.arange(2003 * 3, dtype="<u2").tobytes())
    first, count = shard.find([None, 2, 3, 4000, 99_999])
    assert first.tolist() == [0, 2, -1, 2001, -1] and count.tolist() == [1, 1, 0, 2, 0]
    assert shard.record(2).tolist() == [6, 7, 8]


def test_language(spark, hard):
    known = language_id.profiles(hard)
    got = language_id.identify(hard, known).collect()

    def brute(text):
        counts = Counter(g for w in language_id.words_of(text) for g in language_id.ngrams(w))
        return language_id.nearest(language_id.ranked(counts), known)

    want = Counter((i, *brute(t)) for i, t in rows_of(hard))
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in got) == want
    assert ("und", 0.0) in {w[1:] for w in want} and all(0 <= w[2] <= 1 for w in want)
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcde" if i % 2 else "aeiou") for _ in range(5)) for _ in range(40)), "x" if i % 2 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pred = {r.doc_id: r.lang_pred for r in language_id.identify(df, language_id.profiles(df.where("doc_id < 40"))).collect()}
    assert all(pred[i] == ("x" if i % 2 else "y") for i in range(60))


def plain_features(text):
    h = [zlib.crc32(w.encode()) for w in (text or "").lower().split()]
    return [x % importance.BUCKETS for x in h] + [((a * 0x9E3779B1 + b * 0x85EBCA77) % 2**64 >> 7) % importance.BUCKETS for a, b in zip(h, h[1:])]


def test_importance(spark, hard):
    rng = random.Random(6)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{rng.randrange(30)}" for _ in range(50))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(df, spark.range(1, 100, 2).withColumnRenamed("id", "doc_id"), keep=0.5).collect()
    picked = [r for r in got if r.selected]
    assert len(picked) == 100 and sum(r.doc_id % 2 for r in picked) >= 95
    assert min(r.gumbel_key for r in picked) >= max(r.gumbel_key for r in got if not r.selected)
    raw, target = [0] * importance.BUCKETS, [0] * importance.BUCKETS
    for i, t in rows:
        for f in plain_features(t):
            raw[f] += 1
            target[f] += i % 2 and i < 100
    model = lambda c: [math.log((x + 1) / (sum(c) + importance.BUCKETS)) for x in c]
    p, q, keys = model(target), model(raw), {}
    for i, t in rows:
        f = plain_features(t)
        whole = sum(p[x] - q[x] for x in f)
        r = next(r for r in got if r.doc_id == i)
        assert math.isclose(r.log_ratio, whole, rel_tol=1e-3, abs_tol=1e-3) and math.isclose(r.log_weight, whole * min(1, importance.TEMPER / len(f)), rel_tol=1e-3, abs_tol=1e-3)
        keys[i] = r.log_weight - math.log(-math.log((xxhash.xxh64_intdigest(str(i), 11) + 0.5) / 2**64))
        assert math.isclose(r.gumbel_key, keys[i], rel_tol=1e-9)
    assert {r.doc_id for r in picked} == set(sorted(keys, key=lambda i: (-keys[i], i))[:100])
    plain = importance.resample(df, spark.range(1, 100, 2).withColumnRenamed("id", "doc_id"), keep=0.5, temper=None).collect()
    assert all(r.log_weight == r.log_ratio for r in plain)
    tied = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert sum(r.selected for r in importance.resample(tied, tied.select("doc_id").limit(0), keep=0.5).collect()) == 2
    assert importance.resample(hard, hard.select("doc_id").limit(5)).count() == hard.count()


def test_toxicity(spark, hard):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        bad = i % 5 == 0
        words = prose(rng, 40).split()
        if bad:
            words[3], words[17] = "vile", rng.choice(["nasty", "awful"])
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df.where("doc_id < 400"), lab.where("doc_id < 400"))
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 400"), model).collect()}
    assert np.mean([(s >= 0.5) == (i % 5 == 0) for i, s in got.items()]) > 0.95
    scored = toxicity.score(hard, model)
    assert scored.columns == [*hard.columns, "_score"] and all(0 <= r._score <= 1 for r in scored.collect()) and scored.count() == hard.count()
    assert toxicity.drop_toxic(spark, df, lab).columns == df.columns
    nothing = toxicity.learn(df, lab.where("toxic > 5"))
    assert 0 < toxicity.score(df, nothing).first().score < 0.5


def plain_fit(pos, unl, prior, seed, epochs, parts, rate=0.1, decay=1e-5):
    """The same risk and steps on dense rows, with each gradient by finite differences of the risk's two terms."""
    rng = np.random.default_rng(seed)
    dim = 1 + max(int(i) for x in (*pos, *unl) for i in x)
    dense = lambda docs: np.array([[(j in set(x.tolist())) / math.sqrt(max(1, len(x))) for j in range(dim)] + [1.0] for x in docs])
    pos, unl, w = dense(pos), dense(unl), np.zeros(dim + 1)
    m1, m2, step = np.zeros_like(w), np.zeros_like(w), 0
    loss = lambda z, y: np.log1p(np.exp(-z if y else z)).mean()
    for _ in range(epochs):
        for pi, ui in zip(np.array_split(rng.permutation(len(pos)), parts), np.array_split(rng.permutation(len(unl)), parts)):
            plus = lambda v: prior * loss(pos[pi] @ v, 1)  # noqa: B023, E731
            minus = lambda v: loss(unl[ui] @ v, 0) - prior * loss(pos[pi] @ v, 0)  # noqa: B023, E731
            f = (lambda v: -minus(v)) if minus(w) < 0 else (lambda v: plus(v) + minus(v))  # noqa: B023
            g = np.array([(f(w + e) - f(w - e)) / 2e-5 for e in 1e-5 * np.eye(dim + 1)]) + decay * np.append(w[:-1], 0)
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w = w - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w


def test_risk_and_gradient(monkeypatch):
    """The classifier's weights are those of plain steps along the risk, both where it is negative and where not."""
    monkeypatch.setattr(toxicity, "CHANCE", -1.0)
    rng = np.random.default_rng(2)
    docs = lambda n, lean: [np.unique(rng.choice(8, 4, p=lean)).astype(np.int32) for _ in range(n)]
    pos, unl = docs(40, [0.3, 0.3, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]), docs(160, [0.05] * 4 + [0.2] * 4)
    for prior in (0.1, 0.5):
        got, want = toxicity.fit(pos, unl, prior, 3, epochs=6, parts=2), plain_fit(pos, unl, prior, 3, 6, 2)
        assert np.allclose(got[:8], want[:8], atol=2e-3)


def test_toxic_score_is_a_plain_sum(spark):
    rng = np.random.default_rng(5)
    model = rng.normal(0, 1, toxicity.DIM + 1)
    texts = [None, "", "One two, two!", prose(random.Random(2), 500)]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        words = {w.strip(toxicity.EDGES) for w in (texts[r.doc_id] or "").lower().split()}
        ids = {zlib.crc32(w.encode()) % toxicity.DIM for w in words} | {zlib.crc32(b"^" + w[:4].encode()) % toxicity.DIM for w in words}
        z = sum(model[i] for i in ids) / math.sqrt(max(1, len(ids))) + model[-1]
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_repeated_ids_send_one_text(spark):
    """An id that a thousand rows share sends the driver one sample."""
    rows = [(1, f"vile text {k}") for k in range(1000)] + [(k, f"plain text {k}") for k in range(2, 200)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    seen = []
    keep = toxicity.fit
    try:
        toxicity.fit = lambda pos, unl, *a, **k: seen.append((len(pos), len(unl))) or keep(pos, unl, *a, **k)
        toxicity.learn(df, labels)
    finally:
        toxicity.fit = keep
    assert all(n == 1 for n, _ in seen) and max(m for _, m in seen) <= 199


def test_equal_scores_stay_below_the_cut():
    assert toxicity._cut(np.zeros(50), 0.1) > 0
    assert 1 < toxicity._cut(np.array([5.0] * 3 + [1.0] * 40), 0.1) < 5
    assert 3 < toxicity._cut(np.arange(10.0), 0.6) < 4


def split(text):
    return [*(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))), b"\n"]


MU = (1000.0, 50.0)


class Automaton:
    """The model as states (the last words), arcs and failure arcs, walked word by word."""

    def __init__(self, texts):
        self.n = [Counter(), Counter(), Counter()]
        for t in texts:
            seq = [b"\n", *split(t)]
            self.n[0].update(seq[1:])
            self.n[1].update(zip(seq, seq[1:]))
            self.n[2].update(zip(seq, seq[1:], seq[2:]))
        self.total, self.types = sum(self.n[0].values()), len(self.n[0])
        self.uni = lambda w: (self.n[0][w] + 0.1) / (self.total + 0.1 * (self.types + 1))
        self.fail, self.arcs = {}, {}
        for (v, w), c in self.n[1].items():
            self.fail[v,] = math.log10(MU[0] / (self.n[0][v] + MU[0]))
            self.arcs[(v,), w] = math.log10((c + MU[0] * self.uni(w)) / (self.n[0][v] + MU[0]))
        for (u, v, w), c in self.n[2].items():
            self.fail[u, v] = math.log10(MU[1] / (self.n[1][u, v] + MU[1]))
            self.arcs[(u, v), w] = math.log10((c + MU[1] * 10 ** self.arcs[(v,), w]) / (self.n[1][u, v] + MU[1]))

    def step(self, state, w):
        weight = 0.0
        while state:
            if (state, w) in self.arcs:
                return weight + self.arcs[state, w]
            weight, state = weight + self.fail.get(state, 0.0), state[1:]
        return weight + math.log10(self.uni(w))

    def walk(self, text):
        seq, state, score = split(text), (b"\n",), 0.0
        for w in seq:
            score, state = score + self.step(state, w), (*state, w)[-2:]
        return len(seq), sum(self.n[0][w] > 0 for w in seq), sum(math.log10(self.uni(w)) for w in seq), score


@pytest.mark.parametrize("chunk, span", [(lm_scoring.CHUNK, lm_scoring.RANGE), (1000, 300)])
def test_language_model(hard, chunk, span):
    """Each score is that of a walk through the explicit automaton, however the corpus is cut."""
    au = Automaton(t for i, t in rows_of(hard) if i is None or i % 4)
    got = lm_scoring.score(hard, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True)), mu=MU, chunk=chunk, span=span).collect()
    near = lambda i, n, known, base, score: (i, n, known, float(f"{base:.9g}"), float(f"{score:.9g}"))
    assert Counter(near(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got) == Counter(near(i, *au.walk(t)) for i, t in rows_of(hard))
    assert {r.train_tokens for r in got} == {au.total} and sum(r.train for r in got) == sum(i is None or i % 4 > 0 for i, _ in rows_of(hard))


def test_weights_come_from_training(spark, monkeypatch):
    """The weights at which leaving one out foresees the singletons; texts outside training change nothing."""
    rng, seen = random.Random(2), []
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(120)]
    keep = lm_scoring.fitted
    monkeypatch.setattr(lm_scoring, "fitted", lambda contexts, singles: seen.append((contexts, singles)) or keep(contexts, singles))
    for more in ([], [(1000 + k, prose(rng, 40)) for k in range(30)]):
        lm_scoring.score(spark.createDataFrame([*enumerate(texts), *more], "doc_id long, text string"), F.col("doc_id") < 1000, chunk=2000, span=500).collect()
    assert seen[:2] == seen[2:]
    au = Automaton(texts)
    for order in (0, 1):
        contexts, singles = seen[order]
        assert singles == sum(c == 1 for c in au.n[order + 1].values())
        assert sum(t for t, _ in contexts) == sum(au.n[order].values()) and sum(n for _, n in contexts) == len(au.n[order])
        mu = keep(contexts, singles)
        assert math.isclose(sum(t * mu / (t / n - 1 + mu) for t, n in contexts), singles, rel_tol=1e-6)


def test_automaton_is_a_distribution(hard):
    au = Automaton(t for _, t in rows_of(hard))
    states = [(b"\n",), (b"\n", b"the"), (b"never", b"seen"), *list(au.fail)[:20], *list(au.fail)[-20:]]
    assert len(au.fail) > 20
    for s in states:
        if s[-1] != b"\n" or len(s) == 1:
            assert math.isclose(sum(10 ** au.step(s, w) for w in au.n[0]) + 10 ** au.step(s, b"never seen"), 1, rel_tol=1e-9)


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, F.lit(False)).collect()}
    assert got["a"].n_tokens == 3 and got["a"].n_known == got["b"].n_known == got["a"].train_tokens == 0
    assert got["a"].score == got["a"].base_score == 0.0  # of no known words the unknown one has all the probability


def test_packed_entries():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        counts = rng.integers(0, 600, len(keys))
        back = lm_scoring.unpack_entries(lm_scoring.pack_entries(keys, counts))
        assert (back[0] == keys).all() and (back[1] == counts).all()


def test_long_runs_of_wide_keys(spark):
    """Rows of one key link however many unlike rows lie between, and whichever member of a cluster they are near."""
    rng = np.random.default_rng(5)
    w = rng.integers(-(1 << 62), 1 << 62, (2 * simhash.RUN + 600, 4), dtype=np.int64)
    flip = lambda row, at: row ^ np.array([(1 << 10) - 1 << at] * 4, dtype=np.int64)
    w[1] = flip(w[0], 0)  # 40 of 256 bits
    w[-1] = flip(w[1], 20)  # near row 1, not near row 0, the head of their cluster
    w[-2] = flip(w[2], 0)
    rows = [(7, k, *map(int, x)) for k, x in enumerate(w)]
    keyed = spark.createDataFrame(rows, "key long, node long, w0 long, w1 long, w2 long, w3 long")
    assert {(r.node, r.root) for r in simhash.wide_near(keyed).collect()} == {(0, 0), (1, 0), (len(w) - 1, 0), (2, 2), (len(w) - 2, 2)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.keep_first(none).count() == 0
    assert mixing.taken(mixing.fair_queue(none)).count() == mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
    assert token_files.read_shards(token_files.write_shards(none)).count() == 0
    assert language_id.identify(none, language_id.profiles(none)).count() == 0
    assert importance.resample(none, labels).count() == 0
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert lm_scoring.score(none, F.lit(True)).count() == 0


def test_components_with_hubs(spark):
    """Stars whose centres hold most links, chains between them, and lone pairs, held against a union-find."""
    rng = random.Random(3)
    edges = [(0, x) for x in range(10, 4000)] + [(5000, x) for x in range(3990, 6000)] + [(x, x + 1) for x in range(7000, 7040)]
    edges += [(9000 + 2 * x, 9001 + 2 * x) for x in range(50)] + [(1, 1)] + [(7, 7040)]
    edges = [e[:: rng.choice((1, -1))] for e in edges] + edges[:20]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
