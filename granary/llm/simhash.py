"""Near duplicates by SimHash with pigeonring filtering.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints link at
DISTANCE or fewer differing bits. The bits form a ring of eight segments. By the pigeonring principle (Qin & Xiao,
PVLDB 2018) a linked pair has a segment from which every chain of l consecutive segments differs in l * DISTANCE / 8
bits at most. So the first two segments of such a chain agree and the first five differ in one bit at most: of the last
24 of those 40 bits, one half or the other agrees. That gives sixteen 28-bit keys for each fingerprint. Pairs that
share a key must pass the chain budgets one after another, and then the full Hamming check.

Distinct fingerprints only are searched; copies are collapsed by a map-side minimum before. Keys are sorted and read as a
stream. A run of up to RUN fingerprints is searched in place and emits links that span it, never all pairs. A longer run
is dealt out again by a further quarter of the bits not yet shared (three differing bits leave one quarter equal), until
runs are short, which the eleven last bits force. No task holds more than RUN fingerprints of a key, and no link is lost.

Edge cases. Null, empty and blank texts have fingerprint zero and link like any other. Null ids take part; a component's
id is its smallest non-null id. Repeated rows get a row each. An empty table gives an empty result. Other input columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, materialize, table, with_row
from .tokens import rows

DISTANCE, SEGMENTS = 3, 8
RUN = 2048
SMALL = 8


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text, as an unsigned integer."""
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are concerned
    if not w:
        return 0
    if len(w) < words:
        shingles = iter([b" ".join(w)])
    else:
        shingles = map(b" ".join, zip(*[w[k:] for k in range(words)]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        votes += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (signed long) for each row. Ids keep their type."""
    from pyspark.sql.pandas.types import to_arrow_type

    light = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = to_arrow_type(light.schema[0].dataType)

    def run(batches):
        import pyarrow as pa

        ids, fps = [], []
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids.append(doc_id)
            fps.append(fingerprint(text, words))
            if len(ids) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])
                ids, fps = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return light.mapInArrow(run, f"doc_id {light.schema[0].dataType.simpleString()}, fp long")


def ring_keys(distinct: DataFrame) -> DataFrame:
    """(key, start, mask, fp): for each start segment two keys of 28 shared bits; mask marks those bits."""
    fp, made = F.col("fp"), []
    for start in range(SEGMENTS):
        turned = F.shiftleft(fp, 8 * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * start)) if start else fp
        for half in (0, 1):
            bits = range(16, 28) if half == 0 else range(28, 40)
            mask = 0
            for b in [*range(16), *bits]:
                mask |= 1 << ((63 - b - 8 * start) % 64)
            first, second = F.shiftrightunsigned(turned, 48), F.shiftrightunsigned(turned, 36 if half == 0 else 24).bitwiseAND(F.lit(0xFFF))
            key = F.shiftleft(F.lit(2 * start + half).cast("long"), 28).bitwiseOR(F.shiftleft(first, 12)).bitwiseOR(second)
            made.append(F.struct(key.alias("key"), F.lit(start).alias("start"), F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long").alias("mask"), fp.alias("fp")))
    return distinct.select(F.explode(F.array(*made)).alias("k")).select("k.*")


def _chain(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether pairs keep every chain's budget from their start segment; the last chain is the full Hamming check."""
    x, turn = a ^ b, (8 * start).astype(np.uint64)
    x = np.where(turn > 0, (x << turn) | (x >> ((np.uint64(64) - turn) & np.uint64(63))), x)
    ok = np.ones(len(x), dtype=bool)
    for l in range(2, SEGMENTS + 1):
        live = np.flatnonzero(ok)
        if not len(live):
            break
        ok[live] = np.bitwise_count(x[live] >> np.uint64(64 - 8 * l)) <= l * DISTANCE // SEGMENTS
    return ok


def _span(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that join what is linked within a run: a search tree, at most one link for each fingerprint."""
    left, found = fp.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _chain(np.full(len(left), x, dtype=np.uint64), left, np.full(len(left), start))
            found += [(x, y) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return found


def _search(batches):
    """Sorted (key, start, mask, fp) to links (kind 0: a, b) and, of long runs, rows of the next level (kind 1)."""
    import pyarrow as pa

    def out(kind, key, start, mask, a, b):
        n = len(a)
        cols = [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.asarray(key, dtype=np.int64)), pa.array(np.asarray(start, dtype=np.int32)), pa.array(np.asarray(mask, dtype=np.int64))]
        cols += [pa.array(np.asarray(v, dtype=np.uint64).view(np.int64)) for v in (a, b)]
        return pa.RecordBatch.from_arrays(cols, ["kind", "key", "start", "mask", "a", "b"])

    def links(a, b):
        z = np.zeros(len(a), dtype=np.int64)
        return out(0, z, z, z, a, b)

    def further(key, start, mask, fp):
        """The rows of a long run under four more keys each."""
        mask = int(mask) & (1 << 64) - 1
        free = [p for p in range(64) if not mask >> p & 1]
        for j, part in enumerate(np.array_split(np.array(free), 4)):
            bits = sum(1 << int(p) for p in part)
            with np.errstate(over="ignore"):
                z = (fp & np.uint64(bits)) + np.uint64((int(key) * 4 + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(31)
            new = mask | bits
            new = new - (1 << 64) if new >> 63 else new
            yield out(1, z.view(np.int64), np.full(len(fp), start), np.full(len(fp), new), fp, fp)

    def runs(key, start, mask, fp):
        """Whole runs of at most RUN rows."""
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        each = np.repeat(size, size)
        small = np.flatnonzero((each > 1) & (each <= SMALL))
        k, m, s, f = key[small], mask[small], start[small], fp[small]
        for gap in range(1, SMALL):
            same = np.flatnonzero((k[gap:] == k[:-gap]) & (m[gap:] == m[:-gap])) if len(k) > gap else []
            if not len(same):
                break
            ok = same[_chain(f[same], f[same + gap], s[same])]
            if len(ok):
                yield links(f[ok], f[ok + gap])
        for at, n in zip(begin[size > SMALL], size[size > SMALL]):
            if found := _span(fp[at : at + n], int(start[at])):
                yield links([x for x, _ in found], [y for _, y in found])

    held, hot = None, None
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "mask", "fp")]
        new[3] = new[3].astype(np.int64).view(np.uint64)
        if held is not None:
            new = [np.concatenate(x) for x in zip(held, new)]
        if not len(new[0]):
            continue
        if hot is not None:  # the rest of a long run passes through
            same = (new[0] == hot[0]) & (new[2] == hot[2])
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                yield from further(hot[0], hot[1], hot[2], new[3][:n])
            new = [x[n:] for x in new]
            if not len(new[0]):
                held = None
                continue
            hot = None
        last = (new[0] == new[0][-1]) & (new[2] == new[2][-1])
        cut = len(last) - int(last.sum())
        whole, held = [x[:cut] for x in new], [x[cut:] for x in new]
        if len(whole[0]):
            yield from _settle(whole, runs, further)
        if len(held[0]) > RUN:
            hot = (held[0][0], held[1][0], held[2][0])
            yield from further(*hot, held[3])
            held = None
    if held is not None and len(held[0]):
        yield from _settle(held, runs, further)


def _settle(cols, runs, further):
    """Long runs go on to the next level, the others are searched."""
    key, start, mask, fp = cols
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])]))
    size = np.diff(np.concatenate([begin, [len(key)]]))
    for at, n in zip(begin[size > RUN], size[size > RUN]):
        yield from further(key[at], start[at], mask[at], fp[at : at + n])
    short = np.repeat(size, size) <= RUN
    if short.any():
        yield from runs(key[short], start[short], mask[short], fp[short])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp) that connect whatever lies within DISTANCE, step by step."""
    level, found = ring_keys(distinct), None
    while True:
        level = level.repartition("key").sortWithinPartitions("key", "mask", "fp")
        got = materialize(level.mapInArrow(_search, "kind int, key long, start int, mask long, a long, b long"), "simhash-links")
        here = got.where("kind = 0").select("a", "b")
        found = here if found is None else found.unionByName(here)
        level = got.where("kind = 1").select("key", "start", "mask", F.col("a").alias("fp"))
        if level.isEmpty():
            return found.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp, fingerprint, component_id for each row of df."""
    prints = materialize(fingerprints(df, id_col, text_col, words), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-classes")
    near = components(links(classes.select("fp")))
    named = classes.join(near.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- wide radius: a shingle similarity instead of a Hamming distance of three -----------------------------------------
#
# At a Jaccard similarity of 0.8 two fingerprints differ in about 15 % of their bits, too many for keys that miss none.
# So fingerprints get WIDE_BITS bits over distinct shingles, and slices of them are keys. A slice has as many bits as the
# number of rows asks for (so that few unlike rows share one), and there are as many slices as leave a pair at SIMILARITY
# without a shared one with probability MISS: sixty at 10^5 rows, growing as the rows' power 0.24. Pairs that share a key
# are held to the pigeonring budgets and the Hamming check on CHECK_BITS bits. What is left meets the full Hamming check:
# SURE or fewer differing bits link, more than LOOSE don't, and pairs between have their shingles compared. Copies link to
# each other through many keys and through each other. Where candidate links hold rows together that confirmed links don't,
# the rows of that family meet in blocks.

SIMILARITY, MISS = 0.8, 0.03
WIDE_BITS, LEAST_BITS, CHECK_BITS = 2048, 18, 256
#: The part of its bits in which a pair at SIMILARITY differs, and Hamming distances some standard deviations from it.
APART = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
WIDE_DISTANCE, LOOSE, SURE = (round(n * APART + z * math.sqrt(n * APART * (1 - APART))) for n, z in ((CHECK_BITS, 3), (WIDE_BITS, 3.5), (WIDE_BITS, -4)))


def slices(rows: int) -> np.ndarray:
    """Bit positions of each key (keys x bits) for so many rows: every WIDE_BITS // bits of them are disjoint."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, rows))))
    keys = math.ceil(math.log(MISS) / math.log1p(-((1 - APART) ** bits)))
    rng, each = np.random.default_rng(11), WIDE_BITS // bits
    turns = [rng.permutation(WIDE_BITS)[: each * bits].reshape(each, bits) for _ in range(-(-keys // each))]
    return np.concatenate(turns)[:keys]


def wide_fingerprint(text: str | None, words: int = 5) -> bytes:
    """The WIDE_BITS-bit SimHash of a text's distinct shingles; blank text: zeros."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return bytes(WIDE_BITS // 8)
    shingles = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*[w[k:] for k in range(words)])))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
    seeds = np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(WIDE_BITS, dtype=np.int64)
    for at in range(0, len(h), 2048):
        z = h[at : at + 2048, None] + seeds[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        votes += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(h), bitorder="little").tobytes()


def _ring_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of check words (n x 4) keep, from some start on the ring of eight segments, every chain's budget."""
    seg = np.bitwise_count((a ^ b).view(np.uint32)).astype(np.int16)
    ring = np.concatenate([np.zeros((len(seg), 1), np.int16), np.cumsum(np.concatenate([seg, seg], axis=1), axis=1, dtype=np.int16)], axis=1)
    out, live = np.zeros(len(seg), dtype=bool), np.arange(len(seg))
    viable = np.ones((len(seg), SEGMENTS), dtype=bool)
    for l in range(1, SEGMENTS + 1):
        viable &= ring[:, l : l + SEGMENTS] - ring[:, :SEGMENTS] <= l * WIDE_DISTANCE / SEGMENTS
        left = viable.any(axis=1)
        if not left.all():
            live, ring, viable = live[left], ring[left], viable[left]
    out[live] = True
    return out


def _wide_keys(at: np.ndarray):
    """(sig, node) to (key, node, w0..w3): a row for each slice of at."""
    tables, bits = at.shape

    def run(batches):
        import pyarrow as pa

        power, names = 1 << np.arange(bits, dtype=np.int64), ["key", "node", "w0", "w1", "w2", "w3"]
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                m = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = np.unpackbits(m, axis=1, bitorder="little")[:, at.ravel()].reshape(-1, tables, bits) @ power
                keys += (np.arange(tables, dtype=np.int64) << bits)[None, :]
                words = np.ascontiguousarray(m[:, : CHECK_BITS // 8]).view(np.int64)
                nodes = part.column("node").to_numpy(zero_copy_only=False)
                cols = [keys.ravel(), np.repeat(nodes, tables), *[np.repeat(words[:, k], tables) for k in range(4)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return run


def _wide_search(batches):
    """Rows sorted by key to links (kind 0: node, other) and the rows of runs of more than RUN (kind 1), for _wide_meet.
    A long run is read in blocks of RUN; a block also meets one row of each cluster that the run's blocks before it have
    formed, the RUN latest of them. That only joins most of what is near, so that little is left to _wide_meet."""
    import pyarrow as pa

    names = ["kind", "key", "node", "other", "w0", "w1", "w2", "w3"]

    def emit(pairs):
        z = np.zeros(len(pairs), np.int64)
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (z, z, a, b, z, z, z, z)], names)

    def long_run(key, node, w):
        cols = [np.ones(len(node), np.int64), np.full(len(node), key), node, node, *(w[:, k] for k in range(4))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def span(node, w):
        """Links of a run that join what is near, and the first row of each cluster."""
        left, found, first = np.arange(len(node)), [], []
        while len(left):
            first.append(left[0])
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = _ring_near(np.broadcast_to(w[x], (len(left), 4)), w[left])
                found += [(node[x], node[y]) for y in left[near]]
                queue += left[near].tolist()
                left = left[~near]
        return found, np.array(first, dtype=np.int64)

    held = roots = None
    for batch in _with_end(batches):
        if batch is not None:
            new = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "node", "w0", "w1", "w2", "w3")]
            new = [new[0], new[1], np.stack(new[2:], axis=1)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        key, node, w = held
        begin, last = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), key[-1]
        if batch is not None:  # the last run may go on: it waits, but for blocks that are full
            cut = begin[-1] + (len(key) - begin[-1]) // RUN * RUN
            held = [x[cut:] for x in held]
        else:
            cut, held = len(key), None
        key, node, w = key[:cut], node[:cut], np.ascontiguousarray(w[:cut])
        if not len(key):
            continue
        begin = begin[begin < cut]
        size = np.diff(np.concatenate([begin, [cut]]))
        each = np.repeat(size, size)
        small = np.flatnonzero((each > 1) & (each <= SMALL))
        k, n, v = key[small], node[small], w[small]
        for gap in range(1, SMALL):
            same = np.flatnonzero(k[gap:] == k[:-gap]) if len(k) > gap else []
            if not len(same):
                break
            ok = same[_ring_near(v[same], v[same + gap])]
            if len(ok):
                yield emit(list(zip(n[ok], n[ok + gap])))
        for at, many in zip(begin, size):
            same = roots is not None and roots[0] == key[at]
            if many <= SMALL and not same:
                continue
            goes_on = batch is not None and at == begin[-1] and key[at] == last  # or may do so
            for a in range(at, at + many, RUN):
                b = min(a + RUN, at + many)
                if same or many > RUN or goes_on:
                    yield long_run(key[at], node[a:b], w[a:b])
                run_n, run_w = node[a:b], w[a:b]
                if roots is not None and roots[0] == key[at]:
                    run_n, run_w = np.concatenate([roots[1], run_n]), np.concatenate([roots[2], run_w])
                found, first = span(run_n, np.ascontiguousarray(run_w))
                if found:
                    yield emit(found)
                roots = (key[at], run_n[first][-RUN:], run_w[first][-RUN:])


def _wide_meet(batches):
    """Rows of two blocks of a long run (or of one), sorted by (key, i, j), to links (a, b) that join what is near and has not
    the same root yet. Every row of block i meets every row of block j that it is not joined with."""
    import pyarrow as pa

    def meet(i, j, block, node, root, w):
        root, found = root.copy(), []
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in first:
            apart = second[root[second] != root[x]]
            if not len(apart):
                continue
            near = apart[_ring_near(np.broadcast_to(w[x], (len(apart), 4)), np.ascontiguousarray(w[apart]))]
            for y in near:
                if root[y] != root[x]:
                    found.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    held = None
    for batch in _with_end(batches):
        if batch is not None:
            new = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "i", "j", "block", "node", "root", "w0", "w1", "w2", "w3")]
            new = [*new[:6], np.stack(new[6:], axis=1)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        key, i, j = held[:3]
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        ends = [*begin[1:], *([] if batch is not None else [len(key)])]  # the last pair of blocks may go on
        for a, b in zip(begin, ends):
            yield meet(i[a], j[a], *(x[a:b] for x in held[3:]))
        held = [x[ends[-1] :] for x in held] if ends else held


def wide_near(keyed: DataFrame) -> DataFrame:
    """(node, root): components of what is near under one key or more. keyed: key, node, w0..w3."""
    return components(wide_links(keyed))


def wide_links(keyed: DataFrame) -> DataFrame:
    """Links (a, b) that join what is near under one key or more, step by step, and never all pairs of a key."""
    words = [f"w{k}" for k in range(4)]
    schema = "kind long, key long, node long, other long, w0 long, w1 long, w2 long, w3 long"
    got = materialize(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_wide_search, schema), "wide-links")
    links, long = got.where("kind = 0").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), got.where("kind = 1")
    if long.isEmpty():
        return links
    near = components(links)
    # long runs: blocks in order of roots, so that blocks of one root need not meet; all other pairs of blocks do
    rooted = long.select("key", "node", *words).join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("root", "node")) - 1
    blocks = materialize(rooted.withColumn("block", F.floor(nth / RUN)), "wide-blocks")
    spans = materialize(blocks.groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")), "wide-spans")
    other = spans.select("key", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    pairs = spans.withColumnRenamed("block", "i").join(other, "key").where("i <= j and least(low, low_j) < greatest(high, high_j)")
    sides = pairs.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    met = blocks.join(sides, ["key", "block"]).select("key", "i", "j", "block", "node", "root", *words)
    more = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "root", "node").mapInArrow(_wide_meet, "a long, b long")
    return links.unionByName(materialize(more, "wide-met")).distinct()


def _with_end(batches):
    yield from batches
    yield None


def _shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    import xxhash

    w = (text or "").encode().lower().split()
    found = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*[w[k:] for k in range(words)])))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def _distances(batches):
    """(a, b, sig_a, sig_b) to (a, b, d): the full Hamming check, without pairs beyond LOOSE."""
    import pyarrow as pa

    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64) for c in ("sig_a", "sig_b"))
        d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        near = pa.array(d <= LOOSE)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near), pa.array(d).filter(near)], ["a", "b", "d"])


def _alike(batches):
    """(a, b, set_a, set_b) to the pairs (a, b) whose shingles are alike by SIMILARITY or more."""
    import pyarrow as pa

    for batch in batches:
        sets = [[np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("set_a", "set_b")]
        same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)], dtype=np.float64)
        both = np.array([len(x) + len(y) for x, y in zip(*sets)], dtype=np.float64) - same
        ok = pa.array(same >= SIMILARITY * both - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])


def _sides(pairs: DataFrame, of: DataFrame, c: str) -> DataFrame:
    """pairs (a, b) with c_a and c_b, the column c of both nodes. Joins are merges at every size, so that plans don't turn with
    the input."""
    side = lambda n: of.select(F.col("node").alias(n), F.col(c).alias(f"{c}_{n}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _shingle_sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, set) of the texts (row, text) that nodes (row) names."""

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([_shingles(t, words).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["node", "set"])

    return materialize(texts.join(nodes.hint("merge"), "row", "left_semi").mapInArrow(sets, "node long, set binary"), "wide-shingles")


def _confirmed(links: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, ok): whether the full Hamming check or the shingles themselves confirm a link (a, b). texts: row, text."""
    far = materialize(_sides(links, classes, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(_distances, "a long, b long, d long"), "wide-distances")
    unsure = far.where(F.col("d") > SURE).select("a", "b")
    nodes = unsure.select(F.col("a").alias("row")).unionByName(unsure.select(F.col("b").alias("row"))).distinct()
    alike = _sides(unsure, _shingle_sets(texts, nodes, words), "set").select("a", "b", "set_a", "set_b").mapInArrow(_alike, "a long, b long")
    good = materialize(far.where(F.col("d") <= SURE).select("a", "b").unionByName(alike), "wide-alike").withColumn("ok", F.lit(True))
    return materialize(links.join(good.hint("merge"), ["a", "b"], "left").select("a", "b", F.coalesce("ok", F.lit(False)).alias("ok")), "wide-confirmed")


#: Rows, and bytes of shingles, of a block of a family whose rows meet those of other blocks.
FAMILY_ROWS, FAMILY_BYTES = 1024, 16 << 20


def _family_meet(table):
    """The alike pairs of two blocks (or of one) that aren't joined yet, each joined as it is found. Pairs beyond LOOSE on all
    bits aren't looked at further."""
    import pyarrow as pa

    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block, node, root = (table.column(c).to_numpy().copy() for c in ("block", "node", "root"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64)
    sets = [np.frombuffer(v, np.uint64) for v in table.column("set").to_pylist()]
    first, second, found = np.flatnonzero(block == i), np.flatnonzero(block == j), []
    for x in first:
        apart = second[root[second] != root[x]]
        if not len(apart):
            continue
        d = np.bitwise_count(sig[apart] ^ sig[x]).sum(axis=1, dtype=np.int64)
        for y, bits in zip(apart[d <= LOOSE], d[d <= LOOSE]):
            if root[y] == root[x]:
                continue
            if bits > SURE:
                same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if same < SIMILARITY * (len(sets[x]) + len(sets[y]) - same) - 1e-9:
                    continue
            found.append((node[x], node[y]))
            root[root == root[y]] = root[x]
    return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _family_links(told: DataFrame, joined: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame | None:
    """More links (a, b), within families that candidate links (told: a, b, ok) hold together but confirmed ones (joined: node,
    root) don't. None if there are no such families.

    The search for candidates joins what is near step by step, so two alike rows may both hang on a third that is alike to
    neither. Here the rows of such a family meet each other, in blocks of FAMILY_ROWS rows and FAMILY_BYTES at most, but for
    those joined already.
    """
    piece = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    failed = told.where("not ok").join(piece("a"), "a", "left").join(piece("b"), "b", "left")
    failed = failed.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    family = materialize(components(told.select("a", "b")), "families")
    torn = failed.select(F.col("a").alias("node")).distinct().join(family, "node").select("root").distinct()
    rows = family.withColumnRenamed("root", "family").join(torn.withColumnRenamed("root", "family"), "family", "left_semi")
    rows = materialize(rows.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "family-rows")
    if rows.isEmpty():
        return None
    sets = _shingle_sets(texts, rows.select(F.col("node").alias("row")), words)
    sized = rows.join(sets.select("node", F.octet_length("set").alias("bytes")), "node")
    ahead = Window.partitionBy("family").orderBy("root", "node").rowsBetween(Window.unboundedPreceding, -1)
    cost = F.greatest(F.lit(1.0 / FAMILY_ROWS), F.col("bytes") / F.lit(float(FAMILY_BYTES)))
    blocks = materialize(sized.withColumn("block", F.floor(F.coalesce(F.sum(cost).over(ahead), F.lit(0.0)) + 1e-9)).drop("bytes"), "family-blocks")
    spans = materialize(blocks.groupBy("family", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")), "family-spans")
    other = spans.select("family", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    pairs = spans.withColumnRenamed("block", "i").join(other, "family").where("i <= j and least(low, low_j) < greatest(high, high_j)")
    sides = pairs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    full = blocks.join(sides, ["family", "block"]).join(classes.select("node", "sig").hint("merge"), "node").join(sets.hint("merge"), "node")
    met = full.select("family", "i", "j", "block", "node", "root", "sig", "set").groupBy("family", "i", "j").applyInArrow(_family_meet, "a long, b long")
    return materialize(met, "family-links")


def similar(df: DataFrame, row_col: str, text_col: str = "text", words: int = 5) -> DataFrame:
    """(node, root): components of the rows of df (by a unique integer column) whose shingles are alike by SIMILARITY or more.
    Rows that resemble no other are absent. Texts that are blank are alike; a text of fewer words is one shingle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sigs = [wide_fingerprint(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sigs, pa.binary())], ["row", "sig"])

    light = df.select(F.col(f"`{row_col}`").cast("long").alias("row"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(light.mapInArrow(run, "row long, sig binary"), "wide-fingerprints")
    classes = materialize(prints.groupBy("sig").agg(F.min("row").alias("node"), F.count("*").alias("n")), "wide-classes")
    keyed = classes.select("sig", "node").mapInArrow(_wide_keys(slices(classes.count())), "key long, node long, w0 long, w1 long, w2 long, w3 long")
    told = _confirmed(wide_links(keyed), classes, light, words)
    near = components(told.where("ok").select("a", "b"))
    more = _family_links(told, near, classes, light, words)
    if more is not None:
        near = components(told.where("ok").select("a", "b").unionByName(more))
    # copies of one fingerprint share its class's component
    named = classes.join(near, "node", "left").select("sig", "n", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "node").alias("root"))
    return prints.join(named.where("n > 1 or linked").select("sig", "root"), "sig").select(F.col("row").alias("node"), "root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """df with one row of each group of similar texts, that of the smallest id; columns unchanged.

    Edge cases. Null, empty and blank texts are one group. Null ids come last; of rows of one id any one stays. Repeated rows
    are one group. An empty table gives an empty result. Ids may have any sortable type, other columns any name.
    """
    rows_, row = with_row(df, "simhash-rows")
    near = similar(rows_, row, text_col, words)
    ids = rows_.select(F.col(row).alias("node"), F.col(f"`{id_col}`").alias("id"))
    grouped = materialize(near.join(ids, "node"), "simhash-groups")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "node")).alias("b")).select(F.col("b.node").alias("node"))
    gone = grouped.select("node").join(best, "node", "left_anti").select(F.col("node").alias(row))
    return rows_.join(gone.hint("merge"), row, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
