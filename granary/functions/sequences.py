"""Sequence functions: k-mers, Jaccard, positional identity, MinHash."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, spread


def kmer_set(sequence: str, k: int) -> set[str]:
    """The distinct k-mers; a sequence shorter than k is its own."""
    return {sequence} if len(sequence) < k else {sequence[i : i + k] for i in range(len(sequence) - k + 1)}


def jaccard(a: set, b: set) -> float:
    """Shared over all; two empty sets are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def positional_identity(a: str, b: str) -> float:
    """Positions with the same letter, over the longer length."""
    longest = max(len(a), len(b))
    return sum(x == y for x, y in zip(a, b)) / longest if longest else 1.0


def kmers(df: DataFrame, k: int, id_col: str, seq_col: str, key: Column | None = None) -> DataFrame:
    """(id, n, kmer): a row for each distinct k-mer, with their number; k-mers are 64-bit hashes, or `key` of the text `kmer`.

    Slices are taken in Arrow batches, whose rows go straight out: far cheaper than a lambda over substrings.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, n, out = batch.column(0).slice(at, 64), [], []
                for s in batch.column(1).slice(at, 64).to_pylist():
                    found = kmer_set(s, k)
                    n.append(len(found))
                    out.extend(found)
                take = pa.array([i for i, m in enumerate(n) for _ in range(m)], pa.int32())
                sizes = pc.take(pa.array(n, pa.int32()), take)
                yield pa.RecordBatch.from_arrays([pc.take(ids, take), sizes, pa.array(out, pa.string())], ["id", "n", "kmer"])

    kind = dict(df.dtypes)[id_col]
    cut = spread(df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("sequence"))).mapInArrow(run, f"id {kind}, n int, kmer string")
    return cut.select("id", "n", (F.xxhash64("kmer") if key is None else key).alias("kmer"))


def least_kmers(df: DataFrame, k: int, id_col: str, seq_col: str, most: int) -> DataFrame:
    """(id, len, kmer, at): of each sequence's distinct k-mers the `most` ones of least hash, with the place of the first
    occurrence (from 0) and the sequence's length. Hashes are the first 60 bits of the k-mers' md5."""

    def run(batches) -> Iterator:
        import heapq

        import pyarrow as pa

        md5, known = hashlib.md5, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                take, sizes, keys, places = [], [], [], []
                for i, s in enumerate(batch.column(1).slice(start, 256).to_pylist()):
                    first: dict[str, int] = {}
                    for at in range(max(1, len(s) - k + 1)):
                        first.setdefault(s[at : at + k], at)
                    if len(known) + len(first) > 1_000_000:
                        known.clear()
                    for t in first:
                        if t not in known:
                            known[t] = int(md5(t.encode()).hexdigest()[:15], 16)
                    for key, at in heapq.nsmallest(most, ((known[t], at) for t, at in first.items())):
                        take.append(i)
                        sizes.append(len(s))
                        keys.append(key)
                        places.append(at)
                ids = batch.column(0).slice(start, 256).take(pa.array(take, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())], ["id", "len", "kmer", "at"])

    kind = dict(df.dtypes)[id_col]
    return spread(df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("sequence"))).mapInArrow(run, f"id {kind}, len int, kmer long, at int")


#: The share of a set by which its index prefix is longer than one shared k-mer calls for, so that pairs share several.
MARGIN = 0.05
#: Rows of one k-mer that one task joins with as many others.
TOKEN_ROWS = 4096


def ordered_sets(tokens: DataFrame) -> DataFrame:
    """(id, n, f, kmers) for rows (id, n, kmer): each set's k-mers and their frequencies, rarest first."""
    tokens = materialize(tokens, "kmers")
    rarity = tokens.groupBy("kmer").agg(F.count("*").alias("f"))

    def sort(table):
        import numpy as np
        import pyarrow as pa

        f, kmer = table.column("f").to_numpy(), table.column("kmer").to_numpy()
        order = np.lexsort((kmer, f))
        whole = np.array([0, len(f)], dtype=np.int32)
        lists = [pa.ListArray.from_arrays(whole, pa.array(x[order])) for x in (f, kmer)]
        return pa.Table.from_arrays([table.column("id").slice(0, 1), table.column("n").slice(0, 1), *lists], ["id", "n", "f", "kmers"])

    kind = dict(tokens.dtypes)["id"]
    joined = tokens.join(rarity, "kmer").select("id", "n", "f", "kmer")
    return materialize(joined.groupBy("id").applyInArrow(sort, f"id {kind}, n int, f array<long>, kmers array<long>"), "kmer-sets")


def alike_sets(tokens: DataFrame, threshold: float) -> DataFrame:
    """(p, c, score, shared), p < c, of the sets (id, n, kmer) that share a k-mer and have Jaccard >= threshold.

    With k-mers in order of rarity, a set of n meets larger ones by the first n - ceil(2t/(1+t) n) + 1 and smaller ones by the
    first n - ceil(t n) + 1 (Xiao, Wang, Lin & Yu, WWW 2008); classes of like sizes meet only. The shorter prefix is
    lengthened by MARGIN, so that what two alike sets share in their prefixes is not one k-mer but many: pairs are counted
    where they meet, and few are left. What counts and positions bound:

    * beyond its last shared k-mer, at positions i and j, a pair shares min(n_x - i - 1, n_y - j - 1) at most;
    * beyond the prefix that ends first in the common order, what is left of that set.

    Only pairs that can still reach the threshold have their sets intersected. Rows of a frequent k-mer are dealt out over
    tasks of TOKEN_ROWS each.
    """
    sets, t = ordered_sets(tokens), float(threshold)
    n, least = F.col("n"), 1e-9
    index = F.least(n, F.greatest(F.lit(1), (n - F.ceil(2 * t / (1 + t) * n - least) + 1 + F.floor(MARGIN * n)).cast("int")))
    probe = F.least(n, F.greatest(F.lit(1), (n - F.ceil(t * n - least) + 1).cast("int")))
    # at low thresholds sizes say little: all sets are one class
    steps = F.lit(0) if t < 0.05 else F.floor(F.log(n) / F.lit(math.log(1 / t) if t < 1 else 1e-6) + least).cast("int")
    ends = lambda l: F.struct(F.get("f", l - 1).alias("f"), F.get("kmers", l - 1).alias("k"))
    sets = sets.withColumns({"of_x": index, "of_y": probe, "size": steps})
    sets = sets.withColumns({"end_x": ends(F.col("of_x")), "end_y": ends(F.col("of_y"))})

    def side(name: str) -> DataFrame:
        cut = F.arrays_zip(F.slice("kmers", F.lit(1), F.col(f"of_{name}")).alias("kmer"), F.slice("f", F.lit(1), F.col(f"of_{name}")).alias("f"))
        rows = sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), "size", F.posexplode(cut).alias(f"at_{name}", "token"))
        rows = rows.select(name, f"n_{name}", f"at_{name}", "size", F.col("token.kmer").alias("kmer"), F.ceil(F.col("token.f") / TOKEN_ROWS).alias("salts"))
        if name == "x":
            return rows.withColumn("salt", F.pmod(F.xxhash64("x"), "salts")).drop("salts")
        rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
        return rows if t < 0.05 else rows.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1)))

    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y")))
    both = F.col("n_x") + F.col("n_y")
    need = F.ceil(t / (1 + t) * both - least)
    met = side("x").join(side("y"), ["kmer", "size", "salt"]).where(smaller & (F.col("n_x") >= t * F.col("n_y") - least))
    met = met.groupBy("x", "y").agg(F.first("n_x").alias("n_x"), F.first("n_y").alias("n_y"), F.count("*").alias("m"), F.max("at_x").alias("i"), F.max("at_y").alias("j"))
    met = met.where(F.col("m") + F.least(F.col("n_x") - F.col("i"), F.col("n_y") - F.col("j")) - 1 >= need)
    tails = lambda name: sets.select(F.col("id").alias(name), f"end_{name}", f"of_{name}")
    met = met.join(tails("x"), "x").join(tails("y"), "y")
    left = F.when(F.col("end_x") <= F.col("end_y"), F.col("n_x") - F.col("of_x")).otherwise(F.col("n_y") - F.col("of_y"))
    met = materialize(met.where(F.col("m") + left >= need).select("x", "y", "n_x", "n_y"), "kmer-pairs")
    whole = lambda name: sets.select(F.col("id").alias(name), F.col("kmers").alias(f"s_{name}"))
    out = met.join(whole("x"), "x").join(whole("y"), "y").withColumn("shared", F.size(F.array_intersect("s_x", "s_y")))
    out = out.withColumn("score", F.col("shared") / (both - F.col("shared"))).where((F.col("shared") > 0) & (F.col("score") >= t))
    return out.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("c"), "score", "shared")


#: Rows, and bits of their sketches, that one task of the grid reads from either side.
SKETCH_ROWS, SKETCH_BITS = 16384, 1 << 27


def parity_sketch(sequence: str, k: int, bits: int):
    """(n, words): the number of distinct k-mers, and for each of at least `bits` times n bins, a power of two, whether an odd
    number of k-mers falls into it. Half as many bins are the XOR of both halves."""
    import numpy as np

    code = np.frombuffer(sequence.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    width = min(k, len(code))
    h = np.full(max(1, len(code) - width + 1), width, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + len(h)]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.unique(h ^ (h >> np.uint64(32)))
    bins = 1 << max(6, math.ceil(math.log2(bits * len(h))))
    odd = np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return len(h), np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(words, bins: int):
    """Sketches (rows of bytes) of more bins as those of `bins`."""
    while words.shape[1] * 8 > bins:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def alike_sequences(df: DataFrame, k: int, id_col: str, seq_col: str, threshold: float) -> DataFrame:
    """alike_sets() of the k-mers of sequences, for thresholds at which little may differ. No k-mer becomes a row.

    A k-mer that one set has and the other has not changes one bit of a parity sketch, so sketches differ in no more bits than
    sets in k-mers; a pair with Jaccard >= t differs in (1-t)/(1+t) of both sizes at most. Sketches, of two to four bits a
    k-mer, meet in grids of tasks within classes of like sizes; only pairs that pass have their sequences compared. A sketch
    goes to as many tasks as its class has parts, and memory is that of two parts. All pairs of like sizes meet, so the
    work is quadratic, at a few dozen words a pair.
    """
    t, least = float(threshold), 1e-9
    kind = dict(df.dtypes)[id_col]
    step = math.log(1 / t) if t < 1 else 1e-6

    def draw(batches) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = [parity_sketch(s, k, 2) for s in batch.column(1).slice(at, 256).to_pylist()]
                n = [x for x, _ in made]
                size = [math.floor(math.log(x) / step + least) for x in n]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array([w.tobytes() for _, w in made], pa.binary())], ["id", "n", "size", "bits"])

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("sequence"))).mapInArrow(draw, f"id {kind}, n int, size long, bits binary")
    rows = materialize(rows, "sketches")
    room = F.least(F.lit(SKETCH_ROWS), F.greatest(F.lit(64), F.lit(SKETCH_BITS) / (8 * F.max(F.octet_length("bits")))))
    parts = materialize(rows.groupBy("size").agg(F.ceil(F.count("*") / room).cast("long").alias("parts")), "sketch-parts")
    beside = lambda name, by: parts.select((F.col("size") + by).alias("size"), F.col("parts").alias(name))
    cut = rows.join(parts.join(beside("after", -1), "size", "left").join(beside("before", 1), "size", "left"), "size")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    key = lambda size, near, a, b, right: F.struct(size.alias("s"), F.lit(near).alias("near"), a.alias("a"), b.alias("b"), right.alias("right"))
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    size, part, no, yes = F.col("size"), F.col("part"), F.lit(False), F.lit(True)
    met = F.concat(
        F.transform(every("parts"), lambda q: key(size, 0, F.least(part, q), F.greatest(part, q), part > q)),
        F.transform(every("after"), lambda q: key(size, 1, part, q, no)),
        F.transform(every("before"), lambda q: key(size - 1, 1, q, part, yes)),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = pa.Table.from_batches(list(batches)).sort_by([("n", "ascending"), ("id", "ascending")])
        if not table.num_rows:
            return
        right, raw = table.column("right").to_numpy(), table.column("bits").to_pylist()
        own = table.column("near")[0].as_py() == 0 and table.column("a")[0].as_py() == table.column("b")[0].as_py()
        bins = 8 * min(map(len, raw))
        words = np.empty((len(raw), bins // 64), dtype=np.uint64)
        for w in {len(x) for x in raw}:
            at = [i for i, x in enumerate(raw) if len(x) == w]
            for some in range(0, len(at), 1024):
                block = np.frombuffer(b"".join(raw[i] for i in at[some : some + 1024]), dtype=np.uint8).reshape(-1, w)
                words[at[some : some + 1024]] = np.ascontiguousarray(folded(block, bins)).view(np.uint64)
        del raw
        ids, n = table.column("id").combine_chunks(), table.column("n").to_numpy().astype(np.int64)
        xs = np.arange(len(n)) if own else np.flatnonzero(~right)
        ys = xs if own else np.flatnonzero(right)
        of_y, n_y = words[ys], n[ys]
        first = max(1, words.shape[1] // 2)  # most pairs differ in too many bits of the first half
        for i, x in enumerate(xs):
            low, high = np.searchsorted(n_y, [t * n[x] - least, n[x] / t + least])
            low = max(low, i + 1) if own else low
            if low >= high:
                continue
            limit = np.floor((1 - t) / (1 + t) * (n[x] + n_y[low:high]) + 1e-6)
            apart = np.bitwise_count(of_y[low:high, :first] ^ words[x, :first]).sum(1, dtype=np.int64)
            near = np.flatnonzero(apart <= limit)
            if len(near) and first < words.shape[1]:
                apart = apart[near] + np.bitwise_count(of_y[low + near, first:] ^ words[x, first:]).sum(1, dtype=np.int64)
                near = near[apart <= limit[near]]
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.repeat(ids[x], len(near)), ids.take(pa.array(ys[low + near]))], ["x", "y"])

    grid = cut.select(F.explode(met).alias("k"), "id", "n", "bits").select("k.*", "id", "n", "bits")
    pairs = materialize(grid.groupBy("s", "near", "a", "b").applyInArrow(compare, f"x {kind}, y {kind}"), "sketch-pairs")
    whole = lambda name: df.select(F.col(id_col).alias(name), F.col(seq_col).alias(f"s_{name}"))

    def share(batches) -> Iterator:
        for batch in batches:
            shared, score = [], []
            seen: dict = {}
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for s in (x, y):
                    if s not in seen:
                        if len(seen) > 64:
                            seen.clear()
                        seen[s] = kmer_set(s, k)
                a, b = seen.get(x) or kmer_set(x, k), seen[y]
                shared.append(len(a & b))
                score.append(shared[-1] / (len(a) + len(b) - shared[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score, pa.float64()), pa.array(shared, pa.int32())], ["x", "y", "score", "shared"])

    both = pairs.join(whole("x"), "x").join(whole("y"), "y").select("x", "y", "s_x", "s_y")
    out = both.mapInArrow(share, f"x {kind}, y {kind}, score double, shared int").where((F.col("shared") > 0) & (F.col("score") >= t))
    return out.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("c"), "score", "shared")


def identity_column(a: Column, b: Column) -> Column:
    """positional_identity as a column expression."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x) / longest)


#: The Mersenne prime 2**31 - 1: products of two smaller numbers fit 64 bits.
PRIME = (1 << 31) - 1


def permutations(seeds: int, seed: int) -> list[tuple[int, int]]:
    """Factors and terms of the MinHash functions (factor x hash + term) mod PRIME, from md5 of seed, number and name."""
    draw = lambda j, name, low: low + int(hashlib.md5(f"{seed}:{j}:{name}".encode()).hexdigest()[:15], 16) % (PRIME - low)
    return [(draw(j, "factor", 1), draw(j, "term", 0)) for j in range(seeds)]


def token_hash(text: Column) -> Column:
    """The first 32 bits of a text's md5, modulo PRIME."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % PRIME


def _values(a, b, h):
    """(a h + b) mod PRIME: a row for each hash, a column for each function.

    Of a number below 2**62 the bits beyond the 31st are added to the others, and PRIME is taken off twice where that is
    possible: in unsigned numbers the smaller of y and y - PRIME, as the latter wraps around below zero.
    """
    import numpy as np

    x = h[:, None] * a + b
    y = x >> np.uint64(31)
    x &= np.uint64(PRIME)
    x += y
    for _ in range(2):
        np.subtract(x, np.uint64(PRIME), out=y)
        np.minimum(x, y, out=x)
    return x.astype(np.uint32)


#: Values of functions that a task keeps (64 MB), k-mers whose hashes it keeps, and rows of values that are compared at once.
KEPT_VALUES, KEPT_HASHES, PIECE = 1 << 24, 1 << 19, 128


class _Signer:
    """Signatures of sequences. A text shares most k-mers with those before it: of the first KEPT_VALUES / seeds k-mers the
    values of all functions are kept, and a signature is the least of its k-mers' rows; of the first KEPT_HASHES the hash is
    kept. For other k-mers both are reckoned anew, so what is kept doesn't change the result.

    K-mers are numbers of as many bits for a letter as fit 63; letters are numbered as they come, and k-mers are looked up by
    linear probing. Sequences with letters beyond those, or shorter than k, have their k-mers cut as text.
    """

    def __init__(self, k: int, seeds: int, seed: int):
        import numpy as np

        self.k, self.bits, self.known, self.letters = k, 63 // k, 0, 1
        self.a, self.b = (np.array(x, dtype=np.uint64)[None, :] for x in zip(*permutations(seeds, seed)))
        self.letter = np.zeros(0x110000, dtype=np.int64)
        self.code = np.zeros(1 << min(self.bits, 16), dtype=np.uint32)
        self.table = np.empty((max(1, min(KEPT_HASHES, KEPT_VALUES // seeds)), seeds), dtype=np.uint32)
        self.hashes = np.empty(KEPT_HASHES, dtype=np.uint64)
        size = 4 * KEPT_HASHES
        self.slots, self.number, self.shift = np.zeros(size, dtype=np.int64), np.empty(size, dtype=np.int32), np.uint64(64 - size.bit_length() + 1)

    def keys(self, sequence: str):
        """The distinct k-mers as numbers; None if they have to be cut as text."""
        import numpy as np

        code = np.frombuffer(sequence.encode("utf-32-le"), dtype=np.uint32)
        if len(code) < self.k:
            return None
        found = self.letter[code]
        if not found.all():
            new = np.unique(code[found == 0])[: len(self.code) - self.letters]
            self.code[self.letters : self.letters + len(new)] = new
            self.letter[new] = range(self.letters, self.letters + len(new))
            self.letters += len(new)
            found = self.letter[code]
            if not found.all():
                return None
        n = len(code) - self.k + 1
        key = found[:n].copy()
        for j in range(1, self.k):
            key <<= self.bits
            key |= found[j : j + n]
        key.sort()
        return key[np.append(True, key[1:] != key[:-1])]

    def _texts(self, keys) -> list[str]:
        import numpy as np

        at = keys[:, None] >> (self.bits * np.arange(self.k - 1, -1, -1)) & ((1 << self.bits) - 1)
        text = self.code[at].tobytes().decode("utf-32-le")
        return [text[i : i + self.k] for i in range(0, len(text), self.k)]

    def _start(self, keys):
        import numpy as np

        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys):
        """The numbers of k-mers, in the order in which they were kept; -1 for those that are not."""
        import numpy as np

        at, out, todo = self._start(keys), np.full(len(keys), -1, dtype=np.int32), np.arange(len(keys))
        while len(todo):
            held = self.slots[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.number[at[todo[hit]]]
            todo = todo[~hit & (held != 0)]
            at[todo] = (at[todo] + 1) % len(self.slots)
        return out

    def keep(self, keys, hashes) -> None:
        """Number k-mers that are not kept yet, as far as there is room."""
        import numpy as np

        keys = keys[: KEPT_HASHES - self.known]
        at, todo = self._start(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] == 0]
            self.slots[at[free]] = keys[free]
            won = self.slots[at[todo]] == keys[todo]
            self.number[at[todo[won]]] = self.known + todo[won]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) % len(self.slots)
        self.hashes[self.known : self.known + len(keys)] = hashes[: len(keys)]
        first = self.table[self.known : self.known + len(keys)]
        for piece in range(0, len(first), PIECE):
            first[piece : piece + PIECE] = _values(self.a, self.b, hashes[piece : min(piece + PIECE, len(first))])
        self.known += len(keys)

    def _hashed(self, texts):
        import numpy as np

        return np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % PRIME for t in texts], dtype=np.uint64)

    def sign(self, sequence: str):
        import numpy as np

        keys, least = self.keys(sequence), np.full(self.table.shape[1], PRIME, dtype=np.uint32)
        if keys is None:
            rest = self._hashed(kmer_set(sequence, self.k))
        else:
            at = self.find(keys)
            new = keys[at < 0]
            hashes = self._hashed(self._texts(new))
            held = at[(at >= 0) & (at < len(self.table))]
            for piece in range(0, len(held), PIECE):
                np.minimum(least, self.table.take(held[piece : piece + PIECE], axis=0).min(axis=0), out=least)
            rest = np.concatenate([hashes, self.hashes[at[at >= len(self.table)]]])
            if self.known < KEPT_HASHES:
                self.keep(new, hashes)
        for piece in range(0, len(rest), PIECE):
            np.minimum(least, _values(self.a, self.b, rest[piece : piece + PIECE]).min(axis=0), out=least)
        return least


def signatures(df: DataFrame, k: int, id_col: str, seq_col: str, seeds: int, seed: int) -> DataFrame:
    """(id, sig): for each of `seeds` hash functions the smallest value over a sequence's k-mers; null for null sequences.

    One row goes out for each sequence. Token hashes are those of token_hash(). Memory is bounded: a task keeps KEPT_VALUES
    values and KEPT_HASHES hashes, and k-mers go in pieces.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        signer = _Signer(k, seeds, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.column(1).slice(at, 256).to_pylist()
                out = [signer.sign(s or "") for s in some]
                none = np.repeat([s is None for s in some], seeds)
                sig = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * seeds, pa.array(np.concatenate(out).astype(np.int64), mask=none))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), sig], ["id", "sig"])

    kind = dict(df.dtypes)[id_col]
    return spread(df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("sequence"))).mapInArrow(run, f"id {kind}, sig array<long>")


def bands(threshold: float, seeds: int) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positives and false negatives at the threshold."""
    best, choice, steps = float("inf"), (1, seeds), 200
    for b in range(1, seeds + 1):
        r = seeds // b
        hit = [1 - (1 - ((i + 0.5) / steps) ** r) ** b for i in range(steps)]
        wrong = sum(p if (i + 0.5) / steps < threshold else 1 - p for i, p in enumerate(hit)) / steps
        if wrong < best - 1e-12:
            best, choice = wrong, (b, r)
    return choice
