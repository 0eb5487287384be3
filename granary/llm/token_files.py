"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files in a shared folder: raw ids (16 bits each where the vocabulary allows it, else 32; little-endian),
and an index. Documents lie in ascending key order over all shards (nulls first, repeated keys side by side). The index
holds a minimal perfect hash over the shard's distinct keys: cascaded bit arrays (Limasset et al., SEA 2017), in which
a key owns the first bit that no other key of its level hits; the bit's rank is its slot. A slot stores a 32-bit
fingerprint of the key, its first record and its number of records, so a lookup costs a few probes and a foreign key is
refused but for one in four billion. A shard holds about SHARD_CHARS characters of text at most; records of a key that
is repeated so often may fill several shards, each of which indexes its own. Keys whose 64-bit hashes coincide end in a short explicit list.

Files are named by attempt and only those that a successful task reports enter the manifest, so lost executors and
speculative tasks leave no half-written shard behind.

Edge cases. Null or empty text: the end id alone. Null keys are indexed as a key of their own. An empty table gives an
empty manifest and an empty result. Other input columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table
from .tokens import default_path, encoder, rows

MAGIC = b"GRNTOK01"
GAMMA, LEVELS, SHARD_CHARS = 1.6, 40, 128 << 20


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 of each value, seeded by level."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hashes(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Hash and fingerprint of each key; a null differs from every text."""
    import xxhash

    raw = [b"\x00" if k is None else b"\x01" + str(k).encode() for k in keys]
    return np.array([xxhash.xxh64_intdigest(k, 1) for k in raw], dtype=np.uint64), np.array([xxhash.xxh32_intdigest(k, 2) for k in raw], dtype=np.uint32)


class PerfectHash:
    """Maps n distinct 64-bit hashes one to one to 0..n-1; any other hash to some slot or to -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.base, self.ranks, at = [], [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.base.append(at)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
            at += int(ones.sum())
        self.base.append(at)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels = hashes, []
        while len(left) and len(levels) < LEVELS:
            m = max(1, -(-int(GAMMA * len(left)) // 64)) * 64
            pos = (_mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(pos, minlength=m)[pos] == 1
            bits = np.zeros(m, dtype=np.uint8)
            bits[pos[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(levels, np.sort(left))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot, todo = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        for k, words in enumerate(self.levels):
            if not len(todo):
                return slot
            pos = _mix(hashes[todo], k) % np.uint64(64 * len(words))
            word, bit = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slot[todo[hit]] = self.base[k] + self.ranks[k][word[hit]] + below[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[todo]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[todo]
            slot[todo[hit]] = self.base[-1] + at[hit]
        return slot


def _block(a: np.ndarray) -> bytes:
    return struct.pack("<4sq", a.dtype.str.encode().ljust(4), len(a)) + a.tobytes()


def pack_index(keys: list, lengths: list[int], width: int) -> bytes:
    """The index of records in key order; equal keys are neighbours."""
    first = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
    hashes, prints = key_hashes([keys[i] for i in first])
    order, kept = np.unique(hashes, return_index=True)  # of keys with one hash only the first is reached by it
    mph = PerfectHash.build(order)
    slot = mph(order)
    counts = np.diff([*first, len(keys)])
    by_slot = [np.zeros(len(order), t) for t in ("<u4", "<i8", "<i8")]
    for a, v in zip(by_slot, (prints[kept], np.array(first, dtype=np.int64)[kept], counts[kept])):
        a[slot] = v
    ends = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]).astype("<i8")
    nulls = np.array([k is None for k in keys], dtype="u1")
    ids = np.array([k or 0 for k in keys], dtype="<i8")
    return MAGIC + struct.pack("<iiq", width, len(mph.levels), len(keys)) + b"".join(map(_block, [*mph.levels, mph.rest, *by_slot, ends, ids, nulls]))


class Shard:
    """Keyed access to a shard through its index."""

    def __init__(self, index: bytes, payload: memoryview | bytes):
        if index[:8] != MAGIC:
            raise ValueError("not a token index")
        width, n_levels, self.n = struct.unpack_from("<iiq", index, 8)
        at, blocks = 8 + 16, []
        while at < len(index):
            kind, n = struct.unpack_from("<4sq", index, at)
            a = np.frombuffer(index, np.dtype(kind.decode().strip()), n, at + 12)
            blocks.append(a)
            at += 12 + a.nbytes
        self.mph = PerfectHash([np.asarray(b, dtype=np.uint64) for b in blocks[:n_levels]], blocks[n_levels])
        self.prints, self.first, self.count, self.ends, ids, nulls = blocks[n_levels + 1 :]
        self.keys = [None if z else int(k) for k, z in zip(ids, nulls)]
        self.ids = np.frombuffer(payload, f"<u{width}")

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 where the shard lacks it."""
        hashes, prints = key_hashes(keys)
        slot = self.mph(hashes)
        found = (slot >= 0) & (len(self.prints) > 0)
        found[found] = self.prints[slot[found]] == prints[found]
        first, count = np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        first[found], count[found] = self.first[slot[found]], self.count[slot[found]]
        return first, count

    def record(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] : self.ends[i + 1]]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """A URI with its scheme, as the cluster's default file system has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_shards(
    df: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> DataFrame:
    """Write df as shards and indexes into folder; the manifest: shard, file, n_docs, n_tokens."""
    spark = df.sparkSession
    path, folder = path or default_path("word_bpe_49k.json"), _qualified(spark, folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = encoder(path), end_id.to_bytes(4, "little")
        narrow, keys, lengths = encode.size <= 1 << 16, [], []
        files, at = _open(folder)
        files.create_dir(at, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{at}/{name}.bin") as out:
            for key, text in rows(batches, "doc_id", "text"):
                data = encode(text or "") + end
                keys.append(key)
                lengths.append(len(data) // 4)
                out.write(np.frombuffer(data, "<u4").astype("<u2").tobytes() if narrow else data)
        if not keys:
            files.delete_file(f"{at}/{name}.bin")
            return
        with files.open_output_stream(f"{at}/{name}.idx") as out:
            out.write(pack_index(keys, lengths, 2 if narrow else 4))
        row = (([TaskContext.get().partitionId()], pa.int32()), ([f"{folder}/{name}"], pa.string()), ([len(keys)], pa.int64()), ([sum(lengths)], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(*x) for x in row], ["shard", "file", "n_docs", "n_tokens"])

    light = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = light.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_CHARS))
    # rows of one key, or of none, may be any part of the table: they are dealt over shards by a second, random key
    light = light.withColumn("deal", F.xxhash64("text", F.monotonically_increasing_id()))
    light = light.repartitionByRange(shards, "doc_id", "deal").sortWithinPartitions("doc_id").drop("deal")
    return materialize(light.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row for each document, by keyed access: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # a row for each shard, so the list grows with the number of files only
    listed, at, todo = sorted((r.shard, r.file, r.n_tokens) for r in manifest.collect()), 0, []
    for shard, file, n in listed:
        todo.append((shard, file, at))
        at += n

    def run(batches):
        import pyarrow as pa

        for shard, file, base in rows(batches, "shard", "file", "base"):
            files, at = _open(file)
            with files.open_input_stream(f"{at}.idx") as f:
                index = f.read()
            with files.open_input_stream(f"{at}.bin") as f:
                part = Shard(index, f.read())
            distinct = list(dict.fromkeys(part.keys))
            first, count = part.find(distinct)
            ids, starts, lengths, crcs = [], [], [], []
            for key, i, n in zip(distinct, first.tolist(), count.tolist()):
                if i < 0 or part.keys[i] != key:
                    i = part.keys.index(key)  # two keys with one hash: the list decides
                    n = part.keys.count(key)
                for k in range(i, i + n):
                    got = part.record(k)
                    ids.append(key)
                    starts.append(base + int(part.ends[k]))
                    lengths.append(len(got))
                    crcs.append(zlib.crc32(got.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    plan = spark.createDataFrame(todo, "shard int, file string, base long")
    return plan.repartition(max(1, len(todo))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
