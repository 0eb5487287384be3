"""Exact duplicates by an extendible-hash index on shared files (DataFrame operations only).

1. Every row's key (its text without ASCII white space) is hashed. The index, one entry (hash, rows, bytes) for each
   distinct hash, is written to the shared folder.
2. A directory of hash prefixes is doubled until no bucket holds more bytes than its capacity. A hash whose own rows
   exceed a bucket can't be split by any doubling: it gets an overflow chain.
3. Buckets in order of their prefixes are dealt to owner tasks, each a range of keys and about as many bytes as the
   others. Each row goes once, through the directory, to the task that owns its bucket.
4. An owner chains the rows of a hash and compares their keys' bytes, so that a collision yields two chains.
   Overflow chains are reduced where their rows lie before they meet: such a text sends one row per task.

The driver holds the directory (2**MAX_DEPTH slots at most) and the overflow hashes (4 for each owner at most, as each
is over a quarter of an owner's share); both are broadcast. The input is read up to four times: it must be repeatable.

Edge cases. Null text is the empty text. Null ids sort last. Of rows equal in length and id (repeated rows) one stays,
so that exactly one row of a group is kept. An empty table gives an empty result. Ids may have any sortable type. Other
columns are not read by exact_dedup and are kept as they are by keep_first, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ASCII_SPACE, fresh, materialize, table

SCHEMA_COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
MAX_DEPTH, MOST_OWNERS, OWNER_BYTES, ROW_BYTES = 16, 1 << 14, 64 << 20, 64


def without_space(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _points(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit(""))).cast("long")


def _slot(h: Column, depth: int) -> Column:
    """The hash's first depth bits."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(heads: DataFrame, capacity: int, max_depth: int = MAX_DEPTH, size: Column | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """Double the directory until no bucket is overfull: its global depth, and buckets (number, local depth, prefix).

    heads: a row for each distinct hash h. size: what a row counts in a bucket, 1 unless given. Only a sum for each slot
    comes to the driver. Beyond max_depth buckets grow: they bound a task's key range, not its correctness.
    """
    depth, buckets, _ = _directory(heads, capacity, max_depth, F.lit(1) if size is None else size)
    return depth, buckets


def _directory(heads: DataFrame, capacity: int, max_depth: int, size: Column) -> tuple[int, list[tuple[int, int, int]], list[int]]:
    """As directory(), and what each bucket holds."""
    sums = {r.slot: r.total for r in heads.groupBy(_slot(F.col("h"), max_depth).alias("slot")).agg(F.sum(size).alias("total")).collect()}
    levels = [sums]
    for _ in range(max_depth):
        wider: dict[int, int] = {}
        for slot, total in levels[-1].items():
            wider[slot >> 1] = wider.get(slot >> 1, 0) + total
        levels.append(wider)
    held = lambda prefix, d: levels[max_depth - d].get(prefix, 0)
    depth, done, work = 0, [], [(0, 0)]
    while work:
        full = {b for b in work if held(*b) > capacity} if depth < max_depth else set()
        done += [b for b in work if b not in full]
        work = [(2 * p + bit, d + 1) for p, d in work if (p, d) in full for bit in (0, 1)]
        depth += bool(work)
    done.sort(key=lambda b: b[0] << (max_depth - b[1]))
    return depth, [(k, d, p) for k, (p, d) in enumerate(done)], [held(*b) for b in done]


class Index:
    """The index of a table: its directory's depth and slots (slot, owner), the owners' number, the overflow hashes."""

    def __init__(self, df: DataFrame, text_col: str, capacity: int | None = None):
        spark, text = df.sparkSession, F.col(f"`{text_col}`")
        rows = df.select(F.xxhash64(without_space(text)).alias("h"), (F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + ROW_BYTES).alias("bytes"))
        heads = materialize(rows.groupBy("h").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "dedup-index")
        total = heads.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        self.owners = min(MOST_OWNERS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // OWNER_BYTES, 1))
        capacity = capacity or max(1, total // (4 * self.owners))
        overflow = (F.col("n") > 1) & (F.col("bytes") > capacity)
        self.overflow = [(r.h,) for r in heads.where(overflow).select("h").collect()]
        self.depth, buckets, held = _directory(heads.where(~overflow), capacity, MAX_DEPTH, F.col("bytes"))
        self.slots, before, whole = [], 0, max(1, sum(held))
        for (_, d, p), size in zip(buckets, held, strict=True):
            owner = min(self.owners - 1, before * self.owners // whole)
            self.slots += [(s, owner) for s in range(p << (self.depth - d), (p + 1) << (self.depth - d))]
            before += size

    def split(self, rows: DataFrame, h: str) -> tuple[DataFrame, DataFrame | None]:
        """rows without overflow hashes, and rows of those, None if there are none. h: rows' column of hashes."""
        if not self.overflow:
            return rows, None
        chains = F.broadcast(rows.sparkSession.createDataFrame(self.overflow, f"`{h}` long"))
        return rows.join(chains, h, "left_anti"), rows.join(chains, h, "left_semi")

    def deal(self, rows: DataFrame, h: str) -> tuple[DataFrame, str]:
        """rows in the partitions of their owners, and the owner's column."""
        owner, slot = fresh(rows, "owner"), fresh(rows, "slot")
        where = F.broadcast(rows.sparkSession.createDataFrame(self.slots, f"`{slot}` long, `{owner}` int"))
        routed = rows.withColumn(slot, _slot(F.col(h), self.depth)).join(where, slot).drop(slot)
        return routed.repartitionById(self.owners, owner), owner


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, capacity: int | None = None
) -> DataFrame:
    """A row for each row of df: row, doc_id, keep_id, group_size, kept, text_sha256.

    capacity: bytes of a bucket, by default a quarter of an owner's share.
    """
    text = F.col(f"`{text_col}`")
    log = df.select(
        (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(f"`{id_col}`").alias("id"), _points(text).alias("points"), without_space(text).alias("key"),
    ).withColumn("h", F.xxhash64("key"))
    index = Index(df, text_col, capacity)
    spread, chained = index.split(log, "h")
    dealt, owner = index.deal(spread, "h")
    rank = [F.col("points").desc(), F.col("id").isNull(), F.col("id"), F.col("row")]
    chain = W.partitionBy(owner, "h", "key").orderBy(*rank).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = dealt.select(
        "row", F.col("id").alias("doc_id"), F.first("id").over(chain).alias("keep_id"), F.count("*").over(chain).alias("group_size"),
        (F.first("row").over(chain) == F.col("row")).alias("kept"), F.sha2("key", 256).alias("text_sha256"),
    )
    if chained is None:
        return out
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id"), F.col("row"))).alias("best")
    chains = chained.groupBy("h", "key").agg(F.count("*").alias("group_size"), best).select("h", F.sha2("key", 256).alias("sha"), "group_size", "best")
    # a row for each chain of the overflow hashes, whose number is bounded
    met = chained.select("row", "id", "h", F.sha2("key", 256).alias("sha")).join(F.broadcast(chains), ["h", "sha"])
    return out.unionByName(met.select(
        "row", F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"),
    ))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """df without the rows that are copies of another, its columns unchanged. Whole rows go once to their owners."""
    text, own = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in df.columns]
    h = fresh(df, "h")
    rows = df.withColumn(h, F.xxhash64(without_space(text)))
    index = Index(df, text_col, capacity)
    spread, chained = index.split(rows, h)
    dealt, owner = index.deal(spread, h)
    key, nth = fresh(dealt, "key"), fresh(dealt, "nth")
    ident = F.col(f"`{id_col}`")
    chain = W.partitionBy(owner, h, key).orderBy(_points(text).desc(), ident.isNull(), ident)
    out = dealt.withColumn(key, without_space(text)).withColumn(nth, F.row_number().over(chain)).where(F.col(nth) == 1).select(*own)
    if chained is None:
        return out
    best = F.min_by(F.struct(*own), F.struct(-_points(text), ident.isNull(), ident)).alias("best")
    return out.unionByName(chained.groupBy(h, without_space(text).alias(key)).agg(best).select("best.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(*SCHEMA_COLUMNS)


SQL = r"""
with t as (
  select doc_id, length(coalesce(text, ''))::bigint as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k
  from documents)
select doc_id,
       first_value(doc_id) over (partition by k order by points desc, doc_id) as keep_id,
       count(*) over (partition by k)::bigint as group_size,
       doc_id = first_value(doc_id) over (partition by k order by points desc, doc_id) as kept,
       sha256(k) as text_sha256
from t
"""
