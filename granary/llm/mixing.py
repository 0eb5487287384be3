"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every source is a flow whose rate is its target share. Documents of a source queue in a seeded shuffle order, up to three
passes long, as packets of at most a QUANTA-th of the source's target (most documents are one packet). A packet's virtual
finish time is its source's words up to and with it, divided by the target. All packets of all sources are range-sorted by
finish time; their running word count, from the sums of the ranges before and the rows before within a range, is cut at
the total budget: packets before the cut are served, the one that it meets in part, the rest not at all. At the cut no
source is more than a packet away from its target.

A source may hold any part of the rows: running sums are taken inside (source, 4096 shuffle buckets) and the buckets'
totals, a small table, are summed on their own, so no task ever needs a whole source. The shuffle order is that of a
digest of id and text, so that rows of one id, or of none, spread too.

Edge cases. Null or empty text: size 0, taken 0; such rows never queue. A null source is one source, the last. Rows
repeated in id and text are neighbours in the shuffle and queue one by one. A source without words has target 0. An empty
table gives an empty result. mix() keeps df's columns, whatever their names; there rows repeated in id and text move
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, materialize, table

PASSES, QUANTA, WEIGHTS, SEED = 3, 256, (1, 2, 3), 7


def words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A document's place in the shuffle."""
    known = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), known(doc_id.cast("string")), F.lit(":"), known(text)).cast("binary"))


def flow(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each source (key, source_size, target): shares of all words by weight, capped at three times the source.

    Weights go around by the sources' code point order, null last. The caps are settled in closed form: by rising
    cap/weight, a source is capped while the level that the rest would get exceeds its own ratio.
    """
    s = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.lit(float(PASSES)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = W.orderBy("ratio", "key")
    before, here_on = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on))
    free = F.when(F.col("ratio") >= F.col("level"), F.col("level"))
    s = s.withColumn("free_level", F.first(free, ignorenulls=True).over(rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("key", "source_size", F.least("cap", F.col("weight") * F.col("free_level")).alias("target"))


class Queue:
    """A mix: documents (row, doc_id, key, bucket, at, size, source_size, target, start) and packets (those columns of
    documents that name one, and copy, words, finish, served)."""

    def __init__(self, documents: DataFrame, packets: DataFrame):
        self.documents, self.packets = documents, packets


def fair_queue(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
    weights: tuple[int, ...] = WEIGHTS, seed: int = SEED,
) -> Queue:
    """The queue of df, served up to the budget."""
    ident, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    light = df.select(
        (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("row"),
        ident.alias("doc_id"), source.cast("string").alias("source"), words(text).alias("size"), place(ident, text, seed).alias("at"),
    )
    light = materialize(light.withColumn("key", flow(F.col("source"))).withColumn("bucket", F.substring("at", 1, 3)), "mix-sizes")
    totals = materialize(light.groupBy("key", "source", "bucket").agg(F.sum("size").alias("size")), "mix-totals")
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("key", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    within = W.partitionBy("key", "bucket").orderBy("at", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    documents = light.withColumn("upto", F.sum("size").over(within)).join(offsets.join(targets(totals, weights), "key"), ["key", "bucket"])
    documents = documents.withColumn("start", F.col("offset") + F.col("upto") - F.col("size")).drop("offset", "upto", "source", "bucket")
    documents = materialize(documents, "mix-documents")

    quantum = F.greatest(F.lit(1), F.floor(F.col("target") / QUANTA)).cast("long")
    queued = documents.where("size > 0").withColumn("quantum", quantum).withColumn("copy", F.explode(F.array(*map(F.lit, range(PASSES)))))
    queued = queued.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / F.col("quantum")) - 1)))
    own = F.least(F.col("quantum"), F.col("size") - F.col("packet") * F.col("quantum"))
    end = F.col("copy") * F.col("source_size") + F.col("start") + F.col("packet") * F.col("quantum") + own
    order = ["finish", "doc_id", "copy", "packet", "row"]
    queued = queued.select("row", "doc_id", "key", "size", "source_size", "target", "copy", "packet", own.alias("words"), (end / F.col("target")).alias("finish"))
    ranged = materialize(queued.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-queue")
    ahead = F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.sum("words").alias("held")).select("part", ahead.alias("ahead"))  # a row for each range
    running = F.sum("words").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    budget = F.lit(light.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    queue = ranged.withColumn("running", running).join(F.broadcast(parts), "part")
    served = F.greatest(F.lit(0), F.least(F.col("words"), budget - (F.col("ahead") + F.col("running") - F.col("words")))).cast("long")
    return Queue(documents, queue.select("row", "doc_id", "key", "size", "source_size", "target", "copy", "packet", "words", "finish", served.alias("served")))


def taken(queue: Queue) -> DataFrame:
    """row, doc_id, size, source_size, target, taken (words that the mix takes) for each document."""
    names = ["row", "doc_id", "size", "source_size", "target"]
    got = queue.packets.groupBy(*names).agg(F.sum("served").alias("taken"))
    none = queue.documents.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    return got.unionByName(none)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """df's rows as often as the mix takes them: whole copies, and the copy at a source's cut if half of it or more is taken.

    What is served of a source is the front of its queue. So a source's last served copy tells of all its rows how often
    they are taken, and rows stay where they are: only that copy's place, one for each source, is sent to them.
    """
    queue = fair_queue(df, id_col, text_col, source_col, weights=weights, seed=seed)
    copies = queue.packets.groupBy("key", "row", "copy", "size").agg(F.sum("served").alias("served")).where("served > 0")
    last = copies.join(queue.documents.select("row", "at", F.col("doc_id").alias("id"), "start", "source_size"), "row")
    key, at, ident, size, copy, half, times = (fresh(df, n) for n in ("key", "at", "id", "size", "copy", "half", "times"))
    cut = F.max_by(F.struct("copy", "at", "id", "size", (2 * F.col("served") >= F.col("size")).cast("int").alias("half")), F.col("copy") * F.col("source_size") + F.col("start")).alias("cut")
    cuts = last.groupBy("key").agg(cut).select(*(F.col(f"cut.{a}").alias(b) for a, b in (("copy", copy), ("at", at), ("id", ident), ("size", size), ("half", half))), F.col("key").alias(key))
    cuts = materialize(cuts, "mix-cuts")
    text, own_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    here, there = F.struct(place(own_id, text, seed), own_id, words(text)), F.struct(at, ident, size)
    nth = F.when(here < there, F.col(copy) + 1).when(here == there, F.col(copy) + F.col(half)).otherwise(F.col(copy))
    again = df.withColumn(key, flow(F.col(f"`{source_col}`"))).join(cuts, key).where(words(text) > 0).withColumn(times, nth)
    return again.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in df.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(fair_queue(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with recursive docs as (
  select doc_id, source, md5('7:' || doc_id::varchar || ':' || coalesce(text, '')) as at,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
src as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight
  from docs group by source),
lev as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio,
         (sum(source_size) over ()
          - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / weight, source
                     rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by 3.0::double * source_size / weight, source
                     rows between current row and unbounded following) as level
  from src),
tgt as (
  select source, source_size,
         least(cap, weight * (select min_by(level, ratio) from lev where ratio >= level)) as target
  from lev),
q as (
  select d.doc_id, d.size, t.source_size, t.target, greatest(1, floor(t.target / 256))::bigint as quantum,
         sum(d.size) over (partition by d.source order by d.at, d.doc_id rows between unbounded preceding and current row) - d.size as start
  from docs d join tgt t on d.source is not distinct from t.source),
packets as (
  select *, least(quantum, size - packet * quantum) as words,
         (copy * source_size + start + packet * quantum + least(quantum, size - packet * quantum)) / target as finish
  from (select q.*, c.copy, unnest(range(ceil(size / quantum)::bigint)) as packet from q, range(3) c(copy) where size > 0)),
served as (
  select doc_id, greatest(0, least(words, (select sum(size) from docs)
         - (sum(words) over (order by finish, doc_id, copy, packet rows between unbounded preceding and current row) - words))) as served
  from packets)
select q.doc_id, q.size, q.source_size, q.target, coalesce(sum(served.served), 0)::bigint as taken
from q left join served on q.doc_id = served.doc_id
group by q.doc_id, q.size, q.source_size, q.target
"""
