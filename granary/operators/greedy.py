"""The greedy kept set, in parallel.

A row is kept unless an earlier kept row resembles it: the lexicographically first maximal independent set of the
similarity graph. Each round removes the neighbours of rows that no undecided row precedes (Blelloch, Fineman & Shun,
SPAA 2012). Rounds work on edges only and shrink; once few are left, one task finishes them in order.

Where rows resemble each other by meeting in a bucket, the graph is that of rows and buckets (kept_in_buckets): a round
costs a row for each row's bucket, however many rows a bucket holds, and pairs are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..storage import materialize

#: Edges that one task may finish; the number is counted before.
SMALL = 200_000


def _finish(pdf):
    """The removed rows of a small remainder, by one pass in order of the later row."""
    import pandas as pd

    removed = set()
    for c, earlier in pdf.sort_values(["c", "p"]).groupby("c", sort=True)["p"]:
        if any(p not in removed for p in earlier):
            removed.add(c)
    return pd.DataFrame({"node": pd.Series(sorted(removed), dtype=pdf["c"].dtype)})


def _prefix(ends: DataFrame, most: int):
    """The last row c of the longest prefix with at most `most` edges among rows (c, n, __r), looked for by halving ranks; None
    if the first row has more."""
    low, high = 0, ends.count()
    while low < high:
        middle = (low + high + 1) // 2
        if (ends.where(F.col("__r") <= middle).agg(F.sum("n")).first()[0] or 0) <= most:
            low = middle
        else:
            high = middle - 1
    return ends.where(F.col("__r") == low).first()["c"] if low else None


def removed_rows(edges: DataFrame) -> DataFrame:
    """(node) of the rows that are not kept, for edges (p, c) in which p precedes c. edges: a table, which is read several
    times; parallel edges do no harm.

    First a prefix of the rows, so short that a task can finish its edges, is settled: what it keeps removes most rows where
    there are many edges, and few edges are ever shuffled. What is left goes on in rounds.
    """
    left = edges.select("p", "c")
    kind, out, n = dict(left.dtypes)["c"], None, left.count()
    finish = lambda df: df.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(_finish, f"node {kind}")
    if n > SMALL:
        ends = left.groupBy("c").agg(F.count("*").alias("n"))
        ends = materialize(O.order_rank(ends, F.col("c"), name="__r"), "greedy-nodes")
        end = _prefix(ends, SMALL)
        if end is not None:
            inside = materialize(finish(left.where(F.col("c") <= F.lit(end))), "greedy-prefix")
            early = left.where(F.col("p") <= F.lit(end)).where(F.col("c") > F.lit(end))
            kept = early.select("p").distinct().join(inside, F.col("p") == F.col("node"), "left_anti")
            # all kept rows of the prefix, found where they have later neighbours
            gone = materialize(early.join(materialize(kept, "greedy-kept"), "p", "left_semi").select(F.col("c").alias("node")).distinct(), "greedy-removed")
            out = inside.unionByName(gone)
            later = left.where(F.col("p") > F.lit(end))
            stay = later.select("p").distinct().unionByName(later.select(F.col("c").alias("p"))).distinct().join(gone, F.col("p") == F.col("node"), "left_anti")
            stay = materialize(stay, "greedy-stay")
            left = later.join(stay, "p", "left_semi").join(stay.withColumnRenamed("p", "c"), "c", "left_semi")
        left = materialize(left.select("p", "c").distinct(), "greedy-edges")
    while True:
        n = left.count()
        if n <= SMALL:
            last = finish(left)
            return last if out is None else out.unionByName(last)
        free = left.select(F.col("p").alias("free")).distinct().join(left.select(F.col("c").alias("free")).distinct(), "free", "left_anti")
        gone = materialize(left.join(free, F.col("p") == F.col("free"), "left_semi").select(F.col("c").alias("node")).distinct(), "greedy-removed")
        out = gone if out is None else out.unionByName(gone)
        left = left.join(free, F.col("p") == F.col("free"), "left_anti")
        left = left.join(gone, F.col("c") == F.col("node"), "left_anti").join(gone, F.col("p") == F.col("node"), "left_anti")
        left = materialize(left, "greedy-edges")


#: A bucket with more than a HUBS-th of all entries is a hub; so there are HUBS of them at most.
HUBS = 1000


def with_least(entries: DataFrame, value: str, name: str) -> DataFrame:
    """entries (bucket, id, ...) with the least value of their bucket. Entries of hub buckets stay where they are: only the
    hubs' least values, HUBS rows at most, are sent to them."""
    low = entries.groupBy("bucket").agg(F.min(value).alias(name), F.count("*").alias("__n"))
    low = materialize(low, "buckets")
    total = low.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hub = F.col("__n") * HUBS > F.lit(total)
    hubs, few = F.broadcast(low.where(hub).drop("__n")), low.where(~hub).drop("__n")
    return entries.join(hubs, "bucket").unionByName(entries.join(hubs, "bucket", "left_anti").join(few, "bucket"))


def _finish_buckets(pdf):
    """The kept rows of a small remainder of entries, by one pass in id order."""
    import pandas as pd

    taken, kept = set(), []
    for i, held in pdf.sort_values("id").groupby("id", sort=True)["bucket"]:
        if taken.isdisjoint(held):
            kept.append(i)
            taken.update(held)
    return pd.DataFrame({"id": pd.Series(kept, dtype=pdf["id"].dtype)})


def kept_in_buckets(entries: DataFrame) -> DataFrame:
    """(id) of the greedy kept set, for distinct entries (bucket, id): rows that share a bucket resemble each other.

    A row that is the least undecided one in all its buckets is kept, and the other rows of these buckets go. A bucket holds
    one kept row at most.
    """
    left, kind, out = entries.select("bucket", "id"), dict(entries.dtypes)["id"], None
    while True:
        if left.count() <= SMALL:
            last = left.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(_finish_buckets, f"id {kind}")
            return last if out is None else out.unionByName(last)
        ranked = materialize(with_least(left, "id", "least"), "bucket-entries")
        behind = ranked.where("id <> least").select("id").distinct()
        free = materialize(ranked.select("id").distinct().join(behind, "id", "left_anti"), "bucket-kept")
        out = free if out is None else out.unionByName(free)
        # a bucket is closed once its least row is kept; its rows go from all their buckets
        closed = ranked.join(free.withColumnRenamed("id", "least"), "least", "left_semi").select("id").distinct()
        left = materialize(ranked.join(closed, "id", "left_anti").select("bucket", "id"), "bucket-left")
