"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: A node with more than this part of all links is a hub; so there are at most 4 * HUBS of them.
HUBS = 1000
#: Links that one task may finish; the number is counted before.
SMALL = 200_000


def _with_least(links: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """links (u, v) with m, the smallest v of their u; and a row (u, m) for each u. A hub's links stay where they are: only
    the hubs' minima, at most 4 * HUBS rows, are broadcast. total: the links, of which links holds each twice at most."""
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > total / HUBS / 2
    hubs, few = F.broadcast(low.where(hub).select("u", "m")), low.where(~hub).select("u", "m")
    return links.join(hubs, "u").unionByName(links.join(hubs, "u", "left_anti").join(few, "u")), low.select("u", "m")


def _finish(pdf):
    """The components of a few links, by a union-find whose roots are the smallest nodes."""
    import pandas as pd

    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
        a, b = find(up.setdefault(a, a)), find(up.setdefault(b, b))
        up[max(a, b)] = min(a, b)
    nodes = list(up)
    kind = pdf["u"].dtype
    return pd.DataFrame({"node": pd.Series(nodes, dtype=kind), "root": pd.Series([find(x) for x in nodes], dtype=kind)})


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of the nodes with edges (a, b) to others, root the component's smallest node.

    Large-star and small-star steps in turn (Kiveris et al., SoCC 2014), until links change no more, or are so few (SMALL) that
    one task can finish them. A round moves as many rows as there are edges, writes them to the shared folder, and gathers
    no component.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    count, mark = _mark(links)
    for _ in range(most):
        if count <= SMALL:
            kind = dict(links.dtypes)["u"]
            return links.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(_finish, f"node {kind}, root {kind}")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, _ = _with_least(both, count)
        large = materialize(met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large-star")
        met, low = _with_least(large, large.count())
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        links = materialize(small, "small-star")
        before, (count, mark) = (count, mark), _mark(links)
        if before == (count, mark):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")


def _mark(links: DataFrame) -> tuple[int, int]:
    """The number of links, and a digest that tells whether they are the same as before."""
    n, mark = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0).cast("long"))).first()
    return n, mark
