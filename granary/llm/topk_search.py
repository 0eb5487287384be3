"""Exact top-k inner-product search with a KD-tree for each shard.

Vectors become integers, floor(1024 x), so scores are exact. A shard holds up to SHARD vectors in a KD-tree: median
splits on the widest component, each node with its tight bounding box. A query visits nodes best-first by the largest
inner product that its box allows, and stops at the first node that can't reach its k-th score so far. That score is
propagated from shard to shard within a task, so later shards open fewer leaves. Each tree is built once and written to
the shared folder. Shards come in groups of GROUP and queries in blocks of BLOCK: a task takes one block through one
group's trees, one tree at a time, whatever the size of either table.

Edge cases. A vector that is null or has a null or non-finite component takes no part. Vectors of unequal length count
as padded with zeros. Ties go to the smaller id. A query row isn't its own candidate; other rows are, whatever their ids,
and each row of a repeated id is a query of its own. Rows with null ids take no part. Components are at most 2**31 after scaling, else
an error is raised, for scores are 64-bit integers. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, table
from .tokens import rows

SCALE, SHARD, LEAF, BLOCK, GROUP = 1024, 4096, 128, 1024, 4


class Tree:
    """Median splits with tight boxes, down to LEAF vectors. rows: numbers that tell rows of one id apart."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None):
        rows = ids if rows is None else rows
        self.vectors = vectors
        self.low, self.high, self.kids, self.span = [], [], [], []
        order = np.arange(len(ids))
        self._grow(order, 0, len(ids))
        self.vectors, self.ids, self.rows = vectors[order], ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, order: np.ndarray, a: int, b: int) -> int:
        at, part = len(self.span), self.vectors[order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.span.append((a, b))
        width = high - low
        if b - a > LEAF and width.any():
            axis, mid = int(width.argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            self.kids[at] = (self._grow(order, a, a + mid), self._grow(order, a + mid, b))
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Add to best, a heap of (score, -id) of at most k entries. best's smallest score is the propagated bound."""
        todo = [(-bound[0], 0)]
        while todo:
            top, node = heapq.heappop(todo)
            if len(best) == k and -top < best[0][0]:
                return
            if self.kids[node]:
                for kid in self.kids[node]:
                    if len(best) < k or bound[kid] >= best[0][0]:
                        heapq.heappush(todo, (-bound[kid], kid))
                continue
            a, b = self.span[node]
            scores = self.vectors[a:b] @ query
            near = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(b - a)
            for i in near:
                if self.rows[a + i] == own:
                    continue
                item = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As floats while all sums are exact in them, which is faster; else as integers."""
    most = (np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if max(map(int, most)) > 1 << 31:
        raise ValueError("a component is too large for 64-bit scores")
    if int(most[0]) * int(most[1]) * max(1, a.shape[1]) < 1 << 53:
        return a.astype(np.float64), b.astype(np.float64)
    return a, b


def _arrays(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, ids and row numbers of a part."""
    m = np.zeros((len(pdf), max((len(v) for v in pdf["v"]), default=0)), dtype=np.int64)
    for k, v in enumerate(pdf["v"]):
        m[k, : len(v)] = v
    return m, pdf["id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64)


def _tree(pdf):
    """A shard as one row: its tree."""
    import pandas as pd

    return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [pickle.dumps(Tree(*_arrays(pdf)))]})


def _block(pdf):
    """A block of queries as one row."""
    import pandas as pd

    return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [pickle.dumps(_arrays(pdf))]})


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def _valid(v: Column) -> Column:
    x = v.cast("array<double>")
    return v.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


def top_k(
    df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    shard: int = SHARD, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of df that is_query selects, against all rows."""
    ident, vec = F.col(f"`{id_col}`"), F.col(f"`{vec_col}`")
    v = F.transform(vec.cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))
    usable = df.where(_valid(vec) & ident.isNotNull())
    base = usable.select(ident.cast("long").alias("id"), v.alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row"))
    base = materialize(base, "vectors")
    n, nq = base.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-nq // block))
    groups = max(1, -(-shards // group))
    spread = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")
    packed = lambda rows_, parts, f: rows_.select("id", "v", "row", spread(parts)).groupBy("part").applyInPandas(f, "part int, data binary")
    trees = materialize(packed(base, shards, _tree), "trees")
    asked = materialize(packed(base.where("q"), blocks, _block), "queries")
    # every block of queries meets every group of shards: both sides go to the task of the two
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    trees = trees.select((F.col("part") % groups).alias("group"), F.col("part").alias("shard"), F.col("data").alias("tree")).withColumn("block", every(blocks))
    asked = asked.select(F.col("part").alias("block"), F.col("data").alias("asked")).withColumn("group", every(groups))
    met = trees.join(asked, ["block", "group"]).sortWithinPartitions("block", "group", "shard")

    def run(batches):
        import pyarrow as pa

        now, best, queries, ids, own = None, [], None, None, None

        def done():
            found = [(int(own[j]), int(ids[j]), -i, s) for j, heap in enumerate(best) for s, i in heap]
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], ["row", "query_id", "vec_id", "score"])

        for block_, group_, data, asks in rows(batches, "block", "group", "tree", "asked"):
            if (block_, group_) != now:
                if now is not None:
                    yield done()
                queries, ids, own = pickle.loads(asks)
                now, best = (block_, group_), [[] for _ in own]
            tree = pickle.loads(data)
            width = max(tree.vectors.shape[1], queries.shape[1])
            tree.low, tree.high = _wide(tree.low, width), _wide(tree.high, width)
            tree.vectors, asking = _exact(_wide(tree.vectors, width), _wide(queries, width))
            for at in range(0, len(own), 256):
                bound = tree.bounds(asking[at : at + 256])
                for j in range(at, min(at + 256, len(own))):
                    tree.search(asking[j], own[j], bound[j - at], k, best[j])
        if now is not None:
            yield done()

    found = met.select("block", "group", "tree", "asked").mapInArrow(run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
with v as materialized (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.row, q.vec_id as query_id, c.vec_id,
         list_inner_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.row <> c.row),
r as (
  select *, row_number() over (partition by row order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
