"""Helpers shared by the text operators: shared storage, row ids, hash folds, graph components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh, materialize, shared_dir

__all__ = ["ASCII_SPACE", "components", "fold", "fresh", "materialize", "prepare", "shared_dir", "table", "with_row"]

#: The six ASCII white-space characters, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = str(Path(__file__).resolve().parents[2])
#: A node with more than this part of all links is a hub; so there are at most 4 * HUBS of them.
HUBS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver was started elsewhere; hand them smaller batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [_ROOT, *paths] if p)
    if int(spark.conf.get(_BATCH)) == 10_000:  # the default: texts are long, and a batch is held whole
        spark.conf.set(_BATCH, "2000")
    return spark


def with_row(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df, written once, with a column that is unique for each row; and that column's name."""
    row = fresh(df, "row_id")
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), label), row


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _stars(links: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """links (u, v) with m, the smallest v of their u; and low, a row (u, m) for each u.

    The links of hubs stay where they are: only the hubs' minima, at most 4 * HUBS rows, are broadcast to them. total: the
    number of links, of which links holds each twice at most.
    """
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > total / HUBS / 2
    hubs, few = F.broadcast(low.where(hub).select("u", "m")), low.where(~hub).select("u", "m")
    met = links.join(hubs, "u").unionByName(links.join(hubs, "u", "left_anti").join(few, "u"))
    return met, low.select("u", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the component's smallest node.

    Alternates large-star and small-star contraction (Kiveris et al., SoCC 2014). Every round is a
    grouped minimum and a join; the state is written to the shared folder, never collected. A round
    moves O(edges) rows, and a hub's minimum goes to its links, so no group is gathered in a task.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        # large star: every larger neighbour of u links to the smallest of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, _ = _stars(both, e.count())
        large = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large-star")
        # small star: u and its smaller neighbours link to the smallest of them
        joined, low = _stars(large, large.count())
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        ).distinct()
        new = materialize(small, "small-star")
        change = new.exceptAll(e).limit(1).count() + e.exceptAll(new).limit(1).count()
        e = new
        if not change:
            break
    else:
        raise RuntimeError("the component search did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
