"""A training-corpus pipeline over the documents table.

Toxic documents go, exact copies go, one document of each near-duplicate group stays, sources are mixed to target
weights, and what is left is packed into sequences. Each stage works on all that its predecessor kept, as Parquet.

A stage begins by deleting the intermediate tables of the stage that ran before it, so a stage's result must be written
before the next stage is called: run() does so, and so must whoever calls stages one by one.

Edge cases, of all stages. An empty table gives an empty result. Columns beside doc_id, text and source are carried along,
whatever their names. Null ids and repeated rows are rows like others; each stage says below what it does with them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from granary.llm import exact_dedup, mixing, packing, simhash, toxicity
from granary.llm.common import materialize, prepare, table
from granary.storage import discard, recorded

#: Tables that the latest stage of an application has left in the shared folder.
_LEFT: dict[str, list[str]] = {}


def _stage(f: Callable) -> Callable:
    """A stage begins by deleting what the one before left: its result has been written since, so nothing reads that."""

    @wraps(f)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        discard(spark, _LEFT.pop(spark.sparkContext.applicationId, []))
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = made
        return out

    return step


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. Null and blank texts have no features and stay; null ids can't be
    labelled and are scored like others."""
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies: the longest, then the smallest id, null ids last. Null and blank texts are
    one group; of rows repeated in all columns one stays."""
    return exact_dedup.keep_first(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are alike by 0.8 or more: the smallest id, null ids last.
    A text of fewer words is one shingle; blank texts are one group."""
    return simhash.keep_one(docs)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most. Texts without words are taken no time; null sources are
    one source."""
    return mixing.mix(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: each piece's ids (little-endian unsigned 32-bit numbers) and where they lie. Null and
    blank texts hold the end id."""
    return packing.pack(docs, with_ids=True)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]
#: Stages hold a fitted classifier and a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
