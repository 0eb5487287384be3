"""Quality by importance resampling (DSIR; Xie et al., NeurIPS 2023).

Texts are bags of hashed word unigrams and bigrams. Two bag-of-buckets models, of target text and of raw text, give each
document the log ratio of its probabilities under them; a document's key is that log weight plus Gumbel noise from its
id's hash, and the top k keys are a sample without replacement in proportion to the weights.

Target text is what labels call good; raw text is everything. Both models count all rows. log_ratio is the documents' log
ratio as the models give it. Of a text of hundreds of features it outweighs any Gumbel noise, so that the draw would be a
cut by length. log_weight, which the draw uses, is therefore its mean for a feature times a length of at most TEMPER
features (None: log_ratio itself); whole texts are counted.

Edge cases. Null, empty or blank text has log weight 0 and competes by noise alone. Null ids hash as empty text; equal
keys go by id, so repeated rows are drawn together as far as k allows. Without target rows all log weights are 0. An
empty table gives an empty result. Ids may have any sortable type.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import rows

BUCKETS, SMOOTH, TEMPER, KEEP = 1 << 16, 1.0, 16, 0.85
MEMO = 1 << 17


class Bags:
    """Hashed unigrams and bigrams of a text; a bounded table of word hashes."""

    def __init__(self, limit: int = MEMO):
        self.known, self.limit = {}, limit

    def _word(self, w: str) -> int:
        got = self.known.get(w)
        if got is None:
            got = zlib.crc32(w.encode())
            if len(self.known) < self.limit:
                self.known[w] = got
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        h = np.fromiter(map(self._word, words), np.uint64, len(words))
        pair = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        return np.concatenate([h, pair]).astype(np.int64) % BUCKETS if len(h) else np.zeros(0, np.int64)


def bucket_counts(df: DataFrame, text_col: str, flag_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all rows' features, and of the rows that flag_col marks: BUCKETS numbers each."""

    def run(batches):
        import pyarrow as pa

        bags, raw, target = Bags(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for text, flag in rows(batches, "text", "flag"):
            n = np.bincount(bags(text), minlength=BUCKETS)
            raw += n
            if flag:
                target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], ["bucket", "raw", "target"])

    counted = df.select(F.col(text_col).alias("text"), F.col(flag_col).alias("flag")).mapInArrow(run, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    p = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS))
    return p(target) - p(raw)


def resample(
    df: DataFrame, good: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, temper: int | None = TEMPER
) -> DataFrame:
    """doc_id, log_ratio, log_weight, gumbel_key, selected for each row of df; good: ids of target rows. keep: the share drawn."""
    from pyspark.sql.pandas.types import to_arrow_type

    marks = good.select(F.col(f"`{id_col}`").alias("id")).distinct().withColumn("good", F.lit(True))
    ids = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # marked ids grow with the corpus: a merge at every size, never a broadcast
    flagged = ids.join(marks.hint("merge"), "id", "left").withColumn("flag", F.coalesce("good", F.lit(False)))
    ratio = log_ratio(*bucket_counts(flagged, "text", "flag"))
    sent = df.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))  # BUCKETS numbers
    kind = ids.schema[0].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches):
        import pyarrow as pa
        import xxhash

        bags, table_ = Bags(), sent.value
        for batch in batches:
            found, out = [], []
            for doc_id, text in rows([batch], "id", "text"):
                f = bags(text)
                whole = float(table_[f].sum(dtype=np.float64))
                w = whole * (min(1.0, temper / max(1, len(f))) if temper else 1.0)
                u = (xxhash.xxh64_intdigest("" if doc_id is None else str(doc_id), seed) + 0.5) / 2**64
                found.append(doc_id)
                out.append((whole, w, w - float(np.log(-np.log(min(u, 1 - 1e-16))))))
            cols = [pa.array(found, arrow_kind), *[pa.array([o[k] for o in out], pa.float64()) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "log_ratio", "log_weight", "gumbel_key"])

    keyed = materialize(ids.mapInArrow(run, f"doc_id {kind.simpleString()}, log_ratio double, log_weight double, gumbel_key double"), "gumbel-keys")
    n = keyed.count()
    return top_share(keyed, -(-int(n * keep * 1000) // 1000) if n else 0)


def top_share(keyed: DataFrame, k: int) -> DataFrame:
    """keyed with a column selected: the k greatest keys, equal keys by id. Exact, by range-sorted parts and their sizes."""
    order = (F.desc("gumbel_key"), F.asc_nulls_last("doc_id"))
    parts = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(parts.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "gumbel-order")
    sizes, before, at = parts.groupBy("part").count().orderBy("part").collect(), [], 0  # a row for each partition
    for r in sizes:
        before.append((r.part, at))
        at += r["count"]
    offsets = F.broadcast(keyed.sparkSession.createDataFrame(before, "part int, before long"))
    return parts.join(offsets, "part").select("doc_id", "log_ratio", "log_weight", "gumbel_key", (F.col("before") + F.col("nth") < k).alias("selected"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return resample(table(spark, sf_dir, "documents"), good)
