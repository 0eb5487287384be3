"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., NeurIPS 2017).

Confirmed toxic documents are the positives; every other text is unlabelled, whatever its label. Small numpy networks
without a hidden layer minimise the class-prior-corrected risk
    prior * R+(positives)  +  max(0, R-(unlabelled) - prior * R-(positives)),
stepping back along the second term where it falls below zero. The prior is the share of toxic rows among the labelled
ones. Several classifiers, each with unlabelled texts of its own, are averaged.

A text's features are its distinct hashed words and their first PREFIX letters, each 1 / sqrt(their number), so a score
is a sum over the whole text. The bias is set so that the prior's share of the unlabelled texts scores 0.5 or more. Only
hashed features of a bounded sample reach the driver: POSITIVES and UNLABELLED rows at most, taken by hash. A fitted
classifier is an array of fixed size, which the scoring tasks receive.

Edge cases. Null, empty or blank text has no features and gets the bias alone. Null labels mean unlabelled; null ids
count as empty text in the fold. A document with several labels is toxic if one says so. Without any toxic row every
score is the prior. Repeated rows are scored one by one; of rows with one id one text is learnt from. An empty table
gives an empty result. Ids may have any sortable type.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fresh, materialize, table
from .tokens import rows

DIM, PREFIX = 1 << 18, 4
POSITIVES, UNLABELLED, MEMBERS = 4000, 12000, 3
MEMO = 1 << 16
CHANCE = 3.0  # standard deviations
EDGES = ".,;:!?|%&*#$()[]{}<>\"'-_/\\"


class Features:
    """Ids of a text's features, with a bounded table of words."""

    def __init__(self, limit: int = MEMO):
        self.known, self.limit = {}, limit

    def _ids(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            w = word.strip(EDGES)
            got = zlib.crc32(w.encode()) % DIM, zlib.crc32(b"^" + w[:PREFIX].encode()) % DIM
            if len(self.known) < self.limit:
                self.known[word] = got
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        ids = {i for w in set((text or "").lower().split()) for i in self._ids(w)}
        return np.fromiter(ids, np.int32, len(ids))


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, seed: int, epochs: int = 24, parts: int = 8, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights of a classifier and, last, its bias: Adam on the non-negative risk, with logistic loss."""
    rng, least = np.random.default_rng(seed), max(3, (len(pos) + len(unl)) // 700)
    # features that are common enough, and whose share among positives is no chance
    dp, du = (np.bincount(np.concatenate(x), minlength=DIM) for x in (pos, unl))
    share = (dp + du + 1) / (len(pos) + len(unl) + 2)
    used = (dp + du >= least) & (np.abs(dp - len(pos) * share) >= CHANCE * np.sqrt(len(pos) * share * (1 - share)))
    small = np.cumsum(used) - 1
    cut = lambda docs: [(small[i[used[i]]], 1 / np.sqrt(max(1, len(i)))) for i in docs]
    pos, unl = cut(pos), cut(unl)
    w = np.zeros(int(used.sum()) + 1)  # the bias last
    m1, m2, step = np.zeros_like(w), np.zeros_like(w), 0

    def stack(docs):
        n = [len(i) for i, _ in docs]
        return np.repeat(np.arange(len(docs)), n), np.concatenate([i for i, _ in docs]), np.repeat([v for _, v in docs], n)

    for _ in range(epochs):
        for pi, ui in zip(np.array_split(rng.permutation(len(pos)), parts), np.array_split(rng.permutation(len(unl)), parts)):
            if not len(pi) or not len(ui):
                continue
            (pa, pj, pv), (ua, uj, uv) = stack([pos[k] for k in pi]), stack([unl[k] for k in ui])
            sp = 1 / (1 + np.exp(-np.bincount(pa, pv * w[pj], minlength=len(pi)) - w[-1]))
            su = 1 / (1 + np.exp(-np.bincount(ua, uv * w[uj], minlength=len(ui)) - w[-1]))
            risk = prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean() - np.log1p(-np.minimum(su, 1 - 1e-9)).mean()
            if risk < 0:  # less than no risk: step back along this part alone
                gp, gu = prior * sp / len(pi), -su / len(ui)
            else:  # R+ has gradient s - 1, and R- of the positives takes s away again
                gp, gu = np.full(len(pi), -prior / len(pi)), su / len(ui)
            g = np.bincount(pj, pv * gp[pa], minlength=len(w)) + np.bincount(uj, uv * gu[ua], minlength=len(w)) + decay * w
            g[-1] = gp.sum() + gu.sum()
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w = w - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(DIM + 1)
    full[:DIM][used] = w[:-1]
    full[-1] = -_cut(np.array([v * w[i].sum() for i, v in unl]), prior)
    return full


def _cut(scores: np.ndarray, prior: float) -> float:
    """The score that about the prior's share reaches. Equal scores fall on one side: on the lower, if they are too many."""
    up, k = np.sort(scores)[::-1], int(round(prior * len(scores)))
    if k and np.count_nonzero(up >= up[k - 1]) <= 1.5 * k + 1:
        lower = up[up < up[k - 1]]
        return float(up[k - 1] + lower[0]) / 2 if len(lower) else float(up[k - 1])
    above = up[up > up[max(k - 1, 0)]]
    return float(above[-1] + up[max(k - 1, 0)]) / 2 if len(above) else float(up[0]) + 0.5


def learn(df: DataFrame, toxic: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 1) -> np.ndarray:
    """The averaged classifiers of df's rows, of which toxic labels some."""
    known = toxic.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    share = df.select(F.col(id_col).alias("id")).join(known, "id").agg(F.avg("y")).first()[0] or 0.0
    prior = min(0.5, max(1e-3, share))
    at = F.xxhash64(F.lit(seed), F.col(id_col))
    light = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), at.alias("at"))
    # both samples are the rows of the smallest hashes; ids are drawn before texts are read
    ids = light.select("id", "at").join(known, "id", "left")
    positive = ids.where("y = 1").orderBy("at", "id").limit(POSITIVES).select("id", F.lit(1).alias("s"))
    other = ids.orderBy("at", "id").limit(UNLABELLED).select("id", F.lit(0).alias("s"))
    chosen = materialize(positive.unionByName(other).distinct(), "toxic-sample")
    # however often an id is repeated, one text of it is sampled: POSITIVES + UNLABELLED rows at most
    picked = light.join(F.broadcast(chosen), "id").groupBy("id", "s").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        features = Features()
        for s, text in rows(batches, "s", "text"):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([features(text).tobytes()], pa.binary())], ["s", "f"])

    sample = materialize(picked.select("s", "text").mapInArrow(run, "s int, f binary"), "toxic-features")
    got = [(r.s, np.frombuffer(r.f, np.int32)) for r in sample.collect()]
    pos, unl = ([f for k, f in sorted(got, key=lambda x: x[1].tobytes()) if k == s] for s in (1, 0))
    if not pos or not unl:
        return np.append(np.zeros(DIM), np.log(prior / (1 - prior)))
    return np.mean([fit(pos, unl[k::MEMBERS] if len(unl) > 50 * MEMBERS else unl, prior, seed + k) for k in range(MEMBERS)], axis=0)


def score(df: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """df with a column score, or _score where it has one: 0 to 1, over the whole text."""
    spark, name, cols = df.sparkSession, fresh(df, "score"), df.columns
    sent = spark.sparkContext.broadcast(model.astype(np.float32))  # DIM + 1 numbers

    def run(batches):
        import pyarrow as pa

        model, features = sent.value, Features()
        for batch in batches:
            out = []
            at = batch.schema.names.index(text_col)
            for a in range(0, batch.num_rows, 256):
                for text in batch.column(at).slice(a, 256).to_pylist():
                    ids = features(text)
                    f = model[ids].sum(dtype=np.float64) / np.sqrt(max(1, len(ids))) + model[-1]
                    out.append(float(1 / (1 + np.exp(-np.clip(f, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*cols, name])

    from pyspark.sql.types import DoubleType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, DoubleType()))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without the texts that score limit or more; columns unchanged, whatever their names.

    Null, empty and blank texts score as the bias alone does, below the limit; null ids and repeated rows are scored row by row.
    """
    known = docs.where(fold("doc_id", 5) != 0)
    scored = score(docs, learn(known, labels))
    return scored.where(F.col(scored.columns[-1]) < limit).drop(scored.columns[-1])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = fold("doc_id", 5) != 0
    model = learn(docs.where(train), labels.where(train))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
