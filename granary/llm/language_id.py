"""Language identification by rank-order n-gram profiles (Cavnar & Trenkle, 1994).

A profile is a language's PROFILE most frequent n-grams of one to three letters, words padded by a blank. A document's
own most frequent n-grams are compared to each profile by the out-of-place distance: the sum of rank differences,
PROFILE for an n-gram that the profile lacks. The nearest profile names the language.

Profiles come from labelled rows, about SAMPLE for each language (all, if fewer), taken by hash; they are a fixed number of n-grams
for each language. Whole texts are counted.

Edge cases. Null text and text without a letter: und, score 0. Letters are lower-cased; all else separates words. Equal
counts rank by n-gram, equal distances by language name. Without labelled rows all is und; over LANGUAGES labels are an error. Repeated rows get a row each.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fold, table
from .tokens import rows

PROFILE, ORDERS, SAMPLE = 300, (1, 2, 3), 2000
LANGUAGES = 10_000
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    t = (text or "").lower()
    return t.split() if t.isalpha() else "".join([c if c.isalpha() else " " for c in t]).split()


def ngrams(word: str) -> list[str]:
    w = f" {word} "
    return [g for n in ORDERS for k in range(len(w) - n + 1) if (g := w[k : k + n]) != " "]


def ranked(counts: dict[str, int], most: int = PROFILE) -> list[str]:
    """The most frequent n-grams, equal counts by n-gram."""
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


class Letters:
    """Cuts texts into words: a translation table of the characters seen, so that letters are looked up once."""

    def __init__(self):
        self.table: dict[int, str | int] = {}

    def __call__(self, text: str | None) -> list[str]:
        t = (text or "").lower()
        for c in set(t):
            if ord(c) not in self.table:
                self.table[ord(c)] = ord(c) if c.isalpha() else " "
        return t.translate(self.table).split()


class Grams:
    """Counts of a text's n-grams from its code points: letters get dense numbers, up to three of which make a code."""

    def __init__(self):
        self.cut, self.number = Letters(), np.full(0x110000, -1, dtype=np.int32)
        self.letters: list[str] = []

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the n-grams of the text's words, each padded by a blank on either side."""
        words = self.cut(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # neighbouring words share a blank: no n-gram but a trigram around a blank crosses from one to the next
        points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype=np.uint32)
        d = self.number[points]
        if (d < 0).any():
            for c in np.unique(points[d < 0]).tolist():
                self.letters.append(chr(c))
                self.number[c] = len(self.letters)
            d = self.number[points]
        d, inner = d.astype(np.int64), points != 32
        two = d[:-1] << 21 | d[1:]
        three = (two[:-1] << 21 | d[2:])[inner[1:-1]]
        return np.unique(np.concatenate([d[inner], two, three]), return_counts=True)

    def name(self, code: int) -> str:
        out = ""
        while code:
            out = self.letters[(code & 0x1FFFFF) - 1] + out
            code >>= 21
        return out

    def top(self, text: str | None, most: int = PROFILE) -> list[str]:
        codes, n = self.counts(text)
        if len(codes) > most:
            least = -np.partition(-n, most - 1)[most - 1]
            codes, n = codes[n >= least], n[n >= least]
        return ranked({self.name(i): c for i, c in zip(codes.tolist(), n.tolist())}, most)


def profiles(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, dict[str, int]]:
    """For each language its n-grams' ranks, from df's labelled rows."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.lit(3), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("at"), F.col(text_col).alias("text")
    )
    # a hash threshold for each language: all its rows, or a share that comes to SAMPLE on average
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = sizes.select("lang", F.when(F.col("n") > SAMPLE, SAMPLE / F.col("n")).otherwise(1.0).alias("share"))
    if share.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    picked = known.join(F.broadcast(share), "lang").where(F.shiftrightunsigned("at", 11) < F.col("share") * float(1 << 53))

    def run(batches):
        import pyarrow as pa

        total: dict[str, Counter] = {}
        grams = Grams()
        for lang, text in rows(batches, "lang", "text"):
            ids, n = grams.counts(text)
            mine = total.setdefault(lang, Counter())
            for i, c in zip(ids.tolist(), n.tolist()):
                mine[grams.name(i)] += c
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    counts = picked.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    got: dict[str, dict[str, int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).collect():  # PROFILE rows a language
        got.setdefault(r.lang, {})[r.gram] = r.rank - 1
    return dict(sorted(got.items()))


def nearest(top: list[str], known: dict[str, dict[str, int]]) -> tuple[str, float]:
    """The language of the smallest out-of-place distance; the score is how far below the greatest possible it lies."""
    if not top or not known:
        return UNKNOWN, 0.0
    distance = {lang: sum(abs(k - ranks[g]) if g in ranks else PROFILE for k, g in enumerate(top)) for lang, ranks in known.items()}
    best = min(distance, key=lambda x: (distance[x], x))
    return best, 1 - distance[best] / (PROFILE * len(top))


class Comparer:
    """nearest() for many documents: ranks of all profiles for an n-gram come as one row."""

    def __init__(self, known: dict[str, dict[str, int]]):
        self.langs = sorted(known)
        grams = sorted({g for ranks in known.values() for g in ranks})
        self.row = {g: k for k, g in enumerate(grams)}
        self.ranks = np.array([[known[x].get(g, -1) for x in self.langs] for g in grams] + [[-1] * len(self.langs)], dtype=np.int64)

    def __call__(self, top: list[str]) -> tuple[str, float]:
        if not top or not self.langs:
            return UNKNOWN, 0.0
        ranks = self.ranks[[self.row.get(g, -1) for g in top]]
        distance = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        k = int(distance.argmin())
        return self.langs[k], 1 - int(distance[k]) / (PROFILE * len(top))


def identify(df: DataFrame, known: dict[str, dict[str, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of df."""

    def run(batches):
        import pyarrow as pa

        grams, near, ids, langs, scores = Grams(), Comparer(known), [], [], []
        for doc_id, text in rows(batches, "doc_id", "text"):
            lang, score = near(grams.top(text))
            ids.append(doc_id)
            langs.append(lang)
            scores.append(score)
            if len(ids) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])
                ids, langs, scores = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    light = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return light.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, profiles(docs.where(fold("doc_id", 3) != 1)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
