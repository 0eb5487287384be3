"""Redundancy reduction: eight strategies, each an edge builder and a rule for the representative.

Every strategy takes rows in id order, keeps a row unless an earlier kept row resembles it, and maps each removed row to
one kept row. Ties go to the smaller id. Null ids or sequences are refused; so are repeated ids. Two strategies take null and
blank sequences where they are told to (allow_blank).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import neighbours as N
from ..functions import ordering as O
from ..functions import sequences as S
from ..functions import vectors as V
from ..roles import Columns
from ..storage import materialize, spread
from .greedy import kept_in_buckets, removed_rows, with_least

#: Parameters that place work on one machine; they are accepted for compatibility and warned about.
PLACEMENT = ("use_faiss", "n_jobs", "dtype", "cluster_mode", "threads", "tmp_root", "keep_tmp", "mmseqs_bin", "work_dir", "keep_work")
MAPPING = "removed_id string, representative_id string, cluster_id string, score double"


@dataclass
class ReductionResult:
    kept: DataFrame
    mapping: DataFrame
    strategy: str
    params: dict[str, Any]
    source: DataFrame = field(repr=False)

    def stats(self) -> dict[str, Any]:
        """Counts, computed when asked for."""
        total, kept = self.source.count(), self.kept.count()
        return {"n_total": total, "n_kept": kept, "n_removed": total - kept, "reduction_ratio": kept / total if total else 0.0}


def check_ids(df: DataFrame, id_col: str) -> None:
    if id_col not in df.columns:
        raise ValueError(f"no id column {id_col!r}")
    as_text = F.col(f"`{id_col}`").cast("string")
    n, distinct = df.agg(F.count("*"), F.count_distinct(as_text)).first()
    if n != distinct:
        raise ValueError(f"ids in {id_col!r} are null or not unique as text: {n} rows, {distinct} distinct ids")


def _between(name: str, value: float, low: float = 0.0, high: float = 1.0) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low:g} to {high:g}, not {value}")


def _at_least(name: str, value: float, low: float) -> None:
    if value < low:
        raise ValueError(f"{name} must be at least {low:g}, not {value}")


#: Which of several alike rows is kept, and the column that it looks at where none is named.
POLICIES = ("smallest_id", "longest_sequence", "best_quality", "earliest_time", "greatest_label")


@dataclass
class Reducer:
    """keep: the order in which rows are taken, hence which of several alike rows stays. All ties go to the smaller id.

    smallest_id; longest_sequence (of cols.sequence, or keep_col); best_quality (the greatest keep_col, "quality" unless
    given); earliest_time (keep_col or cols.date); greatest_label (keep_col or cols.label). Rows without a value come last.
    """

    keep: str = field(default="smallest_id", kw_only=True)
    keep_col: str | None = field(default=None, kw_only=True)
    name: ClassVar[str]
    prefix: ClassVar[str]
    cluster_column: ClassVar[str]

    def params(self) -> dict[str, Any]:
        return {f.name: v for f in fields(self) if not isinstance(v := getattr(self, f.name), DataFrame)}

    def validate(self) -> None:
        pass

    def run(self, df: DataFrame, cols: Columns | None = None) -> ReductionResult:
        cols = cols or Columns()
        self.validate()
        if idle := [f.name for f in fields(self) if f.name in PLACEMENT and getattr(self, f.name) != f.default]:
            warnings.warn(f"{self.name}: {idle} have no effect, the plan decides how work is spread", stacklevel=2)
        if clash := [c for c in df.columns if c.startswith("__")]:
            raise ValueError(f"the dataset has columns {clash}, whose names are taken here")
        check_ids(df, cols.id)
        if self.keep not in POLICIES:
            raise ValueError(f"keep must be one of {', '.join(POLICIES)}, not {self.keep!r}")
        if self.keep == "smallest_id":
            return self._result(df, cols, self.pairs(df, cols))  # removed, representative, score
        return self._result(df, cols, self._by_priority(df, cols))

    def _priority(self, df: DataFrame, cols: Columns) -> Column:
        usual = {"longest_sequence": cols.sequence, "best_quality": "quality", "earliest_time": cols.date, "greatest_label": cols.label}[self.keep]
        name = self.keep_col or usual
        if name is None or name not in df.columns:
            raise ValueError(f"{self.keep} needs a column: {name!r} isn't there")
        c = F.col(f"`{name}`")
        if self.keep == "longest_sequence":
            c = F.char_length(c.cast("string"))
        return c.asc_nulls_last() if self.keep == "earliest_time" else c.desc_nulls_last()

    def _by_priority(self, df: DataFrame, cols: Columns) -> DataFrame:
        """pairs() on rows that are named by their places in the priority order; names are put back after."""
        ident = F.col(f"`{cols.id}`")
        ranked = materialize(O.order_rank(df, self._priority(df, cols), ident, name="__rank"), "priority")
        names = ranked.select(ident.alias("__id"), "__rank")
        found = self.renamed(names).pairs(ranked, replace(cols, id="__rank"))
        of = lambda c: names.select(F.col("__rank").alias(c), F.col("__id").alias(f"{c}_id"))
        named = found.join(of("removed"), "removed").join(of("representative"), "representative")
        return named.select(F.col("removed_id").alias("removed"), F.col("representative_id").alias("representative"), "score")

    def renamed(self, names: DataFrame) -> Reducer:
        """This strategy with the ids of its own tables (__id) replaced by ranks (__rank)."""
        return self

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        raise NotImplementedError

    def own_cluster(self, df: DataFrame, cols: Columns) -> Column:
        return F.concat(F.lit(f"{self.prefix}:"), F.col(f"`{cols.id}`").cast("string"))

    def _result(self, df: DataFrame, cols: Columns, pairs: DataFrame) -> ReductionResult:
        gone = pairs.select(F.col("removed").alias("__gone"))
        kept = df.join(gone, F.col(f"`{cols.id}`") == F.col("__gone"), "left_anti").withColumn(self.cluster_column, self.own_cluster(df, cols))
        mapping = pairs.select(
            F.col("removed").cast("string").alias("removed_id"),
            F.col("representative").cast("string").alias("representative_id"),
            F.concat(F.lit(f"{self.prefix}:"), F.col("representative").cast("string")).alias("cluster_id"),
            F.col("score").cast("double").alias("score"),
        )
        return ReductionResult(kept, mapping, self.name, self.params(), df)


def resolve(edges: DataFrame, best: str = "earliest") -> DataFrame:
    """(removed, representative, score) from edges (p, c, score, shared): the kept neighbour that `best` names."""
    edges = materialize(edges, "edges")
    gone = removed_rows(edges)
    order = {"earliest": F.struct("p", "score"), "shared": F.struct((-F.col("shared")).alias("o"), "p", "score"), "score": F.struct((-F.col("score")).alias("o"), "p", "score")}[best]
    return _representatives(edges, gone, order)


def _representatives(edges: DataFrame, gone: DataFrame, order: Column) -> DataFrame:
    """(removed, representative, score) of the removed rows (node): of edges (p, c, score) with a kept p the first in order. A row
    with such an edge is a removed one."""
    gone = materialize(gone, "removed")
    kept = materialize(edges.select("p").distinct().join(gone, F.col("p") == F.col("node"), "left_anti"), "kept")
    best = edges.join(kept, "p", "left_semi").groupBy("c").agg(F.min(order).alias("b"))
    return best.select(F.col("c").alias("removed"), F.col("b.p").alias("representative"), F.col("b.score").alias("score"))


def check_sequences(df: DataFrame, seq_col: str) -> None:
    if seq_col not in df.columns:
        raise ValueError(f"no sequence column {seq_col!r}")
    s = F.col(f"`{seq_col}`").cast("string")
    bad = df.agg(F.count_if(s.isNull() | (s == "") | (F.lower(s) == "nan"))).first()[0]
    if bad:
        raise ValueError(f"{bad} sequences in {seq_col!r} are null, empty or 'nan'")


@dataclass
class Exact(Reducer):
    """Rows with the same sequence; the smallest id stays."""

    name, prefix, cluster_column = "exact", "exact", "exact_cluster_id"

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        if cols.sequence not in df.columns:
            raise ValueError(f"no sequence column {cols.sequence!r}")
        if df.agg(F.count_if(F.col(f"`{cols.sequence}`").isNull())).first()[0]:
            raise ValueError(f"null sequences in {cols.sequence!r}")
        rows = df.select(F.col(f"`{cols.id}`").alias("removed"), F.col(f"`{cols.sequence}`").alias("sequence"))
        # sequences are compared where they are grouped; their digests alone are joined back to the rows
        digest = F.sha2(F.col("sequence").cast("string"), 256).alias("h")
        first = rows.groupBy("sequence").agg(F.min("removed").alias("representative"), F.count("*").alias("n")).where("n > 1")
        met = rows.select("removed", digest).join(first.select(digest, "representative"), "h")
        return met.where("removed <> representative").select("removed", "representative", F.lit(1.0).alias("score"))


@dataclass
class _Tokens(Reducer):
    """Strategies on sequences: equal sequences are one class, named by its smallest id, and classes are compared."""

    def classes(self, df: DataFrame, cols: Columns, blank: bool = False) -> tuple[DataFrame, DataFrame]:
        """(id, cls) of all rows and (sequence, cls) of the classes. blank: null, empty and 'nan' sequences are no errors; null
        ones are one class."""
        if not blank:
            check_sequences(df, cols.sequence)
        rows = df.select(F.col(f"`{cols.id}`").alias("id"), F.col(f"`{cols.sequence}`").cast("string").alias("sequence"))
        first = materialize(rows.groupBy("sequence").agg(F.min("id").alias("cls")), "sequence-classes")
        digest = F.coalesce(F.sha2("sequence", 256), F.lit("")).alias("h")  # texts meet where they are grouped; digests go back to the rows
        return materialize(rows.select("id", digest).join(first.select(digest, "cls"), "h").select("id", "cls"), "sequence-rows"), first

    def finish(self, rows: DataFrame, links: DataFrame, alone: Column, best: str, gone: DataFrame | None = None) -> DataFrame:
        """Removed rows from links (p, c, score, shared) between classes, p < c; alone: shared of a class with itself; gone:
        the classes (node) that aren't kept, where they are known.

        A copy of an earlier row is never kept and removes nothing that its first copy doesn't. It may choose a
        representative that lies between its first copy and itself, so the choice is made for rows, not for classes.
        """
        links = materialize(links, "class-links")
        gone = materialize(removed_rows(links) if gone is None else gone, "class-removed").withColumnRenamed("node", "cls")
        kept = rows.select("cls").distinct().join(gone, "cls", "left_anti")
        both = links.select(F.col("c").alias("cls"), F.col("p").alias("rep"), "score", "shared").unionByName(links.select(F.col("p").alias("cls"), F.col("c").alias("rep"), "score", "shared"))
        own = rows.select("cls").distinct().select("cls", F.col("cls").alias("rep"), F.lit(1.0).alias("score"), alone.alias("shared"))
        options = both.unionByName(own).join(kept.withColumnRenamed("cls", "rep"), "rep", "left_semi")
        order = {"shared": F.struct((-F.col("shared")).alias("o"), "rep", "score"), "score": F.struct((-F.col("score")).alias("o"), "rep", "score")}[best]
        chosen = rows.join(options, "cls").where("rep < id").groupBy("id").agg(F.min(order).alias("b"))
        return chosen.select(F.col("id").alias("removed"), F.col("b.rep").alias("representative"), F.col("b.score").alias("score"))

    def candidates(self, first: DataFrame, k: int, threshold: float) -> DataFrame:
        """(p, c, score, shared): classes that share a k-mer and have Jaccard >= threshold, p < c. Rare k-mers find them at low
        thresholds, sketches of whole sets at high ones; both are exact."""
        if threshold >= 0.5:
            return S.alike_sequences(first, k, "cls", "sequence", threshold)
        return S.alike_sets(S.kmers(first, k, "cls", "sequence"), threshold)


@dataclass
class KmerJaccard(_Tokens):
    """k-mer sets that share a k-mer and have Jaccard >= threshold; the representative shares most k-mers.

    Candidates are never capped: a max_candidates is refused, as it would make results depend on the order of work.
    allow_blank takes null, empty and 'nan' sequences: null ones are copies of each other and share no k-mer with others.
    """

    threshold: float = 0.7
    k: int = 5
    max_candidates: int | None = None
    allow_blank: bool = False
    name, prefix, cluster_column = "kmer_jaccard", "kmer", "kmer_cluster_id"

    def validate(self) -> None:
        _between("threshold", self.threshold)
        _at_least("k", self.k, 1)
        if self.max_candidates is not None:
            raise ValueError("candidates are never capped here: leave max_candidates unset")

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        rows, first = self.classes(df, cols, self.allow_blank)
        # a class shares all its k-mers with itself, more than with any other
        return self.finish(rows, self.candidates(first.where("sequence is not null"), self.k, self.threshold), F.lit(1 << 30), "shared")


@dataclass
class IdentityGreedy(_Tokens):
    """Positional identity >= threshold among pairs of like length and k-mer content; most shared k-mers first."""

    threshold: float = 0.9
    k: int = 5
    jaccard_prefilter: float = 0.2
    length_tolerance: float = 0.15
    max_candidates: int | None = None
    name, prefix, cluster_column = "identity_greedy", "ident", "identity_cluster_id"

    def validate(self) -> None:
        for n in ("threshold", "jaccard_prefilter", "length_tolerance"):
            _between(n, getattr(self, n))
        _at_least("k", self.k, 1)
        if self.max_candidates is not None:
            raise ValueError("candidates are never capped here: leave max_candidates unset")

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        rows, first = self.classes(df, cols)
        met = self.candidates(first, self.k, self.jaccard_prefilter).select("p", "c", "shared")
        a, b = (first.select(F.col("cls").alias(x), F.col("sequence").alias(f"s_{x}")) for x in "pc")
        both = met.join(a, "p").join(b, "c")
        la, lb = F.char_length("s_p"), F.char_length("s_c")
        near = both.where(F.abs(la - lb) / F.greatest(la, lb) <= self.length_tolerance)
        scored = near.withColumn("score", S.identity_column(F.col("s_p"), F.col("s_c"))).where(F.col("score") >= self.threshold)
        return self.finish(rows, scored.select("p", "c", "score", "shared"), F.lit(1 << 30), "shared")


@dataclass
class MinhashJaccard(_Tokens):
    """MinHash signatures that meet in a band; the representative has the highest estimated Jaccard.

    verify drops pairs whose estimate is below the threshold; at threshold 1 whole signatures must agree. allow_blank takes
    null, empty and 'nan' sequences: null ones are copies of each other and resemble no others.
    """

    threshold: float = 0.7
    k: int = 5
    num_perm: int = 128
    seed: int = 42
    verify: bool = False
    allow_blank: bool = False
    name, prefix, cluster_column = "minhash_jaccard", "minhash", "minhash_cluster_id"

    def validate(self) -> None:
        _between("threshold", self.threshold)
        _at_least("k", self.k, 1)
        _at_least("num_perm", self.num_perm, 2)

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        rows, first = self.classes(df, cols, self.allow_blank)
        signed = S.signatures(first, self.k, "cls", "sequence", self.num_perm, self.seed)
        signed = materialize(signed.select("id", F.col("sig").cast("array<int>").alias("sig")), "signatures")  # values are below 2**31
        b, r = (1, self.num_perm) if self.threshold >= 1 else S.bands(self.threshold, self.num_perm)
        keys = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.slice("sig", i * r + 1, F.lit(r)).alias("part")))
        entries = signed.select(F.explode(keys).alias("bucket"), "id")
        if self.verify:
            return self._verified(rows, signed, entries)
        # 128 bits of a digest name a bucket
        digest = F.sha2(F.concat(F.col("bucket.band").cast("string"), F.lit(":"), F.to_json("bucket.part")), 256)
        entries = materialize(entries.select(F.substring(F.unhex(digest), 1, 16).alias("bucket"), "id"), "bands")
        kept = materialize(kept_in_buckets(entries), "class-kept")
        # a bucket's kept row, if it has one, is its only one
        of = entries.join(kept, "id", "left_semi")
        owned = with_least(entries.withColumn("own", F.lit(None).cast(dict(entries.dtypes)["id"])).unionByName(of.withColumn("own", F.col("id"))), "own", "rep")
        met = owned.where("own is null and rep is not null and id <> rep").select("id", "rep").distinct()
        scored = self._scored(met.select(F.col("rep").alias("p"), F.col("id").alias("c")), signed)
        links = scored.select(F.least("p", "c").alias("p"), F.greatest("p", "c").alias("c"), "score", F.lit(0).alias("shared"))
        gone = signed.select(F.col("id").alias("node")).join(kept.select(F.col("id").alias("node")), "node", "left_anti")
        return self.finish(rows, links, F.lit(0), "score", gone)

    def _scored(self, met: DataFrame, signed: DataFrame) -> DataFrame:
        x, y = (signed.select(F.col("id").alias(n), F.col("sig").alias(f"s_{n}")) for n in "pc")
        equal = F.aggregate(F.zip_with("s_p", "s_c", lambda u, v: F.when(u == v, 1).otherwise(0)), F.lit(0), lambda s, e: s + e)
        return met.join(x, "p").join(y, "c").withColumn("score", equal / F.lit(self.num_perm))

    def _verified(self, rows: DataFrame, signed: DataFrame, entries: DataFrame) -> DataFrame:
        """Buckets only name candidates here, so their pairs are made and compared."""
        p, c = (entries.select("bucket", F.col("id").alias(x)) for x in "pc")
        met = p.join(c, "bucket").where("p < c").select("p", "c").distinct()
        scored = self._scored(met, signed).where(F.col("score") >= self.threshold)
        return self.finish(rows, scored.select("p", "c", "score", F.lit(0).alias("shared")), F.lit(0), "score")


#: Rows of the first block of vectors; a further block has BLOCK_GROWTH times those of the one before at most. A block makes about
#: as many pairs as all rows of the first could (or one for each row of the table), or has no more rows than the first.
FIRST_BLOCK, BLOCK_GROWTH = 4096, 8


def _block_end(rest: DataFrame, n: int, rows: float, most: int, threshold: float, metric: str):
    """The last id of the next block of n rows (id, v): about `rows` rows and `most` pairs at most, or FIRST_BLOCK rows; None if all
    rows are one block. Both are reckoned on a sample of N.SAMPLE rows, of a shorter part of the rows if few of it fit."""
    import numpy as np

    last = None
    while True:
        sample = rest.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(N.SAMPLE).orderBy("id").collect()
        m, each, before = np.array([r.v for r in sample], dtype=np.float64), n / len(sample), np.zeros(len(sample))
        for i, j, _ in N._scores(m, m, threshold, metric):
            np.add.at(before, i[j < i], 1)
        # no pair in a sample may still be a few
        pairs, taken = (before.cumsum() + 3) * each**2, (np.arange(len(sample)) + 1) * each
        fit = int(((taken <= FIRST_BLOCK) | (pairs <= most) & (taken <= rows)).sum())
        if fit == len(sample):
            return last
        if fit >= 64 or each == 1:
            return sample[max(fit, 1) - 1].id
        last = sample[len(sample) // 16].id
        rest = rest.where(F.col("id") <= F.lit(last))
        n = rest.count()


def _greedy_vectors(first: DataFrame, threshold: float, metric: str) -> DataFrame:
    """(removed, representative, score) for rows (cls, v), block by block in id order.

    A block is compared with itself; then the rows that it keeps meet all later ones that are left, and what resembles them
    goes. So a block holds no row that an earlier one decides on. Blocks are cut where they would make many pairs, whatever
    order the rows come in: where later rows resemble each other but no earlier row, too, pairs don't grow as the square of
    the rows. No row is sent to more tasks than the other side has parts.
    """
    space = N.Space(first, "cls", "v", N._radius(threshold, metric))
    out, rest, n, rows = None, space.rows, space.n, FIRST_BLOCK
    while n:
        end = _block_end(rest, n, rows, max(FIRST_BLOCK**2 // 2, space.n), threshold, metric)
        block = rest if end is None else rest.where(F.col("id") <= F.lit(end))
        links = N.close_rows(space, block, threshold, metric)
        gone = materialize(resolve(links.select(F.col("a").alias("p"), F.col("b").alias("c"), "score", F.lit(0).alias("shared"))), "removed-in-block")
        out = gone if out is None else out.unionByName(gone)
        if end is None:
            break
        kept = materialize(block.join(gone.select(F.col("removed").alias("id")), "id", "left_anti").select(*space.rows.columns), "kept-vectors")
        later = rest.where(F.col("id") > F.lit(end))
        near = N.first_alike(space, kept, later, threshold, metric)
        near = materialize(near.select(F.col("c").alias("removed"), F.col("p").alias("representative"), "score"), "removed-by-earlier")
        out = out.unionByName(near)
        rest = materialize(later.join(near.select(F.col("removed").alias("id")), "id", "left_anti").select(*space.rows.columns), "block-rest")
        n, rows = rest.count(), rows * BLOCK_GROWTH
    return first.sparkSession.createDataFrame([], f"removed {space.kind}, representative {space.kind}, score double") if out is None else out


def _resolve_vectors(rows: DataFrame, threshold: float, metric: str) -> DataFrame:
    """(removed, representative, score) for rows (id, v) in id order. Equal vectors are one class, named by its smallest id,
    and classes are compared: a copy goes to what keeps its first copy's place. Zero vectors resemble nothing by cosine, not
    even each other, so each stays a class of its own."""
    own = F.exists("v", lambda x: x != 0) if metric == "cosine" else F.lit(True)
    first = rows.where(own).groupBy("v").agg(F.min("id").alias("cls"), F.count("*").alias("n"))
    first = materialize(first.unionByName(rows.where(~own).select("v", F.col("id").alias("cls"), F.lit(1).cast("long").alias("n"))), "vector-classes")
    found = _greedy_vectors(first, threshold, metric)
    # only copies are looked up by their vectors
    many = first.where("n > 1").select("v", "cls")
    copies = rows.join(many, "v").where("id <> cls").select("id", "cls")
    if copies.isEmpty():
        return found
    same = 1.0 if metric == "cosine" else 0.0
    led = copies.join(found.withColumnRenamed("removed", "cls"), "cls", "left")
    return found.unionByName(led.select(F.col("id").alias("removed"), F.coalesce("representative", "cls").alias("representative"), F.coalesce("score", F.lit(same)).alias("score")))


@dataclass
class EmbeddingCosine(Reducer):
    """Cosine >= threshold to an earlier kept row. embeddings: (id, embedding); rows without one are kept as singletons."""

    embeddings: DataFrame | None = None
    threshold: float = 0.95
    embedding_id: str = "id"
    embedding_col: str = "embedding"
    # accepted for compatibility: the plan, not a parameter, decides how work is spread
    use_faiss: bool = False
    n_jobs: int = 1
    dtype: str = "float64"
    name, prefix, cluster_column = "embedding_cosine", "embcos", "embedding_cosine_cluster_id"

    def validate(self) -> None:
        _between("threshold", self.threshold)
        if self.embeddings is None:
            raise ValueError("embedding_cosine needs embeddings")

    def renamed(self, names: DataFrame) -> Reducer:
        return replace(self, embeddings=_put(self.embeddings, names, self.embedding_id))

    def _found(self, df: DataFrame, cols: Columns) -> DataFrame:
        store = self.embeddings.select(F.col(f"`{self.embedding_id}`").alias("id"), F.col(f"`{self.embedding_col}`").cast("array<double>").alias("v"))
        return df.select(F.col(f"`{cols.id}`").alias("id")).join(store.where("v is not null").dropDuplicates(["id"]), "id")

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        found = materialize(self._found(df, cols).select("id", V.unit(F.col("v")).alias("v")), "embeddings")
        if found.isEmpty():
            raise ValueError("no id of the dataset has an embedding")
        return _resolve_vectors(found, self.threshold, "cosine")

    def _result(self, df: DataFrame, cols: Columns, pairs: DataFrame) -> ReductionResult:
        got = super()._result(df, cols, pairs)
        have = self._found(df, cols).select(F.col("id").alias("__have"))
        text = F.col(f"`{cols.id}`").cast("string")
        kept = got.kept.drop(self.cluster_column).join(have, F.col(f"`{cols.id}`") == F.col("__have"), "left")
        label = F.concat(F.when(F.col("__have").isNull(), F.lit("singleton:")).otherwise(F.lit(f"{self.prefix}:")), text)
        got.kept = kept.withColumn(self.cluster_column, label).drop("__have")
        return got


def descriptor_columns(df: DataFrame, prefix: str, given: list[str] | None) -> list[str]:
    cols = list(given) if given else [c for c in df.columns if c.startswith(prefix)]
    if not cols or (missing := [c for c in cols if c not in df.columns]):
        raise ValueError(f"no descriptor columns: {missing if cols else prefix}")
    x = [F.col(f"`{c}`").try_cast("double") for c in cols]
    bad = [F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(str(k)) for k, c in enumerate(x)]
    if any(df.agg(*bad).first()):
        raise ValueError("descriptors must be finite numbers")
    return cols


@dataclass
class DescriptorEuclidean(Reducer):
    """Euclidean distance <= threshold to an earlier kept row, after standardising by population deviation."""

    threshold: float = 1.0
    descriptor_prefix: str = "desc_"
    descriptor_cols: list[str] | None = None
    standardize: bool = True
    metric: str = "euclidean"
    # accepted for compatibility: the plan, not a parameter, decides how work is spread
    n_jobs: int = 1
    dtype: str = "float64"
    name, prefix, cluster_column = "descriptor_euclidean", "deuc", "descriptor_euclidean_cluster_id"

    def validate(self) -> None:
        _at_least("threshold", self.threshold, 0)
        if self.metric != "euclidean":
            raise ValueError(f"metric must be euclidean, not {self.metric!r}")

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        names = descriptor_columns(df, self.descriptor_prefix, self.descriptor_cols)
        base = df.select(F.col(f"`{cols.id}`").alias("id"), V.as_vector(df, names).alias("v"))
        if self.standardize:
            base = base.select("id", V.zscore("v", *V.column_moments(base, "v")).alias("v"))
        return _resolve_vectors(materialize(base, "descriptors"), self.threshold, "euclidean")


def _put(table: DataFrame, names: DataFrame, *cols: str) -> DataFrame:
    """table with the ids in cols replaced by their ranks; rows of other ids go."""
    for c in cols:
        kind = dict(names.dtypes)["__id"]
        own = names.select(F.col("__id").alias("__own"), F.col("__rank").alias("__new"))
        table = table.withColumn(c, F.col(f"`{c}`").cast(kind)).join(own, F.col(f"`{c}`") == F.col("__own")).withColumn(c, F.col("__new")).drop("__own", "__new")
    return table


@dataclass
class StructuralDistance(Reducer):
    """Listed edges within the threshold. Parallel edges count once, by their smallest distance or greatest similarity."""

    edges: DataFrame | None = None
    mode: str = "distance"
    threshold: float = 0.5
    id1_col: str = "id1"
    id2_col: str = "id2"
    value_col: str = "distance"
    name, prefix, cluster_column = "structural_distance", "struct", "structural_cluster_id"

    def validate(self) -> None:
        if self.mode not in ("distance", "similarity"):
            raise ValueError(f"mode must be distance or similarity, not {self.mode!r}")
        if self.edges is None or (missing := [c for c in (self.id1_col, self.id2_col, self.value_col) if c not in self.edges.columns]):
            raise ValueError("structural_distance needs edges" + (f" with {missing}" if self.edges is not None else ""))

    def renamed(self, names: DataFrame) -> Reducer:
        return replace(self, edges=_put(self.edges, names, self.id1_col, self.id2_col))

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        kind, near = dict(df.dtypes)[cols.id], self.mode == "distance"
        e = self.edges.select(F.col(f"`{self.id1_col}`").cast(kind).alias("x"), F.col(f"`{self.id2_col}`").cast(kind).alias("y"), F.col(f"`{self.value_col}`").cast("double").alias("score"))
        e = e.where((F.col("score") <= self.threshold) if near else (F.col("score") >= self.threshold)).where("x <> y")
        e = e.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("c"), "score")
        e = materialize(e, "listed-edges")  # no edge is shuffled: its ends are looked up once, and parallel ones are told apart at the end
        ends = e.select(F.col("p").alias("i")).distinct().unionByName(e.select(F.col("c").alias("i")).distinct()).distinct()
        outside = materialize(ends.join(df.select(F.col(f"`{cols.id}`").alias("i")), "i", "left_anti"), "outside")
        if not outside.isEmpty():
            e = materialize(e.join(outside.withColumnRenamed("i", "p"), "p", "left_anti").join(outside.withColumnRenamed("i", "c"), "c", "left_anti"), "edges")
        return _representatives(e, removed_rows(e), F.struct("p", (F.col("score") if near else -F.col("score")).alias("o"), "score"))


@dataclass
class Homology(_Tokens):
    """Sequence clusters: given as (representative, member) rows, or found by k-mer centres and alignment.

    Without given clusters, each sequence's `centres` smallest k-mer hashes name groups, and a group's longest sequence is
    its centre (Linclust; Steinegger & Söding, 2018). Shared k-mers carry their places: a pair with a centre is looked at on
    the diagonal with most of them. Pairs whose lengths alone rule out the limits go. If the best ungapped run on the diagonal
    meets them, the pair links; else, unless that run scores below min_ungapped, its best local alignment with affine gaps
    decides. The limits: identical columns are min_seq_id of all columns, and columns cover `coverage` of both sequences
    (cov_mode 0), of the member (1) or of the centre (2). Results need not equal the external tool's. Rows that no cluster
    names are kept.
    """

    clusters: DataFrame | None = None
    min_seq_id: float = 0.9
    coverage: float = 0.8
    cov_mode: int = 0
    k: int = 5
    centres: int = 20
    min_ungapped: int = 0
    representative_col: str = "representative"
    member_col: str = "member"
    # accepted for compatibility: the plan, not a parameter, decides how work is spread
    cluster_mode: int = 0
    threads: int = 4
    tmp_root: str | None = None
    keep_tmp: bool = False
    name, prefix, cluster_column = "mmseqs2", "mmseqs2", "mmseqs2_cluster_id"

    def validate(self) -> None:
        _between("min_seq_id", self.min_seq_id)
        _between("coverage", self.coverage)
        if self.cov_mode not in (0, 1, 2):
            raise ValueError("cov_mode must be 0, 1 or 2")

    def renamed(self, names: DataFrame) -> Reducer:
        return self if self.clusters is None else replace(self, clusters=_put(self.clusters, names, self.representative_col, self.member_col))

    def pairs(self, df: DataFrame, cols: Columns) -> DataFrame:
        kind = dict(df.dtypes)[cols.id]
        if self.clusters is not None:
            given = self.clusters.select(F.col(f"`{self.member_col}`").cast(kind).alias("removed"), F.col(f"`{self.representative_col}`").cast(kind).alias("representative"))
            ids = df.select(F.col(f"`{cols.id}`").alias("removed"))
            given = given.where("removed <> representative").groupBy("removed").agg(F.min("representative").alias("representative"))
            reps = ids.withColumnRenamed("removed", "representative")
            return given.join(ids, "removed", "left_semi").join(reps, "representative", "left_semi").withColumn("score", F.lit(None).cast("double"))
        rows, first = self.classes(df, cols)
        links = self.aligned(self.seeds(first).drop("hits"), first)
        out = self.finish(rows, links.select("p", "c", F.lit(0.5).alias("score"), F.lit(0).alias("shared")), F.lit(1), "shared")
        return out.withColumn("score", F.lit(None).cast("double"))

    def seeds(self, first: DataFrame) -> DataFrame:
        """(p, c, centre, diagonal, hits) for (cls, sequence): pairs of a sequence and a centre, the diagonal (place in c minus
        place in p) that most of their shared k-mers lie on, ties to the least, and their number."""
        lead = S.least_kmers(first, self.k, "cls", "sequence", self.centres)
        of = F.min(F.struct((-F.col("len")).alias("o"), F.col("id"), F.col("at"))).alias("m")
        centre = lead.groupBy("kmer").agg(of).select("kmer", F.col("m.id").alias("centre"), F.col("m.at").alias("there"))
        met = lead.join(centre, "kmer").where("id <> centre")
        lower, step = F.col("id") < F.col("centre"), F.col("there") - F.col("at")
        met = met.select(F.least("id", "centre").alias("p"), F.greatest("id", "centre").alias("c"), "centre", F.when(lower, step).otherwise(-step).alias("diagonal"))
        hits = met.groupBy("p", "c", "centre", "diagonal").agg(F.count("*").alias("hits"))
        best = F.min(F.struct((-F.col("hits")).alias("o"), F.col("diagonal"))).alias("b")
        return hits.groupBy("p", "c", "centre").agg(best).select("p", "c", "centre", F.col("b.diagonal").alias("diagonal"), (-F.col("b.o")).alias("hits"))

    def aligned(self, seeds: DataFrame, first: DataFrame) -> DataFrame:
        """(p, c) of the seeds whose sequences link."""
        a, b = (first.select(F.col("cls").alias(x), F.char_length("sequence").alias(f"l_{x}")) for x in "pc")
        sized = seeds.join(a, "p").join(b, "c")
        longer, shorter = F.greatest("l_p", "l_c"), F.least("l_p", "l_c")
        if self.cov_mode == 0:  # identical columns are as many as the shorter sequence has letters, at most
            sized = sized.where(shorter >= self.min_seq_id * self.coverage * longer - 1e-9)
        if sized.where(longer >= A.LONGEST).limit(1).count():
            raise ValueError(f"sequences of {A.LONGEST} letters or more can't be aligned")
        a, b = (first.select(F.col("cls").alias(x), F.col("sequence").alias(f"s_{x}")) for x in "pc")
        both = sized.join(a, "p").join(b, "c").select("p", "c", (F.col("p") == F.col("centre")).alias("lead"), "s_p", "s_c", "diagonal")
        need, cover, mode, floor = self.min_seq_id, self.coverage, self.cov_mode, self.min_ungapped

        def meets(packed, chunk):
            """Whether alignments meet the limits."""
            import numpy as np

            _, same, columns = A.unpack(packed)
            la, lb, lead = (np.array([f(r) for r in chunk]) for f in (lambda r: len(r[1]), lambda r: len(r[2]), lambda r: r[3]))
            centre, member = np.where(lead, la, lb), np.where(lead, lb, la)
            ok = (columns > 0) & (same >= need * columns - 1e-9)
            for length in {0: (la, lb), 1: (member,), 2: (centre,)}[mode]:
                ok &= np.minimum(columns, length) >= cover * length - 1e-9
            return ok

        def run(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                rows, linked, rest = [(k, *r) for k, r in enumerate(zip(*(batch.column(x).to_pylist() for x in ("s_p", "s_c", "lead", "diagonal"))))], [], []
                for chunk in A.chunks(rows):
                    x, y = A.codes([r[1] for r in chunk], -1), A.codes([r[2] for r in chunk], -2)
                    packed = A.ungapped(x, y, np.array([r[4] for r in chunk], dtype=np.int64))
                    ok, scores = meets(packed, chunk), A.unpack(packed)[0]
                    linked += [r[0] for r, good in zip(chunk, ok) if good]
                    rest += [r for r, good, score in zip(chunk, ok, scores) if not good and score >= floor]
                for chunk in A.chunks(rest):
                    ok = meets(A.gapped(A.codes([r[1] for r in chunk], -1), A.codes([r[2] for r in chunk], -2)), chunk)
                    linked += [r[0] for r, good in zip(chunk, ok) if good]
                yield pa.RecordBatch.from_arrays([batch.column(x).take(pa.array(sorted(linked), pa.int64())) for x in ("p", "c")], ["p", "c"])

        kind = dict(both.dtypes)["p"]
        return spread(both).mapInArrow(run, f"p {kind}, c {kind}").distinct()


STRATEGIES: dict[str, type[Reducer]] = {c.name: c for c in (Exact, KmerJaccard, MinhashJaccard, IdentityGreedy, EmbeddingCosine, DescriptorEuclidean, StructuralDistance, Homology)}
