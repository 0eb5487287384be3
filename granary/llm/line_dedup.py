"""Line dedup by levelled sorted runs of line hashes (DataFrame operations only).

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. The index counts the documents that hold
a key. It is a set of sorted runs (h, g, n): two 64-bit hashes of a key and its documents.

1. Texts are read once for the index; what comes out is (batch, h, g, n), with one row for each key and batch.
2. Each batch is merge-anti-joined with the runs: keys that a run already holds in enough documents are settled and need no
   more counting; of a run only those are read. The rest becomes a run of level 0.
3. When a level has FANOUT runs, they are compacted into one of the next level, so a key is rewritten once a level.
4. Keys whose counts over all runs reach min_docs are frequent. Their places (row, line number) are found by hash; the
   at most HOT keys that hold over a HOT-th of all lines are broadcast, the rest are merged, so no hot line meets in a task.
5. A text goes once to the task that has its dropped places, and is joined again from the lines that stay.

Equal hashes in both 64-bit halves are taken for equal keys: among 10**12 keys any such pair has a chance of 10**-15.

Edge cases. Null or empty text: one empty line, which has no key and stays. A text whose lines all go becomes empty. Lines
without a key stay. Every row is a document of its own, rows repeated in all columns too; a line repeated within one text
counts once. Ids may be null and of any type. Other columns are kept as they are, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, recorded
from .common import ASCII_SPACE, fresh, materialize, table, with_row

MIN_DOCS, BATCHES, FANOUT, HOT = 10, 4, 2, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The key of a line; empty if it has none."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    # lower() knows all alphabets, and is the faster one where there is only ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


class Runs:
    """Levelled sorted runs of (h, g, n), each a table in the shared folder whose files are sorted by (h, g)."""

    def __init__(self, min_docs: int, fanout: int = FANOUT):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[tuple[DataFrame, list[str]]]] = []
        self.compactions = 0

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def _place(self, level: int, run: DataFrame) -> None:
        with recorded() as paths:
            written = materialize(run.sortWithinPartitions("h", "g"), "line-run")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((written, paths))

    def add(self, batch: DataFrame) -> None:
        """batch: (h, g, n), a row for each key: what the runs haven't settled becomes a run of level 0."""
        new = batch
        for run in self.tables():  # of a run only its settled keys are read
            new = new.join(run.where(F.col("n") >= self.min_docs).select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        self._place(0, new)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("h", "g").agg(F.sum("n").alias("n"))

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self.levels[level] = []
        self._place(level + 1, self._merged([run for run, _ in old]))
        for run, paths in old:
            discard(run.sparkSession, paths)
        self.compactions += 1

    def frequent(self) -> DataFrame:
        """(h, g) of the keys found in min_docs documents."""
        return self._merged(self.tables()).where(F.col("n") >= self.min_docs).select("h", "g")

    def discard(self) -> None:
        for level in self.levels:
            for run, paths in level:
                discard(run.sparkSession, paths)
        self.levels = []


def counted(rows: DataFrame, text: Column, batch: Column) -> DataFrame:
    """(batch, h, g, n): the documents of a batch that hold a key."""
    keys = rows.select(batch.alias("batch"), F.explode(F.array_distinct(F.transform(lines_of(text), key_of))).alias("key")).where("key <> ''")
    return keys.select("batch", *hashes(F.col("key"))).groupBy("batch", "h", "g").agg(F.count("*").alias("n"))


def frequent_keys(
    rows: DataFrame, text: Column, row: str, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> tuple[DataFrame, DataFrame]:
    """(h, g) of the frequent keys, and (h, g, often) of those keys that may be hot, at most HOT for each batch.

    A key that holds over a HOT-th of all (document, key) pairs holds over a HOT-th of some batch's. often: whether it is
    frequent.
    """
    with recorded() as paths:
        found = materialize(counted(rows, text, F.pmod(F.xxhash64(row), F.lit(batches)).cast("int")), "line-counts")
    runs = Runs(min_docs, fanout)
    for k in range(batches):
        runs.add(found.where(F.col("batch") == k).select("h", "g", "n"))
    frequent = materialize(runs.frequent(), "line-frequent")
    runs.discard()
    totals = found.groupBy("batch").agg(F.sum("n").alias("total"))  # a row for each batch
    hot = found.join(F.broadcast(totals), "batch").where(F.col("n") * HOT > F.col("total")).select("h", "g").distinct()
    often = frequent.join(F.broadcast(hot), ["h", "g"], "left_semi").withColumn("often", F.lit(True))
    hot = materialize(hot.join(F.broadcast(often), ["h", "g"], "left").withColumn("often", F.coalesce("often", F.lit(False))), "line-hot")
    discard(rows.sparkSession, paths)
    return frequent, hot


def dropped_places(rows: DataFrame, text: Column, row: str, frequent: DataFrame, hot: DataFrame) -> DataFrame:
    """(row, gone): the numbers of a row's lines whose keys are frequent, for rows that have such lines.

    Lines of hot keys are told by the broadcast table; in the merge with the others they carry keys of their own that match
    nothing, so they spread.
    """
    places = rows.select(row, F.posexplode(lines_of(text)).alias("at", "line")).select(row, "at", key_of(F.col("line")).alias("key"))
    places = places.where("key <> ''").select(row, "at", *hashes(F.col("key"))).join(F.broadcast(hot), ["h", "g"], "left")
    cold = F.col("often").isNull()
    spread = places.where("often or often is null").select(
        row, "at", "often", F.when(cold, F.col("h")).otherwise(F.xxhash64(row, "at")).alias("h"), F.when(cold, F.col("g")).alias("g")
    )
    met = spread.join(frequent.withColumn("found", F.lit(True)).hint("merge"), ["h", "g"], "left").where("often or found")
    return met.groupBy(row).agg(F.collect_list("at").alias("gone"))


def drop_lines(
    df: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> tuple[DataFrame, str, str]:
    """df with its texts' frequent lines dropped, and the names of two more columns: lines before, and lines dropped."""
    rows, row = with_row(df, "line-rows")
    text, own = F.col(f"`{text_col}`"), list(df.columns)
    frequent, hot = frequent_keys(rows, text, row, min_docs, batches, fanout)
    gone = dropped_places(rows, text, row, frequent, hot)
    lines, places, n_lines, n_dropped = (fresh(rows, c) for c in ("line_list", "gone", "n_lines", "n_dropped"))
    split = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != text_col], lines_of(text).alias(lines))
    met = split.join(gone.withColumnRenamed("gone", places).hint("merge"), row, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(places), F.array().cast("array<int>")))
    whole = F.when(F.col(places).isNull(), F.col(lines)).otherwise(F.transform(stay, lambda i: F.get(F.col(lines), i)))
    out = met.withColumn(text_col, F.array_join(whole, "\n"))
    out = out.withColumns({n_lines: F.size(lines).cast("long"), n_dropped: F.coalesce(F.size(places), F.lit(0)).cast("long")})
    return out.select(*[F.col(f"`{c}`") for c in own], n_lines, n_dropped), n_lines, n_dropped


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n_lines, n_dropped = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", n_lines, n_dropped, F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
  select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as nth from d),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (
  select key from k where key <> '' group by key having count(distinct r) >= 10)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(case when f.key is null then line end, chr(10) order by nth), '')) as kept_sha256
from k left join f on k.key = f.key
group by r, doc_id
"""
