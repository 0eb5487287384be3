"""Readers and writers: datasets, embeddings, edge lists, cluster maps, FASTA."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import order_rank
from .formats import FastaDataSource, NpyDataSource

FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", schema=None, **options) -> DataFrame:
    """A dataset by its extension; a folder or an unknown extension is Parquet. CSV has a header, its types are inferred."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix in (".fasta", ".fa", ".faa", ".fna"):
        return read_fasta(spark, path)
    kind = FORMATS.get(suffix, "parquet")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, sep=sep or ("\t" if suffix == ".tsv" else ","), encoding=encoding, inferSchema=schema is None)
    return reader.format(kind).load(path)


def read_embeddings(spark: SparkSession, matrix: str, ids: str, id_col: str | None = None, dtype: str = "float32") -> DataFrame:
    """(id, embedding) from a table with an embedding column, or from an .npy matrix and a CSV of its rows' ids.

    Executors read the matrix by ranges of rows. Ids are numbered in the order of their file, and meet rows by number.
    """
    if not matrix.endswith(".npy"):
        df = read_table(spark, matrix)
        return df.select(F.col(id_col or df.columns[0]).alias("id"), "embedding")
    spark.dataSource.register(NpyDataSource)
    rows = spark.read.format("npy").load(matrix)
    names = read_table(spark, ids)
    if id_col is not None and id_col not in names.columns:
        raise ValueError(f"{ids} has no column {id_col!r}")
    names = in_file_order(names, id_col or names.columns[0])
    n, m = names.count(), rows.count()
    if not n:
        raise ValueError(f"{ids} is empty")
    if n != m:
        raise ValueError(f"{n} ids for {m} rows")
    kind = "float" if dtype == "float32" else "double"
    return names.join(rows, "position").select(F.col("value").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))


def file_place() -> list:
    """What orders the rows of files as the files do: path, block, and place in the block. For rows just read from files."""
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")]


def in_file_order(df: DataFrame, col: str) -> DataFrame:
    """(position, value): a column of a file just read, with the row's number from 0."""
    placed = df.select(F.col(f"`{col}`").alias("value"), *file_place())
    return order_rank(placed, F.col("path"), F.col("block"), F.col("nth"), name="position").select((F.col("position") - 1).alias("position"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence) of a FASTA file's records."""
    spark.dataSource.register(FastaDataSource)
    return spark.read.format("fasta").load(path)


def read_edges(spark: SparkSession, path: str, id1_col: str = "id1", id2_col: str = "id2", value_col: str = "distance", both_ways: bool = False) -> DataFrame:
    """(id1, id2, value); both_ways adds each edge reversed."""
    df = read_table(spark, path)
    if missing := [c for c in (id1_col, id2_col, value_col) if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    e = df.select(F.col(id1_col).alias("id1"), F.col(id2_col).alias("id2"), F.col(value_col).cast("double").alias("value"))
    return e.unionByName(e.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "value")) if both_ways else e


def read_clusters(spark: SparkSession, path: str, kind: str | None = None, id_col: str = "id", cluster_col: str = "cluster_id") -> DataFrame:
    """(member, cluster): from a headerless (representative, member) TSV, or from a table with a header.

    kind is mmseqs_tsv or csv; by default .tsv files are the former. Of a member's several clusters the file's last counts.
    """
    kind = kind or ("mmseqs_tsv" if path.endswith(".tsv") else "csv")
    if kind == "mmseqs_tsv":
        raw = spark.read.csv(path, sep="\t", schema="cluster string, member string")
        df = raw.select("member", "cluster", *file_place())
    else:
        raw = read_table(spark, path)
        if missing := [c for c in (id_col, cluster_col) if c not in raw.columns]:
            raise ValueError(f"{path} lacks {missing}")
        df = raw.select(F.col(id_col).cast("string").alias("member"), F.col(cluster_col).cast("string").alias("cluster"), *file_place())
    return df.groupBy("member").agg(F.max_by("cluster", F.struct("path", "block", "nth")).alias("cluster"))


def write_table(df: DataFrame, path: str, sep: str = ",", single: bool = True) -> None:
    """By extension. A .csv path becomes one file, for tools that expect it, where the file system is local; any other
    path, and single=False, becomes a folder that tasks write in parallel."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv" and single:
        folder = f"{path}.parts"
        df.coalesce(1).write.mode("overwrite").csv(folder, header=True, sep=sep)
        fs, new = _hadoop(df.sparkSession, folder)
        part = next(s.getPath() for s in fs.listStatus(new(folder)) if s.getPath().getName().startswith("part-"))
        fs.delete(new(path), True)
        fs.rename(part, new(path))
        fs.delete(new(folder), True)
    elif suffix == ".csv":
        df.write.mode("overwrite").csv(path, header=True, sep=sep)
    else:
        df.write.mode("overwrite").parquet(path)


def write_parts(df: DataFrame, folder: str, by: list[str], paths: dict[tuple, str], sep: str = ",") -> None:
    """Each value of the columns `by` to a path of its own, in one job: a .csv path becomes one file, any other a folder.

    What `by` names is written as folders, which are then renamed; rows of a value that paths doesn't have are an error.
    """
    one = all(p.lower().endswith(".csv") for p in paths.values())
    temp = f"{folder.rstrip('/')}/_parts"
    out = (df.repartition(len(paths), *by) if one else df).write.mode("overwrite").partitionBy(*by)
    out.csv(temp, header=True, sep=sep) if one else out.parquet(temp)
    fs, new = _hadoop(df.sparkSession, temp)
    for values, path in paths.items():
        part = new(temp + "".join(f"/{c}={v}" for c, v in zip(by, values)))
        fs.mkdirs(new(path).getParent())
        fs.delete(new(path), True)
        if not fs.exists(part):  # nobody is in this part
            write_table(df.where(F.lit(False)).drop(*by), path, sep)
            continue
        if one:
            found = [s.getPath() for s in fs.listStatus(part) if s.getPath().getName().startswith("part-")]
            part = found[0]
            if len(found) > 1:
                raise RuntimeError(f"{path} came in {len(found)} files")
        fs.rename(part, new(path))
    fs.delete(new(temp), True)


def _hadoop(spark: SparkSession, path: str):
    new = spark._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), new


def write_fasta(df: DataFrame, path: str, id_col: str, seq_col: str) -> None:
    """Records >id and sequence, one below the other."""
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq_col))).write.mode("overwrite").text(path)
