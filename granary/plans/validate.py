"""Checks of a dataset, and of what a strategy needs, before a run. Each is one aggregate or semi-join."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import Columns

#: What a strategy needs beside ids: the sequence column, a file, or a column by role.
NEEDS: dict[str, tuple[str, ...]] = {
    "exact": ("sequence",), "kmer_jaccard": ("sequence",), "minhash_jaccard": ("sequence",), "identity_greedy": ("sequence",), "mmseqs2": ("sequence",),
    "embedding_cosine": ("embeddings",), "descriptor_euclidean": ("descriptors",), "structural_distance": ("edges",),
    "stratified": ("label",), "stratified_kfold": ("label",), "group": ("group",), "group_kfold": ("group",), "time": ("date",),
    "stratified_numeric": ("numeric label",), "stratified_numeric_kfold": ("numeric label",), "cluster_aware": ("clusters",),
    "homology_aware": ("clusters or sequence",), "distance_aware": ("embeddings or descriptors",), "distance_aware_kfold": ("embeddings or descriptors",),
    "structure_aware": ("edges",), "stratified_group_kfold": ("label", "group"),
}


def validate(
    df: DataFrame, cols: Columns | None = None, strategy: str | None = None, embeddings: DataFrame | None = None, edges: DataFrame | None = None,
    descriptor_prefix: str = "desc_", fail_fast: bool = False, clusters: DataFrame | None = None,
) -> dict[str, Any]:
    """{"ok", "errors", "checks"}: every check with its figures; errors are texts. embeddings: (id, embedding); edges: (id1, id2, ...);
    clusters: (id, cluster). For stratified_numeric(_kfold) the label column must hold numbers."""
    cols = cols or Columns()
    checks, errors = {}, []

    def note(name: str, wrong: str | None, **figures) -> None:
        checks[name] = {"ok": not wrong} | figures
        if wrong:
            errors.append(f"{name}: {wrong}")
            if fail_fast:
                raise ValueError(errors[-1])

    if cols.id not in df.columns:
        note("ids", f"no column {cols.id!r}")
        return {"ok": False, "errors": errors, "checks": checks}
    text = F.col(f"`{cols.id}`").cast("string")
    descriptors = [c for c in df.columns if c.startswith(descriptor_prefix)]
    aggs = [F.count("*").alias("n"), F.count_distinct(text).alias("ids")]
    if cols.sequence in df.columns:
        aggs.append(F.count_if(F.col(f"`{cols.sequence}`").cast("string") == "").alias("empty"))
    aggs += [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"d{k}") for k, c in enumerate(descriptors)]
    row = df.agg(*aggs).first()
    note("ids", None if row.n == row.ids else f"{row.n} rows, {row.ids} distinct ids", n=row.n, distinct=row.ids)
    if cols.sequence in df.columns:
        note("sequences", f"{row['empty']} are empty" if row["empty"] else None, empty=row["empty"])
    if descriptors:
        bad = {c: row[f"d{k}"] for k, c in enumerate(descriptors) if row[f"d{k}"]}
        note("descriptors", f"not numeric: {bad}" if bad else None, n=len(descriptors))
    ids = df.select(text.alias("i"))
    if embeddings is not None:
        covered = ids.join(embeddings.select(F.col(embeddings.columns[0]).cast("string").alias("i")).distinct(), "i", "left_semi").count()
        note("embeddings", None if covered else "no id has an embedding", covered=covered, coverage=covered / row.n if row.n else 0.0)
    if edges is not None:
        e = edges.select(F.col(edges.columns[0]).cast("string").alias("x"), F.col(edges.columns[1]).cast("string").alias("y"))
        inside = e.join(ids.withColumnRenamed("i", "x"), "x", "left_semi").join(ids.withColumnRenamed("i", "y"), "y", "left_semi").count()
        note("edges", None if inside else "no edge lies within the dataset", inside=inside)
    if clusters is not None:
        named = clusters.select(F.col(clusters.columns[0]).cast("string").alias("i"))
        covered = ids.join(named.distinct(), "i", "left_semi").count()
        note("clusters", None if covered else "no id is in a cluster", covered=covered, coverage=covered / row.n if row.n else 0.0)
    have = {"embeddings": embeddings is not None, "edges": edges is not None, "descriptors": bool(descriptors)}
    have |= {role: getattr(cols, role) in df.columns for role in ("sequence", "label", "group", "date")}
    if (strategy or "").startswith("stratified_numeric") and have["label"]:
        numbers = df.agg(F.count_if(F.col(f"`{cols.label}`").try_cast("double").isNotNull())).first()[0]
        note("numeric label", None if numbers else f"{cols.label!r} holds no number", numbers=numbers)
        have["numeric label"] = numbers > 0
    own = cols.cluster or "cluster_id"
    have["clusters"] = clusters is not None or own in df.columns
    have["clusters or sequence"] = have["clusters"] or have["sequence"]
    have["embeddings or descriptors"] = have["embeddings"] or have["descriptors"]
    have.setdefault("numeric label", False)
    if strategy in NEEDS and (missing := [x for x in NEEDS[strategy] if not have[x]]):
        note("strategy", f"{strategy} needs {missing}")
    return {"ok": not errors, "errors": errors, "checks": checks}
