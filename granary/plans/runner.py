"""Whole runs: read, check, apply a strategy, write results and a report."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import asdict, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.splitters import FoldResult, SplitResult
from ..roles import Columns
from ..storage import materialize
from ..sources.tables import read_clusters, read_edges, read_embeddings, read_table, write_parts, write_table
from . import registry

VERSION = "0.1"
log = logging.getLogger("granary")


def plain(x: Any) -> Any:
    """x as JSON has it: dataclasses and tuples as mappings and lists, anything else as text."""
    if is_dataclass(x) and not isinstance(x, type):
        return plain(asdict(x))
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def write_report(report: dict, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(plain(report), indent=2, ensure_ascii=False), encoding="utf-8")


def resolve_inputs(spark: SparkSession, params: dict[str, Any]) -> dict[str, Any]:
    """Parameters that name files become tables: embeddings_path (with ids_path), edges_path, clusters_path, cluster_map_path."""
    p = dict(params)
    if path := p.pop("embeddings_path", None):
        p["embeddings"] = read_embeddings(spark, path, p.pop("ids_path", None), p.pop("ids_col", None))
    if path := p.pop("edges_path", None):
        names = {"id1_col": "id1", "id2_col": "id2", "value_col": "value"}
        p["edges"] = read_edges(spark, path, *(p.get(k) or d for k, d in zip(names, ("id1", "id2", "distance"))))
        p |= names
    if path := p.pop("cluster_map_path", None):
        id_col, cluster_col = p.get("map_id_col", "id"), p.get("map_cluster_col", "cluster_id")
        p["clusters"] = read_clusters(spark, path, "csv", id_col, cluster_col).select(F.col("member").alias(id_col), F.col("cluster").alias(cluster_col))
    if path := p.pop("clusters_path", None):
        found = read_clusters(spark, path, p.pop("clusters_format", None), p.get("member_col", "id"), p.get("cluster_col", "cluster_id"))
        p |= {"clusters": found.withColumnRenamed("cluster", "representative"), "member_col": "member"}
        if "cluster_col" in p:
            p["cluster_col"] = "representative"
    return p


def reduce(df: DataFrame, strategy: str, cols: Columns | None = None, **params):
    """The strategy's kept rows and mapping for df."""
    return registry.build("reduce", strategy, params).run(df, cols)


def split(df: DataFrame, strategy: str, cols: Columns | None = None, **params):
    """The strategy's split or folds of df."""
    return registry.build("split", strategy, params).run(df, cols)


def run_reduce(
    spark: SparkSession, path: str, out: str, strategy: str, cols: Columns | None = None, params: dict[str, Any] | None = None,
    mapping_path: str | None = None, report_path: str | None = None, sep: str = ",", encoding: str = "UTF-8",
) -> dict[str, Any]:
    began, params = time.monotonic(), params or {}
    df = read_table(spark, path, sep=sep, encoding=encoding)
    result = registry.build("reduce", strategy, resolve_inputs(spark, params)).run(df, cols)
    # the mapping is joined once; kept rows are counted as they are written
    result.mapping = materialize(result.mapping, "mapping")
    removed, n_in, seen = result.mapping.count(), df.count(), Observation()
    write_table(result.kept.observe(seen, F.count(F.lit(1)).alias("n")), out, sep)
    if mapping_path:
        write_table(result.mapping, mapping_path, sep)
    n_out = seen.get["n"]
    stats = {"n_total": n_in, "n_kept": n_out, "n_removed": n_in - n_out, "reduction_ratio": n_out / n_in if n_in else 0.0}
    report = {
        "schema_version": VERSION, "kind": "reduce", "strategy": strategy,
        "paths": {"input": path, "output": out, "mapping": mapping_path, "report": report_path},
        "params": result.params | {k: v for k, v in params.items() if k.endswith("_path")},
        "summary": {"n_in": n_in, "n_out": n_out, "n_removed": n_in - n_out, "fraction_removed": (n_in - n_out) / n_in if n_in else 0.0, "n_mapped_removed": removed},
        "stats": stats, "columns": cols or Columns(),
    }
    if report_path:
        write_report(report, report_path)
    log.info("reduced %d rows to %d by %s in %.1f s", n_in, n_out, strategy, time.monotonic() - began)
    return plain(report)


def run_split(
    spark: SparkSession, path: str, out_dir: str, strategy: str, cols: Columns | None = None, params: dict[str, Any] | None = None,
    report_path: str | None = None, sep: str = ",", encoding: str = "UTF-8", suffix: str = ".csv",
) -> dict[str, Any]:
    """Write train, test and, if asked for, val; for k folds a folder fold_00, fold_01, ... each."""
    began, params = time.monotonic(), params or {}
    df = read_table(spark, path, sep=sep, encoding=encoding)
    result = registry.build("split", strategy, resolve_inputs(spark, params)).run(df, cols)
    kfold = isinstance(result, FoldResult)
    if not isinstance(result, (FoldResult, SplitResult)):
        raise ValueError(f"{strategy} has no train, test and val files: use split() and its parts")
    result.assigned = materialize(result.assigned, "assigned")  # files and figures read it
    names = ["train", "test", *(["val"] if result.params.get("val_size") else [])]
    seen = Observation()
    if kfold:  # all folds are one table, ranked, counted and written at once
        rows = materialize(result.expanded(), "folds")
        held = [F.count_if((F.col("fold_index") == i) & (F.col("split") == x)).alias(f"{i}_{x}") for i in range(result.k) for x in ("train", "test", "val")]
        paths = {(i, x): f"{out_dir}/fold_{i:02d}/{x}{suffix}" for i in range(result.k) for x in names}
        write_parts(rows.observe(seen, *held), out_dir, ["fold_index", "split"], paths, sep)
    else:
        rows = result.assigned
        held = [F.count_if(F.col("split") == x).alias(f"0_{x}") for x in ("train", "test", "val")]
        write_parts(rows.observe(seen, *held), out_dir, ["split"], {(x,): f"{out_dir}/{x}{suffix}" for x in names}, sep)
    n = seen.get
    stats = []
    for i in range(result.k if kfold else 1):
        part = SplitResult(rows.where(F.col("fold_index") == i).drop("fold_index"), strategy, result.params, result.labels, result.groups, {"fold_index": i} | result.extra, result.more) if kfold else result
        stats.append(part.stats({x: n[f"{i}_{x}"] for x in ("train", "test", "val")}))
    report_path = report_path or f"{out_dir}/{'kfold' if kfold else 'split'}_report.json"
    report = {
        "schema_version": VERSION, "kind": "split", "kfold": kfold, "strategy": strategy, "paths": {"input": path, "output_dir": out_dir, "report": report_path},
        "params": result.params | {k: v for k, v in params.items() if k.endswith("_path")}, "stats": stats if kfold else stats[0], "columns": cols or Columns(),
    }
    write_report(report, report_path)
    log.info("split by %s in %.1f s", strategy, time.monotonic() - began)
    return plain(report)
