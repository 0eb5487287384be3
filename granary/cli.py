"""Command line: reduce, split, validate, info, doctor."""

from __future__ import annotations

import argparse
import importlib.util
import json
import logging
import shutil
import sys

from .roles import Columns


def _logging(level: str, quiet: bool, file: str | None) -> None:
    handlers: list[logging.Handler] = [] if quiet else [logging.StreamHandler()]
    if file:
        handlers.append(logging.FileHandler(file, mode="a", encoding="utf-8"))
    logging.basicConfig(level=level.upper(), handlers=handlers or [logging.NullHandler()], force=True, format="%(asctime)s %(levelname)s %(message)s")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary", description="Reduce redundancy and split datasets without leakage, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("reduce", "split", "validate"):
        c = sub.add_parser(name)
        c.add_argument("-i", "--input", required=True)
        c.add_argument("-s", "--strategy", required=name != "validate")
        c.add_argument("--id-column", default="id")
        c.add_argument("--sequence-column", default="sequence")
        c.add_argument("--label-column", default="label")
        c.add_argument("--group-column")
        c.add_argument("--date-column")
        c.add_argument("--report-output")
        c.add_argument("--params")
        c.add_argument("--set", action="append", default=[], metavar="STRATEGY.NAME=VALUE")
        c.add_argument("--csv-separator", default=",")
        c.add_argument("--encoding", default="UTF-8")
        c.add_argument("--log-level", default="INFO")
        c.add_argument("--quiet", action="store_true")
        c.add_argument("--log-file")
    sub.choices["reduce"].add_argument("-o", "--output", required=True)
    sub.choices["reduce"].add_argument("--mapping-output")
    sub.choices["split"].add_argument("-o", "--output-dir", required=True)
    for a in ("--embeddings", "--embedding-ids", "--edges", "--clusters", "--clusters-format"):
        sub.choices["validate"].add_argument(a)
    sub.choices["validate"].add_argument("--fail-fast", action="store_true")
    info = sub.add_parser("info")
    info.add_argument("--kind", choices=("all", "reduce", "split"), default="all")
    info.add_argument("--show-defaults", action="store_true")
    sub.add_parser("doctor")
    return p


def _info(args) -> int:
    from .plans import registry

    for kind in ("reduce", "split") if args.kind == "all" else (args.kind,):
        print(f"{kind}:")
        for name in sorted(registry.KINDS[kind]):
            print(f"  {name}")
            if args.show_defaults:
                for k, v in registry.defaults(kind, name).items():
                    print(f"    {k} = {v!r}")
    return 0


def _doctor() -> int:
    needed = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "numpy")} | {"java": shutil.which("java") is not None}
    optional = {m: importlib.util.find_spec(m) is not None for m in ("yaml", "xxhash", "tokenizers")}
    for name, ok in needed.items():
        print(f"{'ok' if ok else 'MISSING'}  {name}")
    for name, ok in optional.items():
        print(f"{'ok' if ok else 'absent'}  {name} (optional)")
    return int(not all(needed.values()))


def _work(args) -> int:
    from pyspark.sql import SparkSession

    from .plans import runner
    from .sources.params import apply_overrides, load_params

    _logging(args.log_level, args.quiet, args.log_file)
    spark = SparkSession.builder.appName(f"granary-{args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cols = Columns(args.id_column, args.sequence_column, args.label_column, args.group_column, None, args.date_column)
    if args.command == "validate":
        from .plans.validate import validate
        from .sources.tables import read_clusters, read_embeddings, read_table

        emb = read_embeddings(spark, args.embeddings, args.embedding_ids) if args.embeddings else None
        edges = read_table(spark, args.edges) if args.edges else None
        clusters = read_clusters(spark, args.clusters, args.clusters_format) if args.clusters else None
        df = read_table(spark, args.input, sep=args.csv_separator, encoding=args.encoding)
        report = validate(df, cols, args.strategy, emb, edges, fail_fast=args.fail_fast, clusters=clusters)
        if args.report_output:
            runner.write_report(report, args.report_output)
        print(json.dumps(runner.plain(report), indent=2))
        return int(not report["ok"])
    params = apply_overrides(load_params(args.params, args.strategy), args.strategy, args.set)
    common = dict(cols=cols, params=params, report_path=args.report_output, sep=args.csv_separator, encoding=args.encoding)
    if args.command == "reduce":
        runner.run_reduce(spark, args.input, args.output, args.strategy, mapping_path=args.mapping_output, **common)
    else:
        runner.run_split(spark, args.input, args.output_dir, args.strategy, **common)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _info(args) if args.command == "info" else _doctor() if args.command == "doctor" else _work(args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # a command ends with a message, not a trace
        print(f"error: {e}", file=sys.stderr)
        return 1
