"""Sources, sinks, parameters, runners, validation, command line, streaming."""

import json

import numpy as np
import pytest

from granary import cli
from granary.plans import registry, runner
from granary.plans.validate import validate
from granary.sources import params as par
from granary.sources import tables as T
from granary.streaming.exact import reduce_stream


@pytest.fixture()
def csv(peptides, tmp_path):
    T.write_table(peptides, f"{tmp_path}/in.csv")
    return f"{tmp_path}/in.csv"


def test_run_reduce(spark, csv, tmp_path):
    report = runner.run_reduce(spark, csv, f"{tmp_path}/out.csv", "exact", mapping_path=f"{tmp_path}/map.csv", report_path=f"{tmp_path}/r/report.json")
    assert report["summary"] == {"n_in": 60, "n_out": 55, "n_removed": 5, "fraction_removed": 5 / 60, "n_mapped_removed": 5}
    assert T.read_table(spark, f"{tmp_path}/out.csv").count() == 55 and T.read_table(spark, f"{tmp_path}/map.csv").count() == 5
    assert json.load(open(f"{tmp_path}/r/report.json"))["schema_version"] == "0.1"


def test_empty_mapping_has_its_columns(spark, tmp_path):
    T.write_table(spark.createDataFrame([("a", "X"), ("b", "Y")], "id string, sequence string"), f"{tmp_path}/i.csv")
    runner.run_reduce(spark, f"{tmp_path}/i.csv", f"{tmp_path}/o.csv", "exact", mapping_path=f"{tmp_path}/m.csv")
    assert open(f"{tmp_path}/m.csv").read().strip() in ("", "removed_id,representative_id,cluster_id,score")


def test_run_split(spark, csv, tmp_path):
    report = runner.run_split(spark, csv, f"{tmp_path}/s", "random", params={"val_size": 0.1})
    assert (report["stats"]["n_train"], report["stats"]["n_val"], report["stats"]["n_test"]) == (42, 6, 12)
    assert T.read_table(spark, f"{tmp_path}/s/test.csv").count() == 12 and T.read_table(spark, f"{tmp_path}/s/val.csv").count() == 6
    report = runner.run_split(spark, csv, f"{tmp_path}/k", "random_kfold", params={"n_splits": 3})
    assert report["kfold"] and len(report["stats"]) == 3 and T.read_table(spark, f"{tmp_path}/k/fold_02/test.csv").count() == 20


def test_embeddings_npy(spark, tmp_path):
    np.save(f"{tmp_path}/e.npy", np.arange(12.0).reshape(4, 3))
    open(f"{tmp_path}/ids.csv", "w").write("id\na\nb\nc\nd\n")
    got = T.read_embeddings(spark, f"{tmp_path}/e.npy", f"{tmp_path}/ids.csv")
    assert {r.id: list(r.embedding) for r in got.collect()}["b"] == [3.0, 4.0, 5.0]
    open(f"{tmp_path}/ids.csv", "w").write("id\na\n")
    with pytest.raises(ValueError):
        T.read_embeddings(spark, f"{tmp_path}/e.npy", f"{tmp_path}/ids.csv")


def test_edges_clusters_fasta(spark, peptides, tmp_path):
    open(f"{tmp_path}/e.csv", "w").write("id1,id2,distance\na,b,0.5\n")
    assert T.read_edges(spark, f"{tmp_path}/e.csv", both_ways=True).count() == 2
    with pytest.raises(ValueError):
        T.read_edges(spark, f"{tmp_path}/e.csv", value_col="nope")
    open(f"{tmp_path}/c.tsv", "w").write("r\tr\nr\tx\n")
    assert {r.member: r.cluster for r in T.read_clusters(spark, f"{tmp_path}/c.tsv").collect()} == {"r": "r", "x": "r"}
    open(f"{tmp_path}/c.csv", "w").write("id,cluster_id\na,1\na,2\n")
    assert {r.member: r.cluster for r in T.read_clusters(spark, f"{tmp_path}/c.csv").collect()} == {"a": "2"}  # the last counts
    T.write_fasta(peptides.limit(2), f"{tmp_path}/f", "id", "sequence")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/f").collect()]
    assert len(lines) == 4 and sum(x.startswith(">") for x in lines) == 2


def test_params(tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"random": {"seed": 1}}))
    assert par.load_params(str(p), "random") == {"seed": 1}
    with pytest.warns(UserWarning):
        assert par.load_params(str(p), "time") == {}
    assert par.apply_overrides({"seed": 1}, "random", ["random.seed=2", "random.a.b=x", "time.seed=9"]) == {"seed": 2, "a": {"b": "x"}}
    with pytest.raises(ValueError):
        par.apply_overrides({}, "random", ["seed=2"])
    with pytest.raises(FileNotFoundError):
        par.load_params(str(tmp_path / "no.json"), "random")


def test_registry():
    assert len(registry.KINDS["reduce"]) == 8 and len(registry.KINDS["split"]) == 16
    assert registry.defaults("split", "random") == {"test_size": 0.2, "val_size": 0.0, "seed": 13}
    with pytest.raises(ValueError):
        registry.build("reduce", "exact", {"x": 1})


def test_validate(spark, peptides, vectors):
    assert validate(peptides, strategy="exact", embeddings=vectors)["checks"]["embeddings"]["covered"] == 50
    bad = validate(spark.createDataFrame([("a", "", "x"), ("a", "S", "1")], "id string, sequence string, desc_0 string"))
    assert not bad["ok"] and [e.split(":")[0] for e in bad["errors"]] == ["ids", "sequences", "descriptors"]
    assert not validate(peptides, strategy="structural_distance")["ok"]
    with pytest.raises(ValueError):
        validate(peptides.unionByName(peptides), fail_fast=True)


def test_cli(spark, csv, tmp_path, capsys):
    assert cli.main(["info", "--show-defaults"]) == 0 and "kmer_jaccard" in capsys.readouterr().out
    assert cli.main(["doctor"]) == 0
    assert cli.main(["reduce", "-i", csv, "-o", f"{tmp_path}/o.csv", "-s", "kmer_jaccard", "--set", "kmer_jaccard.threshold=0.4", "--quiet"]) == 0
    assert cli.main(["split", "-i", csv, "-o", f"{tmp_path}/sp", "-s", "stratified", "--quiet"]) == 0
    assert cli.main(["reduce", "-i", csv, "-o", f"{tmp_path}/o.csv", "-s", "nope", "--quiet"]) == 1
    assert cli.main(["validate", "-i", csv, "--quiet"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["reduce"])


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id int, sequence string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("id int, sequence string, ts timestamp").parquet(f"{tmp_path}/s")
    q = reduce_stream(stream, "sequence", "ts").writeStream.format("memory").queryName("reduced").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("reduced").count() == 2


def test_reports_have_the_strategys_figures(spark, peptides, vectors):
    """Distances, bins, label figures with medians, time ranges, group counts and cluster sources."""
    import statistics

    from granary.plans import runner
    from granary.plans.validate import validate
    from granary.roles import Columns

    got = runner.split(peptides, "stratified_numeric", n_bins=4, test_size=0.25).stats()
    ys = {s: [r.y for r in runner.split(peptides, "stratified_numeric", n_bins=4, test_size=0.25).part(s).collect()] for s in ("train", "test")}
    assert got["n_bins"] == 4 and sum(sum(x.values()) for x in got["bin_counts"].values()) == 60
    for part, y in ys.items():
        assert abs(got["label_stats"][part]["median"] - statistics.median(y)) < 1e-9 and got["label_stats"][part]["n"] == len(y)
        assert abs(got["label_stats"][part]["std"] - statistics.stdev(y)) < 1e-9
    far = runner.split(peptides, "distance_aware", embeddings=vectors).stats()["distance_stats"]
    assert far["test"]["min"] >= far["train"]["max"] and far["global"]["n"] == 50
    folds = runner.split(peptides, "distance_aware_kfold", embeddings=vectors, n_splits=3).fold(0).stats()
    assert folds["fold_index"] == 0 and folds["distance_stats"]["global"]["n"] == 50
    times = runner.split(peptides, "time", Columns(date="date")).stats()["time_ranges"]
    assert times["train"]["last"] <= times["test"]["first"]
    groups = runner.split(peptides, "group", Columns(group="group")).stats()
    assert groups["group_n_total"] == 7 and groups["group_n_train"] + groups["group_n_test"] == 7
    clusters = runner.split(peptides, "cluster_aware").stats()
    assert clusters["cluster_source"] == "column" and clusters["n_missing_clusters"] == 0
    assert not validate(peptides.drop("desc_0", "desc_1"), strategy="distance_aware")["ok"]
    assert validate(peptides, strategy="distance_aware_kfold")["ok"] and validate(peptides, strategy="cluster_aware")["ok"]
    assert not validate(peptides.drop("cluster_id"), strategy="cluster_aware")["ok"]
    assert validate(peptides, Columns(label="y"), strategy="stratified_numeric")["ok"] and not validate(peptides, Columns(label="group"), strategy="stratified_numeric")["ok"]
