"""The .npy and FASTA data sources at every cut, cluster maps in file order, and one write for all parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import cli
from granary.operators import splitters as P
from granary.plans import runner
from granary.roles import Columns
from granary.sources import tables as T
from granary.sources.formats import FastaDataSource, FastaReader, NpyDataSource, NpyReader


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">f8", "<i4", "<i8", "|u1", "<f2"])
@pytest.mark.parametrize("split", [1, 37, 1 << 20])
def test_npy(spark, tmp_path, dtype, split):
    m = (np.arange(60).reshape(20, 3) % 100).astype(dtype)
    np.save(f"{tmp_path}/m.npy", m)
    spark.dataSource.register(NpyDataSource)
    df = spark.read.format("npy").option("splitBytes", split).load(f"{tmp_path}/m.npy")
    got = sorted((r.position, r.embedding) for r in df.collect())
    assert [list(map(float, v)) for _, v in got] == m.astype(float).tolist() and [p for p, _ in got] == list(range(20))
    assert df.rdd.getNumPartitions() == len(NpyReader(f"{tmp_path}/m.npy", split).partitions())


def test_npy_errors(tmp_path):
    np.save(f"{tmp_path}/one.npy", np.arange(3.0))
    np.save(f"{tmp_path}/order.npy", np.asfortranarray(np.arange(6.0).reshape(2, 3)))
    np.save(f"{tmp_path}/kind.npy", np.array([["a", "b"]]))
    (tmp_path / "no.npy").write_bytes(b"something else")
    for name, match in (("one", "1 dimensions"), ("order", "column order"), ("kind", "isn't read"), ("no", "not an .npy")):
        with pytest.raises(ValueError, match=match):
            NpyReader(f"{tmp_path}/{name}.npy", 100)


FASTA = ">a first one\nACGT\nAC\n\n>b\n>c  two  words \r\nGG>G\r\nTT\r\n>d\n" + "ACGT" * 30 + "\n>é\nA"


def test_fasta_at_every_cut(tmp_path):
    """Whatever the ranges, each record comes once and whole."""
    path = tmp_path / "x.fasta"
    path.write_bytes(b"; a note\n" + FASTA.encode())
    want = [("a", "first one", "ACGTAC"), ("b", None, ""), ("c", "two  words", "GG>GTT"), ("d", None, "ACGT" * 30), ("é", None, "A")]
    for step in range(1, path.stat().st_size + 2):
        reader = FastaReader(str(path), step)
        assert [r for part in reader.partitions() for r in reader.read(part)] == want, step


def test_fasta_round_trip(spark, peptides, tmp_path):
    T.write_fasta(peptides.coalesce(1), f"{tmp_path}/f", "id", "sequence")
    part = next(p for p in (tmp_path / "f").iterdir() if p.name.startswith("part-"))
    part.rename(tmp_path / "f.fasta")
    spark.dataSource.register(FastaDataSource)
    got = spark.read.format("fasta").option("splitBytes", 100).load(f"{tmp_path}/f.fasta")
    assert sorted((r.id, r.sequence) for r in got.collect()) == sorted((r.id, r.sequence) for r in peptides.collect())
    assert T.read_table(spark, f"{tmp_path}/f.fasta").count() == 60


def test_last_cluster_counts(spark, tmp_path):
    rows = [(f"m{i % 300}", f"c{i}") for i in range(2000)]
    (tmp_path / "c.csv").write_text("id,cluster_id\n" + "".join(f"{a},{b}\n" for a, b in rows))
    (tmp_path / "c.tsv").write_text("".join(f"{b}\t{a}\n" for a, b in rows))
    for name in ("c.csv", "c.tsv"):
        assert {r.member: r.cluster for r in T.read_clusters(spark, f"{tmp_path}/{name}").collect()} == dict(rows)
    found = runner.resolve_inputs(spark, {"cluster_map_path": f"{tmp_path}/c.csv"})["clusters"]
    assert {r.id: r.cluster_id for r in found.collect()} == dict(rows)


@pytest.fixture
def csv(spark, peptides, tmp_path):
    T.write_table(peptides.select("id", "sequence", "label", "group", "y"), f"{tmp_path}/in.csv")
    return f"{tmp_path}/in.csv"


@pytest.mark.parametrize("suffix", [".csv", ".parquet"])
def test_split_files_and_figures(spark, csv, tmp_path, suffix):
    report = runner.run_split(spark, csv, f"{tmp_path}/s", "group", Columns(group="group"), {"test_size": 0.3, "val_size": 0.2}, suffix=suffix)
    parts = {x: T.read_table(spark, f"{tmp_path}/s/{x}{suffix}") for x in ("train", "test", "val")}
    assert {f"n_{x}": df.count() for x, df in parts.items()} == {k: report["stats"][k] for k in ("n_train", "n_test", "n_val")}
    assert parts["train"].columns == ["id", "sequence", "label", "group", "y"] and report["stats"]["group_leak_train_test"] == 0
    assert not [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("_")]


def test_fold_files_are_the_folds(spark, csv, tmp_path):
    """Files, figures and rows of every fold equal those of the folds taken one by one."""
    params = {"n_splits": 3, "val_size": 0.25}
    report = runner.run_split(spark, csv, f"{tmp_path}/k", "stratified_kfold", Columns(label="label"), params)
    result = P.StratifiedKFold(**params).run(T.read_table(spark, csv), Columns(label="label"))
    for i in range(3):
        one = result.fold(i)
        for x in ("train", "test", "val"):
            got = T.read_table(spark, f"{tmp_path}/k/fold_{i:02d}/{x}.csv")
            assert sorted(r.id for r in got.collect()) == sorted(r.id for r in one.part(x).collect())
        assert report["stats"][i]["label_counts"] == {k: {str(c): n for c, n in v.items()} for k, v in one.stats()["label_counts"].items()}
        assert {k: report["stats"][i][k] for k in ("fold_index", "n_total", "n_train", "n_test", "n_val")} == {k: one.stats()[k] for k in ("fold_index", "n_total", "n_train", "n_test", "n_val")}


def test_reduce_figures(spark, csv, tmp_path):
    report = runner.run_reduce(spark, csv, f"{tmp_path}/r.csv", "exact", mapping_path=f"{tmp_path}/m.csv")
    assert report["summary"] == {"n_in": 60, "n_out": 55, "n_removed": 5, "fraction_removed": 5 / 60, "n_mapped_removed": 5}
    assert T.read_table(spark, f"{tmp_path}/r.csv").count() == 55 and T.read_table(spark, f"{tmp_path}/m.csv").count() == 5


def test_validate_clusters_from_the_command_line(spark, csv, tmp_path, capsys):
    (tmp_path / "c.csv").write_text("id,cluster_id\np000,1\np001,1\n")
    assert cli.main(["validate", "-i", csv, "-s", "cluster_aware", "--clusters", f"{tmp_path}/c.csv", "--quiet"]) == 0
    assert '"covered": 2' in capsys.readouterr().out
    (tmp_path / "c.csv").write_text("id,cluster_id\nnobody,1\n")
    assert cli.main(["validate", "-i", csv, "-s", "cluster_aware", "--clusters", f"{tmp_path}/c.csv", "--quiet"]) == 1
    assert cli.main(["validate", "-i", csv, "-s", "cluster_aware", "--quiet"]) == 1


def test_edges_of_other_names(spark, csv, tmp_path):
    (tmp_path / "e.csv").write_text("left,right,far\np000,p001,0.1\np002,p003,0.9\n")
    report = runner.run_reduce(spark, csv, f"{tmp_path}/r.csv", "structural_distance", params={"edges_path": f"{tmp_path}/e.csv", "id1_col": "left", "id2_col": "right", "value_col": "far"})
    assert report["summary"]["n_removed"] == 1
