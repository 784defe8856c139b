"""The commands on the small tables: train, match, attributes, data sets, one query."""

import pytest

from lonja import commands
from lonja.operators import resolvers
from lonja.plans import lifecycle
from lonja.sources import branches

SF = "/root/testdata/sf0.001"


def test_train_and_match(spark, tmp_path, capsys):
    at = ["--data", SF, "--root", str(tmp_path), "--branch", "lima"]
    with pytest.raises(FileNotFoundError):
        commands.main(["match", *at])
    first = commands.main(["train-matcher", *at])
    assert first["promoted"] and first["figures"]["pr_auc"] > 0.5
    again = commands.main(["train-matcher", *at])
    assert not again["promoted"] and again["reason"] == "sin_diferencia_relevante" and "/rejected/" in again["stored"]
    written = commands.main(["match", *at, "--top-k", "2"])["written"]
    assert "data/results/LIMA/match_" in written
    rows = branches.read_results(spark, written)
    assert {r.rank for r in rows.select("rank").distinct().collect()} == {"1", "2"}
    assert rows.groupBy("ruc", "fact", "rank").count().filter("count > 1").isEmpty()


def test_train_and_infer(spark, tmp_path):
    at = ["--data", SF, "--root", f"file:{tmp_path}"]
    with pytest.raises(FileNotFoundError):
        commands.main(["infer", *at])
    assert commands.main(["train-attributes", *at, "--force"])["promoted"]
    model, figures = lifecycle.current(commands.model_folder(f"file:{tmp_path}", None, "attributes"), commands.attributes.Attributes.load)
    assert set(model.numbers) and figures["category"]["n"] > 0
    out = f"{tmp_path}/out"
    (tmp_path / "same.csv").write_text("ruc;other\n1;2\n2;1\n")
    commands.main(["infer", *at, "--out", out, "--format", "parquet", "--equivalents", f"{tmp_path}/same.csv"])
    got = spark.read.parquet(out)
    assert got.count() > 0 and got.filter("factor_sale < 1 OR factor_case < factor_sale").isEmpty()


def test_catalogue_under_equivalent_ids(spark):
    master = spark.createDataFrame([("A", "1"), ("B", "2"), ("C", "3")], "RucProveedor string, CodProducto string")
    sought = lambda *pairs: sorted(tuple(r) for r in resolvers.as_sought(master, spark.createDataFrame(list(pairs), "ruc string, other string")).collect())
    assert sought(("A", "B"), ("B", "A")) == [("A", "2"), ("B", "1"), ("C", "3")]
    assert sought(("D", "C"), ("E", "C")) == [("A", "1"), ("B", "2"), ("C", "3"), ("D", "3"), ("E", "3")]
    assert sought() == [("A", "1"), ("B", "2"), ("C", "3")]


def test_datasets_by_family(spark, tmp_path):
    rows = commands.main(["datasets", "--data", SF, "--root", str(tmp_path), "--branch", "los portales"])["rows"]
    assert sorted(rows) == ["branch_auto_match", "branch_conversions", "branch_invoices", "branch_master"]
    rows = commands.main(["datasets", "--data", SF, "--root", str(tmp_path)])["rows"]
    assert sorted(rows) == ["auto_match_truth", "costed_master", "unit_conversion_facts"] and min(rows.values()) > 0


def test_one_query_and_wrong_names(spark, tmp_path, capsys):
    assert "match_lines" in commands.main(["list"])["queries"]
    out = commands.main(["query", "class_weights", "--data", SF, "--out", f"{tmp_path}/w", "--format", "parquet"])["written"]
    assert spark.read.parquet(out).count() > 0
    for wrong in (["query", "nothing", "--data", SF, "--out", "x"], ["nothing"], ["match"]):
        with pytest.raises(SystemExit):
            commands.main(wrong)
    with pytest.raises(ValueError, match="--lock"):
        commands.lock_of("s3a://models", None, "matcher", None)
