"""Branches, files, promotion, locks and models."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lonja.operators import branch, catalogue
from lonja.plans import lifecycle
from lonja.plans.lifecycle import Metric, compare
from lonja.sources import branches

SF = "/root/testdata/sf0.001"


def test_configuration_and_queries(spark, tmp_path):
    env = {"SQL_LIMA_HOST_DB": "h", "SQL_LIMA_USER_DB": "u", "SQL_LIMA_PASS_DB": "p", "SQL_LIMA_NAME_DB": "n", "SQL_CUZCO_NAME_DB": "x", "PATH": "y"}
    found = branches.configured(env)
    assert found == {"LIMA": {"host": "h", "user": "u", "pass": "p", "name": "n"}}
    assert branches.jdbc_options(found["LIMA"])["url"].startswith("jdbc:sqlserver://h;databaseName=n")
    q = branches.Queries([("PORTALES", branch.QUERIES), ("", catalogue.QUERIES)])
    assert q.of("Los Portales-1") is branch.QUERIES and q.of("rex") is catalogue.QUERIES
    (tmp_path / "q.sql").write_text("SELECT 1 AS one")
    assert q.run(spark, "rex", "group_split", SF, {"SQL_REX_GROUP_SPLIT_QUERY_FILE": str(tmp_path / "q.sql")}).first().one == 1
    assert q.run(spark, "portales", "branch_invoices", SF, {}).count() > 0


def test_folders(tmp_path):
    made = branches.folders(str(tmp_path), "los portales", create=True)
    assert made["data/raw"].endswith("data/raw/LOS_PORTALES") and os.path.isdir(made["artifacts"])
    assert branches.folders(str(tmp_path), None)["data/raw"].endswith("data/raw") and branches.known_branches(str(tmp_path)) == ["default", "LOS_PORTALES"]


def test_delimited_files(spark, tmp_path):
    df = spark.createDataFrame([("007", None, 1.5), ("8", "ñ;x", None)], "CodProducto string, Producto string, Costo double")
    path = str(tmp_path / "out")
    branches.save_delimited(df, path, sep=";")
    assert next(p for p in os.scandir(path) if p.name.startswith("part")) and open(next(p.path for p in os.scandir(path) if p.name.endswith(".csv")), "rb").read(3) == b"\xef\xbb\xbf"
    with pytest.raises(Exception, match="(?i)exists"):
        branches.save_delimited(df, path, sep=";")
    back = branches.read_results(spark, path, ";")
    assert back.columns == df.columns and {r.CodProducto for r in back.collect()} == {"007", "8"}
    for _ in range(2):
        branches.append_results(df, str(tmp_path / "all"))
    assert branches.read_results(spark, str(tmp_path / "all")).count() == 4
    assert branches.results_path("r/", "homologacion", datetime(2024, 1, 2, 3, 4, 5)) == "r/homologacion_20240102_030405_000000"
    assert branches.first_existing(spark, [str(tmp_path / "no"), path], ["Producto", "CodProducto", "Nada"], ";").columns == ["Producto", "CodProducto"]
    assert branches.first_existing(spark, [str(tmp_path / "no")], ["a"]) is None
    assert branches.exported(df, ["Costo", "x", "CodProducto"]).columns == ["Costo", "CodProducto"]


def test_conversion_file_and_datasets(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\ufeffRucProveedor;FactorCantidadCompra;Muestras;MuestrasModa;ConfianzaModa\n01;12;3;2;0.5\n02;0;1;1;1\n03;x;1;1;1\n", encoding="utf-8")
    assert [tuple(r) for r in branches.conversion_file(spark, str(tmp_path / "c.csv")).collect()] == [("01", 12.0, 3, 2, 0.5)]
    q = branches.Queries([("", {"class_weights": catalogue.class_weights})])
    assert branches.generate_datasets(spark, "rex", q, SF, str(tmp_path), {}) == {"class_weights": 6}
    with pytest.raises(Exception, match="(?i)exists"):
        branches.generate_datasets(spark, "rex", q, SF, str(tmp_path), {})
    assert branches.generate_datasets(spark, "rex", q, SF, str(tmp_path), {}, overwrite=True) == {"class_weights": 6}
    words = spark.createDataFrame([("b", "y", 1), ("a", "x", 2), ("a", "z", 1)], "category string, term string, rank int")
    branches.save_lexicon(words, str(tmp_path / "l.json"))
    assert sorted(map(tuple, branches.load_lexicon(spark, str(tmp_path / "l.json")).collect())) == [("a", "x", 2), ("a", "z", 1), ("b", "y", 1)]


def test_promotion():
    specs = [Metric("eval.f1", "f1"), Metric("eval.mae", "mae", higher_is_better=False)]
    report = lambda f1, mae: {"eval": {"f1": f1, "mae": mae}}
    say = lambda a, b, **k: tuple(compare(a, b, specs, **k)[x] for x in ("promoted", "reason"))
    assert say(report(0.5, 1), None) == (True, "no_hay_modelo_anterior")
    assert say(report(0.5, 1), report(0.5, 1)) == (False, "sin_diferencia_relevante")
    assert say(report(0.50005, 0.9), report(0.5, 1)) == (True, "mejora_en_mae")
    assert say(report(0.4, 0.5), report(0.5, 1)) == (False, "empeora_en_f1")
    assert say(report(0.4, 1), report(0.5, 1), force=True) == (True, "force_replace__empeora_en_f1")
    assert say(report(0.5, 1), report(0.5, 1), force=True) == (True, "force_replace")
    assert say({}, report(0.5, 1)) == (False, "sin_diferencia_relevante")


def test_lock(tmp_path):
    path = str(tmp_path / "a" / "lock")
    with lifecycle.training_lock(path):
        with pytest.raises(RuntimeError, match=str(os.getpid())):
            with lifecycle.training_lock(path):
                pass
    assert not os.path.exists(path)
    open(path, "w").write("999999999")  # a process that is no more
    with lifecycle.training_lock(path):
        assert open(path).read() == str(os.getpid())


def test_models(spark, tmp_path):
    rows = spark.range(400).select((F.rand(1) + F.col("id") % 2).alias("a"), F.rand(2).alias("b"), (F.col("id") % 2).cast("int").alias("label"), F.log1p(F.col("id") % 7).alias("t"), (F.col("id") % 7).cast("double").alias("c"))
    model = lifecycle.fit_ranker(rows, ["a", "b"])
    told = lifecycle.predict_pairs(model, rows)
    assert set(told.columns) == {*rows.columns, "model"} and told.filter((F.col("model") > 0.5) == (F.col("label") == 1)).count() > 380
    folder = str(tmp_path / "m")
    assert lifecycle.current(folder) is None
    for run, verdict in (("r1", {"promoted": True}), ("r2", {"promoted": False}), ("r3", {"promoted": True})):
        lifecycle.settle(model, {"f1": run}, verdict, folder, run)
    kept, report = lifecycle.current(folder)
    assert report == {"f1": "r3"} and lifecycle.predict_pairs(kept, rows).count() == 400
    assert os.path.exists(f"{folder}/archive/before-r3") and os.path.exists(f"{folder}/rejected/r2/report.json")
    net = lifecycle.fit_attribute(rows.withColumn("c", F.log1p("c")), ["c"], "t")
    off = lifecycle.predict_attribute(net, rows.withColumn("c", F.log1p("c")), "told").select(F.max(F.abs(F.col("told") - F.expm1("c")))).first()[0]
    assert off < 0.1


def test_lock_of_another_machine_stays(tmp_path):
    """A process id of another host may be anything here: its lock is never taken over, one of this host's dead process is."""
    import json
    import socket

    path = str(tmp_path / "lock")
    open(path, "w").write("999999999")
    for host, stays in (("another", True), (socket.gethostname(), False)):
        open(f"{path}.owner", "w").write(json.dumps({"host": host, "since": "2024"}))
        if stays:
            with pytest.raises(RuntimeError, match="another since 2024"), lifecycle.training_lock(path):
                pass
            assert os.path.exists(path) and open(path).read() == "999999999"
        else:
            with lifecycle.training_lock(path):
                assert json.load(open(f"{path}.owner"))["pid"] == os.getpid()
    assert os.listdir(tmp_path) == []


def test_stores_keep_their_scheme(spark, tmp_path):
    """Roots with a scheme are joined as they are, and everything goes through Spark's file systems."""
    assert branches.folders("s3a://bucket/x", "los portales")["data/raw"] == "s3a://bucket/x/data/raw/LOS_PORTALES"
    root = f"file:{tmp_path}"
    made = branches.folders(root, "lima", create=True)
    assert made["artifacts"] == f"{root}/artifacts/LIMA" and (tmp_path / "artifacts" / "LIMA").is_dir()
    assert branches.known_branches(root) == ["default", "LIMA"] and branches.known_branches(f"{root}/none") == ["default"]
    rows = spark.range(40).select((F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    model = lifecycle.fit_ranker(rows, ["a"])
    for run in ("r1", "r2"):
        lifecycle.settle(model, {"run": run}, {"promoted": True}, made["artifacts"], run)
    kept, report = lifecycle.current(made["artifacts"])
    assert report == {"run": "r2"} and lifecycle.predict_pairs(kept, rows).count() == 40 and (tmp_path / "artifacts/LIMA/archive/before-r2/report.json").exists()
    words = spark.createDataFrame([("a", "ñ", 1)], "category string, term string, rank int")
    branches.save_lexicon(words, f"{root}/l.json")
    assert [tuple(r) for r in branches.load_lexicon(spark, f"{root}/l.json").collect()] == [("a", "ñ", 1)]
