"""Work that grew with repeats, and plans that were too large, by the findings of round 4."""

import re

from pyspark.sql import functions as F

from lonja.functions import vectors
from lonja.functions.text import char_grams
from lonja.operators import matching, resolvers, training
from lonja.plans import domain

SF = "/root/testdata/sf0.001"


def test_each_text_is_lexed_once(spark, monkeypatch):
    seen = []
    real = domain.with_attributes
    monkeypatch.setattr(domain, "with_attributes", lambda df, text: seen.append(df.count()) or real(df, text))
    rows = [(str(i), f"C{i}", f"LECHE {i % 3} X 170 GR" if i % 4 else None, "CAJA" if i % 2 else "UND") for i in range(40)]
    df = spark.createDataFrame(rows, "RucProveedor string, CodProducto string, Producto string, UnidadMedidaCompra string")
    for prepare in (domain.prepare_invoices, domain.prepare_master):
        out = prepare(df)
        assert out.count() == 40 and seen.pop() == 4
        assert {tuple(r) for r in out.select("Producto", "base", "content", "unit").distinct().collect()} == {(r[0] or "", r[1], r[2], r[3]) for r in real(df.fillna(""), "Producto").select("Producto", "base", "content", F.when(F.col("UnidadMedidaCompra") == "CAJA", "CAJA").otherwise("UNIDAD")).distinct().collect()}
    many = domain.once_a_text(df.select(F.coalesce("Producto", F.lit("")).alias("t"), "CodProducto"), ["t"], lambda texts: texts.withColumn("n", F.length("t")))
    monkeypatch.setattr(domain, "FEW", 1)  # a table of more texts is joined by key
    joined = domain.once_a_text(df.select(F.coalesce("Producto", F.lit("")).alias("t"), "CodProducto"), ["t"], lambda texts: texts.withColumn("n", F.length("t")))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, joined.collect()))


def test_grams(spark):
    df = spark.createDataFrame([("AB CD",), ("A B",), ("",), ("  ",), ("AAAAA",), (None,)], "t string")
    assert [r[0] for r in df.select(char_grams(F.col("t"))).collect()] == [["ABC", "BCD"], ["AB"], [], [], ["AAA"], [None]]


def test_pair_methods_can_be_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the whole plan is there before it runs
    try:
        for name in ("support_scores", "final_scores", "hard_negatives", "candidate_retrieval", "negative_samples"):
            said = (matching.QUERIES | training.QUERIES)[name](spark, SF)._jdf.queryExecution().explainString(mode)
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
            assert sizes and max(sizes) <= 8000, (name, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_resolvers_make_word_lists_once_a_text(spark, monkeypatch):
    """Lists are made on sides: no lambda over words is left where pairs are."""
    seen, real = [], resolvers.once_a_text
    monkeypatch.setattr(resolvers, "once_a_text", lambda df, keys, use: seen.append(tuple(keys)) or real(df, keys, use))
    resolvers.factor_resolution(spark, SF)
    assert seen == [("Producto",), ("UnidadMedidaCompra",), ("f_base", "f_text"), ("m_base", "m_text")]
    facts = spark.createDataFrame([("1", "A", "RED BOLT"), ("1", "B", None), ("1", "C", "")], "ruc string, code string, base string")
    master = spark.createDataFrame([("1", "M", "RED BOLT X", "B1", "C1"), ("1", "N", None, "B2", "C2")], "ruc string, code string, base string, brand string, category string")
    got = {r.code: (r.brand, r.source, r.matched) for r in resolvers.resolve_labels(facts, master).collect()}
    assert got == {"A": ("B1", "similar", "M"), "B": (None, "model", None), "C": (None, "model", None)}


def test_lexicon_shuffles_no_row_s_terms(spark, monkeypatch):
    """Terms are neither written nor shuffled by row; rows of one id, null among them, count once for a term."""
    rows = [(1, "a", "RED RED BOLT"), (2, "a", "RED BOLT"), (2, "a", "RED"), (3, "b", "BOLT"), (None, "a", "RED"), (None, "b", "NUT NUT NUT NUT"), (4, "a", ""), (5, None, "RED")]
    df = spark.createDataFrame(rows, "id long, category string, t string").select("id", "category", training.category_terms(F.col("t")).alias("terms"))
    got = {(r.category, r.term): (r.n, r.precision) for r in training.lexicon(df, least=2, precision=0.0).collect()}
    assert got == {("a", "RED"): (5, 1.666667), ("a", "BOLT"): (2, 0.666667), ("a", "RED BOLT"): (2, 1.0), ("b", "NUT"): (4, 4.0), ("b", "NUT NUT"): (3, 3.0)}
    names = []
    real = training.staged
    monkeypatch.setattr(training, "staged", lambda x, name: names.append(name) or real(x, name))
    training.lexicon_classify(spark, SF)
    assert set(names) == {"repeated-ids", "terms-seen", "lexicon"}


def test_nearest_of_a_cell_is_one_table(monkeypatch):
    """One table a cell, not one a query; ties go by name, and no more than k rows a query are let through."""
    import numpy as np
    import pandas as pd

    rng, made, real = np.random.default_rng(4), [], pd.DataFrame
    for n, m, k in ((7, 9, 3), (5, 2, 3), (1, 1, 1), (40, 30, 30), (6, 50, 1)):
        q, r = ({"v": [list(map(int, x)) for x in rng.integers(0, 3, (size, 4))]} for size in (n, m))
        queries, rows = real(q | {"q": [f"q{i}" for i in range(n)]}), real(r | {"r": [f"r{i}" for i in rng.permutation(m)]})
        monkeypatch.setattr(vectors.pd, "DataFrame", lambda *a, **b: made.append(1) or real(*a, **b))
        got = vectors._nearest(k)(None, queries, rows)
        monkeypatch.setattr(vectors.pd, "DataFrame", real)
        assert len(made) == 1 and not made.clear()
        want = []
        for a, v in zip(queries["q"], queries["v"]):
            every = sorted((-int(np.dot(v, w)), b) for b, w in zip(rows["r"], rows["v"]))[:k]
            want += [(a, b, -s) for s, b in every]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_training_pairs_group_lines_once(spark):
    plan = training.training_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "part.parquet" not in plan
