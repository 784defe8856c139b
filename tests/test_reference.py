"""Golden cases of the parsers, readers, and the registered queries against their SQL."""

import re

import pytest
from pyspark.sql import functions as F

from lonja.functions import parsing, similarity, text
from lonja.operators import attributes, blocking, branch, catalogue, examples, lines, matching, ordering, programs, ranking, resolvers, training, vocabularies
from lonja.operators.catalogue import mode_dictionary
from lonja.plans import examples_sql, lines_sql, matching_sql, training_sql, vocabulary_sql
from lonja.plans.oracle import ORACLE_SQL
from lonja.sources import tables

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.QUERIES | branch.QUERIES | matching.QUERIES | training.QUERIES | resolvers.QUERIES | lines.QUERIES | blocking.QUERIES | vocabularies.QUERIES | ordering.QUERIES | ranking.QUERIES | examples.QUERIES | attributes.QUERIES | programs.QUERIES
SQL = ORACLE_SQL | branch.SQL | matching_sql.SQL | training_sql.SQL | resolvers.SQL | lines_sql.SQL | blocking.SQL | vocabulary_sql.SQL | ordering.SQL | examples_sql.SQL | programs.SQL
#: What other queries here contain as a step.
STEPS = ("support_scores", "final_scores", "prepared_master", "prepared_invoices", "hybrid_candidates")


TEXTS = {
    "LECHE / GLORIA": "LECHE GLORIA", "ARROZ - COSTENO": "ARROZ COSTENO", "500.": "500", "PE-XTRA": "PE-XTRA", "170GRX48": "170 GR X 48", "LTX12": "LT X 12", "3LX6": "3 L X 6",
    "CAF&Eacute; &amp; TE": "CAFE TE", "&#65;&#x42;C": "ABC", "<b>PAN</b> DULCE": "PAN DULCE", "6UND1KG": "6 UND 1 KG", "LUMCARB500ML": "LUMCARB 500 ML", "12.5KG": "12.5 KG", "A.B.C": "A B C",
    "029-MACA": "029-MACA", "C/IMPR": "C/IMPR", "XTREME": "X TREME", "CJAX24": "CJA X 24", "48XUND": "48 X UND", "AGUA@#@RESTO": "AGUA", "PAN [COD123 FRESCO": "PAN FRESCO", "ŞEKER Ğ Ő": "SEKER G O",
    "CAJA DISPLEY ONZAS": "CJA DP OZ", "16-6 PCK": "16-6 PCK", "": "", "...": "", "10 X 20 CM": "10 X 20 CM", "LUXE": "LUXE", "UNDX12": "UND X 12", "A+B*C|D_E": "A B C D E", "1/2 KG": "1/2 KG",
}


def test_lexer(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert {r.t: r.x for r in df.select("t", text.product_text(F.col("t")).alias("x")).collect()} == TEXTS
    again = df.select(text.product_text(F.col("t")).alias("x")).select("x", text.product_text(F.col("x")).alias("y")).collect()
    assert all(r.x == r.y for r in again)


ATTRIBUTES = {
    "ATUN FLORIDA 48 X 170 GR": ("ATUN FLORIDA", 48.0, 170.0, 8160.0, "MASS", 0.17, "ATUN FLORIDA FC_48 CONT_170 TIPO_MASS"),
    "GALLETA RITZ 12 GR X 6 X 60 UND": ("GALLETA RITZ", 360.0, 12.0, 4320.0, "MASS", 0.012, "GALLETA RITZ FC_360 CONT_12 TIPO_MASS"),
    "INKA KOLA 500ML": ("INKA KOLA", 1.0, 500.0, 500.0, "VOLUME", 0.0, "INKA KOLA CONT_500 TIPO_VOLUME"),
    "PAÑAL HUGGIES CJAX24": ("PANAL HUGGIES", 24.0, 0.0, 0.0, "NONE", 0.0, "PANAL HUGGIES FC_24"),
    "": ("", 1.0, 0.0, 0.0, "NONE", 0.0, ""),
    "ATUN 170GRX48": ("ATUN", 48.0, 170.0, 8160.0, "MASS", 0.17, "ATUN FC_48 CONT_170 TIPO_MASS"),
    "ACEITE 1LTX12": ("ACEITE", 12.0, 1000.0, 12000.0, "VOLUME", 0.0, "ACEITE FC_12 CONT_1000 TIPO_VOLUME"),
    "AGUA 3LX6": ("AGUA", 6.0, 3000.0, 18000.0, "VOLUME", 0.0, "AGUA FC_6 CONT_3000 TIPO_VOLUME"),
    "SOPA 16-6 PCK": ("SOPA", 96.0, 0.0, 0.0, "NONE", 0.0, "SOPA FC_96"),
    "CLAVOS 12 X 10": ("CLAVOS", 120.0, 0.0, 0.0, "NONE", 0.0, "CLAVOS FC_120"),
    "TABLA 10 X 20 CM": ("TABLA CM", 1.0, 0.0, 0.0, "NONE", 0.0, "TABLA CM"),
    "CHICLE 7 MENTA": ("CHICLE 7 MENTA", 1.0, 0.0, 0.0, "NONE", 0.0, "CHICLE 7 MENTA"),
    "029-MACA 1/2 KG": ("MACA", 1.0, 500.0, 500.0, "MASS", 0.5, "MACA CONT_500 TIPO_MASS"),
    "CAFE PE 2 LB": ("CAFE", 1.0, 907.184, 907.184, "MASS", 0.907184, "CAFE CONT_907 TIPO_MASS"),
    "JABON CJA X 24 UND X 6": ("JABON", 144.0, 0.0, 0.0, "NONE", 0.0, "JABON FC_144"),
    "LECHE 1.5 LT X 6": ("LECHE", 6.0, 1500.0, 9000.0, "VOLUME", 0.0, "LECHE FC_6 CONT_1500 TIPO_VOLUME"),
    "24 UND": ("24 UND", 24.0, 0.0, 0.0, "NONE", 0.0, "24 UND FC_24"),
}


def test_attributes(spark):
    df = parsing.with_attributes(spark.createDataFrame([(t,) for t in ATTRIBUTES], "t string"), "t").select("t", "base", "factor", "content", "total", "kind", "kg", "model_text")
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == ATTRIBUTES


SIGNALS = {
    "ATUN FLORIDA 48 X 170 GR": (48, 48, 0.90, "pre_measure_count"), "GALLETA RITZ 12 GR X 6 X 60 UND": (60, 360, 0.96, "after_measure_chain"), "PAÑAL HUGGIES CJAX24": (24, 24, 0.88, "explicit_pack_tokens"),
    "CARAMELO 5 GR X 20-50": (20, 1000, 0.97, "after_measure_hyphen"), "TE 2 GR X 25": (25, 25, 0.93, "after_measure_single"), "TE 2 GR 25": (25, 25, 0.93, "after_measure_single"), "CLAVOS 12 X 10": (12, 120, 0.91, "generic_x_chain"),
    "CLAVOS 6 X 5 X 10": (6, 50, 0.89, "generic_x_chain"), "CLAVOS 6 X 1": (6, 6, 0.84, "generic_x_chain"), "SOPA 16-6 PCK": (6, 96, 0.93, "explicit_pack_tokens"), "TABLA 10 X 20 CM": (1, 1, 0.0, ""),
    "VINO": (1, 1, 0.0, ""), "": (0, 0, 0.0, ""), "ATUN 170GRX48": (48, 48, 0.93, "after_measure_single"), "3 PCK 12 UND": (12, 36, 0.93, "explicit_pack_tokens"),
}


def test_pack_signals(spark):
    df = parsing.with_pack_signals(spark.createDataFrame([(t,) for t in SIGNALS], "t string"), "t").select("t", "factor_sale", "factor_case", "strength", "source")
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == SIGNALS


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(text.unit(F.lit(u))) for u in ("NIU", "CAJA", "BX", "LTR", "GR")] == ["UNIDAD", "CAJA", "CAJA", "LT", "GR"]
    assert one(text.code(F.lit(" ab 12 "))) == "AB12" and one(text.tax_id(F.lit("20100190797.0"))) == "20100190797"
    assert one(text.robust_code(F.lit("12345.00"))) == "12345" and one(text.robust_code(F.lit("1.2E+5"))) == "120000"
    assert [one(similarity.round_quantity(F.lit(x))) for x in (2.9995, 2.5, -1.0)] == [3.0, 2.5, 0.0]
    assert one(similarity.relative_similarity(F.lit(0.0), F.lit(5.0), 3.0)) == 0.5 and one(similarity.relative_similarity(F.lit(5.0), F.lit(5.0), 3.0)) == 1.0
    assert [one(similarity.units_per_sale(F.lit(a), F.lit(b))) for a, b in ((60.0, 360.0), (7.0, 10.0))] == [6.0, 1.0]
    assert one(text.product_text(F.lit("XTREME"))) == "X TREME"
    assert tables.tenant_id("Los Portales-1") == "LOS_PORTALES_1" and tables.tenant_id("") == "default"


def test_mode_dictionary(spark):
    for pairs, want in (([(12, 1), (24, 2), (10, 1)], (12.0, 3, 2, 0.666667)), ([(12, 1), (10, 1)], (10.0, 2, 1, 0.5))):
        facts = spark.createDataFrame([("k", a / b) for a, b in pairs], "k string, factor double")
        assert tuple(mode_dictionary(facts, ["k"]).first())[1:] == want


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ruc;CodProducto;CostoCaja\n1;007;x\n2;;3.5\n", encoding="utf-8")
    df = tables.typed(tables.rename_aliases(tables.delimited(spark, str(tmp_path / "a.csv")), {"RucProveedor": ["RUC"]}))
    assert [tuple(r) for r in df.orderBy("RucProveedor").collect()] == [("1", "007", 0.0), ("2", "", 3.5)]
    with pytest.raises(KeyError):
        tables.require(df, ["Producto"], "invoices")
    assert tables.items(spark, [{"CodProducto": "01", "Cantidad": 2}, {}]).count() == 2


@pytest.mark.parametrize("name", [n for n in SQL if n not in STEPS])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    say = lambda v: repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    rows = lambda cols, data: sorted(tuple(say(r[cols.index(c)]) for c in sorted(cols)) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_keyed_matching_has_no_cross_join(spark):
    for name in ("exact_code_match", "match_decision", "composite_key_match", "embedding_topk", "branch_auto_match"):
        assert not re.search("CartesianProduct" if name.startswith("branch") else "CartesianProduct|BroadcastNestedLoop", QUERIES[name](spark, SF)._jdf.queryExecution().toString())
