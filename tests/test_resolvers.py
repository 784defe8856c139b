"""Resolver cascades, candidate gates and fallbacks on small tables, with results worked out by hand."""

import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lonja.operators import matching, resolvers
from lonja.operators.catalogue import embedding_topk
from lonja.plans import domain
from lonja.sources.staging import staged

CATALOGUE = [
    ("1", "7", "ATUN FLORIDA 24 X 170 GR", "CAJA", 10.0), ("1", "55", "GALLETA RITZ 12 GR X 6 X 60 UND", "CAJA", 20.0), ("1", "70", "LECHE GLORIA 400 GR", "UND", 3.0),
    ("2", "80", "CLAVOS ACERO", "UND", 5.0), ("2", "81", "MARTILLO ACERO GRANDE", "UND", 9.0),
]
ROWS = [
    ("1", "007", "ATUN FLORIDA 48 X 170 GR", "CAJA", 11.0), ("1", "X9", "GALLETA RITZ 12 GR X 6 X 60 UND", "CAJA", 20.0), ("1", "Z", "VINO ROJO", "UND", 8.0), ("9", "Q", "TORNILLO 12 X 10", "UND", 1.0),
    ("1", "A", "ANTICIPO DE COMPRA", "UND", 1.0), ("2", "N", "MARTILLO ACERO GRANDE", "UND", 9.0),
]
COLUMNS = "RucProveedor string, CodProducto string, Producto string, UnidadMedidaCompra string, CostoCaja double"


@pytest.fixture(scope="module")
def sides(spark):
    master = domain.with_targets(domain.prepare_master(spark.createDataFrame(CATALOGUE, COLUMNS)))
    return staged(resolvers.facts_side(domain.prepare_invoices(spark.createDataFrame(ROWS, COLUMNS))), "f"), staged(resolvers.master_side(master), "m")


def test_factor_cascade(sides):
    got = {r.f_code: (r.sale, r.case, r.source, r.matched) for r in resolvers.resolve_factors(*sides).collect()}
    assert got["007"] == (24.0, 24.0, "exact", "7")  # a signal of 0.90 does not override a row of the same code by its factor alone
    assert got["X9"] == (60.0, 360.0, "text>similar_same_ruc", None)
    assert got["Z"][2:] == ("model", None) and got["Q"] == (12.0, 120.0, "text", None)
    assert got["N"] == (1.0, 1.0, "similar_same_ruc", "81") and len(got) == len(ROWS)


def test_weight_cascade(sides):
    factors = resolvers.resolve_factors(*sides)
    got = {r.f_code: (r.weight, r.weight_case, r.source) for r in resolvers.resolve_weights(*sides, factors).collect()}
    assert got["A"] == (0.0, 0.0, "not_physical") and got["Z"] == (None, None, "model")
    assert got["007"] == (0.17, pytest.approx(0.17 * 24), "exact")
    assert got["X9"][0] == pytest.approx(0.012 * 6)  # six pieces a unit of sale


def test_labels(spark):
    facts = spark.createDataFrame([("1", "7", "ATUN"), ("1", "x", "LECHE GLORIA ENTERA"), ("1", "y", "VINO"), ("3", "7", "ATUN")], "ruc string, code string, base string")
    master = spark.createDataFrame([("1", "7", "ATUN FLORIDA", "FLORIDA", "LATAS"), ("1", "70", "LECHE GLORIA", "GLORIA", "LACTEOS")], "ruc string, code string, base string, brand string, category string")
    got = {(r.ruc, r.code): (r.brand, r.source) for r in resolvers.resolve_labels(facts, master).collect()}
    assert got == {("1", "7"): ("FLORIDA", "exact"), ("1", "x"): ("GLORIA", "similar"), ("1", "y"): (None, "model"), ("3", "7"): (None, "model")}


def two_sides(spark, rows, catalogue):
    """Both sides of the pairs, written first, as the queries do."""
    return staged(matching.side(domain.prepare_invoices(spark.createDataFrame(rows, COLUMNS)), "f"), "f"), staged(matching.side(domain.prepare_master(spark.createDataFrame(catalogue, COLUMNS)), "m"), "m")


def test_candidates_of_unknown_suppliers(spark):
    """A supplier without catalogue rows is compared with all rows that share a word, not with none."""
    facts, master = two_sides(spark, ROWS + [("9", "M", "MARTILLO ROJO", "UND", 1.0)], CATALOGUE)
    got = {(r.f_code, r.m_code, r.origin) for r in matching.candidate_pairs(facts, master).collect()}
    assert {x for x in got if x[0] in "MQ"} == {("M", "81", "global")} and len([x for x in got if x[0] == "007"]) == 3


def test_heuristic_against_a_plain_formula(spark):
    facts, master = two_sides(spark, ROWS, CATALOGUE)
    rows = matching.with_heuristics(matching.candidate_pairs(facts, master)).collect()
    assert len(rows) > 8
    for r in rows:
        a, b, c, d = (set(x.split()) for x in (r.f_base, r.m_base, r.f_clean, r.m_clean))
        j = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
        want = 0.34 * j(a, b) + 0.24 * SequenceMatcher(None, *sorted((r.f_base, r.m_base))).ratio() + 0.14 * j(c, d) + 0.14 * min(len(a & b) / 4, 1) + 0.08 * (r.f_base.split()[:2] == r.m_base.split()[:2]) + 0.03 * (r.f_unit == r.m_unit) + 0.03 * math.exp(-2.2 * abs(math.log1p(r.f_cost) - math.log1p(r.m_cost)))
        assert r.heuristic == pytest.approx(min(want, 1.0), abs=2e-6)


def test_gates_open_where_too_few_are_left(spark):
    """With one row of the family behind the gate and five wanted, all candidates stay; ranks have no gap."""
    many = CATALOGUE + [("1", f"9{i}", f"PRODUCTO{i} DISTINTO{i} {i} KG", "UND", 1.0) for i in range(6)]
    facts, master = two_sides(spark, ROWS[:1], many)
    got = matching.retrieved(matching.candidate_pairs(facts, master), top_n=5).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and got[0].m_code == "7"


def test_vectors_of_small_labels_look_at_all_rows(spark, tmp_path):
    rows = [(i, [float(i), 1.0], 1 if i < 30 else 2 if i < 51 else None) for i in range(60)] + [(100, [1.0, 1.0], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in embedding_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] or all(v < 30 for v in got[0])
    assert all(30 <= v < 51 for v in got[50]) and got[100] == [59, 58, 57, 56, 55]
