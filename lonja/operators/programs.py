"""The first branch's catalogue, matches by composite key and unit conversions.

Goods received are the rows of lineitem, their movements the orders; the invoice of a supplier and order lists the same
rows by shipping date. An item's key is supplier, order and the item's last three figures; its parts are compared on
their own, so that the numbering's partitioning by supplier and order serves the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.operators.catalogue import half_up, latest_cost_per_part
from lonja.sources.tables import table

#: Suppliers whose brand and category stand in other columns than everyone's.
BRAND_SECOND, BRAND_FOURTH, CATEGORY_FIRST = (41, 48, 50), (25, 29), (41, 48, 50)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """code, first, second, fourth: the three names that an article has in the category tables."""
    part = table(spark, d, "part")
    first = part.select("p_brand").distinct().withColumn("first", F.rtrim("p_brand"))
    second = part.select("p_type").distinct().withColumn("second", F.rtrim("p_type"))
    fourth = part.select("p_size").distinct().withColumn("fourth", F.concat(F.lit("SIZE "), F.col("p_size").cast("string")))
    out = part
    for names, key in ((first, "p_brand"), (second, "p_type"), (fourth, "p_size")):
        out = out.join(names, key, "left")
    return out.select(F.col("p_partkey").alias("code"), "p_name", "p_size", "first", "second", "fourth")


def costed_master(spark: SparkSession, d: str) -> DataFrame:
    """Every article of a supplier with brand and category by the supplier's rule, weights and the latest cost of a case."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("code")).distinct()
    cost = latest_cost_per_part(spark, d).select(F.col("l_partkey").alias("code"), "cost")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.rtrim("s_name").alias("ruc")).filter("ruc <> ''")
    out = pairs.join(_labels(spark, d), "code").join(supplier, "s").join(cost, "code", "left")
    brand = F.when(F.col("s").isin(*BRAND_SECOND), F.col("second")).when(F.col("s").isin(*BRAND_FOURTH), F.col("fourth")).otherwise(F.col("first"))
    category = F.when(F.col("s").isin(*CATEGORY_FIRST), F.col("first")).otherwise(F.col("second"))
    factor = F.when(F.col("p_size") != 0, F.col("p_size"))
    weight = (F.pmod("code", F.lit(20)) + 1).cast("double")
    return out.select(
        "ruc", category.alias("category"), brand.alias("brand"), "code", F.rtrim("p_name").alias("product"), factor.alias("factor"), half_up(weight / factor, 2).alias("unit_weight"), weight.alias("case_weight"), half_up(F.col("cost") * factor, 2).alias("case_cost")
    )


def _items(rows: DataFrame, order: list[str]) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy(*order))
    return rows.select(F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("s"), "*", number.alias("n"), F.pmod(number, F.lit(1000)).alias("item"))


def _received(spark: SparkSession, d: str, years: int) -> DataFrame:
    """Accepted movements of the last years with their article and what the invoice says of the same item and amount."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    got = _items(line, ["l_linenumber", "l_partkey", "l_extendedprice"]).select("order", "s", "item", "n", F.col("l_partkey").alias("code"), F.col("l_quantity").alias("bought"), F.col("l_returnflag").alias("unit"), F.col("l_extendedprice").alias("amount"))
    own = F.coalesce(F.col("l_partkey"), F.col("l_linenumber")).cast("string")
    invoices = orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("order"))
    bill = _items(line, ["l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice"]).join(invoices, "order", "left_semi")
    bill = bill.select("order", "s", "item", own.alias("billed_code"), F.col("l_quantity").alias("billed"), F.col("l_linestatus").alias("billed_unit"), F.col("l_extendedprice").alias("total"))
    last = orders.agg(F.add_months(F.max("o_orderdate"), -12 * years).alias("since"))  # one row
    moved = orders.filter("o_orderstatus <> 'P'").crossJoin(F.broadcast(last)).filter(F.col("o_orderdate") >= F.col("since").cast("timestamp")).select(F.col("o_orderkey").alias("order"), F.col("o_orderdate").alias("day"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.trim("s_name").alias("ruc"))
    article = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.rtrim("p_name").alias("product"))
    out = got.join(bill, ["order", "s", "item"], "left").filter(F.abs(F.col("total") - F.col("amount")) < 1)
    out = out.join(moved, "order").join(supplier, "s").join(article, "code")
    return out.filter(F.col("order").cast("string").rlike("[0-9]$"))


def _padded(n: Column, figures: int) -> Column:
    """The last figures of a number, with zeros in front."""
    return F.right(F.concat(F.lit("0" * figures), n.cast("string")), F.lit(figures))


def auto_match_truth(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of article and invoice code of two years, each once, by its latest movement."""
    last = F.max(F.struct("day", "order", "n", "product")).alias("x")
    return _received(spark, d, 2).groupBy("ruc", "code", "billed_code").agg(last).select("ruc", "code", "x.product", "billed_code", "x.order")


def unit_conversion_facts(spark: SparkSession, d: str) -> DataFrame:
    """What was received and what was invoiced under one key in one year, with both quantities and units."""
    key = F.concat("ruc", F.lit("01"), _padded(F.col("order"), 10), _padded(F.col("n"), 3))
    return _received(spark, d, 1).select(key.alias("key"), "ruc", "order", "code", "product", "bought", "unit", "billed_code", "billed", "billed_unit")


_RECEIVED = lambda years: f"""g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
  x AS (SELECT g.*, o.o_orderdate AS day, trim(s_name) AS ruc, rtrim(p_name) AS product, coalesce(b.l_partkey, b.l_linenumber)::VARCHAR AS billed_code, b.l_quantity AS billed, b.l_linestatus AS billed_unit
    FROM g JOIN orders o ON o.o_orderkey = g.l_orderkey JOIN supplier ON s_suppkey = g.l_suppkey JOIN part ON p_partkey = g.l_partkey
    JOIN b ON concat(b.l_suppkey, '|', b.l_orderkey, right('000' || b.n, 3)) = concat(g.l_suppkey, '|', g.l_orderkey, right('000' || g.n, 3))
    JOIN orders i ON i.o_orderkey = b.l_orderkey AND i.o_orderpriority <> '5-LOW'
    WHERE o.o_orderdate >= (SELECT max(o_orderdate) FROM orders)::DATE - INTERVAL {years} YEAR AND o.o_orderstatus <> 'P' AND regexp_matches(g.l_orderkey::VARCHAR, '[0-9]$') AND abs(b.l_extendedprice - g.l_extendedprice) < 1)"""  # noqa: E731
_IN = lambda ids: ", ".join(str(i) for i in ids)
_TWO = lambda x: f"floor(({x}) * 100.0 + 0.5) / 100.0"
SQL = {
    "costed_master": f"""WITH c AS (SELECT l_partkey AS k, {_TWO("l_extendedprice / l_quantity")} AS cost FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)
      SELECT rtrim(s_name) AS ruc, CASE WHEN s_suppkey IN ({_IN(CATEGORY_FIRST)}) THEN rtrim(p_brand) ELSE rtrim(p_type) END AS category,
        CASE WHEN s_suppkey IN ({_IN(BRAND_SECOND)}) THEN rtrim(p_type) WHEN s_suppkey IN ({_IN(BRAND_FOURTH)}) THEN 'SIZE ' || p_size ELSE rtrim(p_brand) END AS brand, p_partkey AS code, rtrim(p_name) AS product, nullif(p_size, 0) AS factor,
        {_TWO("(p_partkey % 20 + 1) / nullif(p_size, 0)")} AS unit_weight, (p_partkey % 20 + 1)::DOUBLE AS case_weight, {_TWO("cost * nullif(p_size, 0)")} AS case_cost
      FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey AND rtrim(s_name) <> '' JOIN part ON p_partkey = l_partkey LEFT JOIN c ON k = p_partkey""",
    "auto_match_truth": f"""WITH {_RECEIVED(2)} SELECT ruc, l_partkey AS code, product, billed_code, l_orderkey AS "order" FROM (SELECT *, row_number() OVER (PARTITION BY ruc, l_partkey, billed_code ORDER BY day DESC, l_orderkey DESC, n DESC) AS rn FROM x) WHERE rn = 1""",
    "unit_conversion_facts": f"""WITH {_RECEIVED(1)} SELECT concat(ruc, '01', right('0000000000' || l_orderkey, 10), right('000' || n, 3)) AS key, ruc, l_orderkey AS "order", l_partkey AS code, product, l_quantity AS bought, l_returnflag AS unit, billed_code, billed, billed_unit FROM x""",
}
QUERIES = {f.__name__: f for f in (costed_master, auto_match_truth, unit_conversion_facts)}
