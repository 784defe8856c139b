"""The second branch's four programs: catalogue, invoices, matches by composite key, and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.operators.catalogue import half_up, latest_cost_per_part
from lonja.sources.tables import table


def _brand() -> Column:
    """Three brands are sold under a house name, one under an alias; all others keep theirs."""
    return F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), "HOUSE").when(F.col("p_brand") == "Brand#4", "BRAND 4").otherwise(F.col("p_brand"))


def branch_master(spark: SparkSession, d: str) -> DataFrame:
    """Distinct supplier and part with the part's latest cost, the supplier's place and the kind's and size's names."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    cost = latest_cost_per_part(spark, d).select(F.col("l_partkey").alias("cost_part"), "cost", F.col("l_suppkey").alias("last_supplier"))
    out = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").filter(F.length(F.rtrim("s_name")) > 2), F.col("l_suppkey") == F.col("s_suppkey"))
    out = out.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = out.join(cost, F.col("l_partkey") == F.col("cost_part"), "left")
    last = table(spark, d, "supplier").select(F.col("s_suppkey").alias("last_key"), F.rtrim("s_name").alias("last_name"))
    out = out.join(last, F.col("last_supplier") == F.col("last_key"), "left")
    group = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "A").when(F.col("p_type").isin("STANDARD", "MEDIUM"), "B").otherwise("C")
    return out.select(
        F.rtrim("s_name").alias("ruc"), F.col("l_partkey").alias("code"), F.trim(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("product"), _brand().alias("brand"), group.alias("kind"),
        "n_name", "r_name", "last_name", F.when(F.col("p_size") != 0, half_up(F.col("cost") / F.col("p_size"), 2)).alias("unit_cost"),
    ).orderBy("ruc", "code")


def branch_invoices(spark: SparkSession, d: str) -> DataFrame:
    """The latest line of every supplier and code whose customer is known in a market segment."""
    people = table(spark, d, "customer").filter(F.length(F.rtrim("c_mktsegment")) > 2).select("c_custkey")
    orders = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    code = F.coalesce(F.col("l_partkey").cast("string"), F.lit(""))
    last = F.max(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("x")
    return lines.groupBy("l_suppkey", code.alias("code")).agg(last).select("l_suppkey", "code", "x.l_orderkey", "x.l_linenumber", "x.l_extendedprice")


def _numbered(line: DataFrame, order: list[str], name: str) -> DataFrame:
    return line.withColumn(name, F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


def _both_sides(spark: SparkSession, d: str, years: int) -> DataFrame:
    """Goods received and invoiced, matched on order and item number, with a band on the amount and a window on the date.

    The key is the order with the item as three figures; both parts are compared on their own, which lets the
    numbering's partitioning serve the join.
    """
    line = table(spark, d, "lineitem")
    last = line.agg(F.max("l_shipdate").alias("last"))
    three = lambda n: F.right(F.concat(F.lit("000"), F.col(n).cast("string")), F.lit(3))
    got = _numbered(line, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "n").select(F.col("l_orderkey").alias("order"), three("n").alias("item"), F.col("l_suppkey").alias("ruc"), F.col("l_partkey").alias("master"), F.col("l_quantity").alias("bought"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("day"), F.col("l_returnflag").alias("unit"))
    bill = _numbered(line, ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "k").select(F.col("l_orderkey").alias("order"), three("k").alias("item"), F.col("l_partkey").alias("billed_code"), F.col("l_quantity").alias("billed"), F.col("l_extendedprice").alias("billed_amount"), F.col("l_linestatus").alias("billed_unit"))
    orders = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O", "P")).select(F.col("o_orderkey").alias("order"), "o_custkey")
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    out = got.join(bill, ["order", "item"]).join(orders, "order").join(known, "o_custkey").filter(F.abs(F.col("amount") - F.col("billed_amount")) < 1)
    return out.crossJoin(F.broadcast(last)).filter(F.col("day") >= F.add_months("last", -12 * years).cast("timestamp")).drop("last")  # one row


def branch_auto_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of catalogue and invoice code of two years, each once, by its latest order; codes that end in a figure."""
    rows = _both_sides(spark, d, 2).filter(F.col("billed_code").cast("string").rlike("[0-9]$"))
    last = F.max(F.struct("day", "order", "item")).alias("x")
    return rows.groupBy("ruc", "master", "billed_code").agg(last).select("ruc", "master", "billed_code", "x.order", "x.item")


def branch_conversions(spark: SparkSession, d: str) -> DataFrame:
    """What was received and what was invoiced in one year, with both units by name."""
    units = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("unit")).distinct().withColumn("unit_name", F.concat(F.lit("UNIT "), "unit"))
    rows = _both_sides(spark, d, 1).join(units, "unit", "left")
    return rows.select(F.concat(F.col("order").cast("string"), F.lit("-"), "item").alias("key"), "ruc", "master", "bought", F.trim("unit_name").alias("unit"), "billed_code", "billed", "billed_unit")


_BOTH = lambda years: f"""g AS (SELECT *, right('000' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), 3) AS item FROM lineitem),
  b AS (SELECT *, right('000' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice), 3) AS item FROM lineitem),
  x AS (SELECT g.*, b.l_partkey AS billed_code, b.l_quantity AS billed, b.l_linestatus AS billed_unit FROM g JOIN b ON g.l_orderkey || '-' || g.item = b.l_orderkey || '-' || b.item JOIN orders ON o_orderkey = g.l_orderkey JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus IN ('F', 'O', 'P') AND abs(g.l_extendedprice - b.l_extendedprice) < 1 AND g.l_shipdate >= ((SELECT max(l_shipdate) FROM lineitem)::DATE - INTERVAL {years} YEAR))"""  # noqa: E731
_COST = "floor(l_extendedprice / l_quantity * 100 + 0.5) / 100"
SQL = {
    "branch_master": f"""WITH c AS (SELECT l_partkey AS k, {_COST} AS cost, l_suppkey AS s FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)
        SELECT rtrim(x.s_name) AS ruc, l_partkey AS code, trim(p_name || ' ' || p_size) AS product, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'HOUSE' WHEN p_brand = 'Brand#4' THEN 'BRAND 4' ELSE p_brand END AS brand,
        CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'A' WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'B' ELSE 'C' END AS kind, n_name, r_name, rtrim(y.s_name) AS last_name, CASE WHEN p_size <> 0 THEN floor(cost / p_size * 100 + 0.5) / 100 END AS unit_cost
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier x ON x.s_suppkey = l_suppkey AND length(rtrim(x.s_name)) > 2 LEFT JOIN nation ON n_nationkey = x.s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN c ON k = l_partkey LEFT JOIN supplier y ON y.s_suppkey = s""",
    "branch_invoices": """SELECT l_suppkey, l_partkey::VARCHAR AS code, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE length(rtrim(c_mktsegment)) > 2)) WHERE rn = 1""",
    "branch_auto_match": f"""WITH {_BOTH(2)} SELECT ruc, master, billed_code, "order", item FROM (SELECT l_suppkey AS ruc, l_partkey AS master, billed_code, l_orderkey AS "order", item, row_number() OVER (PARTITION BY l_suppkey, l_partkey, billed_code ORDER BY l_shipdate DESC, l_orderkey DESC, item DESC) AS rn FROM x) WHERE rn = 1""",
    "branch_conversions": f"""WITH {_BOTH(1)} SELECT l_orderkey || '-' || item AS key, l_suppkey AS ruc, l_partkey AS master, l_quantity AS bought, 'UNIT ' || l_returnflag AS unit, billed_code, billed, billed_unit FROM x""",
}
QUERIES = {f.__name__: f for f in (branch_master, branch_invoices, branch_auto_match, branch_conversions)}
