"""The driver's tables as the domain's relations, and their preparation for matching.

A supplier's tax id is l_suppkey with the brand's number, a catalogue row a part that the supplier delivers,
an invoice row the latest line of supplier and part under a code of the supplier's own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions import similarity as sim
from lonja.functions.parsing import ATTRIBUTES, with_attributes
from lonja.functions.text import code, tax_id, unit
from lonja.sources.staging import staged
from lonja.sources.tables import rename_aliases, require, table, typed

NEEDED = ["RucProveedor", "CodProducto", "Producto", "UnidadMedidaCompra"]
#: Spellings of column names that uploads use.
ALIASES = {
    "RucProveedor": ["RUC", "Ruc_Proveedor"], "CodProducto": ["Codigo", "Cod_Producto"], "Producto": ["Descripcion", "NombreProducto"],
    "UnidadMedidaCompra": ["UnidadMedida", "UM"], "CostoCaja": ["Costo", "Costo_Caja"],
}


#: Rows: a table of distinct texts with no more is broadcast.
FEW = 100_000


def once_a_text(df: DataFrame, keys: list[str], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `use` adds to its distinct texts, each of which is worked on once however many rows repeat it."""
    texts = df.select(*keys).distinct()
    told = staged(use(spread(texts, *keys)), "texts").withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(F.broadcast(told) if told.limit(FEW + 1).count() <= FEW else told, same).drop(*[f"_of_{k}" for k in keys])


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all cores by key: a small table would else be worked on by the one or two tasks that read it."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def _prepared(df: DataFrame, what: str, codes: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    df = require(rename_aliases(df, ALIASES), NEEDED, what)
    df = df.withColumns({c: F.lit("") for c in codes if c not in df.columns} | {c: F.lit(0.0) for c in numbers if c not in df.columns})
    df = typed(df)
    df = df.withColumns({c: code(F.col(c)) for c in codes} | {"RucProveedor": tax_id(F.col("RucProveedor")), "cost_log": sim.log_safe(F.col("CostoCaja"))})
    df = once_a_text(df.drop("unit"), ["UnidadMedidaCompra"], lambda units: units.withColumn("unit", unit(F.col("UnidadMedidaCompra"))))
    df = once_a_text(df.drop("FactorConversion", *ATTRIBUTES), ["Producto"], lambda texts: with_attributes(texts, "Producto"))
    weight = F.when(F.col("PesoUnitario") > 0, F.col("PesoUnitario")).otherwise(F.col("kg"))
    df = df.withColumns({"weight": weight, "weight_total": weight * F.col("factor")})
    return df.withColumns({f"{c}_log": sim.log_safe(F.col(c)) for c in ("factor", "content", "total", "weight_total")})


def prepare_master(df: DataFrame) -> DataFrame:
    """A catalogue with normalised codes and unit, attributes of the text, the text's weight where none is given, and logs."""
    return _prepared(df, "master", ("CodProducto", "CodProducto2", "CodProducto3"), ("CostoCaja", "PesoUnitario"))


def prepare_invoices(df: DataFrame) -> DataFrame:
    """Invoice rows prepared like the catalogue; amounts that are absent or unreadable are 0."""
    return _prepared(df, "invoices", ("CodProducto",), ("CostoCaja", "ValorTotal", "Cantidad", "PesoUnitario"))


def with_targets(master: DataFrame) -> DataFrame:
    """A prepared master with training targets: nulls stay null and have mask 0; a case's weight follows from the unit's.

    The conversion target is the text's factor where the source has none.
    """
    missing = [c for c in ("FactorVenta", "FactorConversionTarget", "PesoCaja") if c not in master.columns]
    df = master.withColumns({c: F.lit(None).cast("double") for c in missing})
    number = lambda c: F.col(c).try_cast("double")
    conversion = F.coalesce(number("FactorConversionTarget"), F.col("factor"))
    sale = F.when(number("FactorVenta") > 0, number("FactorVenta")).otherwise(F.when(conversion > 0, conversion))
    case = F.when(number("PesoCaja") > 0, number("PesoCaja")).otherwise(F.col("weight") * F.coalesce(F.when(sale > 0, sale), conversion, F.lit(1.0)))
    sound = lambda x: F.when(x >= 0, x)
    df = df.withColumns({"target_factor_sale": sound(sale), "target_factor_case": sound(conversion), "target_weight": sound(F.col("weight")), "target_weight_case": sound(case)})
    targets = ("target_factor_sale", "target_factor_case", "target_weight", "target_weight_case")
    return df.withColumns({f"{t}_log": sim.log_safe(F.col(t)) for t in targets} | {f"mask_{t[7:]}": F.col(t).isNotNull().cast("double") for t in targets})


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    grams = (F.pmod("p_partkey", F.lit(20)) + 1) * 50
    return rows.select(
        _ruc().alias("RucProveedor"), F.col("p_partkey").cast("string").alias("CodProducto"),
        F.concat_ws(" ", "p_name", "p_type", grams.cast("string"), F.lit("GR X"), F.col("p_size").cast("string")).alias("Producto"),
        F.when(F.col("p_size") % 2 == 0, "CAJA").otherwise("UND").alias("UnidadMedidaCompra"), F.col("p_retailprice").alias("CostoCaja"), F.col("p_brand").alias("Marca"), F.col("p_type").alias("Categoria"),
    )


def invoices(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")).alias("x")
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(last).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    odd, grams = F.col("x.l_linenumber") % 2, (F.pmod("p_partkey", F.lit(20)) + 1) * 50
    text = F.concat_ws(" ", "p_name", F.when(odd == 1, F.col("p_type")), F.concat(grams.cast("string"), F.lit("GR X")), (F.col("p_size") + odd).cast("string"))
    return rows.select(
        _ruc().alias("RucProveedor"), F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("CodProducto"), text.alias("Producto"), F.when(odd == 0, "BX").otherwise("NIU").alias("UnidadMedidaCompra"),
        (F.floor(F.col("x.l_extendedprice") / F.col("x.l_quantity") * 100 + 0.5) / 100).alias("CostoCaja"), F.col("x.l_extendedprice").alias("ValorTotal"), F.col("x.l_quantity").alias("Cantidad"), F.col("p_partkey").cast("string").alias("truth"),
    )


def _ruc():
    return F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.regexp_extract("p_brand", "[0-9]+", 0))
