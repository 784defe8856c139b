"""Reading catalogue and invoice tables: parquet, delimited text, JDBC, and items from an API."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = ("RucProveedor", "CodProducto", "CodProducto2", "CodProducto3", "Producto", "UnidadMedidaCompra", "CodUnidadMedidaCompra", "Marca", "Categoria")
NUMBERS = ("CostoCaja", "ValorTotal", "Cantidad", "PesoUnitario", "FactorVenta", "FactorConversion", "PesoCaja")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with every column as text (codes keep their leading zeros); the delimiter is read off the header."""
    if sep is None:
        head = (spark.read.text(path).first() or [""])[0]
        sep = max(",;\t|", key=head.count)
    return clean_names(spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path))


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def rename_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical names for known spellings, whatever their case; the first spelling found wins."""
    by = {c.lower(): c for c in df.columns}
    found = {next(by[a.lower()] for a in spellings if a.lower() in by): name for name, spellings in aliases.items() if name not in df.columns and any(a.lower() in by for a in spellings)}
    return df.withColumnsRenamed(found)


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"{what} lacks {', '.join(missing)}")
    return df


def typed(df: DataFrame) -> DataFrame:
    """Text trimmed and never null; numbers as doubles, 0 where they cannot be read."""
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in TEXT if c in df.columns}
    return df.withColumns(text | {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in NUMBERS if c in df.columns})


def items(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Invoice items from an API call, with the schema of typed()."""
    names = [*TEXT, *NUMBERS]
    schema = T.StructType([T.StructField(c, T.StringType() if c in TEXT else T.DoubleType()) for c in names])
    return typed(spark.createDataFrame([tuple(r.get(c) if c in TEXT or r.get(c) is None else float(r[c]) for c in names) for r in rows], schema))


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A remote query; split over a numeric key it is read by `parts` tasks, its bounds asked for first."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader.option("query", query).load()
    low, high = reader.option("query", f"SELECT MIN({key}) a, MAX({key}) b FROM ({query}) q").load().first()
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", low or 0).option("upperBound", high or 1).option("numPartitions", parts).load()


def save(df: DataFrame, path: str, overwrite: bool = False, by_tenant: bool = False) -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy("tenant") if by_tenant else writer).parquet(path)


def tenant_id(name: str | None) -> str:
    """A branch name as a safe directory name; empty is the default branch."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9]+", "_", (name or "").strip())).strip("_").upper() or "default"
