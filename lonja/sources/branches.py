"""Branches (tenants): their databases, queries, folders, and the files written for them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.sources import store
from lonja.sources.tables import clean_names, delimited, tenant_id

FOLDERS = ("data/raw", "data/processed", "data/results", "artifacts")


def configured(env: Mapping[str, str]) -> dict[str, dict[str, str]]:
    """Branches named by SQL_<ID>_HOST_DB and the like: id to host, name, user and password; branches without a host are left out."""
    out: dict[str, dict[str, str]] = {}
    for key, value in env.items():
        if m := re.fullmatch(r"SQL_(\w+?)_(HOST|NAME|USER|PASS)_DB", key):
            out.setdefault(tenant_id(m[1]), {})[m[2].lower()] = value
    return {k: v for k, v in sorted(out.items()) if v.get("host")}


def jdbc_options(config: Mapping[str, str], driver: str = "com.microsoft.sqlserver.jdbc.SQLServerDriver") -> dict[str, str]:
    """Reader options for a branch's database."""
    options = {"url": f"jdbc:sqlserver://{config['host']};databaseName={config.get('name', '')};encrypt=true;trustServerCertificate=true", "driver": driver}
    return options | ({"user": config["user"], "password": config.get("pass", "")} if config.get("user") else {})


class Queries:
    """Each family of branches' queries by name; a branch belongs to the first family whose mark is in its id, else to the last."""

    def __init__(self, families: list[tuple[str, dict[str, Callable[[SparkSession, str], DataFrame]]]]):
        self.families = families

    def of(self, branch: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return next((q for mark, q in self.families if mark and mark in tenant_id(branch)), self.families[-1][1])

    def run(self, spark: SparkSession, branch: str, name: str, sf_dir: str, env: Mapping[str, str]) -> DataFrame:
        """A branch's query; SQL in the file that SQL_<BRANCH>_<NAME>_QUERY_FILE names replaces the one built in."""
        if path := env.get(f"SQL_{tenant_id(branch)}_{name.upper()}_QUERY_FILE"):
            return spark.sql(store.read_text(path))
        return self.of(branch)[name](spark, sf_dir)


def folders(root: str, branch: str | None, create: bool = False) -> dict[str, str]:
    """A branch's folders under root; the default branch has root itself."""
    own = tenant_id(branch)
    out = {f: store.joined(root, f, "" if own == "default" else own) for f in FOLDERS}
    for path in out.values() if create else ():
        store.make_folder(path)
    return out


def known_branches(root: str) -> list[str]:
    """The default branch, then every branch that has a folder of raw data or artefacts."""
    found = {name for f in ("data/raw", "artifacts") for name in store.folders_in(store.joined(root, f)) if tenant_id(name) == name}
    return ["default", *sorted(found - {"default"})]


def first_existing(spark: SparkSession, paths: list[str], columns: list[str], sep: str | None = None) -> DataFrame | None:
    """The named columns, as text, of the first of the files that is there; columns it lacks are left out. None without any."""
    hadoop = spark._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(hadoop).exists(where):
            df = delimited(spark, path, sep)
            return df.select(*[c for c in columns if c in df.columns])
    return None


def conversion_file(spark: SparkSession, path: str) -> DataFrame:
    """A stored conversion dictionary: keys as text, figures as numbers, rows without a positive factor left out."""
    df = delimited(spark, path)
    numbers = {"FactorCantidadCompra": "double", "Muestras": "long", "MuestrasModa": "long", "ConfianzaModa": "double"}
    return df.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in df.columns if c not in numbers} | {c: F.col(c).try_cast(t) for c, t in numbers.items()}).filter("FactorCantidadCompra > 0")


def save_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", mark: bool = True) -> None:
    """Delimited text with a header in every part; `mark` writes the byte order mark that spreadsheets look for. Nulls are empty."""
    names = df.columns
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(("﻿" if mark and i == 0 else "") + c) for i, c in enumerate(names)])
    named.write.mode(mode).option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Adds a batch of results. Batches are committed whole, so those written stay when a later one fails."""
    save_delimited(df, path, mode="append")


def read_results(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return clean_names(spark.read.option("header", True).option("sep", sep).csv(path))


def results_path(folder: str, what: str, now: datetime | None = None) -> str:
    return f"{folder.rstrip('/')}/{what}_{(now or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S_%f')}"


def generate_datasets(spark: SparkSession, branch: str, queries: Queries, sf_dir: str, root: str, env: Mapping[str, str], overwrite: bool = False) -> dict[str, int]:
    """All of a branch's queries as tables in its raw folder, with their row counts; what is there stays unless overwrite is set."""
    raw, out = folders(root, branch)["data/raw"], {}
    for name in queries.of(branch):
        df = queries.run(spark, branch, name, sf_dir, env)
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{raw}/{name}")
        out[name] = spark.read.parquet(f"{raw}/{name}").count()
    return out


def save_lexicon(words: DataFrame, path: str) -> None:
    """The terms of each category, best first, as one JSON file; there are at most ten a category."""
    best: dict[str, list[str]] = {}
    for r in words.orderBy("category", "rank").collect():
        best.setdefault(r.category, []).append(r.term)
    store.write_text(path, json.dumps(best, ensure_ascii=False, sort_keys=True))


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    best = json.loads(store.read_text(path))
    return spark.createDataFrame([(c, t, i + 1) for c, terms in best.items() for i, t in enumerate(terms)], "category string, term string, rank int")


def exported(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that are there, in that order."""
    return df.select(*[c for c in columns if c in df.columns])
