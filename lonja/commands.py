"""Training, matching, attributes and data sets of a branch from the command line: `python -m lonja COMMAND --help`.

Every command is a function that takes a session and gives a table or a report; `main` reads the arguments, runs it and
writes what it gives. The session comes from spark-submit, so that master and stores are the cluster's own.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import pkgutil
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja import operators
from lonja.functions.text import tax_id
from lonja.operators import attributes, branch, programs, ranking
from lonja.operators.ordering import pair_metrics
from lonja.plans import lifecycle
from lonja.plans.lifecycle import Metric
from lonja.sources import branches, store
from lonja.sources.staging import staged
from lonja.sources.tables import delimited

#: The programs of each family of branches; the last family is everyone else's.
FAMILIES = branches.Queries([("PORTALES", branch.QUERIES), ("", programs.QUERIES)])
MATCHER = [Metric("hit_1", "hit_1"), Metric("pr_auc", "pr_auc"), Metric("best_f1", "best_f1")]
ATTRIBUTES = [Metric("category.first", "category_accuracy"), Metric("brand.first", "brand_accuracy"), Metric("factor_sale.first", "factor_mae", False), Metric("weight.first", "weight_mae", False)]


def registered() -> dict:
    """Every registered query of the operators, by name."""
    out = {}
    for m in pkgutil.iter_modules(operators.__path__):
        out |= getattr(importlib.import_module(f"lonja.operators.{m.name}"), "QUERIES", {})
    return dict(sorted(out.items()))


def model_folder(root: str, own: str | None, what: str) -> str:
    return store.joined(branches.folders(root, own)["artifacts"], what)


def lock_of(root: str, own: str | None, what: str, lock: str | None) -> str:
    """The lock's file: beside the models on a file system, elsewhere where `lock` says, as stores cannot lock."""
    if lock is None and "://" in root and not root.startswith("file:"):
        raise ValueError("models on an object store need --lock, a file that all trainers can see")
    return lock or os.path.join(model_folder(root.removeprefix("file://").removeprefix("file:"), own, what), "training.lock")


def _settled(model, figures: dict, metrics: list[Metric], folder: str, force: bool, load) -> dict:
    held = lifecycle.current(folder, load)
    verdict = lifecycle.compare(figures, held[1] if held else None, metrics, force)
    run = datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S-%f")
    place = lifecycle.settle(model, figures, verdict, folder, run)
    return {"run": run, "figures": figures, **verdict, "stored": place}


def train_matcher(spark: SparkSession, data: str, root: str, own: str | None = None, force: bool = False, lock: str | None = None) -> dict:
    """Fits the ranker on all suppliers but those held out, whose figures decide whether it takes over."""
    with lifecycle.training_lock(lock_of(root, own, "matcher", lock)):
        pairs = ranking.featured_pairs(spark, data)
        model, penalty = ranking.fit(pairs.filter(ranking.held_out(F.col("ruc")) != 0))
        rest = staged(pairs.filter(ranking.held_out(F.col("ruc")) == 0), "held-out")
        p = ranking.as_column(model)
        scored = pair_metrics(rest.select(p.alias("p"), F.col("label").alias("y"))).first()
        hits = ranking.final_ranks(rest, p).filter("rank = 1").agg(F.avg((F.col("m_code") == F.col("f_truth")).cast("double")).alias("hit_1")).first()
        figures = scored.asDict() | hits.asDict() | {"penalty": penalty}
        return _settled(model, figures, MATCHER, model_folder(root, own, "matcher"), force, lifecycle.PipelineModel.load)


def match(spark: SparkSession, data: str, root: str, own: str | None = None, top_k: int = 5, candidates: int = 80, threshold: float = 0.72) -> DataFrame:
    """The best catalogue rows of every invoice row by the branch's stored ranker."""
    held = lifecycle.current(model_folder(root, own, "matcher"))
    if held is None:
        raise FileNotFoundError(f"no matcher has been trained in {model_folder(root, own, 'matcher')}")
    best = ranking.final_ranks(ranking.featured_pairs(spark, data), ranking.as_column(held[0]), top_k, candidates, threshold)
    return best.select("ruc", F.col("f_code").alias("fact"), F.col("m_code").alias("code"), "model", "score", "rank", "margin", "verdict")


def train_attributes(spark: SparkSession, data: str, root: str, own: str | None = None, force: bool = False, lock: str | None = None) -> dict:
    """Fits the attribute models on all suppliers but those held out, whose figures decide whether they take over."""
    with lifecycle.training_lock(lock_of(root, own, "attributes", lock)):
        model, quality = attributes.held_out_quality(spark, data)
        figures = {r.target: r.asDict() for r in quality.collect()}  # one row a target
        return _settled(model, figures, ATTRIBUTES, model_folder(root, own, "attributes"), force, attributes.Attributes.load)


def infer(spark: SparkSession, data: str, root: str, own: str | None = None, equivalents: str | None = None) -> DataFrame:
    """Attributes of every invoice row by the branch's stored models and the resolvers.

    equivalents: a delimited file of tax ids (ruc) and those that stand for them (other), one row a ruc.
    """
    held = lifecycle.current(model_folder(root, own, "attributes"), attributes.Attributes.load)
    if held is None:
        raise FileNotFoundError(f"no attribute models have been trained in {model_folder(root, own, 'attributes')}")
    same = delimited(spark, equivalents).select(tax_id(F.col("ruc")).alias("ruc"), tax_id(F.col("other")).alias("other")) if equivalents else None
    return attributes.inferred(spark, data, held[0], same)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lonja", description="Product matching and attributes as Spark jobs.")
    commands = parser.add_subparsers(dest="command", required=True)
    helps = {"train-matcher": train_matcher.__doc__, "match": match.__doc__, "train-attributes": train_attributes.__doc__, "infer": infer.__doc__, "datasets": "Writes the branch's programs to its raw folder.", "query": "Writes one registered query.", "list": "Names the registered queries."}
    made = {name: commands.add_parser(name, help=text.split("\n")[0], description=text) for name, text in helps.items()}
    for name, c in made.items():
        if name != "list":
            c.add_argument("--data", required=True, help="folder of the source tables")
        if name not in ("list", "query"):
            c.add_argument("--root", default=".", help="folder of the branches' data and models")
            c.add_argument("--branch", help="branch; without one the default")
        if name.startswith("train"):
            c.add_argument("--force", action="store_true", help="take over whatever the figures say")
            c.add_argument("--lock", help="lock file")
        if name in ("match", "infer", "query"):
            c.add_argument("--out", required=name == "query", help="where to write; without it the branch's results folder")
            c.add_argument("--format", choices=("csv", "parquet"), default="csv")
    made["query"].add_argument("name")
    made["match"].add_argument("--top-k", type=int, default=5)
    made["match"].add_argument("--candidates", type=int, default=80)
    made["match"].add_argument("--threshold", type=float, default=0.72)
    made["infer"].add_argument("--equivalents", help="delimited file of tax ids: ruc, other")
    made["datasets"].add_argument("--overwrite", action="store_true")
    return parser


def main(args: Sequence[str] | None = None) -> dict:
    """Runs one command and prints its report, one line of JSON."""
    parser = _parser()
    a = parser.parse_args(args)
    if a.command == "list":
        report = {"queries": list(registered())}
        print(json.dumps(report))
        return report
    if a.command == "query" and a.name not in registered():
        parser.error(f"no query {a.name}")
    spark = SparkSession.builder.appName(f"lonja {a.command}").getOrCreate()
    if a.command.startswith("train"):
        train = train_matcher if a.command == "train-matcher" else train_attributes
        report = train(spark, a.data, a.root, a.branch, a.force, a.lock)
    elif a.command == "datasets":
        report = {"rows": branches.generate_datasets(spark, a.branch or "", FAMILIES, a.data, a.root, os.environ, a.overwrite)}
    else:
        if a.command == "query":
            found = registered()[a.name](spark, a.data)
        elif a.command == "match":
            found = match(spark, a.data, a.root, a.branch, a.top_k, a.candidates, a.threshold)
        else:
            found = infer(spark, a.data, a.root, a.branch, a.equivalents)
        out = a.out or branches.results_path(branches.folders(a.root, a.branch)["data/results"], a.command)
        branches.save_delimited(found, out) if a.format == "csv" else found.write.parquet(out)
        report = {"written": out}
    print(json.dumps(report, default=str))
    return report
