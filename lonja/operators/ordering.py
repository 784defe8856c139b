"""Total orders and running sums over all rows without one big task: range partitions, their totals, then each by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.operators.training import chance
from lonja.sources.staging import staged
from lonja.sources.tables import table


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums, its own row included, in an order; rows that the order leaves equal may lie either way round.

    Only one row a partition meets in one place: the partitions' totals.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"_{name}": c for name, c in sums.items()}).repartitionByRange(parts, *order)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_{name}").alias(f"_t_{name}") for name in sums])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({name: F.sum(f"_{name}").over(own) for name in sums}).join(F.broadcast(totals), "_part")
    out = out.withColumns({name: F.col(name) + F.col(f"_b_{name}") for name in sums})
    return out.drop("_part", *[f"_{name}" for name in sums], *[f"_b_{name}" for name in sums])


def shuffled(df: DataFrame, keys: list[Column], seed: int) -> DataFrame:
    """df with place, from 1: a seeded order of all rows that partitioning does not change. Keys are whole numbers and tell rows apart."""
    drawn = df.withColumn("_drawn", chance(*keys, F.lit(seed)))
    return with_running(drawn, [F.col("_drawn"), *keys], {"place": F.lit(1).cast("long")}).drop("_drawn")


def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    """All lines in a seeded order, the first thousand of them as the subsample."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    keys = [F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber")]
    one = line.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return shuffled(one, keys, 42).select("l_orderkey", "l_linenumber", "n", "place", (F.col("place") <= 1000).alias("chosen"))


def pair_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n, positive_rate, pr_auc (average precision), roc_auc, the cut with the best F1 and its figures, and those at `threshold`.

    scored: p, y (0 or 1). Equal scores count as one step, half a pair each in roc_auc. Any number of distinct scores.
    """
    steps = scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    steps = with_running(steps, [F.desc("p")], {"chosen": F.col("n"), "right": F.col("hits")})
    total = steps.agg(F.sum("hits").alias("pos"), F.sum("n").alias("all"))
    both = steps.crossJoin(F.broadcast(total))  # one row
    worse = (F.col("all") - F.col("pos")) - (F.col("chosen") - F.col("right"))
    ap = F.sum(F.col("hits") * F.col("right") / F.col("chosen")) / F.max("pos")
    auc = F.sum(F.col("hits") * (worse + (F.col("n") - F.col("hits")) / 2)) / (F.max("pos") * (F.max("all") - F.max("pos")))
    f1 = lambda right, chosen: F.when(chosen + F.col("pos") > 0, 2 * right / (chosen + F.col("pos"))).otherwise(0.0)
    step = F.struct(F.round(f1(F.col("right"), F.col("chosen")), 6).alias("f1"), F.round(F.col("right") / F.col("chosen"), 6).alias("precision"), (-F.col("p")).alias("cut"), F.round(F.col("right") / F.col("pos"), 6).alias("recall"))
    out = both.agg(
        F.max("all").alias("n"), F.round(F.max("pos") / F.max("all"), 6).alias("positive_rate"), F.round(ap, 6).alias("pr_auc"), F.round(auc, 6).alias("roc_auc"), F.max(step).alias("best"),
        F.max(F.when(F.col("p") >= threshold, F.col("chosen"))).alias("_chosen"), F.max(F.when(F.col("p") >= threshold, F.col("right"))).alias("_right"), F.max("pos").alias("pos"),
    )
    chosen, right = F.coalesce("_chosen", F.lit(0)), F.coalesce("_right", F.lit(0))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return out.select(
        "n", "positive_rate", "pr_auc", "roc_auc", (-F.col("best.cut")).alias("best_cut"), F.col("best.f1").alias("best_f1"), F.col("best.precision").alias("best_precision"), F.col("best.recall").alias("best_recall"),
        part(right, chosen).alias("precision"), part(right, F.col("pos")).alias("recall"), F.round(f1(right, chosen), 6).alias("f1"),
    )


def score_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of two scores of returned lines: the discount, of a few values, and the line's amount, of almost as many as lines."""
    line = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("long"))
    few = pair_metrics(line.select(F.col("l_discount").alias("p"), "y"), 0.05).withColumn("of", F.lit("discount"))
    many = pair_metrics(line.select(F.col("l_extendedprice").alias("p"), "y"), 50_000.0).withColumn("of", F.lit("amount"))
    return few.unionByName(many)


_METRICS = lambda of, p, cut: f"""SELECT '{of}' AS "of", n, positive_rate, pr_auc, roc_auc, best.c AS best_cut, best.f AS best_f1, best.p AS best_precision, best.r AS best_recall,
    round(CASE WHEN ch > 0 THEN rt / ch ELSE 0 END, 6) AS precision, round(CASE WHEN pos > 0 THEN rt / pos ELSE 0 END, 6) AS recall, round(CASE WHEN ch + pos > 0 THEN 2 * rt / (ch + pos) ELSE 0 END, 6) AS f1 FROM (
    SELECT max(a)::BIGINT AS n, round(max(pos) / max(a), 6) AS positive_rate, round(sum(h * r / ch) / max(pos), 6) AS pr_auc, round(sum(h * ((a - pos) - (ch - r) + (n - h) / 2)) / (max(pos) * (max(a) - max(pos))), 6) AS roc_auc,
      arg_max({{'c': p, 'f': round(2 * r / (ch + pos), 6), 'p': round(r / ch, 6), 'r': round(r / pos, 6)}}, (round(2 * r / (ch + pos), 6), round(r / ch, 6), -p)) AS best, coalesce(max(CASE WHEN p >= {cut} THEN ch END), 0) AS ch, coalesce(max(CASE WHEN p >= {cut} THEN r END), 0) AS rt, max(pos) AS pos
    FROM (SELECT *, sum(n) OVER w AS ch, sum(h) OVER w AS r, sum(h) OVER () AS pos, sum(n) OVER () AS a FROM (SELECT {p} AS p, count(*) AS n, sum((l_returnflag = 'R')::INT) AS h FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY p DESC)))"""  # noqa: E731
SQL = {
    "seeded_order": """WITH x AS (SELECT l_orderkey, l_linenumber, count(*) AS n, ((17 + l_orderkey::BIGINT * 7919 + l_linenumber::BIGINT * 104729 + 42 * 31) % 1000003 + 0.5) / 1000003 AS u FROM lineitem GROUP BY ALL),
        y AS (SELECT *, row_number() OVER (ORDER BY u, l_orderkey, l_linenumber) AS place FROM x) SELECT l_orderkey, l_linenumber, n, place, place <= 1000 AS chosen FROM y""",
    "score_metrics": f"{_METRICS('discount', 'l_discount', 0.05)} UNION ALL {_METRICS('amount', 'l_extendedprice', 50000)}",
}
QUERIES = {f.__name__: f for f in (seeded_order, score_metrics)}
