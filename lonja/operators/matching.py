"""Invoice rows against catalogue rows: candidates, support, final scores and the verdict.

Candidates are the catalogue rows of the invoice row's supplier. Where the supplier has none, they are all
rows that share a word of the name, over an inverted index, so that no cross join arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.functions import similarity as sim
from lonja.functions.sequences import block_ratio
from lonja.functions.text import char_grams
from lonja.operators.catalogue import half_up
from lonja.plans import domain
from lonja.plans.domain import once_a_text, spread
from lonja.sources.staging import kept

#: Words that say nothing of a product, and words that belong to no family of products.
GENERIC = ("X", "UND", "UNIDAD", "UNIDADES", "CAJA", "CJA", "CJ", "PAQUETE", "PQT", "PACK", "PCK", "PAQ", "BOL", "BOLSA", "BOT", "BOTELLA", "LT", "L", "ML", "CC", "KG", "GR", "G", "TIPO", "CONT", "FC", "PE", "DISPLAY", "DP", "DSP")
NO_FAMILY = ("UND", "UNIDAD", "UNIDADES", "CAJA", "CJA", "CJ", "PAQUETE", "PCK", "PACK", "PQT", "PAQ", "BOL", "BOLSA", "BOT", "BANDEJA", "X", "BONIF", "CODIGO", "PRODUCTO", "PRODUCTOS", "SB", "AD", "PE", "EX", "REG")
SHOWN = ("code", "text", "base", "clean", "unit", "kind", "factor", "content", "total", "weight", "cost", "cost_log", "factor_log", "content_log", "total_log")


def lexed(c: Column) -> Column:
    """The words of a text that has been lexed before; marks like FC_12 come apart."""
    return F.filter(F.split(F.translate(c, "_", " "), " "), lambda t: t != "")


def core_words(c: Column) -> Column:
    """Distinct words of a lexed text that tell products apart."""
    return F.array_distinct(F.filter(lexed(c), lambda t: ~t.isin(*GENERIC) & ~t.rlike("^[0-9]+$") & (F.length(t) > 1)))


def family_words(c: Column) -> Column:
    return F.filter(lexed(c), lambda t: ~t.isin(*NO_FAMILY) & ~t.rlike("^[0-9]+$") & (F.length(t) > 2))


def rows_side(df: DataFrame, p: str, *more: str) -> DataFrame:
    """A prepared relation under the names of one side of a pair: a prefix but for ruc."""
    own = df.select("RucProveedor", F.col("CodProducto").alias("code"), F.col("model_text").alias("text"), "base", "clean", "unit", "kind", "factor", "content", "total", "weight", F.col("CostoCaja").alias("cost"), "cost_log", "factor_log", "content_log", "total_log", *more)
    return own.select(*[F.col(c).alias("ruc" if c == "RucProveedor" else f"{p}_{c}") for c in own.columns])


def with_sets(side: DataFrame, p: str) -> DataFrame:
    """A side with its word and gram sets, each computed once for every distinct text and hashed."""
    of = lambda c: F.col(f"{p}_{c}")
    every = lambda c: F.array_distinct(lexed(of(c)))
    sets = {
        "words": core_words(of("text")), "base_words": core_words(of("base")), "grams": char_grams(F.translate(of("text"), "_", " ")), "base_grams": char_grams(of("base")),
        "family": family_words(of("base")), "all_words": every("text"), "all_base": every("base"), "all_clean": every("clean"), "start": F.slice(lexed(of("base")), 1, 2),
    }
    return once_a_text(side, [f"{p}_text", f"{p}_base", f"{p}_clean"], lambda texts: texts.withColumns({f"{p}_{name}": sim.hashed(words) for name, words in sets.items()}))


def side(df: DataFrame, p: str, *more: str) -> DataFrame:
    """A prepared relation as one side of a pair, with its sets."""
    return with_sets(rows_side(df, p, *more), p)


def candidate_pairs(facts: DataFrame, master: DataFrame) -> DataFrame:
    """Every invoice row with the catalogue rows of its supplier; with all rows that share a family word where the supplier has none.

    Invoice rows are dealt by supplier and code, as later windows ask for, so that a large supplier is no one task's work.
    """
    facts = spread(facts, "ruc", "f_code")
    own = facts.join(master, "ruc").withColumn("origin", F.lit("supplier"))
    lost = facts.join(master.select("ruc").distinct(), "ruc", "left_anti")
    words = lambda df, p: df.select(F.col("ruc").alias(f"{p}_ruc"), f"{p}_code", F.explode(F.array_distinct(f"{p}_family")).alias("word"))
    hits = words(lost, "f").join(words(master, "m"), "word").select("f_ruc", "f_code", "m_ruc", "m_code").distinct()
    found = lost.join(hits, (F.col("ruc") == F.col("f_ruc")) & (lost["f_code"] == hits["f_code"])).drop(hits["f_code"]).drop("f_ruc")
    other = master.withColumnRenamed("ruc", "of").withColumnRenamed("m_code", "of_code")
    found = found.join(other, (F.col("m_ruc") == F.col("of")) & (F.col("m_code") == F.col("of_code"))).drop("m_ruc", "of", "of_code").withColumn("origin", F.lit("global"))
    return own.unionByName(found)


def _f(c: str) -> Column:
    return F.col(f"f_{c}")


def _m(c: str) -> Column:
    return F.col(f"m_{c}")


def apart(x: Column) -> Column:
    """x by way of a lambda, which keeps its step out of whole-stage code: of a pair's many similarities Spark would make one
    method that is too large for the JVM to compile and that runs interpreted, some twenty times slower."""
    return F.element_at(F.transform(F.array(x), lambda v: v), 1)


def with_shared(pairs: DataFrame, *sets: str) -> DataFrame:
    """both_<set>: how many values the two sides' sets share, each pair of sets met once."""
    return pairs.withColumns({f"both_{c}": apart(sim.shared(_f(c), _m(c))) if c == sets[0] else sim.shared(_f(c), _m(c)) for c in sets})


def jaccard(c: str) -> Column:
    return sim.jaccard_of(F.col(f"both_{c}"), _f(c), _m(c))


def overlap(c: str) -> Column:
    return sim.overlap_of(F.col(f"both_{c}"), _f(c), _m(c))


def with_support(pairs: DataFrame) -> DataFrame:
    """lexical, structure and support of each pair, and the similarities that final scores ask for."""
    alike = lambda c, k: sim.relative_similarity(_f(c), _m(c), k)
    pairs = with_shared(pairs, "words", "base_words", "grams", "base_grams")
    #: The weights of scores here and below.
    lexical = 0.18 * jaccard("words") + 0.28 * jaccard("base_words") + 0.18 * overlap("words") + 0.22 * overlap("base_words") + 0.05 * jaccard("grams") + 0.09 * jaccard("base_grams")
    kind = F.when((_f("kind") == "NONE") | (_m("kind") == "NONE"), 0.5).otherwise((_f("kind") == _m("kind")).cast("double"))
    pairs = pairs.withColumns({"unit_equal": (_f("unit") == _m("unit")).cast("double"), "factor_sim": alike("factor", 6.0), "content_sim": alike("content", 7.0), "total_sim": alike("total", 7.0)})
    structure = 0.10 * F.col("unit_equal") + 0.08 * kind + 0.24 * F.col("factor_sim") + 0.22 * F.col("content_sim") + 0.22 * F.col("total_sim") + 0.08 * alike("weight", 7.0) + 0.06 * alike("cost", 2.5)
    pairs = pairs.withColumns({"lexical": apart(half_up(lexical, 6)), "structure": half_up(structure, 6)})
    return pairs.withColumn("support", half_up(0.58 * F.col("lexical") + 0.42 * F.col("structure"), 6))


def with_mining_support(pairs: DataFrame) -> DataFrame:
    """The variant that mining uses: no grams, other weights, kinds compared as they are."""
    alike = lambda c, k: sim.relative_similarity(_f(c), _m(c), k)
    pairs = with_shared(pairs, "words", "base_words", "base_grams")
    lexical = 0.30 * jaccard("words") + 0.30 * jaccard("base_words") + 0.20 * overlap("words") + 0.20 * overlap("base_words")
    structure = 0.10 * (_f("unit") == _m("unit")).cast("double") + 0.08 * (_f("kind") == _m("kind")).cast("double") + 0.24 * alike("factor", 6.0) + 0.22 * alike("content", 7.0) + 0.22 * alike("total", 7.0) + 0.08 * alike("weight", 7.0) + 0.06 * alike("cost", 2.5)
    return pairs.withColumn("support", half_up(0.58 * lexical + 0.42 * structure, 6))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= most)


def with_retrieval(pairs: DataFrame, embedding: Column, most: int = 80) -> DataFrame:
    """The `most` best candidates of each invoice row by support and embedding (-1 to 1)."""
    out = pairs.withColumn("embedding", embedding).withColumn("retrieval", half_up(0.55 * F.col("support") + 0.45 * (F.col("embedding") + 1) / 2, 6))
    return ranked(out, ["ruc", "f_code"], [F.desc("retrieval"), F.desc("support"), F.desc("lexical"), F.desc("embedding"), F.col("m_code")], most, "retrieved")


def with_final_scores(found: DataFrame) -> DataFrame:
    """score of each candidate from support, embedding and `model`, the model's probability.

    Where the model tells an invoice row's candidates hardly apart, it does not count. A candidate without
    textual evidence cannot win by the model alone.
    """
    group = Window.partitionBy("ruc", "f_code")
    high, low = F.max("model").over(group), F.min("model").over(group)
    e, s, lex, st = (F.col("embedding") + 1) / 2, F.col("support"), F.col("lexical"), F.col("structure")
    emb = F.when(s >= 0.72, F.greatest(e, F.lit(0.55))).otherwise(e)
    bonus = F.when((s >= 0.72) & (lex >= 0.55) & (F.col("factor_sim") >= 0.98) & (F.col("content_sim") >= 0.98) & (F.col("total_sim") >= 0.98), 0.05).otherwise(0.0)
    gates = clip((lex - 0.03) / 0.30) * clip((s - 0.12) / 0.40)
    collapsed = 0.52 * s + 0.25 * lex + 0.11 * st + 0.08 * emb + bonus
    usual = (0.20 * F.col("model") * gates + 0.35 * s + 0.16 * lex + 0.12 * st + 0.17 * emb + bonus) * clip(0.15 + 0.85 * (0.55 * lex + 0.45 * st), 0.15)
    score = F.when((high < 0.15) | (high - low < 0.03), collapsed).otherwise(usual)
    capped = F.when((lex < 0.08) & (s < 0.28), F.least(score, 0.04 + 0.28 * s + 0.06 * emb + 0.04 * st)).otherwise(score)
    return found.withColumn("score", half_up(capped, 6))


def decided(scored: DataFrame, top_k: int = 5, threshold: float = 0.72) -> DataFrame:
    """The top_k candidates of each invoice row with rank, margin of the first over the second (0 where there is none) and verdict."""
    order = [F.desc("score"), F.desc("support"), F.desc("lexical"), F.desc("structure"), F.desc("model"), F.desc("embedding"), F.col("m_code")]
    best = ranked(scored, ["ruc", "f_code"], order, top_k)
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("ruc", "f_code"))
    best = best.withColumn("margin", half_up(F.col("score") - F.coalesce(second, F.lit(0.0)), 6))
    yes = (F.col("score") >= threshold) & (F.col("support") >= 0.30) & ((F.col("margin") >= 0.03) | (F.col("support") >= 0.55)) & ~((F.col("lexical") < 0.12) & (F.col("structure") < 0.35))
    return best.withColumn("verdict", F.when(F.col("rank") > 1, "alternative").when(yes, "tentative").otherwise("maybe_new"))


def brand_bonus(a: Column, b: Column, keys: list[str], each: float = 0.04, most: float = 0.16) -> Column:
    """`each` for every key that is a word of both hashed sets, as often as it is listed; `most` at most.

    Keys of several words, or with letters that lexed words cannot have, never count.
    """
    both, bonus = F.array_intersect(a, b), F.lit(0.0)
    for times in sorted({keys.count(k) for k in keys}):
        some = sim.hashed(F.array(*[F.lit(k) for k in dict.fromkeys(keys) if keys.count(k) == times]))
        bonus = bonus + each * times * sim.shared(both, some)
    return F.least(bonus, F.lit(most))


def with_heuristics(pairs: DataFrame, keys: list[str] | None = None, sequence: bool = True) -> DataFrame:
    """The text heuristic of each pair; `keys` are brand words that count extra, `sequence` takes in the block ratio of both names."""
    pairs = with_shared(pairs, "all_base", "all_clean")
    prefix = ((F.size(_f("start")) > 0) & (_f("start") == _m("start"))).cast("double")
    ratio = block_ratio("f_base", "m_base") if sequence else F.lit(0.0)
    text = (
        0.34 * jaccard("all_base") + 0.24 * ratio + 0.14 * jaccard("all_clean") + 0.14 * F.least(F.col("both_all_base") / 4, F.lit(1.0))
        + 0.08 * prefix + 0.03 * (_f("unit") == _m("unit")).cast("double") + 0.03 * sim.log_similarity(_f("cost_log"), _m("cost_log"), 2.2)
    )
    if keys:
        text = text + brand_bonus(_f("all_base"), _m("all_base"), keys)
    return pairs.withColumn("heuristic", half_up(clip(text), 6))


def retrieved(pairs: DataFrame, top_n: int = 30, keys: list[str] | None = None, sequence: bool = True, last: tuple[str, ...] | list[str] = ("m_code",)) -> DataFrame:
    """The top_n candidates of each invoice row, by a shortlist, a family gate, a presentation gate and six sort keys.

    A gate is only closed where enough candidates are left behind it: of the strict family, else of the soft
    one, else all; then the same by presentation.
    """
    by = ["ruc", "f_code"]
    out = ranked(with_heuristics(pairs, keys, sequence), by, [F.desc("heuristic"), *last], max(12 * top_n, 120), "listed")
    both = F.array_intersect("f_family", "m_family")
    start = lambda n: (F.size("f_family") >= n) & (F.size("m_family") >= n) & (F.slice("f_family", 1, n) == F.slice("m_family", 1, n))
    differ = lambda c: sim.relative_difference(_f(c), _m(c))
    alike = lambda c, k: sim.relative_similarity(_f(c), _m(c), k)
    out = out.withColumns({
        "family_strict": start(2) | (F.size(both) >= 2), "family_soft": start(2) | (F.size(both) >= 1) | (F.col("heuristic") >= 0.55),
        "tier": sim.presentation_tier(_f("kind"), _m("kind"), differ("factor"), differ("content"), differ("total"), differ("weight")),
        "presentation": half_up(clip(sim.presentation_score(_f("kind"), _m("kind"), alike("factor", 7.0), alike("content", 8.0), alike("total", 8.0), alike("weight", 8.0))), 6),
    })
    group = Window.partitionBy(*by)
    enough = lambda c, n: F.sum(F.col(c).cast("int")).over(group) >= n
    out = out.withColumns({"by_strict": enough("family_strict", max(top_n, 5)), "by_soft": enough("family_soft", max(top_n, 5))})
    out = out.filter(F.when(F.col("by_strict"), F.col("family_strict")).when(F.col("by_soft"), F.col("family_soft")).otherwise(True))
    near = lambda c, most: (_f(c) > 0) & (_m(c) > 0) & (differ(c) <= most)
    kind = (_f("kind") == "NONE") | (_m("kind") == "NONE") | (_f("kind") == _m("kind"))
    out = out.withColumns({
        "presented_strict": F.col("family_soft") & kind & near("factor", 0.02) & (near("content", 0.08) | near("total", 0.08) | near("weight", 0.08)),
        "presented_soft": F.col("family_soft") & kind & (near("factor", 0.02) | (F.col("tier") <= 1)),
        "score": half_up((0.78 * F.col("heuristic") + 0.22 * F.col("presentation")) * (0.20 + 0.80 * clip((F.col("heuristic") - 0.12) / 0.35)), 6),
    })
    out = out.withColumns({"by_strict": enough("presented_strict", top_n), "by_soft": enough("presented_soft", top_n)})
    out = out.filter(F.when(F.col("by_strict"), F.col("presented_strict")).when(F.col("by_soft"), F.col("presented_soft")).otherwise(True))
    order = [F.desc("family_strict"), F.desc("family_soft"), F.col("tier"), F.desc("presented_strict"), F.desc("score"), F.desc("heuristic"), *last]
    return ranked(out, by, order, top_n)


def _sources(d: str) -> list[str]:
    return [f"{d}/lineitem.parquet", f"{d}/part.parquet"]


def rows_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Invoice rows and catalogue rows as sides of pairs without sets, prepared once for all queries of a session."""
    facts = kept(spark, "facts-rows", _sources(d), lambda: rows_side(domain.prepare_invoices(domain.invoices(spark, d)), "f", "truth", "ValorTotal", "Cantidad"))
    return facts, kept(spark, "master-rows", _sources(d), lambda: rows_side(domain.prepare_master(domain.catalogue(spark, d)), "m"))


def sides_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same with their sets."""
    facts, master = rows_of(spark, d)
    return kept(spark, "facts-side", _sources(d), lambda: with_sets(facts, "f")), kept(spark, "master-side", _sources(d), lambda: with_sets(master, "m"))


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all invoice rows."""
    return candidate_pairs(*sides_of(spark, d))


#: Words of the stand-in's names that count as brands, one of them listed twice.
BRAND_KEYS = ["GEAR", "HOT", "GEAR", "RED WIDGET"]


def heuristic_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return retrieved(pairs_of(spark, d), top_n=5, keys=BRAND_KEYS).select("ruc", F.col("f_code").alias("fact"), F.col("m_code").alias("code"), "rank", "heuristic", "presentation", "tier", "score")


def candidate_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The same chain of shortlist, gates and ranks without the sequence ratio, so that SQL can follow it to the end."""
    found = retrieved(pairs_of(spark, d), top_n=3, keys=BRAND_KEYS, sequence=False)
    return found.select("ruc", F.col("f_code").alias("fact"), F.col("m_code").alias("code"), "rank", "heuristic", "presentation", "tier", "score", "family_strict", "family_soft", "presented_strict", "presented_soft")


def gram_similarity() -> Column:
    """The share of both names' grams, from -1 to 1."""
    return half_up(2 * jaccard("base_grams") - 1, 6)


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with support and retrieval score; the gram similarity of names stands for the embedding, a fixed logistic curve for the model."""
    found = with_support(pairs_of(spark, d))
    found = with_retrieval(found, gram_similarity())
    return found.withColumn("model", half_up(1 / (1 + F.exp(3 - 6 * F.col("support"))), 6))


def support_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored_pairs(spark, d).filter("retrieved <= 5").select("ruc", F.col("f_code").alias("fact"), F.col("m_code").alias("code"), "lexical", "structure", "support", "retrieval", "retrieved")


def final_scores(spark: SparkSession, d: str) -> DataFrame:
    return decided(with_final_scores(scored_pairs(spark, d))).select("ruc", F.col("f_code").alias("fact"), F.col("m_code").alias("code"), "score", "rank", "margin", "verdict")


def match_decision(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on each invoice row, with the caller's own threshold."""
    best = decided(with_final_scores(scored_pairs(spark, d)), top_k=2, threshold=0.60).filter("rank = 1")
    return best.select("ruc", F.col("f_code").alias("fact"), F.col("m_code").alias("code"), "score", "margin", "verdict", (F.col("m_code") == F.col("f_truth")).alias("right"))


def hard_negatives(spark: SparkSession, d: str, least_model: float = 0.25, least_support: float = 0.08, k: int = 2) -> DataFrame:
    """For each invoice row the k hardest catalogue rows of its supplier that are not its own, one a code."""
    wrong = with_mining_support(pairs_of(spark, d).filter("m_code <> f_truth"))
    wrong = wrong.withColumns({"embedding": gram_similarity(), "model": half_up(1 / (1 + F.exp(3 - 6 * F.col("support"))), 6)})
    wrong = wrong.withColumn("hardness", half_up(0.72 * F.col("model") + 0.18 * F.col("support") + 0.10 * (F.col("embedding") + 1) / 2, 6)).filter((F.col("model") >= least_model) | (F.col("support") >= least_support))
    order = [F.desc("hardness"), F.desc("model"), F.desc("support"), F.desc("embedding"), F.col("m_code")]
    one = ranked(wrong, ["ruc", "f_code", "m_code"], order, 1, "of_code")
    return ranked(one, ["ruc", "f_code"], order, k).select("ruc", F.col("f_code").alias("fact"), F.col("m_code").alias("negative"), "support", "hardness", "rank")


def prepared_master(spark: SparkSession, d: str) -> DataFrame:
    cols = ("base", "model_text", "unit", "kind", "factor", "content", "total", "weight", "weight_total")
    return domain.prepare_master(domain.catalogue(spark, d)).select(F.col("RucProveedor").alias("ruc"), F.col("CodProducto").alias("code"), *cols, F.round("total_log", 6).alias("total_log"), F.round("cost_log", 6).alias("cost_log"))


def prepared_invoices(spark: SparkSession, d: str) -> DataFrame:
    cols = ("base", "model_text", "unit", "kind", "factor", "content", "total", "weight", "weight_total")
    return domain.prepare_invoices(domain.invoices(spark, d)).select(F.col("RucProveedor").alias("ruc"), F.col("CodProducto").alias("code"), *cols, F.col("CostoCaja").alias("cost"), F.round("cost_log", 6).alias("cost_log"))


QUERIES = {f.__name__: f for f in (prepared_master, prepared_invoices, heuristic_retrieval, candidate_retrieval, support_scores, final_scores, match_decision, hard_negatives)}
