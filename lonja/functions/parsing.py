"""Pack, measure and content attributes of a product text, as expressions over its lexed words.

`with_attributes` and `with_pack_signals` take a table and the name of its text column, so that the lexed
words are computed once and every rule is a short expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import DIMENSION, MEASURE, PACK, product_tokens

#: Grams or millilitres of one unit of measure; words that are no part of a name.
SCALE = {"MG": 0.001, "G": 1.0, "GR": 1.0, "KG": 1000.0, "LB": 453.592, "OZ": 28.3495, "ML": 1.0, "CC": 1.0, "LT": 1000.0, "L": 1000.0}
VOLUME = ("ML", "CC", "LT", "L")
NOISE = ("RN", "NF", "PE")
#: What `with_attributes` adds.
ATTRIBUTES = ("content", "kind", "clean", "base", "factor", "total", "kg", "model_text")

_in = lambda words: lambda t: F.coalesce(t.isin(*sorted(set(words))), F.lit(False))
is_pack, is_measure, is_dimension = _in(PACK.values()), _in(MEASURE.values()), _in(DIMENSION.values())
is_x = lambda t: F.coalesce(t == "X", F.lit(False))
is_pair = lambda t: F.coalesce(t.rlike("^[0-9]+-[0-9]+$"), F.lit(False))


def number(t: Column) -> Column:
    """A whole or decimal number, or a fraction; null for other words."""
    part = lambda i: F.try_element_at(F.split(t, "/"), F.lit(i)).try_cast("double")
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double")).when(t.rlike("^[0-9]+/[0-9]+$"), F.try_divide(part(1), part(2)))


def whole_number(t: Column) -> Column:
    """A number without fraction, else null."""
    n = number(t)
    return F.when(n == F.floor(n), n)


def _places(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.sequence(F.lit(0), F.size(toks) - 1)).otherwise(F.array().cast("array<int>"))


def _walk(toks: Column, least: float, pairs_of: float) -> Column:
    """Places read from left to right: numbers before a pack word, after a pack word and X, and hyphen pairs before a pack word.

    What one rule takes the next one does not see. Entries (place, number); a pair gives two.
    """
    at = lambda i: F.get(toks, i)
    entry = lambda i, n: F.struct(i.cast("int").alias("i"), n.cast("double").alias("n"))
    none = F.array().cast("array<struct<i:int,n:double>>")
    start = F.struct(F.lit(0).alias("next"), none.alias("found"))

    def step(s: Column, i: Column) -> Column:
        ahead, behind = whole_number(at(i)), whole_number(at(i + 2))
        half = lambda k: F.try_element_at(F.split(at(i), "-"), F.lit(k)).try_cast("double")
        taken = lambda n, entries: F.struct((i + n).cast("int").alias("next"), F.concat(s["found"], entries).alias("found"))
        return (
            F.when(i < s["next"], s)
            .when((ahead > least) & is_pack(at(i + 1)), taken(2, F.array(entry(i, ahead))))
            .when(is_pair(at(i)) & is_pack(at(i + 1)) & (half(1) > pairs_of) & (half(2) > pairs_of), taken(2, F.array(entry(-2 - i, half(1)), entry(-2 - i, half(2)))))
            .when(is_pack(at(i)) & is_x(at(i + 1)) & (behind > least), taken(3, F.array(entry(i + 2, behind))))
            .otherwise(s)
        )

    return F.aggregate(_places(toks), start, step)["found"]


def _measured(toks: Column, positive: bool) -> Column:
    """Place of the first number that a measure follows, or -1."""
    at = lambda i: F.get(toks, i)
    fits = lambda i: is_measure(at(i + 1)) & (F.coalesce(number(at(i)) > 0, F.lit(False)) if positive else F.coalesce(at(i).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.lit(False)))
    return F.coalesce(F.array_min(F.filter(_places(toks), fits)), F.lit(-1))


def _behind_measure(toks: Column, m: Column, least: float) -> Column:
    """Places of numbers behind an X after the measure, up to the first that leads to another measure or a dimension."""
    at = lambda i: F.get(toks, i)
    after = F.filter(_places(toks), lambda i: (i >= m + 3) & is_x(at(i - 1)) & F.coalesce(whole_number(at(i)) > least, F.lit(False)))
    stop = F.coalesce(F.array_min(F.filter(after, lambda i: is_measure(at(i + 1)) | is_dimension(at(i + 1)))), F.lit(1 << 30))
    return F.when(m >= 0, F.filter(after, lambda i: i < stop)).otherwise(F.array().cast("array<int>"))


def with_attributes(df: DataFrame, text: str) -> DataFrame:
    """df with clean, base, factor, content, total, kind, kg and model_text of its product text.

    A number counts towards the factor, once, when it stands before a pack word, after a pack word and X,
    before X and a measure, after X behind the first measure, or in an A X B that ends the text or leads to
    a pack word; both numbers of a hyphen pair before a pack word count.
    """
    toks, at = F.col("_toks"), lambda i: F.get(F.col("_toks"), i)
    out = df.withColumn("_toks", product_tokens(F.col(text)))
    out = out.withColumns({"_m": _measured(toks, True), "_walk": _walk(toks, 1, -1)})
    m = F.col("_m")
    value, word = number(at(m)), at(m + 1)
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv]), word)
    # Where the measure's word has no scale of its own the number is no content.
    content = F.when((m >= 0) & scale.isNotNull(), value * scale).otherwise(0.0)
    count = lambda i: F.coalesce(whole_number(at(i)), F.lit(0.0))
    sized = F.filter(_places(toks), lambda i: (count(i) > 1) & is_x(at(i + 1)) & number(at(i + 2)).isNotNull() & is_measure(at(i + 3)))
    ends = lambda i: whole_number(at(i)).isNotNull() & is_x(at(i + 1)) & whole_number(at(i + 2)).isNotNull() & (at(i + 3).isNull() | is_pack(at(i + 3)) | F.coalesce(at(i + 3) == "EX", F.lit(False)))
    crossed = F.flatten(F.transform(F.filter(_places(toks), ends), lambda i: F.array(i, (i + 2).cast("int"))))
    walked = F.filter(F.col("_walk"), lambda e: e["n"] > 1)
    places = F.array_distinct(F.filter(F.concat(F.transform(F.filter(walked, lambda e: e["i"] >= 0), lambda e: e["i"]), sized, _behind_measure(toks, m, 1), crossed), lambda i: count(i) > 1))
    paired = F.transform(F.filter(walked, lambda e: e["i"] < 0), lambda e: e["n"])
    out = out.withColumns({"_used": places, "_pairs": paired, "content": content, "kind": F.when(content <= 0, "NONE").when(word.isin(*VOLUME), "VOLUME").otherwise("MASS")})
    used = F.col("_used")
    factor = F.aggregate(F.concat(F.transform(used, count), F.col("_pairs")), F.lit(1.0), lambda x, y: x * y)

    def name(i: Column) -> Column:  # the word as part of the name, or null
        t = F.regexp_replace(at(i), "^[0-9]{2,4}-", "")
        near = lambda j: is_pack(at(j)) | is_measure(at(j)) | is_x(at(j))
        small = t.rlike("^[0-9]+$") & (t.try_cast("double") <= 10) & ~F.when(i > 0, near(i - 1)).otherwise(False) & ~near(i + 1)
        gone = F.array_contains(used, i) | ((F.col("_m") >= 0) & ((i == F.col("_m")) | (i == F.col("_m") + 1)))
        junk = (t == "") | is_pack(t) | is_measure(t) | is_x(t) | t.isin(*NOISE) | t.rlike("^(RN[0-9]+|[0-9]+-[0-9]+)$")
        return F.when(~gone & ~junk & (~t.rlike(r"^[0-9]+(\.[0-9]+)?$") | small), t)

    clean = F.array_join(toks, " ")
    base = F.array_join(F.filter(F.transform(_places(toks), name), lambda t: t.isNotNull()), " ")
    out = out.withColumns({"clean": clean, "base": F.when(base == "", clean).otherwise(base), "factor": F.when(F.size(toks) > 0, factor).otherwise(1.0)})
    out = out.withColumns({"total": F.col("content") * F.col("factor"), "kg": F.when(F.col("kind") == "MASS", F.col("content") / 1000).otherwise(0.0)})
    shown = lambda mark, x: F.concat(F.lit(mark), F.bround(x).cast("long").cast("string"))
    marks = F.concat_ws(
        " ", F.when(F.col("base") != "", F.col("base")), F.when(F.col("factor") > 1, shown("FC_", F.col("factor"))),
        F.when(F.col("content") > 0, shown("CONT_", F.col("content"))), F.when(F.col("kind") != "NONE", F.concat(F.lit("TIPO_"), "kind")),
    )
    return out.withColumn("model_text", marks).drop("_m", "_walk", "_used", "_pairs", "_toks")


def with_pack_signals(df: DataFrame, text: str) -> DataFrame:
    """df with factor_sale, factor_case, strength, explicit and source of the pack signal, by order of precedence; and attributes."""
    out = with_attributes(df, text).withColumn("_toks", F.split("clean", " "))
    toks, at = F.col("_toks"), lambda i: F.get(F.col("_toks"), i)
    out = out.withColumns({"_m": _measured(toks, False), "_explicit": F.transform(_walk(toks, 1, 1), lambda e: e["n"])})
    m, explicit, none = F.col("_m"), F.col("_explicit"), F.array().cast("array<double>")
    count = lambda i: F.coalesce(whole_number(at(i)), F.lit(0.0))
    half = lambda k: F.try_element_at(F.split(at(m + 3), "-"), F.lit(k)).try_cast("double")
    linked = (m >= 0) & is_x(at(m + 2))
    hyphen = linked & is_pair(at(m + 3)) & (half(1) > 1) & (half(2) > 1)
    chain = F.when(linked & at(m + 3).isNotNull(), F.transform(_behind_measure(toks, m, 1), count)).when((m >= 0) & ~is_x(at(m + 2)) & (count(m + 2) > 1), F.array(count(m + 2))).otherwise(none)
    ahead = F.filter(_places(toks), lambda i: (count(i) > 1) & is_x(at(i + 1)) & whole_number(at(i + 2)).isNotNull() & is_measure(at(i + 3)))
    first = F.array_min(F.filter(_places(toks), lambda i: (count(i) > 1) & is_x(at(i + 1)) & whole_number(at(i + 2)).isNotNull()))
    loose = (m < 0) & ~F.exists(toks, is_dimension) & first.isNotNull()
    runs_on = lambda s, i: F.when(s["open"] & is_x(at(i - 1)) & (count(i) > 1), F.struct(F.lit(True).alias("open"), F.concat(s["n"], F.array(count(i))).alias("n"))).otherwise(F.struct(F.lit(False).alias("open"), s["n"].alias("n")))
    steps = F.when(first + 4 < F.size(toks), F.sequence(first + 4, F.size(toks) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    free = F.aggregate(steps, F.struct(F.lit(True).alias("open"), F.array(count(first), count(first + 2)).alias("n")), runs_on)["n"]
    free = F.when(loose & (count(first + 2) <= 1), F.array(count(first))).when(loose, free).otherwise(none)
    out = out.withColumns({"_hyphen": F.coalesce(hyphen, F.lit(False)), "_chain": F.when(hyphen, none).otherwise(chain), "_ahead": F.coalesce(count(F.array_min(ahead)), F.lit(0.0)), "_free": free, "_a": half(1), "_b": half(2)})
    chain, free = F.col("_chain"), F.col("_free")
    source = (
        F.when(F.col("_hyphen"), "after_measure_hyphen").when(F.size(chain) >= 2, "after_measure_chain").when(F.size(explicit) > 0, "explicit_pack_tokens")
        .when(F.size(chain) == 1, "after_measure_single").when(F.col("_ahead") > 1, "pre_measure_count").when(F.size(free) > 0, "generic_x_chain").otherwise("")
    )
    out = out.withColumn("source", source)
    source, product = F.col("source"), lambda a: F.aggregate(a, F.lit(1.0), lambda x, y: x * y)
    sale = (
        F.when(source == "after_measure_hyphen", F.col("_a")).when(source.isin("after_measure_chain", "after_measure_single"), F.element_at(chain, -1))
        .when(source == "explicit_pack_tokens", F.element_at(explicit, -1)).when(source == "pre_measure_count", F.col("_ahead")).when(source == "generic_x_chain", F.element_at(free, 1)).otherwise(0.0)
    )
    own = (
        F.when(source == "after_measure_hyphen", F.col("_a") * F.col("_b")).when(source == "after_measure_chain", product(chain)).when(source == "explicit_pack_tokens", product(explicit))
        .when(source == "generic_x_chain", product(free)).when(source == "", 1.0).otherwise(sale)
    )
    case = F.when(F.col("factor") > 1, F.bround("factor")).otherwise(own)
    strength = (
        F.when(source == "after_measure_hyphen", 0.97).when(source == "after_measure_chain", 0.96).when(source == "explicit_pack_tokens", F.when(F.size(explicit) >= 2, 0.93).otherwise(0.88))
        .when(source == "after_measure_single", 0.93).when(source == "pre_measure_count", 0.90).when(source == "generic_x_chain", F.when(F.size(free) == 1, 0.84).when(F.size(free) == 2, 0.91).otherwise(0.89)).otherwise(0.0)
    )
    empty = F.col("clean") == ""
    sale = F.when(sale > 0, sale).otherwise(case)
    out = out.withColumns({"factor_sale": F.when(empty, 0).otherwise(sale).cast("long"), "factor_case": F.when(empty, 0).otherwise(F.greatest(case, sale)).cast("long"), "strength": strength, "explicit": source != ""})
    return out.drop("_toks", "_m", "_explicit", "_hyphen", "_chain", "_ahead", "_free", "_a", "_b")
