"""Column functions for codes, labels and dirty product text; all run in the JVM."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the letters under them, by Unicode decomposition; the marks themselves go.
_MARKED = {c: u for c in map(chr, range(0xC0, 0x2000)) if len(u := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) == 1 and u != c}
_ACCENTED, _PLAIN = "".join(_MARKED) + "".join(map(chr, range(0x300, 0x370))), "".join(_MARKED.values())

#: Spellings of pack words, measures and dimensions, and unit names.
PACK = {
    "UND": "UND", "UNDS": "UND", "UNID": "UND", "UNIDADES": "UND", "UN": "UND", "U": "UND", "IT": "UND", "UAD": "UND",
    "PQT": "PQT", "PAQ": "PQT", "PAQT": "PQT", "PACK": "PCK", "PCK": "PCK", "PK": "PCK",
    "BOL": "BOL", "BLS": "BOL", "BOT": "BOT", "BTL": "BOT", "CJ": "CJA", "CAJ": "CJA", "CJA": "CJA", "CAJA": "CJA",
    "BDJ": "BDJ", "BAN": "BAN", "DP": "DP", "DISPLAY": "DP", "DISPLEY": "DP",
    "SOB": "SOB", "SACHET": "SACHET", "SACH": "SACHET", "ROL": "ROL", "TIRA": "TIRA",
}
MEASURE = {
    "MG": "MG", "GR": "GR", "G": "G", "KG": "KG", "KGS": "KG", "ML": "ML", "CC": "CC",
    "LT": "LT", "LTS": "LT", "LTR": "LT", "L": "L", "LB": "LB", "LIBRAS": "LB", "LIBRA": "LB", "ONZA": "OZ", "ONZAS": "OZ",
}
DIMENSION = {"CM": "CM", "MM": "MM", "MPLG": "MPLG", "PLG": "PLG", "PULG": "PLG", "INCH": "INCH", "MTS": "MTS", "MTR": "MTR", "METRO": "METRO", "HJ": "HJ"}
UNIT = {
    "NIU": "UNIDAD", "UND": "UNIDAD", "UNIDAD": "UNIDAD", "PIEZA": "UNIDAD", "KGM": "KG", "KG": "KG", "GRM": "G", "G": "G",
    "LTR": "LT", "L": "LT", "LT": "LT", "MLT": "ML", "ML": "ML", "BX": "CAJA", "CJ": "CAJA", "CAJ": "CAJA", "CJA": "CAJA", "CAJA": "CAJA", "PF": "PALETAS",
}


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fixed_map(values: dict[str, str]) -> Column:
    """A small fixed map as one constant, so that plans stay small wherever it is used."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in values.items())), F.lit("\x1e"), F.lit("\x1f"))


def lookup(values: dict[str, str], c: Column) -> Column:
    """The value of a small fixed map, or the column itself."""
    return F.coalesce(F.element_at(fixed_map(values), c), c)


def no_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def code(c: Column) -> Column:
    """A product code without white space, in upper case."""
    return F.upper(F.regexp_replace(or_empty(c), r"\s+", ""))


def tax_id(c: Column) -> Column:
    """A supplier's tax id without the .0 that numeric columns leave."""
    return F.regexp_replace(F.trim(or_empty(c)), r"\.0$", "")


def robust_code(c: Column) -> Column:
    """A code, with 12345.00 and 1.2E+5 written out."""
    c = code(c)
    return F.when(c.rlike(r"^\d+\.0+$"), F.regexp_extract(c, r"^(\d+)", 1)).when(c.rlike(r"^\d+(\.\d+)?E[+]?\d{1,2}$"), F.format_string("%.0f", c.try_cast("double"))).otherwise(c)


def code_variants(c: Column) -> Column:
    """A code and the code without leading zeros."""
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"^0+(?=.)", "")))


def label(c: Column) -> Column:
    """Brand and category names: no accents, upper case, only letters and digits."""
    return F.trim(F.regexp_replace(F.upper(no_accents(or_empty(c))), r"[^A-Z0-9]+", " "))


def unescaped(c: Column) -> Column:
    """Named and numbered HTML entities as the characters they stand for; unknown names stay."""
    names = fixed_map({name: chr(point) for name, point in name2codepoint.items()})
    point = lambda e: F.when(e.rlike("^#[xX]"), F.conv(F.substring(e, 3, 8), 16, 10)).otherwise(F.substring(e, 2, 8)).try_cast("int")
    sign = lambda e: F.when(e.startswith("#"), F.decode(F.unhex(F.lpad(F.hex(point(e)), 8, "0")), "UTF-32")).otherwise(F.element_at(names, e))
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&(#\d{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    # The ampersand last, so that what it sets free is not read again.
    found = F.concat(F.filter(found, lambda e: e != "amp"), F.filter(found, lambda e: e == "amp"))
    done = F.aggregate(found, c, lambda text, e: F.replace(text, F.concat(F.lit("&"), e, F.lit(";")), F.coalesce(sign(e), F.concat(F.lit("&"), e, F.lit(";")))))
    return F.when(c.contains("&"), done).otherwise(c)


_GLUED = "|".join(["CJA", "CJ", "CAJ", "CAJA", "UND", "UNID", "UNIDADES", "UN", "U", "IT", "PQT", "PAQ", "PAQT", "PACK", "PCK", "PK", "BOL", "BLS", "BOT", "BTL", "BDJ", "BAN", "DP", "DISPLAY", "DISPLEY", "SOB", "SACHET", "SACH", "ROL", "TIRA"])
WORDS = PACK | MEASURE | DIMENSION
_NAMES = sorted(set(WORDS.values()) | set(WORDS))


def product_tokens(c: Column) -> Column:
    """The lexed words of a dirty product text.

    Markup, accents and noise go first. Dots stay inside numbers only. Numbers and letters come apart, but
    words joined by hyphen or slash (PE-XTRA, 029-MACA, 16-6) stay whole. An X that starts a run of letters
    is a word of its own, and so is one behind a pack word, measure or dimension (CJAX, GRX, LX). Signs left
    alone go, and pack words, measures and dimensions get one spelling.
    """
    for pattern, by in ((r"<[^>]+>", " "),):
        c = F.regexp_replace(unescaped(or_empty(c)), pattern, by)
    c = F.replace(F.upper(no_accents(c)), F.lit("POR ANTICIPO DE MERCADERIA"), F.lit(" "))
    for pattern, by in (
        (r"@#@.*|\[\S*", " "), (r"(?U)[^\w\s/.-]|_", " "), (r"(?<=[A-Z])\.(?=[A-Z0-9])|(?<=[0-9])\.(?=[A-Z])|(?<![0-9])\.(?![0-9])", " "),
        (r"(?<=[0-9])(?=[A-Z])|(?<=[A-Z])(?=[0-9])", " "), (rf"(?<=[0-9] )X(?=(?:{_GLUED})\b)", "X "),
    ):
        c = F.regexp_replace(c, pattern, by)
    known = lambda t: F.element_at(fixed_map({n: WORDS.get(n, n) for n in _NAMES}), t)
    stem = lambda t: F.when(t.endswith("X") & (F.length(t) > 1), known(F.substring(t, F.lit(1), F.length(t) - 1)))
    letters = lambda t: F.when(known(t).isNotNull(), F.array(known(t))).when(stem(t).isNotNull(), F.array(stem(t), F.lit("X"))).otherwise(F.array(t))
    parts = lambda chunk: F.flatten(F.transform(F.regexp_extract_all(chunk, F.lit(r"X|\p{L}+|[0-9]+(?:\.[0-9]+)*"), F.lit(0)), letters))
    whole = lambda chunk: chunk.rlike(r"^[A-Z0-9]+([-/][A-Z0-9]+)+$")
    chunks = F.filter(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " "), lambda t: t != "")
    return F.flatten(F.transform(F.transform(chunks, lambda t: F.btrim(t, F.lit("."))), lambda t: F.when(whole(t), F.array(t)).otherwise(parts(t))))


def product_text(c: Column) -> Column:
    return F.array_join(product_tokens(c), " ")


def unit(c: Column) -> Column:
    return lookup(UNIT, product_text(c))


def tokens(c: Column) -> Column:
    """Distinct words of a text, none for an empty one."""
    return F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != ""))


def char_grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text without spaces; the whole of it if it is no longer than n."""
    # The text is bound by a transform over a single element, instead of being built anew for each gram.
    grams = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    all_grams = F.element_at(F.transform(F.array(F.regexp_replace(c, r"\s+", "")), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(grams(s))), 1)
    return F.array_distinct(all_grams)


def one_and_two_grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)
