"""Column functions shared by the screening operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargosift.config import COUNTRY_LEVELS, SEVERITIES


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def signal(name, when: Column, value, weight, evidence) -> Column:
    """A list of one signal struct where the condition holds, else null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(lit(name).alias("name"), lit(value).cast("double").alias("value"), lit(weight).cast("double").alias("weight"), lit(evidence).alias("evidence"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(made))


def signals(*each: Column) -> Column:
    """The lists one after another, null ones left out; compiled, as functions that take a lambda are not."""
    return F.concat(*[F.coalesce(x, F.array()) for x in each])


def severity(score: Column) -> Column:
    return F.when(score >= 0.80, "critical").when(score >= 0.60, "high").when(score >= 0.40, "medium").when(score >= 0.15, "low").otherwise("none")


def rank(name: Column) -> Column:
    """0 to 4 of a severity; unknown names are 0."""
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(name == s, i).otherwise(out)
    return out


def severity_of(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in SEVERITIES]), number), F.lit("none"))


def tier_of(raw: Column) -> Column:
    return F.when(raw >= 0.80, 5).when(raw >= 0.60, 4).when(raw >= 0.40, 3).when(raw >= 0.20, 2).otherwise(1)


def level_value(level: Column) -> Column:
    out = F.lit(0.0)
    for name, v in COUNTRY_LEVELS.items():
        out = F.when(level == name, v).otherwise(out)
    return out


def normal_name(c: Column) -> Column:
    """Party name in lower case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def hs_clean(c: Column) -> Column:
    return F.replace(strip(c), F.lit("."), F.lit(""))


def hs_chapter(c: Column) -> Column:
    """First two digits of a code without points and spaces; null if they are not digits."""
    own = F.replace(hs_clean(c), F.lit(" "), F.lit(""))
    return F.when(own.rlike(r"^[0-9]{2}"), F.substring(own, 1, 2))


def hs_well_formed(c: Column) -> Column:
    return hs_clean(c).rlike(r"^[0-9]{4,}\z")


def first_prefix(code: Column, prefixes: Iterable[str]) -> Column:
    """The first of the prefixes that the code starts with, else null."""
    return F.coalesce(*[F.when(code.startswith(p), F.lit(p)) for p in prefixes], F.lit(None).cast("string"))


def is_round(value: Column, tolerance: float, base: float) -> Column:
    rest = value % F.lit(base)
    return (value > 0) & ((rest < tolerance * value) | (rest > (1 - tolerance) * base))


def keyword_set(text: Column, keywords: Iterable[str]) -> Column:
    """Sorted distinct lower-case keywords that occur in the text as whole words."""
    import re

    from cargosift.functions import keywords as many

    keywords = list(keywords)
    if len(keywords) > many.CHAINED:
        return many.whole_words(text, keywords)
    pattern = r"(?i)\b(" + "|".join(re.escape(k) for k in keywords if k) + r")\b"
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)))
    return F.when(~text.rlike(pattern), F.array().cast("array<string>")).otherwise(found)  # most texts hold none


def softmax(x: Column) -> Column:
    def shares(e: Column) -> Column:
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    shifted = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    return F.element_at(F.transform(F.array(shifted), shares), 1)


def entropy(p: Column) -> Column:
    """Minus the sum of p ln p, each p held to 1e-12 or more."""
    safe = lambda v: F.least(F.greatest(v.cast("double"), F.lit(1e-12)), F.lit(1.0))
    return -F.aggregate(F.transform(p, lambda v: safe(v) * F.ln(safe(v))), F.lit(0.0), lambda a, b: a + b)


def margin(p: Column) -> Column:
    """1 less the gap between the two greatest probabilities; a missing second counts as 0."""
    s = F.sort_array(p, asc=False)
    return 1.0 - (F.get(s, F.lit(0)).cast("double") - F.coalesce(F.get(s, F.lit(1)).cast("double"), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, v: s + v))


def preview(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def fixed(c: Column, digits: int) -> Column:
    """The text that format_string gives; whole numbers make it where rounding is plain, as Java's formatter takes far longer."""
    x = c.cast("double")
    shifted = x * float(10**digits)
    low = F.floor(shifted)
    rest = shifted - low
    near = F.when(rest > 0.5, low + 1).otherwise(low)
    text = F.concat(F.floor(near / 10**digits).cast("string"), F.lit("."), F.substring((near % 10**digits + 10**digits).cast("string"), 2, digits))
    plain = (x > 0) & (x < 1e9) & (F.abs(rest - 0.5) > 1e-3)  # a tie is the formatter's to decide
    return F.when(F.coalesce(plain, F.lit(False)), text).otherwise(F.format_string(f"%.{digits}f", x))


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1000)))


# Parsers of vendor cells.
def parse_level(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("severe", "very high", "critical"), "critical").when(t == "high", "high").when(t.isin("moderate", "medium"), "medium").when(t.isin("minimal", "very low", "low"), "low").otherwise("unknown")


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "y", "t"), F.lit(False))


def parse_share(c: Column) -> Column:
    """Number held to 0..1; above 1 it counts as percent; blank or bad is 0."""
    v = F.coalesce(strip(c).try_cast("double"), F.lit(0.0))
    return F.least(F.greatest(F.when(v > 1, v / 100).otherwise(v), F.lit(0.0)), F.lit(1.0))


def parse_sanctions(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("comprehensive", "sanctioned", "full", "total"), "comprehensive").when(t.isin("sectoral", "partial", "sector"), "sectoral").otherwise("none")


def parse_fatf(c: Column, column_present: bool = True) -> Column:
    """Blank cells of a present column are compliant; a missing column is unknown."""
    if not column_present:
        return F.lit("unknown")
    t = F.coalesce(F.lower(strip(c)), F.lit(""))
    return F.when(t.isin("black", "blacklist", "increased monitoring"), "black").when(t.isin("grey", "greylist", "enhanced monitoring"), "grey").when(t.isin("compliant", "clear", "ok", ""), "compliant").otherwise("unknown")
