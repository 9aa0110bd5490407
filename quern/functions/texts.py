"""Text expressions: normal forms, sentences, windows, domains, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.labels import outside_brackets as without_brackets  # noqa: F401

# Company suffixes, the name of an unknown maker.
SUFFIXES = ["股份有限公司", "有限公司", "股份公司", "(股)公司", "(股)公", "（股）公司", "（股）公"]
UNKNOWN_MAKER = "未知製造商"
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def half_width(text: Column) -> Column:
    """Full-width ASCII as ASCII."""
    return F.translate(text, FULL, HALF)


def maker_key(text: Column) -> Column:
    """A company's name without suffixes and white space."""
    suffixes = "|".join(x.replace("(", r"\(").replace(")", r"\)") for x in SUFFIXES)
    return F.when(F.coalesce(text, F.lit("")) == "", UNKNOWN_MAKER).otherwise(F.regexp_replace(text, rf"{suffixes}|\s+", ""))


def sentences(text: Column) -> Column:
    """Sentences, cut at full stops that are not between digits; trimmed, none empty."""
    marked = F.regexp_replace(text, r"(?<!\d)\.(?!\d)", "。")
    return F.filter(F.transform(F.split(marked, "。"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def essential(found: Column, hints: list[str]) -> Column:
    """Sentences with a hint, else the last one; an empty array where there are none."""
    hit = F.filter(found, lambda s: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(s, h)))
    return F.when(F.size(found) == 0, found).when(F.size(hit) > 0, hit).otherwise(F.slice(found, -1, 1))


def first_hit(text: Column, terms: list[str]) -> Column:
    """1-based place of the first term in the text; null where there is none."""
    return F.array_min(F.filter(F.transform(F.array(*map(F.lit, terms)), lambda t: F.call_function("instr", text, t)), lambda p: p > 0))


def window_around(text: Column, terms: list[str], before: int = 100, width: int = 400) -> Column:
    """`width` characters from `before` ahead of the first term, led by an ellipsis if that is not the start."""
    at = F.greatest(F.coalesce(first_hit(text, terms), F.lit(1)) - 1 - before, F.lit(0))
    return F.concat(F.when(at > 0, "…").otherwise(""), F.substring(F.coalesce(text, F.lit("")), at + 1, F.lit(width)))


def clean_lines(text: Column) -> Column:
    """Distinct lines whose characters besides `|!#-*` and white space are at least 40 %, as one line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    core = lambda x: F.length(F.regexp_replace(x, r"[|!#\-*\s]", ""))
    kept = F.array_distinct(F.filter(lines, lambda x: (core(x) > 0) & (core(x) / F.length(x) >= 0.4)))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "), r"^\s+|\s+$", "")


def domain(url: Column) -> Column:
    """The authority part of an absolute address, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def in_domains(name: Column, domains: list[str]) -> Column:
    """Equal to one of the domains or below it."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d)))


def domain_tier(name: Column, tiers: dict[str, list[str]], other: str = "unknown") -> Column:
    """The first tier with a domain that the name is or lies below."""
    tier = F.lit(other)
    for word, domains in reversed(tiers.items()):
        tier = F.when(in_domains(name, domains), word).otherwise(tier)
    return tier


def mentions(text: Column, name: Column) -> Column:
    """How often a name stands in a text, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).cast("int")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def coerced_id(text: Column) -> Column:
    """The digits of an id such as `candidate 19`, as a number; null without any."""
    return F.regexp_replace(text, r"\D", "").try_cast("long")


def request_id(text: Column) -> Column:
    """The id if it is 1 to 64 of `A-Za-z0-9_.:-`, else an empty text."""
    return F.when(text.rlike(r"^[A-Za-z0-9_.:\-]{1,64}$"), text).otherwise("")
