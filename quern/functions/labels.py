"""Predicates and normal forms of label records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for no maker.
PLACEHOLDERS = ["未知", "未知製造商", "無", "n/a", "none", "unknown", "test", "測試", ""]
# Status codes of an upstream that is down.
DOWN = [502, 503, 504, 520, 521, 522, 523, 524, 525, 526, 527, 530]
# Keys of an analysis, and status values of what is none.
ANALYSIS_KEYS = ["product_info", "final_health_diagnosis", "name", "ingredients", "ingredients_list", "nutrition", "nutrition_facts", "health_score"]
NO_ANALYSIS = ["error", "rejected", "not_found", "degraded"]
# Domains of regulators.
REGULATORS = ["efsa.europa.eu", "who.int", "fao.org", "inchem.org", "fda.gov", "fsa.gov.uk", "mhlw.go.jp", "fda.gov.tw"]
# Points of a title by its source.
TITLE_POINTS = {"official": 30, "news": 20, "wiki": 10, "consumer_complaint": 5}
# One form of punctuation.
CANON = {"‘": "'", "’": "'", "ʼ": "'", "´": "'", "`": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-"}
# Apostrophes that names are written with or without.
APOSTROPHES = "['’‘′`ˊ]"
# Notes on a substance's state.
NOTES = ["無水", "液狀", "粉狀", "顆粒", "天然", "人工", "食品級", "非基因改造", "基因改造", "含", "微量", "適量"]


def either(column: Column, terms: list[str]) -> Column:
    """Does the text hold any of the terms."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(column, t))


def absolute_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://[^/]"), F.lit(False))


def placeholder_name(name: Column) -> Column:
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.lower(bare).isin(PLACEHOLDERS) | (F.length(bare) < 2)


def must_degrade(code: Column, failed: Column) -> Column:
    """A raised failure, or a status code of an upstream that is down; no code is no failure."""
    return F.coalesce(code.isin(DOWN), F.lit(False)) | failed


def is_analysis(payload: Column) -> Column:
    """Is a JSON payload the result of an analysis: by its status, else by the keys that it has."""
    keys, status = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.get_json_object(payload, "$.status")
    data = F.coalesce(F.startswith(F.get_json_object(payload, "$.data"), F.lit("{")), F.lit(False))
    known = F.arrays_overlap(keys, F.array(*map(F.lit, ANALYSIS_KEYS)))
    return F.when(status.isin(NO_ANALYSIS), False).otherwise((F.coalesce(status == "success", F.lit(False)) & data) | known)


def trace_verdict(event: Column, events: list[str], request: Column, ms: Column) -> Column:
    """`ok`, or the first field of a trace row that is not valid."""
    return (
        F.when(~F.coalesce(event.isin(events), F.lit(False)), "event")
        .when(~F.coalesce(request.rlike(r"^[A-Za-z0-9_.:\-]{1,64}$"), F.lit(False)), "id")
        .when(~F.coalesce(ms.between(0, 600_000), F.lit(False)), "duration")
        .otherwise("ok")
    )


def topic_hits(text: Column, keywords: list[str], company: Column) -> Column:
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: ~k.rlike("[0-9]") & ~F.contains(company, k) & F.contains(text, k))


def item_name(name: Column) -> Column:
    """An item without marks around it, without a leading word for `contains` and without the tail of a listing."""
    marks = r"[\s　。，,、;；:：●•·※*]+"
    bare = F.regexp_replace(name, f"^{marks}|{marks}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "^(?:含|添加|另含|並含)", ""), "(?:及其製品|及製品|等)$", ""))


def cjk_share(text: Column) -> Column:
    """The share of Chinese characters among those that are not blank; null for a blank text."""
    body = F.regexp_replace(text, " ", "")
    return F.try_divide(F.length(F.regexp_replace(body, "[^一-鿿]", "")), F.length(body))


def folded(text: Column) -> Column:
    """Letters and digits only, full-width ASCII as ASCII, lower case."""
    from quern.functions.texts import half_width

    return F.lower(F.regexp_replace(half_width(text), r"[^\p{L}\p{N}]", ""))


def label_name(text: Column) -> Column:
    """A name as it is looked up: half width, one form of punctuation, no apostrophes, no bracketed notes, no white space; letters keep their case."""
    from quern.functions.texts import half_width

    canon = F.translate(half_width(text), "".join(CANON), "".join(CANON.values()))
    return F.regexp_replace(F.regexp_replace(canon, APOSTROPHES, ""), r"\(.*?\)|\s+", "")


def outside_brackets(text: Column) -> Column:
    """The text outside of brackets of any depth, round, square and curly; a bracket that is not closed stays with its text.

    The innermost pairs go again and again: as often as the text has closing brackets at
    most, so the expression repeats while it changes anything.
    """
    inner = r"[（(\[{][^（()）\[\]{}]*[)）\]}]"
    depth = F.length(text) - F.length(F.regexp_replace(text, r"[)）\]}]", ""))
    return F.aggregate(F.sequence(F.lit(0), F.coalesce(depth, F.lit(0))), text, lambda t, _: F.regexp_replace(t, inner, ""))


def is_note(name: Column) -> Column:
    """Is what stands in brackets a note (a state, an origin, a share) and no item."""
    key = label_name(name)
    return (key == "") | key.isin(NOTES) | key.rlike(r"^(?:來自|源自|取自|添加|約)|來源$|^\d+(?:\.\d+)?%?$")


def parts_of(text: Column) -> Column:
    """The items between the first opening and the last closing bracket."""
    inside = F.regexp_extract(text, r"(?s)[（({\[](.*)[）)}\]]", 1)
    return F.filter(F.split(inside, "[、,，/]"), lambda x: label_name(x) != "")


def is_compound(text: Column, generic: list[str], least: int = 3) -> Column:
    """A food of its own with at least three parts in brackets; a generic term is none."""
    outer = label_name(outside_brackets(text))
    bare = F.regexp_replace(outer, "^複方", "")
    return (outer != "") & ~outer.isin(generic) & ~bare.isin(generic) & (F.size(parts_of(text)) >= least)


def number_present(value: Column, text: Column) -> Column:
    """Does a number stand in a text as a whole: not within a longer one, 9 and 9.0 alike."""
    plain = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    pattern = F.concat(F.lit(r"(?<![\d.])"), F.replace(plain, F.lit("."), F.lit(r"\.")), F.when(F.contains(plain, F.lit(".")), r"0*").otherwise(r"(?:\.0+)?"), F.lit(r"(?![\d])(?!\.\d)"))
    return F.coalesce(F.call_function("regexp_like", text, pattern), F.lit(False))


def evidence_scope(url: Column, kind: Column) -> Column:
    """regulatory_or_authority where the address or the kind says so, else null."""
    return F.when(either(F.lower(F.coalesce(url, F.lit(""))), REGULATORS) | F.coalesce(F.lower(F.trim(kind)) == "official", F.lit(False)), "regulatory_or_authority")


def display_name(name: Column, english: Column, aliases: Column) -> Column:
    """`english (name)`, else the first alias in ASCII with the name, else the name."""
    ascii_alias = F.get(F.filter(aliases, lambda a: a.rlike("^[ -~]+$")), F.lit(0))
    other = F.coalesce(F.when(F.trim(english) != "", english), ascii_alias)
    return F.when(other.isNotNull(), F.concat(other, F.lit(" ("), name, F.lit(")"))).otherwise(name)


def title_score(title: Column, kind: Column) -> Column:
    """How well a title names an event: by source, less for noise, more for a fitting length; -100 without one."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", "")
    base = F.lit(0)
    for k, points in TITLE_POINTS.items():
        base = F.when(kind == k, points).otherwise(base)
    minus = F.when(t.rlike(r"^\[(?:PDF|pdf)\]"), 20).otherwise(0) + F.when(t.rlike(r"^[一-鿿]{2,4}\s*[-—|]"), 15).otherwise(0) + F.when(F.lower(t).rlike("facebook|instagram"), 15).otherwise(0)
    return F.when(t == "", -100).otherwise(base - minus + F.when(F.length(t).between(10, 45), 5).otherwise(0))


def link_label(url: Column, kind: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.contains(low, F.lit("threads.com")), "Threads 連結").when(F.contains(low, F.lit("wikipedia.org")), "維基百科")
        .when(kind == "official", "官方公告").when(kind == "news", "新聞連結").when(kind == "social", "社群討論").otherwise("來源連結")
    )


def clean_label(text: Column, most: int = 40) -> Column:
    """A text as part of a file's name."""
    return F.left(F.regexp_replace(F.trim(text), r"[^\w\-一-鿿]+", "_"), F.lit(most))


def reader_id(text: Column, backend: Column) -> Column:
    """What stands before ` (`, 32 characters at most, else the backend's name."""
    name = F.left(F.trim(F.substring_index(text, " (", 1)), F.lit(32))
    return F.coalesce(F.when(name != "", name), backend)


def byte_offset(text: Column, characters: Column) -> Column:
    """How many UTF-8 bytes stand before a character."""
    return F.octet_length(F.substring(text, F.lit(1), characters))


def without_data_prefix(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("data:")), F.regexp_replace(text, "^data:[^,]*,", "")).otherwise(text)


def greedy_json(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """From the first opening to the last closing bracket, if that is JSON."""
    found = F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def has_exact_keys(text: Column, keys: list[str]) -> Column:
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def split_names(text: Column) -> Column:
    """Names between semicolons and enumeration commas, normalised, none empty."""
    return F.filter(F.transform(F.split(text, "[;；、]"), label_name), lambda n: n != "")


def first_condition(conditions: Column, groups: dict[str, str], other: str = "general") -> Column:
    """The group of the first condition that has one."""
    table = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair))
    return F.coalesce(F.get(F.filter(F.transform(conditions, lambda c: F.element_at(table, F.trim(c))), lambda g: g.isNotNull()), F.lit(0)), F.lit(other))
