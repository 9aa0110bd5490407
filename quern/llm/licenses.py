"""License scans by ordered signature rules, in DataFrame operations only.

A text's ASCII letters are lower-cased and it is cut into words.  One regex pass
finds which rules' keywords it has; only those rules are tried.  Each match is
an interval of words.  A detection gives way if another one of at least its
priority contains its interval (of equal intervals and priorities the rule that
stands first stays).  What is left gives the labels.

Null and empty texts have no words, no labels and score 0.  The work is row by
row, without a shuffle, so repeated rows get equal values; an empty table gives an
empty one.  Whole texts are read, of any length.  `scan` adds columns that end in an
underscore; the query reads the id and the text only, so other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.license_rules import BASE, RULES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[tuple[str, int, str, str, bool, int]]:
    """(label, priority, keyword, regex on spaced words, base, rank).  Every word has a blank of its own on both sides, so neighbouring matches share none."""
    out = []
    for text, base in ((BASE, True), (RULES, False)):
        for line in text.strip().splitlines():
            label, priority, keyword, regex = (x.strip() for x in line.split("; ", 3))
            regex = regex.replace(" ?", "(?:  )?").replace("[^ ]", "[^\x00]").replace(" ", "  ").replace("(?:    )?", "(?:  )?").replace("[^\x00]", "[^ ]")
            out.append((label, int(priority), keyword, f" {regex} ", base, len(out)))
    return out


def keyword_pattern(keywords: set[str]) -> str:
    """One group of all keywords, by first letter."""
    by: dict[str, list[str]] = {}
    for k in sorted(keywords, key=lambda k: (-len(k), k)):
        by.setdefault(k[0], []).append(k[1:])
    return " (" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(by.items())) + ") "


def spaced(text: Column) -> Column:
    """` w1  w2  w3 `: lower-cased words, each with a blank on both sides; empty without words."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def n_words(spaced_text: Column) -> Column:
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("int")


def intervals(spaced_text: Column, rule: Column) -> Column:
    """All matches of one rule: array of (start, minus end, minus priority, rank, label, base)."""
    matches = F.call_function("regexp_extract_all", spaced_text, rule["regex"], F.lit(0))
    between = F.call_function("split", spaced_text, rule["regex"], F.lit(-1))
    lengths = F.zip_with(F.transform(F.slice(between, F.lit(1), F.size(matches)), n_words), F.transform(matches, n_words), lambda a, b: F.struct(a.alias("gap"), b.alias("n")))
    found = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(found).alias("found"))
    folded = F.aggregate(
        lengths,
        start,
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end")))).alias("found")),
        lambda acc: acc["found"],
    )
    return F.transform(folded, lambda i: F.struct(i["start"].alias("start"), (-i["end"]).alias("end"), (-rule["priority"]).alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["base"].alias("base")))


def unsuppressed(detections: Column) -> Column:
    """The detections that none of at least their priority contains.  They come sorted by start, longest first, highest priority first."""
    kind = "array<struct<start:int,end:int,priority:int,rank:int,label:string,base:boolean>>"
    start = F.struct(*(F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)), F.array().cast(kind).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["end"], -d["priority"]
        reach = F.when(priority == 3, acc["m3"]).when(priority == 2, acc["m2"]).otherwise(acc["m1"])
        ends = [F.when(priority >= p, F.greatest(acc[f"m{p}"], end)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(reach >= end, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(detections, start, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, with n_words_ and detections_ (all) and kept_ (after suppression) as arrays of intervals."""
    table = rules()
    fields = ("label", "priority", "keyword", "regex", "base", "rank")
    literal = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(fields, r))) for r in table))
    s = F.col("spaced_")
    keywords = F.array_distinct(F.regexp_extract_all(s, F.lit(keyword_pattern({r[2] for r in table})), F.lit(1)))
    tried = F.filter(literal, lambda r: F.array_contains(F.col("keywords_"), r["keyword"]))
    rows = docs.withColumn("spaced_", spaced(F.col(text))).withColumn("keywords_", keywords)
    found = F.when(F.size("keywords_") > 0, F.array_sort(F.flatten(F.transform(tried, lambda r: intervals(s, r)))))
    rows = rows.withColumn("n_words_", n_words(s)).withColumn("detections_", found)
    return rows.withColumn("kept_", F.when(F.size("detections_") > 0, unsuppressed(F.col("detections_")))).drop("spaced_", "keywords_")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's query."""
    rows = scan(docs.select("doc_id", "text"))
    base = F.coalesce(F.filter("detections_", lambda d: d["base"]), F.array().cast("array<struct<start:int,end:int,priority:int,rank:int,label:string,base:boolean>>"))
    own = F.coalesce(F.transform("kept_", lambda d: d["label"]), F.array().cast("array<string>"))
    base_labels = F.array_distinct(F.transform(base, lambda d: d["label"]))
    starts = F.transform(base, lambda d: d["start"])
    best = F.coalesce(F.array_max(F.transform("kept_", lambda d: -d["priority"])), F.lit(0))
    return rows.select(
        "doc_id", F.col("n_words_").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base_labels, own)), ",").alias("labels"),
        F.round(best / 3, 4).alias("score"),
    )


def sql() -> str:
    """The same in SQL, with the rules as a table of values."""
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    values = ",\n".join(f"({quote(label)}, {p}, {quote(k)}, {quote(r)}, {str(b).lower()}, {n})" for label, p, k, r, b, n in rules())
    words = lambda s: f"((length({s}) - length(replace({s}, ' ', ''))) // 2)"
    return rf"""
WITH rules(label, priority, keyword, regex, base, rank) AS (VALUES {values}),
cut AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', '  ', 'g')) AS t FROM documents),
norm AS MATERIALIZED (SELECT r, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS s FROM cut),
tried AS (SELECT r, s, rules.*, regexp_extract_all(s, regex) AS m, string_split_regex(s, regex) AS p FROM norm JOIN rules ON contains(s, ' ' || keyword || ' ')),
steps AS (SELECT r, label, priority, base, rank, unnest(range(1, len(m) + 1)) AS i, m, p FROM tried WHERE len(m) > 0),
found AS (SELECT r, label, priority, base, rank,
  list_sum(list_transform(p[1:i], lambda x: {words("x")})) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: {words("x")})), 0) AS start_, {words("m[i]")} AS n FROM steps),
kept AS (SELECT *, NOT EXISTS (SELECT 1 FROM found e WHERE e.r = d.r AND e.start_ <= d.start_ AND e.start_ + e.n >= d.start_ + d.n AND e.priority >= d.priority
  AND (e.n > d.n OR e.priority > d.priority OR e.rank < d.rank)) AS stays FROM found d),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(start_) FILTER (base) AS first_word, max(start_) FILTER (base) AS last_word,
  list_sort(list_distinct(list(label) FILTER (base))) AS base_list, list_sort(list_distinct(list(label) FILTER (base OR stays))) AS all_list, max(priority) FILTER (stays) AS best FROM kept GROUP BY r)
SELECT doc_id, CAST({words("s")} AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base_list, ','), '') AS base_labels, coalesce(array_to_string(all_list, ','), '') AS labels, round(coalesce(best, 0) / 3.0, 4)::DOUBLE AS score
FROM norm LEFT JOIN per USING (r)
"""
