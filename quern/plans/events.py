"""Reports merged to events, and reports of events that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import events as E
from quern.plans.registry import query
from quern.sources.tables import table

# Parameters of these queries: incidents of the given texts, and the kinds of their sources.
INCIDENTS = {"licence": ["Apache License", "MIT License", "GNU"], "rights": ["all rights reserved", "All rights reserved"], "insult": ["scum", "trash"]}
KINDS = {"src0": "official", "src1": "news", "src2": "social", "src3": "wiki"}


def told(text: str) -> str:
    """The incidents of a text in SQL."""
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({text}, '{t}')" for t in terms) + f" THEN '{name}' END" for name, terms in INCIDENTS.items()) + "], lambda i: i IS NOT NULL)"


@query()
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports, in the order of their years: the first line is the title, the whole text the summary; one row an event."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("source"))
    reports = d.select(
        "lang", "doc_id", F.pmod("doc_id", F.lit(7)).alias("o"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"), F.when(F.col("doc_id") % 5 > 0, (F.lit(2018) + F.pmod("doc_id", F.lit(7))).cast("string")).alias("date"),
        kind.alias("kind"), (F.col("doc_id") % 4).alias("severity"), F.col("source").alias("type"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), (F.col("doc_id") % 50).cast("string")).alias("url"),
    )
    m = E.merged_reports(reports, "lang", "doc_id", "o", INCIDENTS)
    addresses = F.array_join(F.transform("links", lambda x: F.concat(x["title"], F.lit(" "), x["url"])), "|")
    return m.select("lang", "event", "n", "title", F.md5("summary").alias("summary_md5"), "date", "severity", "type", addresses.alias("links"), *E.LINKS)


@query(f"""WITH d AS (SELECT doc_id, coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS t, {told("coalesce(text, '')")} AS i, CASE WHEN doc_id % 3 > 0 THEN 2018 + doc_id % 4 END AS y FROM documents),
b AS (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, {told("text")} AS i, CASE WHEN item_id % 3 > 0 THEN 2018 + item_id % 4 END AS y FROM benchmark)
SELECT d.doc_id, min(b.item_id) AS known FROM d LEFT JOIN b ON (d.t <> '' AND b.t <> '' AND (contains(d.t, b.t) OR contains(b.t, d.t))) OR (len(list_intersect(d.i, b.i)) > 0 AND (d.y IS NULL OR b.y IS NULL OR d.y = b.y)) GROUP BY d.doc_id""")
def known_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark item that each document repeats, by its whole text or by an incident of the same year."""
    sides = []
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        id_ = F.col(key)
        year = F.when(id_ % 3 > 0, (F.lit(2018) + id_ % 4).cast("string"))
        sides.append(table(spark, sf_dir, name, key, "text").select(F.lit(0).alias("all_"), id_.alias("id"), F.col("text").alias("title"), F.lit("").alias("summary"), year.alias("date")))
    return E.known_event(*sides, "all_", "id", INCIDENTS).select(F.col("id").alias("doc_id"), "known")
