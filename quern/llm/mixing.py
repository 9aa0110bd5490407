"""Mixing sources to target weights by hierarchical budgeting.

Documents form a tree: domain, language, source.  A token budget flows down it.
Every node's children share its budget in proportion to their weights, none above
its capacity (its tokens times `max_epochs`); what a child cannot take goes to
its siblings first.  A node's capacity is the sum of its children's, so only what
all siblings cannot take is offered further up.  Shares are rounded down to whole
tokens.

A leaf with quota Q and T tokens takes every document Q div T times; the rest is
the longest prefix of its next epoch, an order by md5(seed:epoch:id), whose
tokens stay within Q mod T.  The prefix is found by radix: sums over 256 hash
buckets, then over 256 parts of the bucket that the prefix ends in, then the
documents of that part; no task holds a whole leaf.

Tokens are runs of characters other than ASCII white space; null and empty texts
have none.  A null language or source is a node of its own, named `?`.  Rows that
share an id enter or stay out together.  Texts of any length count whole, other columns
are carried under any name, and an empty table gives an empty one.  Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise

LEAF = ["domain", "lang", "source"]
# The production weights.
DOMAINS = {"books": 2, "reference": 3, "web": 5}
LANGUAGES = {"en": 6, "de": 2, "fr": 2, "es": 2}
OTHER_LANGUAGE, SOURCE = 1, 1
MAX_EPOCHS, SEED = 2, 7


def domain_of(source: Column) -> Column:
    """Domains are dealt to sources by the first digit of their md5."""
    digit = F.substring(F.md5(source), 1, 1)
    return F.when(digit < "6", "books").when(digit < "b", "reference").otherwise("web")


def weight(values: dict[str, int], name: Column, other: int) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def leaves_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, domain, lang, source, n_tokens."""
    source = F.coalesce(F.col("source"), F.lit("?"))
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), domain_of(source).alias("domain"), F.coalesce(F.col("lang"), F.lit("?")).alias("lang"), source.alias("source"), tokens.alias("n_tokens"))


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `quota` to rows with budget (their parent's), cap and w: filled like vessels, smallest cap per weight first."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    whole = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("w")
    rows = children.withColumn("before", before).withColumn("rest", rest).withColumn("full", full)
    rows = rows.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    rows = rows.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    quota = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((budget - taken) * w) div open"))
    return rows.withColumn("quota", quota).drop("before", "rest", "full", "taken", "open", "budget")


def quotas(leaves: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """LEAF, tokens, quota; the budget is all tokens once.  leaves: LEAF and tokens."""
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("w", F.lit(SOURCE).cast("long"))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight(LANGUAGES, F.col("lang"), OTHER_LANGUAGE))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight(DOMAINS, F.col("domain"), 1))
    total = leaves.agg(F.sum("tokens").alias("budget"))
    domain = share(domain.withColumn("all", F.lit(1)).join(total.withColumn("all", F.lit(1)), "all"), ["all"], "domain").select("domain", F.col("quota").alias("budget"))
    lang = share(lang.join(domain, "domain"), ["domain"], "lang").select("domain", "lang", F.col("quota").alias("budget"))
    return share(leaf.join(lang, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "tokens", "quota")


def seeded(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))


def cutoffs(thin: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """LEAF, epochs (whole ones) and the end of the next epoch's prefix: ids with hash below `part`, or (hash, id) up to `last`."""
    leaf = thin.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    state = quotas(leaf, max_epochs).select(
        *LEAF, F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(0)).cast("long").alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(F.lit(0)).alias("left"), F.lit("").alias("part"),
    )
    whole = materialise(state)
    state = whole.where("left > 0")
    for digits in (2, 4):
        rows = thin.join(state, LEAF).withColumn("h", seeded(F.col("epochs"), seed)).where(F.col("h").startswith(F.col("part")))
        sums = rows.groupBy(*LEAF, "epochs", "left", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        sums = sums.withColumn("until", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket")))
        beyond = sums.where("until > left").groupBy(*LEAF, "epochs").agg(F.min(F.struct("bucket", "until", "n", "left")).alias("x"))
        state = materialise(beyond.select(*LEAF, "epochs", (F.col("x.left") - F.col("x.until") + F.col("x.n")).alias("left"), F.col("x.bucket").alias("part")))
    rows = thin.join(state, LEAF).withColumn("h", seeded(F.col("epochs"), seed)).where(F.col("h").startswith(F.col("part")))
    inside = rows.withColumn("until", F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("h", "doc_id"))).where("until <= left")
    last = inside.groupBy(*LEAF).agg(F.max(F.struct("h", "doc_id")).alias("last"))
    ends = state.select(*LEAF, "part").join(last, LEAF, "left")
    return materialise(whole.select(*LEAF, "epochs").join(ends, LEAF, "left"))


def with_copies(rows: DataFrame, ends: DataFrame, seed: int = SEED, most_broadcast: int = 100_000) -> DataFrame:
    """rows (with LEAF and doc_id) and `copies`, how often each is taken.  The leaves are broadcast only if at most `most_broadcast`."""
    side = F.broadcast(ends) if ends.limit(most_broadcast + 1).count() <= most_broadcast else ends
    h = seeded(F.col("epochs"), seed)
    within = F.coalesce(h < F.col("part"), F.lit(False)) | F.coalesce(F.struct(h.alias("h"), F.col("doc_id")) <= F.col("last"), F.lit(False))
    return rows.join(side, LEAF).withColumn("copies", F.col("epochs") + within.cast("long")).drop("epochs", "part", "last")


def mix(docs: DataFrame) -> DataFrame:
    """The query: doc_id, domain, lang, source, n_tokens, copies of every document."""
    thin = materialise(leaves_of(docs))
    return with_copies(thin, cutoffs(thin)).select("doc_id", *LEAF, "n_tokens", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document as often as it is taken; columns as before."""
    thin = materialise(leaves_of(docs))
    keys = docs.select("*", F.struct(*(F.col(c) for c in docs.columns)).alias("row_")).select("row_", "doc_id", domain_of(F.coalesce(F.col("source"), F.lit("?"))).alias("domain"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"))
    taken = with_copies(keys, cutoffs(thin)).where("copies > 0")
    return taken.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row_.*")


def level_sql(child: str, parent: str, name: str) -> str:
    """The SQL of `share`: rows of `child` (budget, cap, w) with their quota."""
    over = f"PARTITION BY {parent}"
    return f"""
SELECT *, CASE WHEN is_full THEN cap ELSE CAST(((budget - taken) * w) // open_w AS BIGINT) END AS quota FROM (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({over}), 0) AS taken, sum(CASE WHEN NOT is_full THEN w END) OVER ({over}) AS open_w FROM (
    SELECT *, cap * rest <= (budget - before_) * w AS is_full FROM (
      SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
             sum(w) OVER ({over} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {child})))"""


def case_sql(column: str, values: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


SQL = rf"""
WITH thin AS (
  SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '?')), 1, 1) < '6' THEN 'books' WHEN substr(md5(coalesce(source, '?')), 1, 1) < 'b' THEN 'reference' ELSE 'web' END AS domain,
         coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS cap, {SOURCE} AS w FROM thin GROUP BY ALL),
language AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {case_sql("lang", LANGUAGES, OTHER_LANGUAGE)} AS w FROM leaf GROUP BY domain, lang),
domains AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {case_sql("domain", DOMAINS, 1)} AS w, 1 AS whole, (SELECT sum(tokens) FROM leaf) AS budget FROM language GROUP BY domain),
d AS ({level_sql("domains", "whole", "domain")}),
l_in AS (SELECT l.*, d.quota AS budget FROM language l JOIN d USING (domain)),
l AS ({level_sql("l_in", "domain", "lang")}),
s_in AS (SELECT leaf.*, l.quota AS budget FROM leaf JOIN l USING (domain, lang)),
s AS ({level_sql("s_in", "domain, lang", "source")}),
q AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS remains FROM s),
ordered AS (SELECT t.*, q.epochs, q.remains, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{SEED}:', q.epochs, ':', coalesce(CAST(doc_id AS VARCHAR), '?'))), doc_id) AS until
  FROM thin t JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN remains > 0 AND until <= remains THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ordered
"""
