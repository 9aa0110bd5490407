"""Text, matching and grouped queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import texts as X
from quern.functions.labels import label_name
from quern.functions.times import epoch_seconds, relative_bucket
from quern.operators import grouped as G
from quern.operators import matching as M
from quern.plans.registry import query
from quern.sources.tables import spread, table


@query("""SELECT page_id, host, CASE WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'official' WHEN host LIKE '%.cheap-pills.example.com' OR host = 'cheap-pills.example.com' THEN 'self_published' WHEN host LIKE '%.example.net' OR host = 'example.net' THEN 'news' WHEN host LIKE '%.com' THEN 'social' ELSE 'unknown' END AS tier
FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages)""")
def domain_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official, the maker's own, news or social by domain or subdomain; the first tier that holds it counts."""
    host = X.domain(F.col("url"))
    tier = X.domain_tier(host, {"official": ["example.org"], "self_published": ["cheap-pills.example.com"], "news": ["example.net"], "social": ["com"]})
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", host.alias("host"), tier.alias("tier"))


@query("""SELECT p_partkey, replace(p_name, ' ', '') AS name_key, 'Brand' || substr(p_brand, 7) AS brand_key FROM part""")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", label_name(F.concat("p_name", F.lit(" (x)’"))).alias("name_key"), label_name(F.translate("p_brand", "#", "")).alias("brand_key"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '未知製造商' ELSE regexp_replace(c_name, '\\s+', '', 'g') END AS maker FROM customer""".replace("\\\\", "\\"))
def company_suffix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    raw = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 == 1, F.concat("c_name", F.lit("股份有限公司"))).when(F.col("c_custkey") % 5 == 2, F.concat("c_name", F.lit(" (股)公司"))).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("有限公司")))
    return c.select("c_custkey", X.maker_key(raw).alias("maker"))


HINTS = ["the", "les"]
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '\.', '。', 'g'), '。'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"""SELECT item_id, len(s)::BIGINT AS n, array_to_string(CASE WHEN len(s) = 0 THEN s WHEN len(h) > 0 THEN h ELSE s[-1:] END, '。') AS essential FROM (
  SELECT item_id, s, list_filter(s, lambda x: contains(x, 'the') OR contains(x, 'les')) AS h FROM (SELECT item_id, {SENTENCES} AS s FROM (SELECT item_id, regexp_replace(text, '[0-9]', '', 'g') AS text FROM benchmark)))""")
def sentence_essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", X.sentences(F.regexp_replace("text", "[0-9]", "")).alias("s"))
    return b.select("item_id", F.size("s").cast("long").alias("n"), F.array_join(X.essential(F.col("s"), HINTS), "。").alias("essential"))


@query("""SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, 400) AS win FROM (SELECT doc_id, text, greatest(coalesce(least(nullif(instr(text, 'license'), 0), nullif(instr(text, 'oi'), 0)), 1) - 1 - 100, 0) AS a FROM documents)""")
def relevance_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.window_around(F.col("text"), ["license", "oi"]).alias("win"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i AND k(x) > 0 AND k(x) / length(x) >= 0.4), lambda x: x), ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS snippet FROM
 (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) AS l FROM documents)""".replace("k(x)", r"length(regexp_replace(x, '[|!#*\s-]', '', 'g'))"))
def snippet_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.clean_lines(F.col("text")).alias("snippet"))


@query("""SELECT p_partkey, p_name, name AS match, CASE WHEN name = p_name THEN 0 ELSE 2 END AS priority FROM (SELECT p_partkey, p_name, arg_min(k, CASE WHEN k = p_name THEN -1000 ELSE -length(k) END * 1000 + o) AS name FROM part
  JOIN (SELECT k, row_number() OVER (ORDER BY k) AS o FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS k FROM part WHERE p_size < 10 UNION SELECT DISTINCT p_name FROM part WHERE p_size = 50)) ON contains(p_name, k) GROUP BY ALL)""")
def best_match_longest_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    names = p.where("p_size < 10").select(F.explode(F.split("p_name", " ")).alias("k")).union(p.where("p_size = 50").select("p_name"))
    best = M.longest_contained(p, "p_name", names, "k")
    return p.join(best, "p_name").select("p_partkey", "p_name", "match", "priority")


@query("""WITH q AS (SELECT DISTINCT upper(left(p_name, 1)) || substr(p_name, 2) AS q FROM part WHERE length(p_name) >= 8), n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 25)
SELECT q, name, distance FROM (SELECT q, name, levenshtein(q, name) AS distance, row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, name), name) AS r FROM q JOIN n ON levenshtein(q, name) <= length(q) // 4 AND levenshtein(q, name) > 0) WHERE r = 1""")
def near_miss_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_name", "p_size")
    q = p.select(F.concat(F.upper(F.left("p_name", F.lit(1))), F.expr("substring(p_name, 2)")).alias("q"))
    return M.near_misses(q, "q", p.where("p_size < 25"), "p_name")


@query("""WITH l AS (SELECT label, [{axes}] AS mean FROM embeddings GROUP BY label)
SELECT vec_id, label, round(s, 5) AS cosine FROM (SELECT vec_id, l.label, list_dot_product(embedding::DOUBLE[], mean) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(mean, mean)) + 1e-8) AS s,
  row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(embedding::DOUBLE[], mean) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(mean, mean)) + 1e-8), 9) DESC, l.label) AS r FROM embeddings, l) WHERE r = 1""".replace("{axes}", ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65))))
def vector_nearest_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's most similar label mean.  The means, one row a label, are collected into one row that is joined to all vectors."""
    e = table(spark, sf_dir, "embeddings")
    double = F.transform("embedding", lambda x: x.cast("double"))
    dims = e.select("label", F.posexplode(double).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    every = means.agg(F.collect_list(F.struct("label", "mean", F.sqrt(dot(F.col("mean"), F.col("mean"))).alias("norm"))).alias("means"))
    rows = e.select("vec_id", double.alias("v")).join(F.broadcast(every), F.lit(True))  # one row
    score = lambda m: F.struct((-F.round(dot(F.col("v"), m["mean"]) / (F.sqrt(dot(F.col("v"), F.col("v"))) * m["norm"] + 1e-8), 9)).alias("minus"), m["label"].alias("label"))
    best = F.array_min(F.transform("means", score))
    return rows.select("vec_id", best.alias("b")).select("vec_id", "b.label", F.round(-F.col("b.minus"), 5).alias("cosine"))


ALIASES = {"alpha": ["scum", "idiot"], "beta": ["trash", "clown"], "gamma": ["License", "Licensed"]}
ALIAS_SQL = " ".join(f"""SELECT doc_id, '{k}' AS entity, CASE {" ".join(f"WHEN contains(text, '{a}') THEN '{a}'" for a in v)} END AS alias, contains(text, 'worthless') AS ambiguous FROM documents WHERE {" OR ".join(f"contains(text, '{a}')" for a in v)} UNION ALL""" for k, v in ALIASES.items())[: -len(" UNION ALL")]


@query(ALIAS_SQL)
def entity_alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = F.array(*(F.struct(F.lit(k).alias("entity"), F.array(*map(F.lit, v)).alias("aliases")) for k, v in ALIASES.items()))
    hits = F.transform(registry, lambda r: F.struct(r["entity"].alias("entity"), F.get(F.filter(r["aliases"], lambda a: F.contains(F.col("text"), a)), F.lit(0)).alias("alias")))
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = d.select("doc_id", F.contains("text", F.lit("worthless")).alias("ambiguous"), F.explode(F.filter(hits, lambda h: h["alias"].isNotNull())).alias("h"))
    return rows.select("doc_id", "h.entity", "h.alias", "ambiguous")


@query("""SELECT doc_id, array_to_string(list_filter(['scum', 'trash', 'rights', 'Apache'], lambda t: contains(text, t)), ',') AS terms FROM documents WHERE source <> 'src0' AND (contains(text, 'scum') OR contains(text, 'trash') OR contains(text, 'rights') OR contains(text, 'Apache'))""")
def controlled_term_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.filter(F.array(*map(F.lit, ["scum", "trash", "rights", "Apache"])), lambda t: F.contains(F.col("text"), t))
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source").where("source <> 'src0'").withColumn("t", terms)
    return d.where(F.size("t") > 0).select("doc_id", F.array_join("t", ",").alias("terms"))


@query("""SELECT doc_id, a AS own, b AS other, a <= b AS ambiguous FROM (SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::INT AS a, ((length(text) - length(replace(text, 'an', ''))) // 2)::INT AS b FROM documents) WHERE a > 0""")
def mention_count_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.mentions(F.col("text"), F.lit("the")).alias("own"), X.mentions(F.col("text"), F.lit("an")).alias("other"))
    return d.where("own > 0").select("*", (F.col("own") <= F.col("other")).alias("ambiguous"))


SPANS = "SELECT l_orderkey, l_linenumber, l_partkey AS grp, {epoch} // 86400 AS a, {epoch} // 86400 + CAST(l_quantity AS INT) % 7 + 1 AS b FROM lineitem".replace("{epoch}", "epoch_us(l_shipdate) // 1000000")


@query(f"""WITH s AS ({SPANS}), o AS (SELECT o_orderkey, o_custkey AS grp, epoch_us(o_orderdate) // 1000000 // 86400 AS a, epoch_us(o_orderdate) // 1000000 // 86400 + 3 AS b FROM orders)
SELECT l_orderkey, l_linenumber, o_orderkey, count(*) AS n FROM s JOIN o ON s.grp = o.grp AND s.a < o.b AND o.a < s.b GROUP BY ALL""")
def interval_overlap_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.floor(epoch_seconds(F.col(c)) / 86400)
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")  # noqa: E741
    s = l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("grp"), day("l_shipdate").alias("a1"), (day("l_shipdate") + F.col("l_quantity").cast("int") % 7 + 1).alias("b1"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    o = o.select("o_orderkey", F.col("o_custkey").alias("grp"), day("o_orderdate").alias("a2"), (day("o_orderdate") + 3).alias("b2"))
    return M.overlapping(s, o, ("a1", "b1"), ("a2", "b2"), 16, ["grp"]).groupBy("l_orderkey", "l_linenumber", "o_orderkey").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, {l} AS a, {l} + CAST(l_quantity AS INT) % 7 + 1 AS b FROM lineitem), o AS (SELECT o_orderkey, {o} AS a, {o} + 3 AS b FROM orders)
SELECT l_orderkey, l_linenumber, count(*) AS n FROM s JOIN o ON l_orderkey = o_orderkey AND s.a < o.b AND o.a < s.b GROUP BY ALL""".replace("{l}", "epoch_us(l_shipdate) // 86400000000").replace("{o}", "epoch_us(o_orderdate) // 86400000000"))
def interval_overlap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose span overlaps the first three days of their order."""
    day = lambda c: F.floor(epoch_seconds(F.col(c)) / 86400)
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")  # noqa: E741
    s = l.select(F.col("l_orderkey").alias("key"), "l_linenumber", day("l_shipdate").alias("a1"), (day("l_shipdate") + F.col("l_quantity").cast("int") % 7 + 1).alias("b1"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("a2"), (day("o_orderdate") + 3).alias("b2"))
    return M.overlapping(s, o, ("a1", "b1"), ("a2", "b2"), 16, ["key"]).groupBy(F.col("key").alias("l_orderkey"), "l_linenumber").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view'), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'),
n AS (SELECT user_id FROM events GROUP BY user_id HAVING abs(count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click')) <= 3)
SELECT user_id, k, event_id, value FROM a JOIN b USING (user_id, k) JOIN n USING (user_id)""")
def rank_position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th view of a user beside the k-th click, where their numbers nearly agree: one shuffle by user, ranks by type."""
    e = table(spark, sf_dir, "events", "user_id", "event_id", "value", "event_type", "ts").where("event_type in ('view', 'click')")
    rows = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long"))
    counts = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "click").alias("c")).where("abs(v - c) <= 3").select("user_id")
    both = rows.groupBy("user_id", "k").agg(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("event_id"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("value"))
    return both.where("event_id is not null and value is not null").join(counts, "user_id", "left_semi")


@query("""SELECT user_id, island, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM
  (SELECT *, CASE WHEN epoch_us(ts) // 1000000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 > 86400 THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY ALL""".replace("AS island FROM", "::BIGINT AS island FROM"))
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_id", "ts").withColumn("s", epoch_seconds(F.col("ts")))
    rows = M.islands(e, ["user_id"], ["ts", "event_id"], "s", 86400)
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""SELECT conv_id, turn, coalesce(array_to_string([lag(r, 3) OVER w, lag(r, 2) OVER w, lag(r, 1) OVER w], ''), '') AS before_, coalesce(array_to_string([lead(r, 1) OVER w, lead(r, 2) OVER w, lead(r, 3) OVER w], ''), '') AS after_
FROM (SELECT conv_id, turn, left(role, 1) || length(text) % 10 AS r FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r)""")
def token_window_pm3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.left("role", F.lit(1)), (F.length("text") % 10).cast("string")).alias("r"))
    w = Window.partitionBy("conv_id").orderBy("turn", "r")
    around = lambda a, b: F.array_join(F.collect_list("r").over(w.rowsBetween(a, b)), "")
    return c.select("conv_id", "turn", around(-3, -1).alias("before_"), around(1, 3).alias("after_"))


@query("""SELECT doc_id, count(*) AS lines, count(*) FILTER (k = 1) AS kept_first, count(*) FILTER (k <= 2) AS kept_two FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) GROUP BY doc_id""")
def dedupe_keep_first_and_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept when repeats go, or all after the second: counts of equal lines are taken before the shuffle."""
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = lines.groupBy("doc_id", F.xxhash64("line"), F.md5("line")).agg(F.count("*").alias("k"))
    return n.groupBy("doc_id").agg(F.sum("k").alias("lines"), F.count("*").alias("kept_first"), F.sum(F.least("k", F.lit(2))).alias("kept_two"))


@query("""WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS s FROM benchmark WHERE item_id < 1000)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 9) AS jaccard FROM g a JOIN g b ON a.item_id < b.item_id WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) > 0.45""".replace(" WHERE item_id < 1000", ""))
def bigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", X.bigrams(F.col("text")).alias("s"))
    return M.set_pairs(b, "item_id", "s", 0.45).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("""WITH t AS (SELECT item_id, unnest(list_concat(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS g FROM benchmark),
tf AS (SELECT item_id, g, count(*) AS tf FROM t GROUP BY ALL), idf AS (SELECT g, ln((1 + (SELECT count(DISTINCT item_id) FROM tf)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY g),
w AS (SELECT item_id, g, tf * idf AS w FROM tf JOIN idf USING (g)), n AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM w GROUP BY item_id)
SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)), 6) AS cosine FROM w a JOIN w b ON a.g = b.g AND a.item_id < b.item_id JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id GROUP BY a.item_id, b.item_id HAVING sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)) >= 0.5""")
def tfidf_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose weighted character 2- and 3-grams have a cosine of 0.5 or more."""
    b = table(spark, sf_dir, "benchmark")
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.length("text") - k + 1), lambda i: F.substring("text", i, F.lit(k)))
    tf = b.where(F.length("text") >= 3).select("item_id", F.explode(F.concat(grams(2), grams(3))).alias("g")).groupBy("item_id", "g").agg(F.count("*").alias("tf"))
    total = b.agg(F.count_distinct("item_id").alias("total"))
    idf = tf.groupBy("g").agg(F.count("*").alias("df")).join(F.broadcast(total), F.lit(True)).select("g", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    w = tf.join(idf, "g").select("item_id", "g", (F.col("tf") * F.col("idf")).alias("w"))
    n = w.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    w = w.join(n, "item_id").select("item_id", "g", (F.col("w") / F.col("n")).alias("w"))
    return M.cosine_pairs(w, "item_id", "g", "w", 0.5).select("a", "b", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.5")


@query("""SELECT conv_id, count(*) AS turns, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AND bool_and(role IN ('user', 'assistant', 'system', 'tool')) AND bool_and(length(trim(text)) > 0) AS valid FROM conversations GROUP BY conv_id""")
def cluster_partition_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch is valid only if its members are complete, unique and well formed."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id")
    n = F.count("*")
    ok = (F.count_distinct("turn") == n) & (F.min("turn") == 0) & (F.max("turn") == n - 1) & F.bool_and(F.col("role").isin("user", "assistant", "system", "tool")) & F.bool_and(F.length(F.trim("text")) > 0)
    return c.agg(n.alias("turns"), ok.alias("valid"))


@query("""WITH u AS (SELECT DISTINCT source, lower(text) AS e FROM documents) SELECT source, count(*) AS found, count(*) FILTER (n = 1) AS only_here, round(count(*) FILTER (n = 1) / count(*), 6) AS gain FROM (SELECT source, e, count(*) OVER (PARTITION BY e) AS n FROM u) GROUP BY source""")
def leave_one_out_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_only_here(table(spark, sf_dir, "documents", "source", "text").select("source", F.lower("text").alias("e")).distinct())


def found_only_here(u: DataFrame) -> DataFrame:
    """From distinct (source, e): how many entities each source has, and how many of them no other has."""
    only = u.groupBy("e").agg(F.count("*").alias("n"), F.min("source").alias("source")).where("n = 1").groupBy("source").agg(F.count("*").alias("only_here"))
    rows = u.groupBy("source").agg(F.count("*").alias("found")).join(only, "source", "left").select("source", "found", F.coalesce("only_here", F.lit(0)).alias("only_here"))
    return rows.select("*", F.round(F.col("only_here") / F.col("found"), 6).alias("gain"))


@query("""WITH u AS (SELECT DISTINCT source, md5(text) AS e FROM documents) SELECT source, count(*) AS found, count(*) FILTER (n = 1) AS only_here, round(count(*) FILTER (n = 1) / count(*), 6) AS gain FROM (SELECT source, e, count(*) OVER (PARTITION BY e) AS n FROM u) GROUP BY source""")
def leave_one_out_gain_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be missing without a source; an entity is the digest of a whole text."""
    return found_only_here(table(spark, sf_dir, "documents", "source", "text").select("source", F.md5("text").alias("e")).distinct())


RULES = [("r1", "warning", "scum,trash", None, 0), ("r2", "info", None, "n_chars", 5000), ("r3", "alert", "Apache,MIT", None, 0), ("r4", "info", "the", "n_chars", 1)]


@query("""SELECT doc_id, rule, severity FROM (SELECT doc_id, unnest([CASE WHEN contains(text, 'scum') OR contains(text, 'trash') THEN {'rule': 'r1', 'severity': 'warning'} END, CASE WHEN n_chars > 5000 THEN {'rule': 'r2', 'severity': 'info'} END,
  CASE WHEN contains(text, 'Apache') OR contains(text, 'MIT') THEN {'rule': 'r3', 'severity': 'alert'} END, CASE WHEN contains(text, 'the') THEN {'rule': 'r4', 'severity': 'info'} END], recursive := true) FROM documents) WHERE rule IS NOT NULL""")
def rule_engine_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword rules by any keyword; a numeric limit counts only for rules without keywords.  The rules are one literal, evaluated in each row."""

    def fires(keywords: str | None, field: str | None, limit: int):
        if keywords:
            return F.exists(F.array(*map(F.lit, keywords.split(","))), lambda k: F.contains(F.col("text"), k))
        return F.coalesce(F.col(field) > limit, F.lit(False))

    hits = F.filter(F.array(*(F.when(fires(k, f, n), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, k, f, n in RULES)), lambda x: x.isNotNull())
    return table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")


@query("""SELECT event_id, CASE WHEN s < -60 THEN NULL WHEN s < 60 THEN 'now' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' WHEN s < 2592000 THEN s // 86400 || 'd' END AS ago FROM (SELECT event_id, 1706745600 - epoch_us(ts) // 1000000 AS s FROM events)""")
def relative_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts")
    return e.select("event_id", relative_bucket(F.lit(1706745600) - epoch_seconds(F.col("ts"))).alias("ago"))


@query("""SELECT o_orderkey, try_cast(regexp_replace(x, '[^0-9]', '', 'g') AS BIGINT) AS id, CASE WHEN regexp_matches(x, '^[A-Za-z0-9_.:-]{1,64}$') THEN x ELSE '' END AS request FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '候選 ' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'req-' || o_custkey ELSE 'none' END AS x FROM orders)""")
def id_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    x = F.when(k == 0, F.concat(F.lit("候選 "), F.col("o_custkey").cast("string"))).when(k == 1, F.concat(F.lit("req-"), F.col("o_custkey").cast("string"))).otherwise("none")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", X.coerced_id(x).alias("id"), X.request_id(x).alias("request"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_texts(table(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")


@query()
def bracket_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lists, here made of each document's first sentences."""
    from quern.llm.common import short_batches

    short_batches(spark)
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.regexp_replace(F.regexp_replace("text", r"\. ", "("), r"\.\n", "), ")
    return G.flattened(d.select("doc_id", text.alias("t")), "doc_id", "t")


@query()
def semi_global_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest edits between a whole turn and any part of the next one."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = spread(c.withColumn("next_", following).where("next_ is not null"))
    return G.edits_within(rows, "text", "next_", ["conv_id", "turn"])


@query()
def degenerate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repetitions(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query()
def event_merge_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one conversation merged in their order, by their whole texts."""
    return G.merged_events(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text")


@query()
def dbscan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.floor(F.col("embedding")[2].cast("double") * 20).alias("band"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return G.dbscan(e.withColumn("grp", F.concat_ws(":", "label", "band")), "grp", "vec_id", "x", "y", 0.05)


@query()
def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents", "doc_id", "source")  # noqa: E741
    return G.bootstrap(l.join(d, "doc_id").select("source", "toxic", "quality", "doc_id"), "source", "toxic", "quality")
