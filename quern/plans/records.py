"""Changes, filters and guards of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import labels as L
from quern.functions import texts as X
from quern.operators import changes as C
from quern.operators import tables as T
from quern.plans.registry import query
from quern.sources.tables import table


@query("""SELECT o_orderkey, 'P' AS old_status, CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0 THEN 'rejected' ELSE 'approved' END AS new_status
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def guarded_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders are approved, or rejected where a line came back; only pending ones change."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    decisions = lines.agg(F.when(F.max(F.col("l_returnflag") == "R"), "rejected").otherwise("approved").alias("decision"))
    return C.transitioned(o, decisions, "o_orderkey", "o_orderstatus", "P", "decision")


@query("""WITH c AS (SELECT l_partkey AS k, CASE l_linenumber WHEN 1 THEN 'p_name' WHEN 2 THEN 'p_brand' ELSE 'p_size' END AS name, 'v' || l_orderkey AS value, l_orderkey * 10 + l_linenumber AS o FROM lineitem),
n AS (SELECT k, arg_max(value, o) FILTER (name = 'p_name') AS n1, arg_max(value, o) FILTER (name = 'p_brand') AS n2 FROM c GROUP BY k)
SELECT p_partkey, coalesce(n1, p_name) AS p_name, coalesce(n2, p_brand) AS p_brand, p_size FROM part LEFT JOIN n ON k = p_partkey""")
def whitelisted_column_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested values by column name; only two columns may be changed, and the last suggestion counts."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    line = F.col("l_linenumber")
    changes = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber").select(
        F.col("l_partkey").alias("p_partkey"), F.when(line == 1, "p_name").when(line == 2, "p_brand").otherwise("p_size").alias("name"),
        F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("value"), (F.col("l_orderkey") * 10 + line).alias("o"),
    )
    return C.column_updates(p, changes, "p_partkey", ["p_name", "p_brand"], "o")


REFERENCES = "SELECT l_partkey, l_suppkey, CASE WHEN l_orderkey % 97 <> 0 THEN l_orderkey END AS owner FROM lineitem"


@query(f"""WITH r AS ({REFERENCES}), g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 3 = 0)
SELECT DISTINCT l_partkey, l_suppkey FROM r a WHERE owner IN (FROM g) AND NOT EXISTS (SELECT 1 FROM r b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND (b.owner IS NULL OR b.owner NOT IN (FROM g)))""")
def delete_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only cleaned-up requests refer to may be deleted; a reference without request keeps it."""
    l = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_orderkey")  # noqa: E741
    r = l.select(F.struct("l_partkey", "l_suppkey").alias("file"), F.when(F.col("l_orderkey") % 97 != 0, F.col("l_orderkey")).alias("owner"))
    going = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus <> 'P' OR o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("owner"))
    named = r.join(going, "owner", "left_semi").select("file").distinct()
    return C.unreferenced(named, r, "file", "owner", going).select("file.*")


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY p_name), p_name FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT s_name FROM supplier))""")
def insert_with_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows are numbered on from the largest id and returned with the table."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return s.unionByName(T.new_keys(table(spark, sf_dir, "part", "p_name").select(F.col("p_name").alias("name")), s, "name", "id"))


@query("""SELECT e.event_id, CASE WHEN s.user_id IS NULL THEN 'pending' ELSE 'synced' END AS state FROM events e LEFT JOIN (SELECT user_id, max(ts) AS until FROM events WHERE event_type = 'purchase' GROUP BY user_id) s ON s.user_id = e.user_id AND e.ts <= s.until WHERE e.event_type = 'click'""")
def feedback_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued rows are marked as synced by the newest sync of their user that is not before them."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    sync = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("until"))
    queued = e.where("event_type = 'click'").join(sync, "user_id", "left")
    return queued.select("event_id", F.when(F.col("ts") <= F.col("until"), "synced").otherwise("pending").alias("state"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_retailprice > 1000 AND p_size = 50)) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def cache_purge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached rows go by key, and with them all of the products of brands that have a new alert."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_retailprice", "p_size")
    brands = p.where("p_retailprice > 1000 AND p_size = 50").select("p_brand")
    products = p.select("p_partkey", "p_brand").join(brands, "p_brand", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    keys = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    cache = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return cache.join(products, "l_partkey", "left_anti").join(keys, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN false ELSE n_chars > 50 OR contains(text, ',') OR (source <> 'src0' AND length(trim(source)) >= 2) END AS passed,
 CASE WHEN quality = 0 THEN 'flagged' WHEN n_chars > 50 THEN 'long' WHEN contains(text, ',') THEN 'items' WHEN source <> 'src0' AND length(trim(source)) >= 2 THEN 'named' ELSE 'empty' END AS reason,
 sha256(text) AS digest, strlen(text) AS bytes FROM documents LEFT JOIN labels USING (doc_id)""")
def gate_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is kept with the gate's verdict, its reason, the digest and the size; a flag that is absent does not reject."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    named = (F.col("source") != "src0") & (F.length(F.trim("source")) >= 2)
    reason = F.when(F.col("quality") == 0, "flagged").when(F.col("n_chars") > 50, "long").when(F.contains("text", F.lit(",")), "items").when(named, "named").otherwise("empty")
    return d.select("doc_id", (~reason.isin("flagged", "empty")).alias("passed"), reason.alias("reason"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey = 7")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    return C.filtered(o, o_orderstatus=None, o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=7).select("o_orderkey", "o_orderpriority")


@query("SELECT * FROM customer WHERE c_custkey = 7")
def primary_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filtered(table(spark, sf_dir, "customer"), c_custkey=7)


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part ORDER BY length(p_name) DESC, p_name, p_partkey")
def longest_name_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type").orderBy(F.length("p_name").desc(), "p_name", "p_partkey")


@query("SELECT doc_id, source, lang FROM documents WHERE starts_with(source, 'src1') OR starts_with(lang, 'e') ORDER BY doc_id LIMIT 40")
def manifest_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that any selector begins, the first ones in order."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    return d.where(F.startswith("source", F.lit("src1")) | F.startswith("lang", F.lit("e"))).orderBy("doc_id").limit(40)


@query("SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE length(term) >= 3 GROUP BY term ORDER BY length(term) DESC, term")
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at least three characters, longest first."""
    words = table(spark, sf_dir, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("term")).where(F.length("term") >= 3)
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.length("term").desc(), "term")


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'license')")
def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").where(F.contains("text", F.lit("license")))
    return d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit("license")))


@query("SELECT l_suppkey AS id FROM lineitem WHERE l_quantity = 50 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def union_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").where("l_quantity = 50").select(F.col("l_suppkey").alias("id"))  # noqa: E741
    return l.union(table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal < 0").select("s_suppkey")).distinct()


@query("""SELECT doc_id, array_to_string(CASE WHEN contains(text, 'license') THEN ['alert'] || w[1:20] ELSE w[1:20] END, ' ') AS listed, left(text, 500) AS title, left(source, 1000) AS url FROM (SELECT *, string_split(text, ' ') AS w FROM documents)""")
def head_insert_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list cut to 20 with an alert put in front, and texts cut to their columns' widths."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    listed = C.head_inserted(F.slice(F.split("text", " "), 1, 20), F.when(F.contains("text", F.lit("license")), F.lit("alert")))
    return d.select("doc_id", F.array_join(listed, " ").alias("listed"), F.left("text", F.lit(500)).alias("title"), F.left("source", F.lit(1000)).alias("url"))


@query("""WITH c AS (SELECT p_partkey, unnest([p_name, split_part(p_name, ' ', 2), split_part(p_name, ' ', 1), p_type]) AS name, generate_subscripts([1, 2, 3, 4], 1) AS at_ FROM part), k AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part WHERE p_size < 5 UNION SELECT DISTINCT p_type FROM part WHERE p_size > 45)
SELECT p_partkey, arg_min(name, at_) AS match, min(at_)::INT AS place FROM c JOIN k USING (name) GROUP BY p_partkey""")
def first_candidate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a record's candidate names, in order, the first that the dictionary has."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    known = p.where("p_size < 5").select(second.alias("name")).union(p.where("p_size > 45").select("p_type")).distinct()
    tried = p.select("p_partkey", F.posexplode(F.array("p_name", second, F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type")).alias("at", "name"))
    return tried.join(known, "name").groupBy("p_partkey").agg(F.min_by("name", "at").alias("match"), (F.min("at") + 1).alias("place"))


@query("""WITH a AS (SELECT user_id, round(sum(value), 4) AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, round(sum(value), 4) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, a.v AS before, b.v AS after, round(b.v - a.v, 3) AS delta FROM a JOIN b USING (user_id)""")
def two_run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs on the cases that both have."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    run = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias(name))
    return run("view", "before").join(run("click", "after"), "user_id").select("user_id", "before", "after", F.round(F.col("after") - F.col("before"), 3).alias("delta"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE length(text) > 100), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id FROM (SELECT conv_id, count(*) AS k FROM l GROUP BY 1) JOIN (SELECT conv_id, count(*) AS k FROM p GROUP BY 1) USING (conv_id, k))
SELECT l.conv_id, l.n::INT AS n, l.turn AS line, p.turn AS prediction FROM l JOIN p USING (conv_id, n) JOIN s USING (conv_id)""")
def aligned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions meet the lines that a filter keeps by their number; cases with another count are left out whole."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    count = F.count("*").over(Window.partitionBy("conv_id"))
    side = lambda rows, name: rows.select("conv_id", F.row_number().over(w).alias("n"), count.alias("k"), F.col("turn").alias(name))
    return side(c.where(F.length("text") > 100), "line").join(side(c.where("role = 'user'"), "prediction"), ["conv_id", "n", "k"]).drop("k")


@query("""SELECT page_id, regexp_matches(url, '^https?://[^/]') AS absolute, CASE WHEN lower(trim(host)) IN ('unknown', 'n/a', 'none', 'test', '') OR length(trim(host)) < 2 THEN 'placeholder_name' ELSE 'searched' END AS state
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN substr(url, 7) ELSE url END AS url, CASE page_id % 7 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'x' ELSE regexp_extract(url, '://([^/]*)', 1) END AS host FROM pages)""")
def url_and_name_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url")
    host = F.when(F.col("page_id") % 7 == 0, " Unknown ").when(F.col("page_id") % 7 == 1, "x").otherwise(X.domain(F.col("url")))
    url = F.when(F.col("page_id") % 5 == 0, F.expr("substring(url, 7)")).otherwise(F.col("url"))
    return p.select("page_id", L.absolute_url(url).alias("absolute"), F.when(L.placeholder_name(host), "placeholder_name").otherwise("searched").alias("state"))


@query("""SELECT event_id, code, coalesce(code IN (502, 503, 504, 520, 521, 522, 523, 524, 525, 526, 527, 530), false) OR failed AS degrade, json_extract_string(p, '$.status') IS NULL AND (json_extract(p, '$.name') IS NOT NULL OR json_extract(p, '$.nutrition') IS NOT NULL) OR json_extract_string(p, '$.status') = 'success' AND json_extract(p, '$.data') IS NOT NULL AS analysis
FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 500 + CAST(json_extract_string(props, '$.k') AS INT) % 40 END AS code, event_id % 11 = 0 AS failed,
CASE event_id % 5 WHEN 0 THEN '{"status":"error","name":"x"}' WHEN 1 THEN '{"name":"y"}' WHEN 2 THEN '{"status":"success","data":{"a":1}}' WHEN 3 THEN '{"detail":"x"}' ELSE '{"nutrition":{"a":null}}' END AS p FROM events)""")
def upstream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a call must fall back (a raised failure or one of twelve codes; none is no failure), and whether a payload is an analysis."""
    e = table(spark, sf_dir, "events", "event_id", "props")
    code = F.when(F.col("event_id") % 4 != 0, 500 + F.get_json_object("props", "$.k").cast("int") % 40)
    payloads = ['{"status":"error","name":"x"}', '{"name":"y"}', '{"status":"success","data":{"a":1}}', '{"detail":"x"}', '{"nutrition":{"a":null}}']
    p = F.get(F.array(*map(F.lit, payloads)), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", code.alias("code"), L.must_degrade(code, F.col("event_id") % 11 == 0).alias("degrade"), L.is_analysis(p).alias("analysis"))


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'error') THEN 'event' WHEN NOT regexp_full_match(id, '[A-Za-z0-9_.:-]{1,64}') THEN 'id' WHEN ms IS NULL OR ms < 0 OR ms > 600000 THEN 'duration' ELSE 'ok' END AS verdict
FROM (SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN 'bad id' ELSE 'r-' || event_id END AS id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(floor(value * 20000) AS BIGINT) - 100 END AS ms FROM events)""")
def trace_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    id_ = F.when(F.col("event_id") % 9 == 0, "bad id").otherwise(F.concat(F.lit("r-"), F.col("event_id").cast("string")))
    ms = F.when(F.col("event_id") % 10 != 3, F.floor(F.col("value") * 20000) - 100)
    return e.select("event_id", L.trace_verdict(F.col("event_type"), ["view", "click", "purchase", "error"], id_, ms).alias("verdict"))


@query("""SELECT doc_id, array_to_string(list_filter(['water', 'tion', 'license', 'souille', 'src1 rights'], lambda k: NOT regexp_matches(k, '[0-9]') AND NOT contains('license corp', k) AND contains(text, k)), ',') AS hits FROM documents""")
def topic_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a hypothesis in a text; those with digits or that the company's name holds do not count."""
    hits = L.topic_hits(F.col("text"), ["water", "tion", "license", "souille", "src1 rights"], F.lit("license corp"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(hits, ",").alias("hits"))


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'error' THEN n END) AS error, max(CASE WHEN event_type = 'signup' THEN n END) AS signup FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 8 GROUP BY ALL) GROUP BY user_id""")
def csv_pivot_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a segment; what is absent stays empty, not 0."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value").where("value > 8")
    return e.groupBy("user_id").pivot("event_type", ["click", "error", "signup"]).agg(F.count("event_type"))
