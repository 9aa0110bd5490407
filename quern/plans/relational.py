"""Joins, aggregations, windows and state over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.times import epoch_seconds
from quern.operators import tables as T
from quern.plans.registry import query
from quern.sources.tables import table


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%' OR to_json([p_name, p_type]) ILIKE '%red%' ORDER BY p_partkey")
def ilike_multi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "%red%"
    rows = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    hit = F.col("p_name").ilike(q) | F.col("p_brand").ilike(q) | F.col("p_type").ilike(q) | F.to_json(F.array("p_name", "p_type")).ilike(q)
    return rows.where(hit).select("p_partkey", "p_name", "p_brand").orderBy("p_partkey")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers, count(*) FILTER (s_acctbal > 5000) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL ORDER BY suppliers DESC, n_name")
def parent_child_count_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    counts = s.groupBy("s_nationkey").agg(F.count("s_suppkey").alias("suppliers"), F.count_if(F.col("s_acctbal") > 5000).alias("rich"))  # before the join
    out = n.join(counts, n.n_nationkey == counts.s_nationkey, "left")
    return out.select("n_nationkey", "n_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("suppliers", "rich"))).orderBy(F.desc("suppliers"), "n_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def enrich_left_join_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50)
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").where("c_acctbal > 0").drop("c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")


@query("""SELECT o_orderkey, o_orderstatus, coalesce(string_agg(CASE WHEN l_returnflag <> 'N' THEN l_linenumber || ':' || l_partkey END, ',' ORDER BY l_linenumber, l_partkey), '') AS citable,
  count(l_orderkey) FILTER (l_returnflag = 'N') AS social FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def event_sources_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")  # noqa: E741
    nested = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("s"))
    rows = o.join(nested, o.o_orderkey == nested.l_orderkey, "left")
    citable = F.transform(F.filter("s", lambda x: x["l_returnflag"] != "N"), lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    social = F.size(F.filter(F.coalesce("s", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_returnflag:string>>")), lambda x: x["l_returnflag"] == "N"))
    return rows.select("o_orderkey", "o_orderstatus", F.coalesce(F.array_join(citable, ","), F.lit("")).alias("citable"), social.cast("long").alias("social"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'").select("o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def not_exists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 300000").select("o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'A') GROUP BY ALL")
def anti_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    a = l.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return a.join(l.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_anti")


@query("""WITH o AS (SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN upper(p_name) END AS p_name, CASE WHEN p_partkey % 7 <> 0 THEN lower(p_brand) END AS p_brand, p_size + 1 AS p_size FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NOT NULL THEN n.p_name ELSE o.p_name END AS p_name, coalesce(n.p_brand, o.p_brand) AS p_brand,
  CASE WHEN o.p_partkey IS NULL THEN n.p_size ELSE o.p_size END AS p_size FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    new = p.where("p_partkey % 2 = 0").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 <> 0 THEN upper(p_name) END").alias("p_name"), F.expr("CASE WHEN p_partkey % 7 <> 0 THEN lower(p_brand) END").alias("p_brand"), (F.col("p_size") + 1).alias("p_size"))
    return T.upsert(p.where("p_partkey % 3 <> 0"), new, "p_partkey", {"p_name": "overwrite", "p_brand": "keep"})


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value", "ts")
    return T.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT user_id, max(epoch_us(ts)) // 1000000 AS written, CASE WHEN 1706745600 <= max(epoch_us(ts)) // 1000000 + arg_max(CASE WHEN event_type = 'view' THEN 86400 ELSE 3600 END, epoch_us(ts) // 1000000 * 100000 + CASE WHEN event_type = 'view' THEN 86400 ELSE 3600 END)
  THEN 'HIT' ELSE 'STALE' END AS state FROM events GROUP BY user_id""")
def ttl_cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    rows = e.select("user_id", epoch_seconds(F.col("ts")).alias("w"), F.when(F.col("event_type") == "view", 86400).otherwise(3600).alias("t"))
    rows = rows.groupBy("user_id", "w").agg(F.max("t").alias("t"))
    return T.cache_state(rows, "user_id", F.col("w"), F.col("t"), F.lit(1706745600))


@query("""SELECT user_id, event_id, before_ IS NULL OR s - before_ >= 604800 AS searched FROM (WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, event_id, s, n, NULL::BIGINT AS before_, s AS last_ FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.s, e.n, r.last_, CASE WHEN e.s - r.last_ >= 604800 THEN e.s ELSE r.last_ END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT * FROM r)""")
def cooldown_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search is made if the user's last one that was made is seven days back or there is none."""
    e = table(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type").where("event_type = 'purchase'")
    return T.cooled_down(e.select("user_id", "event_id", epoch_seconds(F.col("ts")).alias("s"), "ts"), "user_id", "s", ["ts", "event_id"], 7 * 86400).select("user_id", "event_id", "searched")


@query("SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m') END AS d FROM orders) WHERE coalesce(try_cast(left(d, 4) AS INT) >= 1998, true)")
def recent_or_unparsable(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("d"))
    return rows.where(F.coalesce(F.left("d", F.lit(4)).try_cast("int") >= 1998, F.lit(True)))


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, o_orderpriority = '1-URGENT' AS severe, row_number() OVER (PARTITION BY o_custkey, o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE severe OR n <= 5""")
def severity_all_plus_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    severe = o.where("o_orderpriority = '1-URGENT'")
    others = T.last_rows(o.where("o_orderpriority <> '1-URGENT'"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5)
    return severe.unionByName(others).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT coalesce(w, 'uncategorised') AS category, count(*) AS n FROM (SELECT unnest(CASE WHEN p_size > 25 THEN string_split(p_type || ' ' || p_name, ' ') ELSE [NULL]::VARCHAR[] END) AS w FROM part) GROUP BY w""")
def category_explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_type", "p_name", "p_size")
    words = F.when(F.col("p_size") > 25, F.split(F.concat_ws(" ", "p_type", "p_name"), " "))
    counts = p.select(F.explode_outer(words).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("category", F.lit("uncategorised")).alias("category"), "n").orderBy(F.col("category") == "uncategorised", F.desc("n"), "category")


@query("""SELECT source, count(*) AS total, count(l.doc_id) AS covered, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unknown, round(count(l.doc_id) / count(*), 6) AS rate
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents", "doc_id", "source"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")  # noqa: E741
    rows = d.join(l, d.doc_id == l.labelled, "left").groupBy("source")
    return rows.agg(F.count("*").alias("total"), F.count("labelled").alias("covered"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unknown"), F.round(F.count("labelled") / F.count("*"), 6).alias("rate"))


@query("SELECT event_type, s[len(s) // 2 + 1] AS upper_median, s[CAST(floor(0.9 * (len(s) - 1)) AS BIGINT) + 1] AS p90, n, least, most FROM (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY event_type)")
def upper_median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics from counts of distinct values: groups hold one row a value, and no list of all rows is built."""
    e = table(spark, sf_dir, "events", "event_type", "value").where("value is not null")
    values = e.groupBy("event_type", "value").agg(F.count("*").alias("k"))
    until = values.withColumn("until", F.sum("k").over(Window.partitionBy("event_type").orderBy("value")))
    total = values.groupBy("event_type").agg(F.sum("k").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    rows = until.join(total, "event_type")
    at = lambda place: F.min(F.when(F.col("until") > place, F.col("value")))
    return rows.groupBy("event_type", "n", "least", "most").agg(at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.floor(0.9 * (F.col("n") - 1))).alias("p90"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def csv_pivot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type")
    segments = ["click", "error", "purchase", "signup", "view"]  # given, so no job looks for them
    return e.groupBy("user_id").pivot("event_type", segments).agg(F.count("event_type")).na.fill(0, segments)


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 200")
def ring_buffer_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "event_id", "ts")
    return T.last_rows(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 200).select("event_type", "event_id")


@query("""SELECT user_id, event_type, event_id, CAST(n AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1) WHERE n <= 3""")
def history_upsert_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.latest(table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("place", n.cast("long")).where("place <= 3").drop("ts")


@query("""SELECT 'both' AS part, id FROM (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'first', id FROM (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return of("F").intersect(of("O")).select(F.lit("both").alias("part"), "id").unionByName(of("F").subtract(of("O")).select(F.lit("first").alias("part"), "id"))


@query("SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE c_acctbal > 9000")
def union_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return s.unionByName(c)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey LIMIT 100")
def custom_enum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").orderBy(F.when(rank == 0, 4).otherwise(rank), "o_orderkey").limit(100)


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_name LIKE '%old%' OR p_name LIKE 'r_d%') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def delete_by_pattern_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").where(~(F.col("p_name").like("%old%") | F.col("p_name").like("r_d%")))
    gone = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity = 1").select("l_partkey")
    return p.join(gone, p.p_partkey == gone.l_partkey, "left_anti")


@query("""WITH known AS (SELECT DISTINCT p_name FROM part WHERE p_size < 3), start AS (SELECT count(*) AS k FROM known)
SELECT k + row_number() OVER (ORDER BY p_name) AS id, p_name FROM (SELECT DISTINCT p_name || ' ' || p_brand AS p_name FROM part WHERE p_name || ' ' || p_brand NOT IN (SELECT p_name FROM known)), start""")
def get_or_create_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the dimension lacks, with ids numbered on from its largest."""
    p = table(spark, sf_dir, "part", "p_name", "p_brand", "p_size")
    known = p.where("p_size < 3").select("p_name").distinct()
    known = known.join(F.broadcast(known.agg(F.count("*").alias("id"))), F.lit(True))  # the next free id; one row
    return T.new_keys(p.select(F.concat_ws(" ", "p_name", "p_brand").alias("p_name")), known, "p_name", "id").select("id", "p_name")


@query("""WITH extra AS (SELECT l_suppkey AS s_suppkey, CAST(l_partkey % 5 AS VARCHAR) AS v FROM lineitem WHERE l_quantity > 48)
SELECT s.s_suppkey, array_to_string(['0', '1'] || coalesce(list_sort(list_filter(m, lambda x: x <> '0' AND x <> '1')), []), ',') AS aliases, CAST(coalesce(len(list_filter(m, lambda x: x <> '0' AND x <> '1')), 0) AS BIGINT) AS added, CAST(coalesce(len(list_filter(m, lambda x: x = '0' OR x = '1')), 0) AS BIGINT) AS skipped
FROM supplier s LEFT JOIN (SELECT s_suppkey, list(DISTINCT v) AS m FROM extra GROUP BY 1) e ON e.s_suppkey = s.s_suppkey""")
def array_append_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier", "s_suppkey").withColumn("aliases", F.array(F.lit("0"), F.lit("1")))
    extra = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_quantity").where("l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % 5).cast("string").alias("v"))
    out = T.appended(base, extra, "s_suppkey", "aliases", "v")
    return out.select("s_suppkey", F.array_join("aliases", ",").alias("aliases"), F.col("added").cast("long").alias("added"), F.col("skipped").cast("long").alias("skipped"))


@query("""SELECT source, sum(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS hits, round(coalesce(sum(CASE WHEN hit THEN 1 END) / nullif(sum(CASE WHEN pred THEN 1 END), 0), 0), 9) AS p, round(coalesce(sum(CASE WHEN hit THEN 1 END) / nullif(sum(CASE WHEN truth THEN 1 END), 0), 0), 9) AS r
FROM (SELECT source, n_chars > 2000 AS pred, toxic = 1 AS truth, n_chars > 2000 AND toxic = 1 AS hit FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id")
    pred, truth = F.col("n_chars") > 2000, F.col("toxic") == 1
    hits, ratio = F.count_if(pred & truth), lambda n: F.round(F.coalesce(F.try_divide(F.count_if(pred & truth), F.count_if(n)), F.lit(0.0)), 9)
    return d.groupBy("source").agg(hits.alias("hits"), ratio(pred).alias("p"), ratio(truth).alias("r"))


@query("""SELECT l_orderkey, min(l_shipdate)::VARCHAR AS x0, max(l_shipdate)::VARCHAR AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1, bool_and(l_discount > 0.0) AS all_discounted, round(avg(l_quantity * l_tax), 6) AS mean_area FROM lineitem GROUP BY l_orderkey""")
def bounding_box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")  # noqa: E741
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return l.groupBy("l_orderkey").agg(day(F.min("l_shipdate")).alias("x0"), day(F.max("l_shipdate")).alias("x1"), F.min("l_quantity").alias("y0"), F.max("l_quantity").alias("y1"), F.bool_and(F.col("l_discount") > 0.0).alias("all_discounted"), F.round(F.avg(F.col("l_quantity") * F.col("l_tax")), 6).alias("mean_area"))


@query("""SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), '..:..$', '00:00') AS hour, event_type, value FROM events""")
def mask_pii_hour_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").drop("user_id", "props")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    hour = F.when(F.length(text) >= 13, F.concat(F.substring(text, 1, 13), F.lit(":00:00"))).otherwise(text)
    return e.select("event_id", hour.alias("hour"), "event_type", "value")


@query("""SELECT event_id, m['vision'] AS vision, m['total'] AS total, m['bad'] AS bad FROM (SELECT event_id, map_from_entries(list_transform(list_filter(string_split(h, ';'), lambda s: try_cast(split_part(s, '=', 2) AS BIGINT) IS NOT NULL), lambda s: (split_part(s, '=', 1), CAST(split_part(s, '=', 2) AS BIGINT)))) AS m
FROM (SELECT event_id, 'vision=' || CAST(floor(value * 100) AS BIGINT) || ';bad=x;junk;total=' || (event_id % 1000) AS h FROM events))""")
def telemetry_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.concat(F.lit("vision="), F.floor(F.col("value") * 100).cast("string"), F.lit(";bad=x;junk;total="), (F.col("event_id") % 1000).cast("string"))
    m = F.map_filter(F.transform_values(F.str_to_map(h, F.lit(";"), F.lit("=")), lambda k, v: v.try_cast("long")), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "events", "event_id", "value").select("event_id", m.alias("m")).select("event_id", *(F.col("m")[k].alias(k) for k in ("vision", "total", "bad")))


@query("""SELECT event_id, array_to_string(CASE WHEN event_id % 3 = 0 THEN [json_extract_string(props, '$.k'), 'a'] WHEN event_id % 3 = 1 THEN ['k' || json_extract_string(props, '$.k')] ELSE [] END, '|') AS category FROM events""")
def json_scalar_or_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell that is a JSON array, a JSON or plain scalar, or null, as an array of distinct trimmed texts."""
    k = F.get_json_object("props", "$.k")
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), k, F.lit('", "a", " a ", ""]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("k"), k))
    listed = F.from_json(cell, "array<string>")
    values = F.when(cell.startswith("["), listed).when(cell.isNotNull(), F.array(cell)).otherwise(F.array().cast("array<string>"))
    clean = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.array_join(clean, "|").alias("category"))
