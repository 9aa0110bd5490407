"""Fields of recognised labels, and the records that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fields as X
from quern.operators import items as I
from quern.operators import tables as T
from quern.plans.registry import query
from quern.sources.tables import spread, table
from quern.streaming import states as S


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || '(容量x、' || p_type || ')、鹽' WHEN 1 THEN p_name || '、水' WHEN 2 THEN p_type WHEN 3 THEN '' WHEN 4 THEN '' ELSE p_name || '{' || p_type || ']、糖' END AS section,
 CASE p_partkey % 6 WHEN 3 THEN 'empty' WHEN 4 THEN 'allergen_warning_only' END AS reason FROM part""")
def ingredient_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingredients' part of a label: from its marker, or past leading fields, to the first other field outside of brackets, without bracketed notes."""
    p, k = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")), F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("品名:X 製造日期:Y 成分: "), "p_name", F.lit("(容量x、"), "p_type", F.lit(")、鹽。有效期限:2026/1/1 重量:5g")))
        .when(k == 1, F.concat(F.lit("品名:X 500g 淨重:3 "), "p_name", F.lit("(本產品與蛋同一產線)、水 素食")))
        .when(k == 2, F.concat(F.lit("(辣味) 原料表："), "p_type", F.lit("、某某來源:x")))
        .when(k == 3, "  ").when(k == 4, "本產品含有牛奶及其製品")
        .otherwise(F.concat(F.lit("成 分:"), "p_name", F.lit("{"), "p_type", F.lit("]、糖 地址x")))
    )
    section, reason = X.ingredient_section(raw)
    return p.select("p_partkey", section.alias("section"), reason.alias("reason"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_name END AS name FROM part""")
def product_name_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type"), F.col("p_partkey") % 4
    lines = (
        F.when(k == 0, F.array(F.lit("x"), F.concat(F.lit("品 名： ·"), "p_name", F.lit(" 內容量:5"))))
        .when(k == 1, F.array(F.lit("名:a"), F.concat(F.lit("名:"), "p_type", F.lit("，"))))
        .when(k == 2, F.array(F.concat(F.lit("No.2 名稱:"), "p_name", F.lit("【")), F.lit("品名:later")))
        .otherwise(F.array(F.lit("name: x"), F.lit(None).cast("string"), F.lit("品名:")))
    )
    return p.select("p_partkey", X.product_name(lines).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_brand || '(' || p_type || '、x)|y。' WHEN 1 THEN 'a|b(' || p_name || '、c' ELSE 'd(' || repeat('e', 130) || '|' || p_name END AS items FROM part""")
def depth_split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items between separators outside of brackets; one whose bracket was never closed is cut after 120 characters."""
    p, k = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")), F.col("p_partkey") % 3
    text = (
        F.when(k == 0, F.concat("p_name", F.lit("、"), "p_brand", F.lit("("), "p_type", F.lit("、x)，y。")))
        .when(k == 1, F.concat(F.lit("a；b("), "p_name", F.lit("、c"))).otherwise(F.concat(F.lit("d("), F.lit("e" * 130), F.lit("、"), "p_name"))
    )
    return p.select("p_partkey", F.array_join(X.items_outside()(text), "|").alias("items"))


WORDS = ["widget", "gadget", "gizmo", "flange", "bolt", "gear", "cold", "new", "blue", "red"]


@query(f"""SELECT p_partkey, array_to_string(list_filter(list_transform(CASE WHEN length(t) < 12 THEN [t] ELSE string_split(regexp_replace(t, '({"|".join(WORDS)})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) END, lambda s: trim(s, ' ,()')), lambda s: s <> ''), '|') AS parts
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN left(p_name, 8) ELSE 'x ' || replace(p_name, ' ', '') || ' (' || p_type || ')' END AS t FROM part)""")
def dictionary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    text = F.when(F.col("p_partkey") % 5 == 0, F.left("p_name", F.lit(8))).otherwise(F.concat(F.lit("x "), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" ("), "p_type", F.lit(")")))
    return p.select("p_partkey", F.array_join(F.transform(X.dictionary_split(text, WORDS), lambda s: F.trim(s)), "|").alias("parts"))


@query("""WITH RECURSIVE n AS (SELECT l_orderkey, l_quantity AS y, l_partkey AS x, 4 + l_suppkey % 9 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_linenumber) AS n FROM lineitem),
r AS (SELECT l_orderkey, x, y, n, y AS base, 1 AS band FROM n WHERE n = 1 UNION ALL SELECT n.l_orderkey, n.x, n.y, n.n, CASE WHEN (n.y - r.base) * 5 <= n.h * 3 THEN r.base ELSE n.y END, CASE WHEN (n.y - r.base) * 5 <= n.h * 3 THEN r.band ELSE r.band + 1 END FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.n = r.n + 1)
SELECT l_orderkey, x, y, band::INT AS band FROM r""")
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in lines: a new line begins where a box lies more than 0.6 of its own height below the line's first one.  A record has a few boxes."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_partkey", "l_linenumber", "l_suppkey")  # noqa: E741
    boxes = F.array_sort(F.collect_list(F.struct(F.col("l_quantity").cast("double").alias("y"), F.col("l_partkey").alias("x"), "l_linenumber", (F.lit(4) + F.col("l_suppkey") % 9).alias("h"))))
    first = F.get("b", F.lit(0))["y"]

    def place(s: Column, box: Column) -> Column:
        same = (box["y"] - s["base"]) * 5 <= box["h"] * 3
        band = F.when(same, s["band"]).otherwise(s["band"] + 1)
        row = F.struct(box["x"].alias("x"), box["y"].alias("y"), band.alias("band"))
        return F.struct(F.when(same, s["base"]).otherwise(box["y"]).alias("base"), band.alias("band"), F.concat(s["rows"], F.array(row)).alias("rows"))

    none = F.array().cast("array<struct<x:bigint,y:double,band:int>>")
    banded = l.groupBy("l_orderkey").agg(boxes.alias("b")).select("l_orderkey", F.aggregate("b", F.struct(first.alias("base"), F.lit(1).alias("band"), none.alias("rows")), place)["rows"].alias("rows"))
    return banded.select("l_orderkey", F.explode("rows").alias("r")).select("l_orderkey", "r.x", "r.y", "r.band")


@query(r"""SELECT doc_id, entry::INT AS entry, string_agg(line, ' ' ORDER BY at_) AS text FROM (SELECT doc_id, at_, line, sum(CASE WHEN before IS NULL OR regexp_matches(before, '[.!?]$') OR regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY at_) AS entry FROM (
 SELECT doc_id, at_, line, lag(line) OVER (PARTITION BY doc_id ORDER BY at_) AS before FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS at_ FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE NOT regexp_full_match(line, '[0-9 .]*'))) GROUP BY doc_id, entry""")
def continued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines join the one before unless that one ended its sentence or a new field begins; lines of numbers are passed over."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(~F.col("line").rlike("^[0-9 .]*$"))
    w = Window.partitionBy("doc_id").orderBy("at")
    before = F.lag("line").over(w)
    begins = before.isNull() | before.rlike("[.!?]$") | F.col("line").rlike("^[A-Z]")
    rows = d.withColumn("begins", begins.cast("int")).withColumn("entry", F.sum("begins").over(w).cast("int"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id", "entry").agg(F.array_join(joined, " ").alias("text"))


@query("""SELECT conv_id, word, count(*) AS segments FROM (SELECT conv_id, turn, unnest(list_distinct(string_split(text, ' '))) AS word FROM (SELECT *, max(length(text)) OVER (PARTITION BY conv_id) AS best FROM conversations) WHERE length(text) >= 0.7 * best) GROUP BY conv_id, word""")
def segment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all segments that score at least 0.7 of their record's best, each once, with how many segments hold it."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("score", F.length("text"))
    good = c.join(c.groupBy("conv_id").agg(F.max("score").alias("best")), "conv_id").where("score >= 0.7 * best")
    return good.select("conv_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).groupBy("conv_id", "word").agg(F.count("*").alias("segments"))


@query("""SELECT doc_id, quality AS score, CASE WHEN quality > 0.5 THEN 'A' ELSE 'B' END AS grade, CASE doc_id % 5 WHEN 0 THEN 'milk|nuts' WHEN 1 THEN 'milk' WHEN 2 THEN '[broken' ELSE '' END AS warnings, CASE doc_id % 5 WHEN 0 THEN 'milk' WHEN 1 THEN 'milk' WHEN 2 THEN '[broken' ELSE '' END AS shown FROM labels""")
def diagnosis_with_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade are always computed anew; warnings come from the allergens' text or list, and those of an older rule are not shown."""
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, '["milk", "nuts"]').when(k == 1, "milk").when(k == 2, "[broken").when(k == 3, "")
    rows = table(spark, sf_dir, "labels", "doc_id", "quality").select("doc_id", F.col("quality").alias("score"), X.listed_warnings(raw).alias("w"))
    grade = F.when(F.col("score") > 0.5, "A").otherwise("B")
    return rows.select("doc_id", "score", grade.alias("grade"), F.array_join("w", "|").alias("warnings"), F.array_join(F.filter("w", lambda x: ~x.rlike("^nuts")), "|").alias("shown"))


@query("""SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) || ' x' AS spaced, 'A.B,' || p_name || ' 1 2' AS recognised FROM part""")
def recognised_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingredient's spaced form and recognised text in half width."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    raw, seen = F.concat(F.lit(" *"), F.upper("p_name"), F.lit("（"), "p_type", F.lit(")_  †x ")), F.concat(F.lit("Ａ·B，"), "p_name", F.lit("\n　1、２"))
    return p.select("p_partkey", X.spaced_out(raw).alias("spaced"), X.recognised(seen).alias("recognised"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS level, CASE o_orderstatus WHEN 'F' THEN 'maker' WHEN 'O' THEN 'importer' ELSE 'other' END AS role FROM orders""")
def dictionary_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small dictionaries as literal maps; what they lack has a default."""
    level = F.create_map(*(F.lit(x) for pair in {"1-URGENT": 5, "2-HIGH": 3, "3-MEDIUM": 1}.items() for x in pair))
    role = F.create_map(*(F.lit(x) for pair in {"F": "maker", "O": "importer"}.items() for x in pair))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return o.select("o_orderkey", F.coalesce(F.element_at(level, F.col("o_orderpriority")), F.lit(0)).alias("level"), F.coalesce(F.element_at(role, F.col("o_orderstatus")), F.lit("other")).alias("role"))


@query("SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part)")
def truncate_and_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is emptied and loaded again; its ids begin at 1."""
    names = table(spark, sf_dir, "part", "p_name", "p_brand").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return T.new_keys(names, spark.createDataFrame([], "id long, name string"), "name", "id")


@query("""SELECT DISTINCT user_id, event_type FROM events e WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events p WHERE p.value > 100 AND p.user_id = e.user_id AND p.event_type = e.event_type)""")
def stream_new_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on arrival: only those that neither the published ones nor an earlier batch have."""
    published = table(spark, sf_dir, "events", "user_id", "event_type", "value").where("value > 100").select("user_id", "event_type").distinct()
    where = S.folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["user_id", "event_type"]).join(published, ["user_id", "event_type"], "left_anti")
        if number:
            earlier = batch.sparkSession.read.parquet(f"{where}/rows").where(F.col("at") < number)
            fresh = fresh.join(earlier, ["user_id", "event_type"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{where}/rows/at={number}")  # a repeated batch overwrites itself

    e = S.stream(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "event_type")
    q = e.writeStream.foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/rows").select("user_id", "event_type")


@query("""WITH l AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS makers, count(*) FILTER (l_returnflag <> 'N') AS sources, max(l_tax) AS tax FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, CASE WHEN makers IS NULL OR c_custkey IS NULL THEN 'not_target' WHEN makers > 5 THEN 'ambiguous' WHEN sources = 0 THEN 'no_sources' WHEN tax < 0.03 THEN 'extract_failed' END AS failed FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey)
SELECT status, count(*) AS n FROM (SELECT coalesce(failed, CASE WHEN row_number() OVER (PARTITION BY o_custkey, y, failed IS NULL ORDER BY o_orderkey) > 1 THEN 'duplicate' ELSE 'published' END) AS status FROM s) GROUP BY status""")
def grounded_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each report gets: the first stage that it fails, a duplicate of a published one, or published; counts by status."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_tax").groupBy(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    facts = l.agg(F.count_distinct("l_suppkey").alias("makers"), F.count_if(F.col("l_returnflag") != "N").alias("sources"), F.max("l_tax").alias("tax"))
    makers = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(facts, "o_orderkey", "left").join(makers, "o_custkey", "left")
    failed = F.when(F.col("makers").isNull() | F.col("known").isNull(), "not_target").when(F.col("makers") > 5, "ambiguous").when(F.col("sources") == 0, "no_sources").when(F.col("tax") < 0.03, "extract_failed")
    rows = o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), failed.alias("failed"))
    passed = rows.where("failed IS NULL").groupBy("o_custkey", "year").agg(F.count("*").alias("n"))
    counts = passed.agg(F.count("*").alias("published"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))  # of each maker and year the first one is published
    last = counts.select(F.explode(F.create_map(F.lit("published"), "published", F.lit("duplicate"), "duplicate")).alias("status", "n")).where("n > 0")
    return rows.where("failed IS NOT NULL").groupBy(F.col("failed").alias("status")).agg(F.count("*").alias("n")).union(last)


@query("""WITH a AS (SELECT l_orderkey, min(l_linenumber) AS act, min(l_partkey) AS target FROM lineitem GROUP BY 1), p AS (SELECT * FROM orders JOIN a ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')
SELECT 'event' AS kind, o_orderkey AS event_id, o_orderkey FROM p WHERE act IN (1, 2) UNION ALL SELECT 'link', target, o_orderkey FROM p WHERE act = 3 AND target IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending reports by their reviewer's action: approved and new ones become events, attached ones links to an event that exists, rejected ones nothing."""
    acts = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("act"), F.min("l_partkey").alias("event_id"))
    pending = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").join(acts, "o_orderkey")
    there = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size > 10").select(F.col("p_partkey").alias("event_id"))
    events = pending.where("act IN (1, 2)").select(F.lit("event").alias("kind"), F.col("o_orderkey").alias("event_id"), "o_orderkey")
    return events.union(pending.where("act = 3").join(there, "event_id", "left_semi").select(F.lit("link"), "event_id", "o_orderkey"))


@query("""SELECT o_orderkey, '{"product":{"id":' || o_orderkey || ',"name":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'nested' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'unnamed' END || '"},"score":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE (o_custkey % 100)::VARCHAR END || ',"summary":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'given' ELSE 'order ' || o_orderstatus END || '"}' AS response FROM orders""")
def response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response with fixed keys from flat or nested records: flat names are wrapped, a summary that is absent is filled in, a score that is absent stays null."""
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), F.col("o_orderkey")
    nested, flat = F.when(k % 3 == 0, "nested"), F.when(k % 3 == 1, F.col("o_orderpriority"))
    summary = F.coalesce(F.when(k % 5 == 0, "given"), F.concat(F.lit("order "), "o_orderstatus"))
    body = F.struct(F.struct(k.alias("id"), F.coalesce(nested, flat, F.lit("unnamed")).alias("name")).alias("product"), F.when(k % 4 != 0, F.col("o_custkey") % 100).alias("score"), summary.alias("summary"))
    return o.select("o_orderkey", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


@query("""SELECT p_partkey, (2 + (p_partkey % 2 = 0)::INT)::INT AS hits, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type || 'zzzzzzzz' END AS missed, 'qqqqqqqqqqqq|' || p_name AS spurious FROM part""")
def matched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two lists, one to one, with as many edits as a quarter of their length."""
    p, k = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")), F.col("p_partkey") % 2
    wanted = F.array("p_name", F.concat("p_type", F.lit("zzzzzzzz")), F.col("p_brand"))
    got = F.array(F.concat(F.lit("#"), "p_name"), F.lit("q" * 12), F.col("p_brand"), F.col("p_name"), F.when(k == 0, F.concat("p_type", F.lit("zzzzzz"))))
    rows = p.select("p_partkey", I.matched(F.array_compact(got), wanted).alias("m"))
    return rows.select("p_partkey", "m.hits", F.array_join("m.missed", "|").alias("missed"), F.array_join("m.spurious", "|").alias("spurious"))


@query("""SELECT p_partkey, p_brand || '|#' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '|salt|malt' ELSE '|salt' END AS items FROM part""")
def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers' items as one list: of alike ones the longer stays; short ones must be equal."""
    p = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand"))
    base = F.array(F.col("p_brand"), F.col("p_name"), F.concat(F.lit("#"), "p_name"), F.lit("salt"))
    more = F.array(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, "malt").otherwise("salt"))
    return p.select("p_partkey", F.array_join(I.merged(base, more), "|").alias("items"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS energy, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity * 2 END AS energy_100, l_linenumber + 0.5 AS saturated, NULL::DOUBLE AS saturated_100, CASE WHEN l_partkey % 2 = 0 THEN 7.0 END AS fat, 5.0 AS sugar, CASE WHEN l_partkey % 2 = 1 THEN 40.0 END AS sodium FROM lineitem""")
def numbers_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nutrition table's numbers by the names before them: longer names first, no name of an ingredient, no second column where that holds daily values."""
    l, k = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")), F.col("l_partkey")  # noqa: E741
    whole = F.col("l_quantity").cast("int")
    text = F.concat(
        F.when(k % 3 == 0, "每日參考值 ").otherwise("每100公克 "), F.lit("熱量 "), whole.cast("string"), F.lit("大卡 "), (whole * 2).cast("string"), F.lit("大卡\n"),
        F.lit("飽和脂肪 "), F.col("l_linenumber").cast("string"), F.lit(",5 公克 每份其他各項合計共計如下 "), F.when(k % 2 == 0, "脂肪 7 公克 每份其他各項合計共計如下 ").otherwise("磷酸鈉 3 鈉 40毫克 每份其他各項合計共計如下 "), F.lit("蔗糖 9 糖：５ 公克"),
    )
    rows = l.select("l_orderkey", "l_linenumber", "l_partkey", I.numbers_by_field(text).alias("m"))
    value = lambda key, at: F.get(F.element_at("m", F.lit(key)), F.lit(at))
    names = {"energy": ("calories", 0), "energy_100": ("calories", 1), "saturated": ("saturated_fat", 0), "saturated_100": ("saturated_fat", 1), "fat": ("fat", 0), "sugar": ("sugar", 0), "sodium": ("sodium", 0)}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *(value(*at).alias(n) for n, at in names.items()))


# Entities and terms of the ingest below; both are parameters of a real run.
MAKERS, GATE = {1: "thre", 2: "thble", 3: "than"}, ["thnt", "ther"]


@query("""WITH r AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'ftp://x' ELSE 'https://' || source || '.example.org/' || lang END AS url, text, ['thnt', 'ther'] AS terms FROM documents),
h AS (SELECT doc_id, url, left(text, 40) AS title, list_filter(terms, lambda t: contains(text, t)) AS terms, unnest(list_filter(['thre', 'thble', 'than'], lambda m: contains(text, m))) AS m FROM r WHERE regexp_matches(url, '^https?://[^/]'))
SELECT CASE m WHEN 'thre' THEN 1 WHEN 'thble' THEN 2 ELSE 3 END AS producer_id, url, min(doc_id) AS doc_id, arg_min(title, doc_id) AS title, arg_min(array_to_string(terms, ','), doc_id) AS matched_terms, CASE WHEN url LIKE 'https://src1.%' THEN 'official' ELSE 'unknown' END AS tier, 'pending' AS status
FROM h WHERE len(terms) > 0 AND (url, m) NOT IN (SELECT ('https://' || source || '.example.org/' || lang, 'than') FROM documents WHERE source = 'src2') GROUP BY m, url""")
def candidate_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results as candidates: absolute address, known makers, gate terms, tier; one row a maker and address (the first one), none that is queued already."""
    from quern.functions import labels as L
    from quern.functions import texts as N

    d = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    address = lambda c: F.concat(F.lit("https://"), c, F.lit(".example.org/"), "lang")
    url = F.when(F.col("source") == "src3", "ftp://x").otherwise(address(F.col("source")))
    held = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w))
    results = d.select("doc_id", url.alias("url"), F.left("text", F.lit(40)).alias("title"), held(GATE).alias("terms"), held(MAKERS.values()).alias("makers"))
    passed = results.where(L.absolute_url(F.col("url")) & (F.size("terms") > 0))
    ids = F.create_map(*(F.lit(x) for i, name in MAKERS.items() for x in (name, i)))
    hits = passed.select("doc_id", "url", "title", "terms", F.explode("makers").alias("maker")).withColumn("producer_id", F.element_at(ids, F.col("maker")))
    first = hits.groupBy("producer_id", "url").agg(F.min_by(F.struct("doc_id", "title", "terms"), "doc_id").alias("f"))
    queued = d.where("source = 'src2'").select(F.lit(3).alias("producer_id"), address(F.col("source")).alias("url")).distinct()
    tier = F.when(N.in_domains(N.domain(F.col("url")), ["src1.example.org"]), "official").otherwise("unknown")
    new = first.join(queued, ["producer_id", "url"], "left_anti")
    return new.select("producer_id", "url", "f.doc_id", "f.title", F.array_join("f.terms", ",").alias("matched_terms"), tier.alias("tier"), F.lit("pending").alias("status"))


@query("SELECT doc_id, toxic, quality FROM labels JOIN documents USING (doc_id) WHERE source = 'src1'")
def truth_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON by category, every category of the manifest there, and one category read back by its folder."""
    from quern.sources.sinks import case_json

    d = table(spark, sf_dir, "documents", "doc_id", "source")
    rows = table(spark, sf_dir, "labels", "doc_id", "toxic", "quality").join(d, "doc_id")
    where = f"{S.folder(spark)}/truth"
    case_json(rows, where, "source", rows.select("source").distinct())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spark.read.schema(schema).json(where).where("source = 'src1'").select("doc_id", "toxic", "quality")
