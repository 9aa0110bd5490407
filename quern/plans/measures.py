"""Statistics, geometry, times and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import labels as L
from quern.functions.times import epoch_seconds
from quern.plans.registry import query
from quern.sources.tables import table


@query("SELECT l_suppkey, median(l_extendedprice) AS middle, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def true_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of both middle values where the count is even."""
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice").groupBy("l_suppkey").agg(F.median("l_extendedprice").alias("middle"), F.count("*").alias("n"))


CELLS = """SELECT l_orderkey, c.field, c.truth, c.ours FROM (SELECT l_orderkey, unnest([{'field': 'quantity', 'truth': l_quantity, 'ours': CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END END}, {'field': 'tax', 'truth': nullif(l_tax, 0), 'ours': CASE WHEN l_partkey % 11 = 0 THEN 0.5 ELSE nullif(l_tax, 0) END}]) AS c FROM lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of records, as read and in truth."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_linenumber", "l_partkey", "l_tax")  # noqa: E741
    quantity = F.when(F.col("l_linenumber") % 4 != 3, F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0))
    tax = F.nullif("l_tax", F.lit(0.0))
    cell = lambda name, truth, ours: F.struct(F.lit(name).alias("field"), truth.alias("truth"), ours.alias("ours"))
    return l.select("l_orderkey", F.inline(F.array(cell("quantity", F.col("l_quantity"), quantity), cell("tax", tax, F.when(F.col("l_partkey") % 11 == 0, 0.5).otherwise(tax)))))


@query(f"""SELECT field, count(*) FILTER (truth IS NOT DISTINCT FROM ours) AS ok, count(*) AS total, (SELECT count(*) FROM (SELECT l_orderkey FROM ({CELLS}) GROUP BY 1 HAVING bool_and(truth IS NOT DISTINCT FROM ours))) AS perfect_cases FROM ({CELLS}) GROUP BY field""")
def cell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right cells by field, and how many cases are right as a whole."""
    rows = cells(spark, sf_dir).withColumn("ok", F.col("truth").eqNullSafe(F.col("ours")))
    perfect = rows.groupBy("l_orderkey").agg(F.bool_and("ok").alias("all_ok")).agg(F.count_if("all_ok").alias("perfect_cases"))
    by = rows.groupBy("field").agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"))
    return by.join(F.broadcast(perfect), F.lit(True))  # one row


@query(f"SELECT field, count(ours) AS filled, count(truth) AS wanted, count(*) FILTER (ours IS NOT NULL AND truth IS NULL) AS spurious FROM ({CELLS}) GROUP BY field")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("field").agg(F.count("ours").alias("filled"), F.count("truth").alias("wanted"), F.count_if(F.col("ours").isNotNull() & F.col("truth").isNull()).alias("spurious"))


@query("""WITH r AS (SELECT l_orderkey, round(l_extendedprice / l_quantity / 10, 1) AS r FROM lineitem WHERE round(l_extendedprice / l_quantity / 10, 1) BETWEEN 5 AND 2000),
g AS (SELECT a.l_orderkey, a.r, count(*) AS n, round(avg(b.r), 4) AS mean FROM (SELECT DISTINCT * FROM r) a JOIN r b ON a.l_orderkey = b.l_orderkey AND abs(b.r - a.r) <= greatest(2.0, a.r * 0.03) GROUP BY a.l_orderkey, a.r)
SELECT l_orderkey, arg_min(mean, -n * 100000 + r) AS serving, max(n) AS votes FROM g GROUP BY l_orderkey HAVING max(n) >= 2""")
def ratio_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group of ratios within 3 % of one of them (the smallest of equals), from two votes on.  A record has a few lines."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_quantity")  # noqa: E741
    r = l.select("l_orderkey", F.round(F.col("l_extendedprice") / F.col("l_quantity") / 10, 1).alias("r")).where("r BETWEEN 5 AND 2000")
    lists = r.groupBy("l_orderkey").agg(F.collect_list("r").alias("rs"))
    near = lambda r0: F.filter("rs", lambda x: F.abs(x - r0) <= F.greatest(F.lit(2.0), r0 * 0.03))
    mean = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a), 4)
    groups = F.transform("rs", lambda r0: F.struct((-F.size(near(r0))).alias("minus"), r0.alias("r"), mean(near(r0)).alias("mean")))
    rows = lists.select("l_orderkey", F.array_min(groups).alias("g"))
    return rows.select("l_orderkey", F.col("g.mean").alias("serving"), (-F.col("g.minus")).cast("long").alias("votes")).where("votes >= 2")


@query("SELECT l_partkey, l_suppkey, count(*) AS votes FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pair_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("votes")).where("votes > 1")


@query("""SELECT l_orderkey, arg_min(l_returnflag, -n * 1000 + first) AS label FROM (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) * 10 + ascii(l_returnflag) / 100 AS first FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY l_orderkey""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label of each box; of equals the one that stands first."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber")  # noqa: E741
    counts = l.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"))
    return counts.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(-F.col("n"), "first", "l_returnflag")).alias("label"))


@query("SELECT l_orderkey, sum(n - 1)::BIGINT AS duplicates FROM (SELECT l_orderkey, l_quantity, count(*) AS n FROM lineitem WHERE l_quantity <> 0 GROUP BY ALL HAVING count(*) > 1) GROUP BY l_orderkey")
def duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a value of a record is claimed again; zeros do not count."""
    counts = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity <> 0").groupBy("l_orderkey", "l_quantity").agg(F.count("*").alias("n")).where("n > 1")
    return counts.groupBy("l_orderkey").agg(F.sum(F.col("n") - 1).alias("duplicates"))


@query("""SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS name, array_to_string(list_sort(list(o_orderkey)), ',') AS members FROM orders GROUP BY o_custkey""")
def collected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's members and the name that was given last.  A customer's orders are few."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority").groupBy("o_custkey")
    return o.agg(F.max_by("o_orderpriority", "o_orderkey").alias("name"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("members"))


@query("""SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS date, arg_max(o_orderpriority, length(o_orderpriority) * 1000000000 - o_orderkey) AS summary, max(o_totalprice) AS severity, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS links, count(*) AS n FROM orders GROUP BY o_custkey""")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one event as one: last date, longest summary (the first of equals), highest severity, all links."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus").groupBy("o_custkey")
    return o.agg(
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("date"), F.min_by("o_orderpriority", F.struct(-F.length("o_orderpriority"), "o_orderkey")).alias("summary"),
        F.max("o_totalprice").alias("severity"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("links"), F.count("*").alias("n"),
    )


@query("""SELECT user_id, event_id, n::INT AS n, (s - lag(s + ms) OVER (PARTITION BY user_id ORDER BY n))::BIGINT AS pause FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, CAST(floor(value) AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def sequence_and_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's place in its batch, and the time since the one before it ended."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events", "user_id", "event_id", "ts", "value").withColumn("s", epoch_seconds(F.col("ts")))
    return e.select("user_id", "event_id", F.row_number().over(w).alias("n"), (F.col("s") - F.lag(F.col("s") + F.floor("value")).over(w)).alias("pause"))


@query("""SELECT o_custkey, arg_min(o_orderpriority, tier * 1000000000000 + (100 - length(o_orderpriority)) * 10000000000 + o_orderkey) AS name, min(tier)::INT AS tier FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS tier FROM orders WHERE o_orderkey % 4 <> 0) GROUP BY o_custkey""")
def tier_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the first tier that has any; within it the longest."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority").where("o_orderkey % 4 <> 0")
    o = o.withColumn("tier", F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3))
    return o.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("tier", -F.length("o_orderpriority"), "o_orderkey")).alias("name"), F.min("tier").alias("tier"))


@query("SELECT user_id, event_type AS segment, sum(CAST(floor(value * 100) AS BIGINT))::BIGINT AS ms, count(*) AS laps FROM events GROUP BY ALL")
def lap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of one name add up."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    return e.groupBy("user_id", F.col("event_type").alias("segment")).agg(F.sum(F.floor(F.col("value") * 100)).alias("ms"), F.count("*").alias("laps"))


@query("""SELECT o_orderkey, regexp_extract(d, '^[0-9]{4}') AS leading, regexp_extract(t, '(19|20)[0-9]{2}') AS any_year FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y/%m') WHEN 1 THEN 'in ' || strftime(o_orderdate, '%Y') ELSE '' END AS d, 'No. 3121: ' || strftime(o_orderdate, '%d.%m.%Y') AS t FROM orders)""")
def years_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), F.col("o_orderkey") % 3
    d = F.when(k == 0, F.date_format("o_orderdate", "yyyy/MM")).when(k == 1, F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"))).otherwise("")
    return o.select("o_orderkey", F.regexp_extract(d, "^[0-9]{4}", 0).alias("leading"), F.regexp_extract(F.concat(F.lit("No. 3121: "), F.date_format("o_orderdate", "dd.MM.yyyy")), "(19|20)[0-9]{2}", 0).alias("any_year"))


@query("""SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS shown, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN 1706745600 - s <= 86400 THEN 'fresh' ELSE 'stale' END AS state,
 CASE WHEN 1706745600 - s < 3600 THEN 'now' WHEN 1706745600 - s < 86400 THEN ((1706745600 - s) // 3600) || ' h' WHEN 1706745600 - s <= 604800 THEN ((1706745600 - s) // 86400) || ' d' ELSE month(ts) || '/' || day(ts) END AS relative FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)""")
def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute, ISO and relative times and the state of the data, at a given moment."""
    e = table(spark, sf_dir, "events", "event_id", "ts")
    age = F.lit(1706745600) - epoch_seconds(F.col("ts"))
    text = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    relative = F.when(age < 3600, "now").when(age < 86400, text(age / 3600, " h")).when(age <= 604800, text(age / 86400, " d")).otherwise(F.concat(F.month("ts").cast("string"), F.lit("/"), F.dayofmonth("ts").cast("string")))
    return e.select("event_id", F.date_format("ts", "yyyy/MM/dd HH:mm").alias("shown"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.when(age <= 86400, "fresh").otherwise("stale").alias("state"), relative.alias("relative"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '1999-06-01' AS overdue FROM orders WHERE o_orderpriority = '5-LOW'")
def review_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority").where("o_orderpriority = '5-LOW'")
    return o.select("o_orderkey", (F.to_date("o_orderdate") + F.expr("INTERVAL 365 DAY") <= F.to_date(F.lit("1999-06-01"))).alias("overdue"))


BOXES = "SELECT vec_id, label, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[1]::DOUBLE + abs(embedding[3]::DOUBLE) AS x1, embedding[2]::DOUBLE + abs(embedding[4]::DOUBLE) AS y1 FROM embeddings"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", x(0).alias("x0"), x(1).alias("y0"), (x(0) + F.abs(x(2))).alias("x1"), (x(1) + F.abs(x(3))).alias("y1"))


@query(f"""SELECT vec_id, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(least(x1 - x0, y1 - y0), 6) AS thickness, round(greatest(x1 - x0, y1 - y0), 6) AS long_side, round((x1 - x0) * (y1 - y0) / ((bx1 - bx0) * (by1 - by0)), 6) AS area_share
FROM ({BOXES}) JOIN (SELECT label, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM ({BOXES}) GROUP BY label) USING (label)""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre, thickness, length and the share of its image's area of every box."""
    b = boxes(spark, sf_dir)
    page = b.groupBy("label").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = w * h / ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))
    parts = {"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "thickness": F.least(w, h), "long_side": F.greatest(w, h), "area_share": share}
    return b.join(page, "label").select("vec_id", *(F.round(v, 6).alias(k) for k, v in parts.items()))


@query(f"""WITH b AS ({BOXES}), r AS (SELECT label, avg(x0) AS rx0, avg(y0) AS ry0, avg(x1) + 0.05 AS rx1, avg(y1) + 0.05 AS ry1 FROM b GROUP BY label)
SELECT vec_id, (x0 + x1) / 2 BETWEEN rx0 AND rx1 AND (y0 + y1) / 2 BETWEEN ry0 AND ry1 AS inside FROM b JOIN r USING (label)""")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a box's centre lie in the region of its image."""
    b = boxes(spark, sf_dir)
    r = b.groupBy("label").agg(F.avg("x0").alias("rx0"), F.avg("y0").alias("ry0"), (F.avg("x1") + 0.05).alias("rx1"), (F.avg("y1") + 0.05).alias("ry1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return b.join(r, "label").select("vec_id", (cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1"))).alias("inside"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(n * 2 - round(n * 2)) <= 0.16 AND n > 0 THEN round(n * 2) / 2 END AS servings FROM (SELECT *, round(l_quantity * 10 / (l_linenumber + 3), 4) AS n FROM lineitem)""")
def half_servings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count of servings to the half, where it lies within 0.08 of one."""
    n = F.round(F.col("l_quantity") * 10 / (F.col("l_linenumber") + 3), 4)
    near = F.when((F.abs(n * 2 - F.round(n * 2)) <= 0.16) & (n > 0), F.round(n * 2) / 2)
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", near.alias("servings"))


@query("""SELECT o_orderkey, 'Score ' || total || '. ' || CASE WHEN len(bad) > 0 THEN 'Mainly ' || array_to_string(list_transform(bad[1:3], lambda x: x.name || ' ' || x.p || '/20'), ', ') || '.' ELSE 'No penalties.' END || CASE WHEN bonus > 0 AND lost > 0 THEN ' Bonus of ' || bonus || ' offsets ' || least(CAST(round_even(bonus * 100.0 / lost, 0) AS INT), 100) || '%.' WHEN bonus > 0 THEN ' Bonus of ' || bonus || '.' ELSE '' END AS summary
FROM (SELECT o_orderkey, lost - bonus AS total, lost, bonus, list_sort(list_filter([{'minus': -a, 'name': 'sugar', 'p': a}, {'minus': -b, 'name': 'salt', 'p': b}, {'minus': -c, 'name': 'fat', 'p': c}, {'minus': -d, 'name': 'energy', 'p': d}], lambda x: x.p > 0)) AS bad FROM (SELECT *, a + b + c + d AS lost, e AS bonus FROM (
 SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 6 AS b, (o_orderkey // 7) % 3 AS c, o_custkey % 2 AS d, (o_orderkey // 3) % 4 AS e FROM orders)))""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score in words: the three largest penalties, and how much of them the bonus offsets (100 % at most, halves to even)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    points = {"sugar": k % 4, "salt": c % 6, "fat": F.floor(k / 7) % 3, "energy": c % 2}
    items = F.array(*(F.struct((-p).alias("minus"), F.lit(n).alias("name"), p.alias("p")) for n, p in points.items()))
    rows = o.select("o_orderkey", F.array_sort(F.filter(items, lambda x: x["p"] > 0)).alias("bad"), (F.floor(k / 3) % 4).alias("bonus"))
    lost = F.aggregate("bad", F.lit(0).cast("long"), lambda a, x: a + x["p"])
    rows = rows.withColumn("lost", lost)
    text = lambda x: x.cast("string")
    main = F.when(F.size("bad") > 0, F.concat(F.lit("Mainly "), F.array_join(F.transform(F.slice("bad", 1, 3), lambda x: F.concat(x["name"], F.lit(" "), text(x["p"]), F.lit("/20"))), ", "), F.lit("."))).otherwise("No penalties.")
    offset = F.least(F.bround(F.col("bonus") * 100 / F.col("lost"), 0).cast("int"), F.lit(100))
    more = F.when((F.col("bonus") > 0) & (F.col("lost") > 0), F.concat(F.lit(" Bonus of "), text(F.col("bonus")), F.lit(" offsets "), text(offset), F.lit("%."))).when(F.col("bonus") > 0, F.concat(F.lit(" Bonus of "), text(F.col("bonus")), F.lit("."))).otherwise("")
    return rows.select("o_orderkey", F.concat(F.lit("Score "), text(F.col("lost") - F.col("bonus")), F.lit(". "), main, more).alias("summary"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT a AND NOT b THEN 'none' WHEN NOT a THEN 'drop_serving' WHEN NOT b AND l_quantity > 0 AND l_tax > 0 THEN 'from_serving' ELSE 'drop_totals' END AS choice, CASE WHEN a AND NOT b AND l_quantity > 0 AND l_tax > 0 THEN round(l_extendedprice * 100 / l_quantity, 4) ELSE l_extendedprice END AS energy
FROM (SELECT *, l_discount > l_tax + 0.03 AS a, l_partkey % 3 = 0 AS b FROM lineitem)""")
def conflict_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two contradictory columns is used: none, without the serving, derived from it, or without the totals."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")  # noqa: E741
    whole, serving = F.col("l_discount") > F.col("l_tax") + 0.03, F.col("l_partkey") % 3 == 0
    derivable = ~serving & (F.col("l_quantity") > 0) & (F.col("l_tax") > 0)
    choice = F.when(~whole & ~serving, "none").when(~whole, "drop_serving").when(derivable, "from_serving").otherwise("drop_totals")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", choice.alias("choice"), F.when(whole & derivable, F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity"), 4)).otherwise(F.col("l_extendedprice")).alias("energy"))


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'degraded' ELSE 'success' END AS status, n AS health_score, CASE WHEN n IS NULL THEN 'health_score,risk_level,score_breakdown' ELSE '' END AS unavailable, CASE WHEN n IS NULL THEN NULL WHEN n < 2 THEN 'low' WHEN n < 5 THEN 'medium' ELSE 'high' END AS risk_level
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def partial_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response without a score says so and names what it lacks; no score is made up."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("health_score"))
    rows = table(spark, sf_dir, "orders", "o_orderkey").join(lines, "o_orderkey", "left")
    n = F.col("health_score")
    risk = F.when(n < 2, "low").when(n < 5, "medium").when(n.isNotNull(), "high")
    return rows.select("o_orderkey", F.when(n.isNull(), "degraded").otherwise("success").alias("status"), "health_score", F.when(n.isNull(), "health_score,risk_level,score_breakdown").otherwise("").alias("unavailable"), risk.alias("risk_level"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') > 0 AS has_records, array_to_string(list_sort(coalesce(list(event_id) FILTER (event_type = 'error'), [])), ',') AS events, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'reports' ELSE 'nothing found; this does not mean that nothing happened' END AS disclaimer FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def published_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is published of each maker; without records it says that this proves nothing."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "event_id").where("user_id IS NOT NULL")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id")))).alias("found"))
    some = F.size("found") > 0
    return rows.select("user_id", some.alias("has_records"), F.array_join("found", ",").alias("events"), F.when(some, "reports").otherwise("nothing found; this does not mean that nothing happened").alias("disclaimer"))


@query("""SELECT p_partkey, array_to_string(list_filter(['milk', 'nuts', 'fish'], lambda a: CASE a WHEN 'milk' THEN contains(p_name, 'red') WHEN 'nuts' THEN contains(p_name, 'bolt') OR contains(p_name, 'nut') ELSE contains(p_name, 'gear') END), ',') AS allergens, array_to_string(list_filter(['milk', 'fish'], lambda a: CASE a WHEN 'milk' THEN contains(p_name, 'red') ELSE contains(p_name, 'gear') END), ',') AS mine FROM part""")
def allergen_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a product by its words, and those that a profile shares."""
    tags = {"milk": ["red"], "nuts": ["bolt", "nut"], "fish": ["gear"]}
    found = F.array_compact(F.array(*(F.when(L.either(F.col("p_name"), words), tag) for tag, words in tags.items())))
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", found.alias("tags"))
    return p.select("p_partkey", F.array_join("tags", ",").alias("allergens"), F.array_join(F.array_intersect("tags", F.array(F.lit("milk"), F.lit("fish"))), ",").alias("mine"))


@query("""SELECT a.l_orderkey, arg_min(a.l_quantity, a.l_linenumber * 1000 + b.l_linenumber) AS a, arg_min(b.l_quantity, a.l_linenumber * 1000 + b.l_linenumber) AS b FROM one a JOIN one b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND abs(b.l_quantity * 40 / 100 - a.l_quantity) <= greatest(0.6, a.l_quantity * 0.06) GROUP BY a.l_orderkey""".replace("FROM one a JOIN one b", "FROM (Q) a JOIN (Q) b").replace("Q", "SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL"))
def consistent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ordered pair of a record's values that agrees with its serving of 40.  A record has a few lines."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))  # noqa: E741
    side = lambda n: l.select("l_orderkey", F.col("l_linenumber").alias(f"{n}_at"), F.col("q").alias(n))
    fits = (F.col("a_at") != F.col("b_at")) & (F.abs(F.col("b") * 40 / 100 - F.col("a")) <= F.greatest(F.lit(0.6), F.col("a") * 0.06))
    pairs = side("a").join(side("b"), "l_orderkey").where(fits)
    return pairs.groupBy("l_orderkey").agg(F.min_by(F.struct("a", "b"), F.struct("a_at", "b_at")).alias("p")).select("l_orderkey", "p.a", "p.b")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS y, min(l_partkey) AS x FROM lineitem GROUP BY ALL), l AS (FROM n WHERE l_linenumber = 1), v AS (FROM n WHERE l_linenumber > 1)
SELECT l.l_orderkey, arg_min(v.l_linenumber, v.x * 100 + v.l_linenumber)::INT AS cell, count(*) AS n FROM l JOIN v ON v.l_orderkey = l.l_orderkey AND abs(v.y - l.y) <= 10 AND v.x > l.x GROUP BY l.l_orderkey""")
def same_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's values: in its band, to its right, the nearest one first."""
    n = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("y"), F.min("l_partkey").alias("x"))
    labels = n.where("l_linenumber = 1").select("l_orderkey", F.col("x").alias("lx"), F.col("y").alias("ly"))
    found = labels.join(n.where("l_linenumber > 1"), "l_orderkey").where("abs(y - ly) <= 10 AND x > lx")
    return found.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("x", "l_linenumber")).alias("cell"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey, ['a' || (p_size % 5), 'b' || (p_partkey % 3)] AS groups, p_partkey % 4 AS layer FROM part) SELECT p_partkey, layer, list_contains(groups, 'a2') AS of_group FROM s WHERE layer = 1 OR list_contains(groups, 'b0')""")
def sources_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(F.concat(F.lit("a"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("b"), (F.col("p_partkey") % 3).cast("string")))
    s = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", groups.alias("groups"), (F.col("p_partkey") % 4).alias("layer"))
    return s.where((F.col("layer") == 1) | F.array_contains("groups", "b0")).select("p_partkey", "layer", F.array_contains("groups", "a2").alias("of_group"))


@query("""SELECT o_custkey, array_to_string(list_transform(list_filter([{'n': 'sugar', 'p': s, 'k': 'x'}, {'n': 'salt', 'p': t, 'k': 'x'}, {'n': 'antioxidant', 'p': 1, 'k': 'antioxidant'}], lambda x: x.k <> 'antioxidant' AND x.p > 0), lambda x: x.n || '=' || x.p), ';') AS breakdown FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) FILTER (o_orderstatus = 'O') AS t FROM orders GROUP BY o_custkey)""")
def breakdown_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breakdown that comes as an object, as a list; nulls and the antioxidants are left out, and so it is written as `k=v;k=v`."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count_if(F.col("o_orderstatus") == "O").alias("t"))
    m = F.create_map(F.lit("sugar"), F.nullif("s", F.lit(0)), F.lit("salt"), F.nullif("t", F.lit(0)), F.lit("antioxidant"), F.lit(1).cast("long"))
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & (k != "antioxidant"))
    return o.select("o_custkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("breakdown"))


@query("""WITH p AS (SELECT conv_id AS id, unnest([turn, turn + 1]) AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')), n AS (SELECT id, k FROM p JOIN (SELECT DISTINCT turn AS k, conv_id AS id FROM conversations) USING (id, k))
SELECT id, count(DISTINCT k) AS keys, count(DISTINCT k) >= 2 AS valid FROM n GROUP BY id""")
def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed merges: their keys that exist, and whether there are at least two."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    proposed = c.where("role = 'user'").select(F.col("conv_id").alias("id"), F.explode(F.array("turn", F.col("turn") + 1)).alias("k")).distinct()
    found = proposed.join(c.select(F.col("conv_id").alias("id"), F.col("turn").alias("k")), ["id", "k"], "left_semi")
    return found.groupBy("id").agg(F.count("*").alias("keys")).select("id", "keys", (F.col("keys") >= 2).alias("valid"))
