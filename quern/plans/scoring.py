"""Nutrition queries.  Line items stand in for labelled products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import nutrition as N
from quern.plans.registry import query
from quern.sources.tables import table

# The label of a line item: amounts per 100 g.
INPUTS = {
    "energy": "l_extendedprice / 30.0", "sugars": "l_quantity * 1.1", "sfa": "l_discount * 120.0", "salt": "l_tax * 55.0",
    "protein": "l_quantity / 3.0", "fibre": "l_tax * 100.0", "fruit": "l_quantity * 2.0", "drink": "l_linestatus = 'O'",
}


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *(F.expr(e).alias(k) for k, e in INPUTS.items()))


def ladder(value: str, thresholds: list[float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {value} > {float(t)}::DOUBLE THEN 1 ELSE 0 END" for t in thresholds) + ")"


LABELS = "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"{e} AS {k}" for k, e in INPUTS.items()) + " FROM lineitem"
POINTS = f"""
  SELECT *, CASE WHEN drink THEN {ladder("energy", N.DRINK_ENERGY)} + {ladder("sugars", N.DRINK_SUGARS)} ELSE {ladder("energy", N.ENERGY)} + {ladder("sugars", N.SUGARS)} END
    + {ladder("sfa", N.SATURATED)} + {ladder("salt", N.SALT)} AS points_n,
    CASE WHEN drink THEN {ladder("protein", N.DRINK_PROTEIN)} ELSE {ladder("protein", N.PROTEIN)} END AS p_protein,
    CASE WHEN drink THEN {ladder("fibre", N.DRINK_FIBRE)} ELSE {ladder("fibre", N.FIBRE)} END AS p_fibre,
    CASE WHEN fruit > 80 THEN CASE WHEN drink THEN 6 ELSE 5 END WHEN fruit > 60 THEN CASE WHEN drink THEN 4 ELSE 2 END WHEN fruit > 40 THEN CASE WHEN drink THEN 2 ELSE 1 END ELSE 0 END AS p_fruit
  FROM ({LABELS})"""
GRADES = """CASE WHEN drink THEN CASE WHEN score <= 2 THEN 'B' WHEN score <= 6 THEN 'C' WHEN score <= 9 THEN 'D' ELSE 'E' END
  ELSE CASE WHEN score <= 0 THEN 'A' WHEN score <= 2 THEN 'B' WHEN score <= 10 THEN 'C' WHEN score <= 18 THEN 'D' ELSE 'E' END END"""


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, points_n, p_protein + p_fibre + p_fruit AS points_p, score, {GRADES} AS grade FROM (
  SELECT *, points_n - CASE WHEN NOT drink AND points_n >= 11 AND p_fruit <> 5 THEN p_fibre + p_fruit ELSE p_protein + p_fibre + p_fruit END AS score FROM ({POINTS}))""")
def nutriscore_points_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir)
    s = N.score(*(F.col(c) for c in ("energy", "sugars", "sfa", "salt", "protein", "fibre", "fruit", "drink")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", s.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "s.points_n", "s.points_p", "s.score", "s.grade")


@query(f"""
SELECT grade, count(*) AS n, min(score) AS least, max(score) AS most, CAST(sum(score) AS BIGINT) AS total FROM (
  SELECT score, {GRADES} AS grade FROM (SELECT *, points_n - CASE WHEN NOT drink AND points_n >= 11 AND p_fruit <> 5 THEN p_fibre + p_fruit ELSE p_protein + p_fibre + p_fruit END AS score FROM ({POINTS}))) GROUP BY grade""")
def grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nutriscore_points_grade(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.sum("score").alias("total"))


GAPS = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice / 100.0 END AS calories, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity * 1.1 END AS sugar,
  CASE WHEN l_partkey % 11 <> 0 THEN l_tax * 9000.0 END AS sodium, CASE WHEN l_suppkey % 3 <> 0 THEN l_discount * 100.0 END AS saturated_fat, CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity / 4.0 END AS fat,
  CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity * 1.0 END AS carbohydrates, l_quantity / 5.0 AS protein FROM lineitem"""


@query(f"""
SELECT l_orderkey, l_linenumber, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) > 0 THEN 'insufficient' WHEN saturated_fat IS NULL THEN 'estimated' ELSE 'ok' END AS status,
  round(CASE WHEN len(missing) = 0 THEN coalesce(saturated_fat, fat * 0.35) END, 4) AS used_saturated_fat
FROM (SELECT *, list_filter([CASE WHEN calories IS NULL THEN 'calories' END, CASE WHEN sugar IS NULL THEN 'sugar' END, CASE WHEN sodium IS NULL THEN 'sodium' END,
  CASE WHEN saturated_fat IS NULL AND fat IS NULL THEN 'saturated_fat' END], lambda x: x IS NOT NULL) AS missing FROM ({GAPS}))""")
def score_status_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GAPS.replace("FROM lineitem", "FROM {t}"), t=table(spark, sf_dir, "lineitem"))
    missing = N.missing_inputs(calories=F.col("calories"), sugar=F.col("sugar"), sodium=F.col("sodium"), saturated_fat=F.coalesce("saturated_fat", "fat"))
    rows = rows.withColumn("m", missing)
    return rows.select(
        "l_orderkey", "l_linenumber", F.array_join("m", ",").alias("missing"),
        F.when(F.size("m") > 0, "insufficient").when(F.col("saturated_fat").isNull(), "estimated").otherwise("ok").alias("status"),
        F.round(F.when(F.size("m") == 0, F.coalesce(F.col("saturated_fat"), F.col("fat") * 0.35)), 4).alias("used_saturated_fat"),
    )


@query(f"""
SELECT l_orderkey, l_linenumber, coalesce(saturated_fat > fat + 0.1, false) AS fat_conflict, coalesce(sugar > carbohydrates + 0.1, false) AS sugar_conflict,
  coalesce(abs(protein * 4 + fat * 9 + carbohydrates * 4 - calories) <= calories * 0.1, false) AS energy_ok FROM ({GAPS})""")
def nutrition_conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GAPS.replace("FROM lineitem", "FROM {t}"), t=table(spark, sf_dir, "lineitem"))
    c = F.col
    return rows.select(
        "l_orderkey", "l_linenumber", N.conflict(c("saturated_fat"), c("fat")).alias("fat_conflict"), N.conflict(c("sugar"), c("carbohydrates")).alias("sugar_conflict"),
        F.coalesce(N.atwater(c("calories"), c("protein"), c("fat"), c("carbohydrates")), F.lit(False)).alias("energy_ok"),
    )


REFERENCE_ROWS = [(g, k, float(v) if v is not None else None) for g, values in N.REFERENCES.items() for k, v in values.items()]


@query(f"""
WITH refs(grp, nutrient, reference) AS (VALUES {", ".join(f"('{g}', '{k}', {'NULL' if v is None else v}::DOUBLE)" for g, k, v in REFERENCE_ROWS)}),
long AS (SELECT rid, l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'toddler' ELSE 'pregnant' END AS grp, unnest(['calories', 'fat', 'sodium', 'protein']) AS nutrient, unnest([calories, fat, sodium, protein]) AS amount FROM (SELECT *, row_number() OVER () AS rid FROM ({GAPS})))
SELECT l_orderkey, l_linenumber, grp, nutrient, round(amount / reference * 100, 1) AS percent, reference IS NULL AS no_reference,
  row_number() OVER (PARTITION BY rid ORDER BY (amount / reference) IS NULL, round(amount / reference * 100, 1) DESC, nutrient) AS place
FROM long JOIN refs USING (grp, nutrient) WHERE amount IS NOT NULL""")
def daily_reference_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GAPS.replace("FROM lineitem", "FROM {t}"), t=table(spark, sf_dir, "lineitem"))
    group = F.when(F.col("l_partkey") % 3 == 0, "general").when(F.col("l_partkey") % 3 == 1, "toddler").otherwise("pregnant")
    nutrients = ("calories", "fat", "sodium", "protein")
    by = {(g, k): F.lit(v).cast("double") for g, k, v in REFERENCE_ROWS}
    reference = lambda k: F.when(group == "general", by["general", k]).when(group == "toddler", by["toddler", k]).otherwise(by["pregnant", k])
    rows = rows.select("*", *((F.col(k) / reference(k)).alias(f"share_{k}") for k in nutrients))
    # A product has a handful of nutrients, so they are ranked inside their row and not by a shuffle.
    entry = lambda k: F.when(F.col(k).isNotNull(), F.struct(F.col(f"share_{k}").isNull().alias("last"), (-F.round(F.col(f"share_{k}") * 100, 1)).alias("minus"), F.lit(k).alias("nutrient")))
    ranked = F.array_sort(F.array_compact(F.array(*map(entry, nutrients))))
    out = rows.select("l_orderkey", "l_linenumber", group.alias("grp"), F.posexplode(ranked).alias("i", "x"))
    return out.select("l_orderkey", "l_linenumber", "grp", "x.nutrient", (-F.col("x.minus")).alias("percent"), F.col("x.last").alias("no_reference"), (F.col("i") + 1).cast("long").alias("place"))


PAIRS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 <> 1 THEN CASE WHEN l_partkey % 6 = 2 THEN l_quantity * 10 % 100 ELSE l_quantity * 10 END END AS per_serving,
  CASE WHEN l_suppkey % 9 <> 2 THEN CASE WHEN l_partkey % 6 = 3 THEN l_quantity * 1000 / 250 % 100 ELSE l_quantity * 1000 / 250 END END AS per_100, CASE WHEN l_suppkey % 13 <> 0 THEN 250.0::DOUBLE END AS serving FROM lineitem"""
SOLVER_SQL = """
WITH pairs AS ({pairs}),
txt AS (SELECT *, printf('%g', per_serving) AS ts, printf('%g', per_100) AS th FROM pairs),
cand AS (SELECT *,
  coalesce(abs(per_100 * serving / 100 - per_serving) <= greatest(0.6, abs(per_serving) * 0.06), false) AS fits,
  list_filter(list_transform(range(1, 10), lambda d: CAST(d || th AS DOUBLE)), lambda c: coalesce(abs(c * serving / 100 - per_serving) <= greatest(0.6, abs(per_serving) * 0.06), false)) AS c100,
  list_filter(list_transform(range(1, 10), lambda d: CAST(d || ts AS DOUBLE)), lambda c: coalesce(abs(per_100 * serving / 100 - c) <= greatest(0.6, abs(c) * 0.06), false)) AS cserv FROM txt),
how AS (SELECT *, CASE WHEN serving IS NULL OR fits THEN 'read' WHEN per_serving IS NULL AND per_100 IS NULL THEN 'missing' WHEN per_100 IS NULL THEN 'derived_100' WHEN per_serving IS NULL THEN 'derived_serving'
  WHEN len(c100) = 1 AND len(cserv) = 0 THEN 'repaired_100' WHEN len(cserv) = 1 AND len(c100) = 0 THEN 'repaired_serving' ELSE 'inconsistent' END AS provenance FROM cand)
SELECT l_orderkey, l_linenumber, CASE provenance WHEN 'derived_serving' THEN round(per_100 * serving / 100, 1) WHEN 'repaired_serving' THEN cserv[1] ELSE per_serving END AS per_serving,
  CASE provenance WHEN 'derived_100' THEN round(per_serving * 100 / serving, 1) WHEN 'repaired_100' THEN c100[1] ELSE per_100 END AS per_100, provenance FROM how"""


@query(SOLVER_SQL.replace("{pairs}", PAIRS).replace("\\\\", "\\"))
def solver_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.sql(PAIRS.replace("FROM lineitem", "FROM {t}").replace("250.0::DOUBLE", "CAST(250.0 AS DOUBLE)"), t=table(spark, sf_dir, "lineitem"))
    return pairs.select("l_orderkey", "l_linenumber", N.solved(F.col("per_serving"), F.col("per_100"), F.col("serving")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey % 3 AS profile, array_to_string(list_filter([CASE WHEN l_partkey % 3 = 0 AND sodium > 400 THEN 'hypertension' END, CASE WHEN l_partkey % 3 <> 1 AND sugar > 10 THEN 'diabetes' END,
  CASE WHEN l_partkey % 3 > 0 AND saturated_fat > 5 THEN 'hyperlipidemia' END], lambda x: x IS NOT NULL), ',') AS warnings FROM ({GAPS})""")
def personal_risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GAPS.replace("FROM lineitem", "FROM {t}"), t=table(spark, sf_dir, "lineitem"))
    profile = F.col("l_partkey") % 3
    has = {"hypertension": profile == 0, "diabetes": profile != 1, "hyperlipidemia": profile > 0}
    found = F.filter(F.array(*(F.when(has[k] & (F.col(field) > limit), F.lit(k)) for k, (field, limit) in N.WARNINGS.items())), lambda x: x.isNotNull())
    return rows.select("l_orderkey", "l_linenumber", profile.alias("profile"), F.array_join(found, ",").alias("warnings"))
