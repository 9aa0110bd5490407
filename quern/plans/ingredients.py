"""Ingredient lists of orders, flattened and matched with a dictionary made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import ingredients as N
from quern.plans.registry import query
from quern.sources.tables import table


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, english, aliases: an entry for every name and brand; some names stand two in a cell."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"), F.min("p_type").alias("type"))
    name = F.concat("p_name", F.lit(" "), "p_brand")
    k = F.col("id")
    return p.select(
        "id", F.when(k % 7 == 0, F.concat(name, F.lit("； "), "type", F.lit(" No"), k.cast("string"))).when(k % 11 == 0, F.concat(F.lit("L-"), name)).otherwise(name).alias("name"),
        F.when(k % 5 == 0, F.concat("type", F.lit(" extra "), k.cast("string"))).alias("english"), F.when(k % 3 == 0, F.array(F.concat("p_name", F.lit("'s "), "type"), F.lit(""))).alias("aliases"),
    )


def order_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, section: the parts of an order as an ingredient list with brackets, notes, recipes and unpaired brackets."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    name, k = F.concat("p_name", F.lit(" "), "p_brand"), F.col("l_partkey") % 9
    item = (
        F.when(k == 0, F.concat(F.lit("乳化劑("), name, F.lit("、"), "p_type", F.lit(")"))).when(k == 1, F.concat(name, F.lit("(無水)"))).when(k == 2, F.concat("p_type", F.lit("醬("), name, F.lit("、鹽、糖)等")))
        .when(k == 3, F.concat(F.lit("含"), name, F.lit("x"))).when(k == 4, F.concat(F.lit("DL-"), name, F.lit(")"))).when(k == 5, F.concat("p_name", F.lit("’s "), "p_type", F.lit("(大豆油、芝麻油)")))
        .when(k == 6, F.concat(name, F.lit("菌"))).when(k == 7, F.lit("香料")).otherwise(name)
    )
    rows = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", item.alias("item")).alias("x"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]), "、").alias("section"))


@query()
def matched_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of every order's list with its place in the brackets and the dictionary's entry, by equal names, then by contained ones."""
    known = part_dictionary(spark, sf_dir)
    items = N.items_of(order_sections(spark, sf_dir), "l_orderkey", "section", known.select("name"))
    return N.matched(items, known, "l_orderkey")


@query()
def ingredient_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of every list have an entry, are generic, or are unknown, and which are unknown."""
    return N.coverage(matched_ingredients(spark, sf_dir), "l_orderkey")
