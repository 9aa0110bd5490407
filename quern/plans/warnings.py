"""Allergen warnings of labels that are made of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import warnings as W
from quern.plans.registry import query
from quern.sources.tables import table


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, no, text: every line of every document behind a piece of label text by its length and place: openings, allergens, amounts, fields."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    said = ["", "本產品含有", "過敏原資訊：本產品含牛奶、", "大豆及其製品。", "※該生產線亦生產", "花生、堅果", "沉澱為黃豆纖維。", "每一份量：", "成分", "不適合對其過敏體質者食用。", "含蛋、", "●", "含有小麥的產品，"]
    piece = F.get(F.array(*map(F.lit, said)), F.pmod(F.length("line") + F.col("no") * 5 + F.col("doc_id"), F.lit(len(said))).cast("int"))
    tail = F.when(F.length("line") % 3 == 0, "").when(F.length("line") % 7 == 0, F.concat(F.lit("保存方式："), F.left("line", F.lit(9)))).otherwise(F.left("line", F.length("line") % 12))
    text = F.when(F.length("line") % 11 == 0, F.concat((F.length("line")).cast("string"), F.lit("毫克 5公克"))).otherwise(F.concat(piece, tail))
    return d.select("doc_id", "no", text.alias("text"))


@query()
def allergen_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest warning on every label, over line ends and between amounts, and the allergens that it names."""
    return W.allergen_warnings(label_lines(spark, sf_dir), "doc_id").withColumn("allergens", F.array_join("allergens", ","))
