"""Shapes of items and blocks, by hand."""

from pyspark.sql import functions as F

from quern.functions import shapes as H


def test_items(spark):
    cases = {"砂糖": (True, True), "Ｂ１2": (False, False), "抗氧化劑(L-抗壞血酸鈉)": (True, False), "小麥粉 水": (True, False), "一二三四五六七八九": (True, False), "台南市": (False, False), "糖1234": (False, False), "(x)": (True, True), "": (False, False), None: (False, False), "甲" * 60: (True, False), "甲" * 61: (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: (r.a, r.b) for r in df.select("x", H.looks_like_item(F.col("x")).alias("a"), H.strict_item(F.col("x")).alias("b")).collect()}
    assert got == cases


def test_plausible(spark):
    df = spark.createDataFrame([(0, []), (1, ["砂糖", "食鹽", "x", "  ", None]), (2, ["甲" * 41, "糖", "糖ab"]), (3, None)], "k int, i array<string>")
    assert [r[0] for r in df.orderBy("k").select(H.plausible(F.col("i"))).collect()] == [None, 1, -2, None]


def test_junk(spark):
    rows = [("熱量1大卡2公克33", False, True), ("熱量1大卡2公克33", True, False), ("熱量大卡公克甲乙丙丁1", False, False), ("某有限公司地址", None, True), ("台南市甲乙區x", False, False), ("鄉9號", False, True), ("鄉9號x", False, False), (None, False, False), ("", None, False)]
    df = spark.createDataFrame(rows, "t string, known boolean, junk boolean")
    assert df.where(H.junk(F.col("t"), F.col("known")) != F.col("junk")).count() == 0
