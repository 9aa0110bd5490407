"""JSON scans and sinks, null tokens, hourly counts and value equality on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import nutrition
from quern.sources.sinks import case_json
from quern.sources.tables import cleaned, json_records
from quern.streaming import states


def test_json_records(spark, tmp_path):
    rows = [{"name": "a", "n": 1}, {"name": "None", "n": None}, {"name": " b "}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "records.json").write_text(json.dumps({"records": rows}))
    a = json_records(spark, str(tmp_path / "list.json"), "name:string, n:int", rename={"name": "label"})
    b = json_records(spark, str(tmp_path / "records.json"), "name:string, n:int", records="records")
    assert sorted(a.columns) == ["label", "n"]
    got = sorted(b.select(cleaned("name").alias("x"), "n").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1), (None, None), ("b", None)], key=str)
    assert a.count() == 3


def test_case_json(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "c string, n int")
    case_json(df, str(tmp_path / "out"), "c", df.select("c"))
    back = spark.read.schema("n int, c string").json(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("c", "n").collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="no rows"):
        case_json(df, str(tmp_path / "other"), "c", spark.createDataFrame([("z",)], "c string"))


def test_hourly(spark):
    df = spark.createDataFrame([("u", "2024-01-01 01:10:00", 1.0), ("u", "2024-01-01 01:50:00", 2.0), ("v", "2024-01-01 02:00:00", 4.0)], "k string, t string, value double")
    rows = states.hourly(df.withColumn("t", F.to_timestamp("t")), "t", "k").collect()
    assert sorted((r.k, r.hour.hour, r.n, r.total) for r in rows) == [("u", 1, 2, 3.0), ("v", 2, 1, 4.0)]


def test_close(spark):
    df = spark.createDataFrame([(1.0, 1.04), (1.0, 1.06), (100.0, 101.0), (100.0, 102.0)], "a double, b double")
    assert [r[0] for r in df.select(nutrition.close(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
