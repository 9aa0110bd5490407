"""Queries that run as streams over all events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.times import epoch_seconds
from quern.plans.registry import query
from quern.streaming import states as S


@query()
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user that come seven days after the last accepted one."""
    e = S.stream(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("s", epoch_seconds(F.col("ts")))
    return S.finished(S.cooldowns(e, "user_id", "s"))


@query("SELECT user_id, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts by key; of each key the newest state is the result."""
    e = S.stream(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    where = S.folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/rows/at={number}")  # a repeated batch overwrites itself

    q = e.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{where}/rows")
    return rows.groupBy("user_id", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("most", "batch").alias("most"))


@query()
def stream_early_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pieces of a text stream, the later ones of some with a part said again and again."""
    c = S.stream(spark, sf_dir, "conversations")
    again = F.repeat(F.substring("text", 1, F.pmod(F.col("turn") + F.length("text"), F.lit(20)).cast("int")), F.lit(60))
    return S.finished(S.early_stops(c.withColumn("piece", F.when(F.col("turn") >= 2, F.concat("text", again)).otherwise(F.col("text"))), "conv_id", "turn", "piece"))
