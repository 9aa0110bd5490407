"""Connected components of pairs, by joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.streaming.states import folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key, no, cluster: the smallest number (long) that pairs lead to within a key.  nodes: key, no; pairs: key, no, other, in both directions.

    Each round takes over the smallest number of the neighbours and jumps along it, so
    rounds grow with the logarithm of the longest way.  Rows with nulls connect nothing.
    """
    now, before = written(nodes.select(key, "no", F.col("no").alias("cluster"))), None
    while True:
        least = pairs.join(now.select(key, F.col("no").alias("other"), "cluster"), [key, "other"]).groupBy(key, "no").agg(F.min("cluster").alias("m"))
        lower = now.join(least, [key, "no"], "left").select(key, "no", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        onward = lower.select(key, F.col("no").alias("cluster"), F.col("cluster").alias("further"))
        then = written(lower.join(onward, [key, "cluster"]).select(key, "no", F.col("further").alias("cluster")))
        after = then.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
        if after == before:
            return then
        now, before = then, after
