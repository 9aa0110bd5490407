"""Table operators: upserts, latest versions, caches with a time to live, semi and anti joins, top parts of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def upsert(old: DataFrame, new: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Rows of both by key.  policy: `overwrite` takes new values, `keep` takes them only where not null; other columns stay."""
    o, n = old.alias("o"), new.alias("n")
    is_new = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if policy.get(c) == "overwrite":
            return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if policy.get(c) == "keep":
            return F.coalesce(f"n.{c}", f"o.{c}")
        return F.when(F.col(f"o.{key}").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*(value(c).alias(c) for c in old.columns))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, by aggregation: partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*").select(*df.columns)


def cache_state(df: DataFrame, key: str, written: Column, ttl: Column, now: Column) -> DataFrame:
    """HIT while now <= written + ttl, else STALE; each key's newest row counts."""
    rows = df.select("*", written.alias("written_"), ttl.alias("ttl_"))
    newest = rows.groupBy(key).agg(F.max_by(F.struct("ttl_", "written_"), "written_").alias("x"))
    return newest.select(key, F.col("x.written_").alias("written"), F.when(now <= F.col("x.written_") + F.col("x.ttl_"), "HIT").otherwise("STALE").alias("state"))


def last_rows(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each partition in the given order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= n).drop("place_")


def new_keys(names: DataFrame, known: DataFrame, key: str, id_col: str) -> DataFrame:
    """Names that are not known, numbered on from the largest id in their order.

    Numbers are given by range partitions: each partition counts its rows, and a
    small table of offsets is added, so no task sorts all names.
    """
    fresh = names.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    dealt = fresh.repartitionByRange(key).sortWithinPartitions(key).withColumn("part_", F.spark_partition_id())
    counts = dealt.groupBy("part_").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before_", before).drop("count")
    start = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("start_"))
    local = F.row_number().over(Window.partitionBy("part_").orderBy(key))
    rows = dealt.join(F.broadcast(offsets), "part_").join(F.broadcast(start), F.lit(True))  # one row a partition, and one row
    return rows.select((F.col("start_") + F.col("before_") + local).cast("long").alias(id_col), key)


def appended(base: DataFrame, extra: DataFrame, key: str, array: str, value: str) -> DataFrame:
    """Adds values to an array column where absent, with counts of added and skipped values."""
    more = extra.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("more_"))
    rows = base.join(more, key, "left")
    have, got = F.coalesce(F.col(array), F.array().cast("array<string>")), F.coalesce(F.col("more_"), F.array().cast("array<string>"))
    fresh = F.array_except(got, have)
    return rows.select(*(c for c in base.columns if c != array), F.concat(have, fresh).alias(array), F.size(fresh).alias("added"), (F.size(got) - F.size(fresh)).alias("skipped"))


def cooled_down(df: DataFrame, key: str, second: str, order: list[str], seconds: int) -> DataFrame:
    """df with `searched`: no accepted row of its key lies less than `seconds` before it.  Rows without key are left out.

    Whether a row is accepted depends on all accepted ones before it, so each key's rows
    are passed in order, with only the last accepted time held; `second` must rise with `order`.
    """

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = last = None
        for f in frames:
            s, k = f[second].to_numpy(), f[key].to_numpy()
            out = np.zeros(len(f), bool)
            edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(f)]
            for a, b in zip(edges, edges[1:]):
                if a < b and k[a] != now:
                    now, last = k[a], None
                i = a
                while i < b:
                    i += 0 if last is None else int(np.searchsorted(s[i:b], last + seconds))
                    if i < b:
                        out[i], last = True, s[i]
            yield f.assign(searched=out)

    rows = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInPandas(mark, StructType([*df.schema.fields, StructField("searched", BooleanType())]))
