"""Guarded changes of tables: updates and deletes as joins, with the changed rows as their result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transitioned(df: DataFrame, decisions: DataFrame, key: str, status: str, guard: str, to: str) -> DataFrame:
    """Rows whose status is the guard and whose key has a decision, with the old and the new status; all others stay untouched.

    `decisions` has one row a key, with the new status in `to`.
    """
    rows = df.where(F.col(status) == guard).join(decisions.select(key, to), key)
    return rows.select(key, F.col(status).alias("old_status"), F.col(to).alias("new_status"))


def column_updates(df: DataFrame, changes: DataFrame, key: str, allowed: list[str], order: str) -> DataFrame:
    """Applies (key, name, value) changes to the columns in `allowed`; of several changes of a cell the last by `order` counts, other names count for nothing."""
    last = changes.where(F.col("name").isin(allowed)).groupBy(key).agg(*(F.max_by(F.when(F.col("name") == c, F.col("value")), F.when(F.col("name") == c, F.col(order))).alias(f"new_{c}") for c in allowed))
    rows = df.join(last, key, "left")
    return rows.select(*(F.coalesce(F.col(f"new_{c}").cast(df.schema[c].dataType), F.col(c)).alias(c) if c in allowed else F.col(c) for c in df.columns))


def unreferenced(candidates: DataFrame, references: DataFrame, key: str, owner: str, going: DataFrame) -> DataFrame:
    """Candidates that no surviving row refers to: rows of an owner in `going` do not count, rows without owner do."""
    surviving = references.join(going.select(owner), owner, "left_anti")  # a null owner matches nothing, so it survives
    return candidates.join(surviving.select(key), key, "left_anti")


def filtered(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters that are left out where no value is given; a list means any of its values."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def head_inserted(array: Column, item: Column) -> Column:
    """The array with an item put in front; a null item changes nothing."""
    return F.when(item.isNull(), array).otherwise(F.concat(F.array(item), array))
