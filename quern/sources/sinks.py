"""Sinks: CSV with columns from the data, JSON by case, parquet tables that are replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.tables import latest


def segments_csv(df: DataFrame, path: str, keys: list[str], segments: str, names: list[str] | None = None) -> list[str]:
    """Writes keys and one column for each key of a map column, in name order; absent values are empty, not 0.

    Without `names`, the distinct map keys are looked up first; they are names of measured segments, so few.
    """
    if names is None:
        names = sorted(r[0] for r in df.select(F.explode(F.map_keys(segments))).distinct().collect())
    df.select(*keys, *(F.col(segments)[n].alias(n) for n in names)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", quoteAll=False, escape='"')
    return names


def case_json(df: DataFrame, path: str, case: str, manifest: DataFrame | None = None) -> None:
    """Writes one folder a case; cases of the manifest without rows stop the write."""
    if manifest is not None:
        missing = manifest.select(case).join(df.select(case), case, "left_anti").limit(5).collect()
        if missing:
            raise ValueError(f"no rows for {[r[0] for r in missing]}")
    df.write.mode("overwrite").partitionBy(case).json(path)


def replaced(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both tables, the newest version of each key."""
    return latest(old.unionByName(new), [key], [version])
