"""Scans: tables as parquet, JSON-array files, SQL dumps of INSERT statements, recognised-text records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_TOKENS = ["none", "null", "nan", ""]

OCR_RECORD = (
    "case_id string, preset string, set_version string, category string, images array<struct<path:string, error:string, elapsed_s:double, n_lines:int, "
    "lines:array<struct<text:string, score:double, box:array<array<double>>>>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """The rows dealt over all cores.  A small file is one split, and so one task, however long the work on its rows takes."""
    return df.repartition(tasks_per_core * df.sparkSession.sparkContext.defaultParallelism)


def spread_by(df: DataFrame, key: str, tasks_per_core: int = 2) -> DataFrame:
    """The rows dealt by a key over all cores, so that what groups, orders or joins by it does not deal them again.  Small rows with much work on them would else end in few tasks."""
    return df.repartition(tasks_per_core * df.sparkSession.sparkContext.defaultParallelism, key)


def json_records(spark: SparkSession, path: str, schema: str, records: str | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """A JSON file that holds an array of objects, or an object with one under `records`."""
    if records:
        rows = spark.read.schema(f"`{records}` array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(records).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(", ".join(f.replace(":", " ", 1) for f in schema.split(", "))).json(path, multiLine=True)
    for old, new in (rename or {}).items():
        rows = rows.withColumnRenamed(old, new)
    return rows


def cleaned(column: str):
    """Blank and null-like texts as null."""
    c = F.trim(F.col(column))
    return F.when(~F.lower(c).isin(NULL_TOKENS), c)


def insert_dump(spark: SparkSession, path: str, table_name: str, columns: list[str], expected: int | None = None) -> DataFrame:
    """Rows of `INSERT INTO t (...) VALUES (...);` lines of a dump; lines that begin with a backslash are left out.

    Values are texts (null for NULL).  With `expected`, a different number of rows fails the query.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("\\") & F.col("value").startswith(f"INSERT INTO {table_name} "))
    body = F.regexp_extract("value", r"VALUES\s*\((.*)\);?\s*$", 1)
    fields = F.regexp_extract_all(body, F.lit(r"('(?:[^']|'')*'|[^,'\s][^,']*)"), F.lit(1))
    value = lambda i: F.regexp_replace(F.regexp_replace(F.trim(F.get(fields, F.lit(i))), "^'|'$", ""), "''", "'")
    rows = lines.select(*(F.when(F.trim(F.get(fields, F.lit(i))) != "NULL", value(i)).alias(c) for i, c in enumerate(columns)))
    if expected is not None:
        total = rows.agg(F.assert_true(F.count("*") == expected, F.lit(f"the dump should have {expected} rows")).alias("ok"))
        rows = rows.join(F.broadcast(total), F.col("ok").isNull()).drop("ok")  # one row
    return rows


def ocr_lines(spark: SparkSession, path: str) -> DataFrame:
    """Recognised-text records, one row a line: case_id, image, line, text, score, x0, y0, x1, y1."""
    records = spark.read.schema(OCR_RECORD).json(path, multiLine=True)
    images = records.select("case_id", F.posexplode("images").alias("image", "i"))
    lines = images.select("case_id", "image", F.posexplode("i.lines").alias("line", "l"))
    axis = lambda k: F.transform("l.box", lambda p: p[k])
    return lines.select(
        "case_id", "image", "line", F.col("l.text").alias("text"), F.col("l.score").alias("score"),
        F.array_min(axis(0)).alias("x0"), F.array_min(axis(1)).alias("y0"), F.array_max(axis(0)).alias("x1"), F.array_max(axis(1)).alias("y1"),
    )
