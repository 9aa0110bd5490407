"""Scans of spreadsheets (Office Open XML workbooks): cells as rows, and sheets as tables."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of a workbook.
WORKBOOK, LINKS, TEXTS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
BATCH = 5_000  # rows of a sheet that a task holds at a time


def bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a part as they end; what lies before them is let go."""
    with book.open(part) as f:
        path: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if bare(e.tag) == name:
                yield e
                if path:
                    path[-1].remove(e)


def text_of(e: ElementTree.Element) -> str:
    """A text's runs as one; readings beside it (phonetic runs) are left out."""
    return "".join((x.text or "") if bare(x.tag) == "t" else text_of(x) for x in e if bare(x.tag) in ("t", "r", "is"))


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet in the workbook's order."""
    parts = {e.get("Id"): e.get("Target") for e in elements(book, LINKS, "Relationship")}
    found = []
    for e in elements(book, WORKBOOK, "sheet"):
        target = next((parts.get(v) for a, v in e.attrib.items() if bare(a) == "id" and a != "id"), None)
        if target:
            found.append((e.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
    return found


def cell_text(c: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = c.get("t"), next((x.text for x in c if bare(x.tag) == "v"), None)
    if kind == "inlineStr":
        return text_of(c)
    if v is None or kind == "e":
        return None
    return shared[int(v)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v, v) if kind == "b" else v


def rows_of(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row from 1, column letters -> text) of every row with a cell that is not empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [text_of(e) for e in elements(book, TEXTS, "si")] if TEXTS in book.namelist() else []
        for name, part in sheets_of(book):
            no = 0
            for row in elements(book, part, "row"):
                no = int(row.get("r") or no + 1)
                cells, column = {}, 0
                for c in (x for x in row if bare(x.tag) == "c"):
                    letters = re.sub(r"[^A-Z]", "", c.get("r") or "")
                    column = number_of(letters) if letters else column + 1
                    value = cell_text(c, shared)
                    if value is not None:
                        cells[letters_of(column)] = value
                if cells:
                    yield name, no, cells


def number_of(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def letters_of(column: int) -> str:
    out = ""
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def spreadsheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells (column letters -> text) of workbooks; a path may name many files, each is read by one task.

    Spark reads the files, so any file system will do.  Empty cells and errors are absent, numbers are
    as they are stored, rows without a value are left out; a file that is no workbook is an error.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, content in zip(f["path"], f["content"]):
                held: list[tuple] = []
                for sheet, no, cells in rows_of(content):
                    held.append((where, sheet, no, cells))
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, sheet string, row int, cells map<string,string>")


def spreadsheet(spark: SparkSession, path: str, sheet: str, columns: list[str], needed: str, first_row: int = 2) -> DataFrame:
    """A sheet as a table of trimmed texts: `columns` from the left, from `first_row` on, without rows whose `needed` is empty."""
    text = lambda i: F.nullif(F.regexp_replace(F.try_element_at("cells", F.lit(letters_of(i))), r"^\s+|\s+$", ""), F.lit(""))
    rows = spreadsheet_cells(spark, path).where((F.col("sheet") == sheet) & (F.col("row") >= first_row))
    return rows.select(*(text(i).alias(c) for i, c in enumerate(columns, 1))).where(F.col(needed).isNotNull())


def additives(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """An official list of additives: record_id, name_zh, name_en, category (a list of one), description, regulatory_status."""
    rows = spreadsheet(spark, path, sheet, ["idx", "name_zh", "name_en", "usage", "limits", "category"], "name_zh")
    return rows.select(
        F.concat(F.lit("TFDA-"), "idx").alias("record_id"), "name_zh", "name_en", F.when(F.col("category").isNotNull(), F.array("category")).alias("category"),
        F.col("usage").alias("description"), F.col("limits").alias("regulatory_status"),
    )
