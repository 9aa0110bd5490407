"""Pictures as batches of boxes: those of many pictures in flat arrays, for work that compares a picture's boxes with each other.

Spark deals and orders rows by picture; a row holds some of its boxes.  Batches are cut
between pictures, so that a task holds few of them at once.  Pictures of more than MOST
boxes, and those with boxes that are not plain (points without two finite coordinates, no
number, one number twice), are only named: they take the way by joins, which need no
picture in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import written

MOST, POINTS = 256, 64  # boxes of a picture and points of a box that are read in a batch


@dataclass
class Boxes:
    """Boxes by picture and number.  at: places in `texts`, each text once; x, y: their points one after another; begins: where a box's points begin."""

    picture: np.ndarray
    no: np.ndarray
    at: np.ndarray
    texts: list[str]
    x: np.ndarray
    y: np.ndarray
    begins: np.ndarray

    def __len__(self) -> int:
        return len(self.no)


def numbers_of(a: pa.Array, kind: type) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(kind)


def lengths(a: pa.Array) -> np.ndarray:
    return numbers_of(pc.fill_null(pc.list_value_length(a), 0), np.int64)


def changes(values: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def first_rows(table: pa.Table) -> np.ndarray:
    return changes(numbers_of(table["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices, np.int64))


def cut(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables with no picture in two of them; one row is left of a picture with too many boxes."""
    rest = None
    for part in parts:
        table = pa.Table.from_batches([part])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        if table.num_rows:
            table = table.filter(pa.array(first_rows(table) | (numbers_of(table["n"].combine_chunks(), np.int64) <= most)))
            last = int(np.flatnonzero(first_rows(table))[-1])
            if last:
                yield table.slice(0, last)
            rest = table.slice(last)
    if rest is not None:
        yield rest


def boxes_of(table: pa.Table, least: int, most: int) -> tuple[pa.Array, np.ndarray, Boxes]:
    """The pictures' keys, which of them are left to joins, and the others' boxes with `least` points or more."""
    first = first_rows(table)
    keys, row, lists = table["key"].combine_chunks().filter(pa.array(first)), np.cumsum(first) - 1, table["boxes"].combine_chunks()
    left = np.zeros(len(keys), bool)
    left[row[numbers_of(table["n"].combine_chunks(), np.int64) > most]] = True
    flat, picture = lists.flatten(), np.repeat(row, lengths(lists))
    there = numbers_of(flat.is_valid(), bool) & ~left[picture]
    flat, picture = flat.filter(pa.array(there)), picture[there]
    size = lengths(pc.struct_field(flat, "box"))
    flat, picture, size = flat.filter(pa.array(size >= least)), picture[size >= least], size[size >= least]
    number, points = pc.struct_field(flat, "no"), pc.struct_field(flat, "box").flatten()
    left[picture[numbers_of(number.is_null(), bool) | (size > POINTS)]] = True
    wide = lengths(points)
    of = np.repeat(picture, size)
    left[of[wide < 2]] = True
    values, at = numbers_of(points.flatten(), float), np.cumsum(wide) - wide
    x, y = (values[np.minimum(at + i, max(len(values) - 1, 0))] if len(values) else np.full(len(at), np.nan) for i in (0, 1))
    left[of[~(np.isfinite(x) & np.isfinite(y))]] = True
    no = numbers_of(pc.fill_null(number, 0), np.int64)
    order = np.lexsort((no, picture))
    twice = ~changes(no[order]) & ~changes(picture[order])
    left[picture[order[twice]]] = True
    order = order[~left[picture[order]]]
    texts = pc.fill_null(pc.struct_field(flat, "text"), "").take(pa.array(order)).dictionary_encode()
    begins = np.cumsum(size) - size
    size = size[order]
    ends = np.cumsum(size)
    place = np.repeat(begins[order] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return keys, left, Boxes(picture[order], no[order], numbers_of(texts.indices, np.int64), texts.dictionary.to_pylist(), x[place], y[place], ends - size)


def with_sizes(rows: DataFrame, key: str) -> DataFrame:
    """key, boxes, n (of the picture).  The window has Spark deal and order the rows by picture; those that come so are not dealt again."""
    return rows.select(F.col(key).alias("key"), "boxes", F.sum(F.size("boxes")).over(Window.partitionBy(key)).alias("n"))


def by_picture(rows: DataFrame, key: str, found: Callable[[Boxes, int], dict], columns: str, least: int, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `found` gives for the boxes of many pictures (their number follows): `picture` and the columns; `joined` does the same for rows of a box each.  rows: key, boxes (array<struct<no, text, box>>, null for none)."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, left boolean, {columns}"
    names, most = [c.split()[0] for c in columns.split(", ")], MOST

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cut(parts, most):
            keys, left, boxes = boxes_of(table, least, most)
            got = found(boxes, len(keys))
            own, n = got["picture"], int(left.sum())
            which = pa.array(np.concatenate([own, np.flatnonzero(left)]))
            cells = [pa.concat_arrays([a, pa.nulls(n, a.type)]) for a in (got[c] for c in names)]
            yield pa.RecordBatch.from_arrays([keys.take(which), pa.array(np.arange(len(own) + n) >= len(own)), *cells], names=[key, "left", *names])

    out = written(with_sizes(rows, key).mapInArrow(read, schema))
    rest, done = out.where("left").select(key), out.where("not left").drop("left")
    if rest.isEmpty():
        return done
    boxes = rows.join(rest, key, "left_semi").select(key, F.inline_outer(F.filter("boxes", lambda b: b.isNotNull())))
    return done.unionByName(joined(boxes))


def boxes_in_rows(boxes: DataFrame, key: str) -> DataFrame:
    """key, boxes: a row a box."""
    return boxes.select(key, F.array(F.struct(F.col("no").cast("long").alias("no"), F.col("text").alias("text"), F.col("box").cast("array<array<double>>").alias("box"))).alias("boxes"))


def per_picture(picture: np.ndarray, n: int, values: np.ndarray, f: np.ufunc, start: float) -> np.ndarray:
    """f over each picture's values; start for those without."""
    out = np.full(n, start, np.result_type(values, type(start)))
    begins = np.flatnonzero(changes(picture))
    if len(begins):
        out[picture[begins]] = f.reduceat(values, begins)
    return out


def pairs_within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of all pairs of one picture.  a, b: pictures in order."""
    low, high = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    n = high - low
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(a)), n), np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
