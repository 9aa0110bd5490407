"""Regions of a label's picture: where the nutrition table and the ingredients stand, from the boxes of its lines.

Lengths are measured by the picture itself: the unit is the median thickness of its
lines, a long line has at least LONG of the 90th percentile of lengths.  The table
begins with the lines that hold its words and grows for ROUNDS rounds by short lines
with amounts within three units; without enough words it is the largest cluster of
short lines with units.  What is left and long, or lists things, falls into clusters:
lines whose boxes are at most GAP units apart, and what is connected by such lines.

Pictures of few lines are measured and compared in batches.  For those of many, all is
windows, aggregates and joins: up to MANY lines to connect are compared pair by pair, in a
row of their own; in larger ones neighbours meet in tiles, and clusters are the connected components of
their pairs, found by taking over the smallest number and jumping along it.  So a picture
may have many lines, and only lines that a later step needs are written.  Boxes of fewer
than two points, and lines without one, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import connected, written
from quern.operators.pictures import Boxes, boxes_in_rows, by_picture, changes, pairs_within, per_picture

# Words of a nutrition table, words above ingredients, units that stand in cells.
TABLE_WORDS = ["熱量", "蛋白質", "飽和脂肪", "反式脂肪", "碳水化合物", "每一份量", "本包裝含", "營養標示"]
INGREDIENT_WORDS = ["成分", "成份", "原料", "內容物", "配料"]
CELL_UNITS = ["大卡", "公克", "毫克", "公毫", "毫升", "克", "卡"]
SODIUM, MILLIGRAMS = r"^\s*[鈉钠纳]\s*(?:[:：]|$|\d|[（(])", r"(?i)\d(?:[.,]\d+)?\s*(?:毫克|公絲|mg)"
LEAST_WORDS, LEAST_CELLS, LEAST_MARKS, ROUNDS, LONG, GAP = 3, 6, 2, 2, 0.45, 1.5
MANY = 128  # lines of a picture that are compared pair by pair
CORNERS = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}


def measured_lines(lines: DataFrame, key: str) -> DataFrame:
    """key, no, t, x0, y0, x1, y1, long, unit, least_long, first (on one line a picture).  lines: key, no, text, box (points)."""
    xs, ys = F.transform("box", lambda p: F.get(p, F.lit(0))), F.transform("box", lambda p: F.get(p, F.lit(1)))
    rows = lines.where(F.size("box") >= 2).select(key, "no", F.coalesce("text", F.lit("")).alias("t"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = rows.withColumns({"thick": F.least(w, h), "long": F.greatest(w, h)})
    by_length, whole = Window.partitionBy(key).orderBy("long"), Window.partitionBy(key)
    ninth = F.floor((F.count("*").over(whole) - 1) * 0.9)
    rows = rows.withColumns({"place_": F.row_number().over(by_length) - 1, "ninth_": ninth})
    scales = {"unit_": F.median("thick").over(whole), "p90_": F.max(F.when(F.col("place_") == F.col("ninth_"), F.col("long"))).over(whole)}
    unit = F.when(F.col("unit_") == 0, 1.0).otherwise(F.col("unit_")).alias("unit")
    return rows.withColumns(scales).select(key, "no", "t", *CORNERS, "long", unit, (F.col("p90_") * LONG).alias("least_long"), (F.col("place_") == 0).alias("first"))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def least_numbers(sizes: np.ndarray, no: np.ndarray, corners: list[np.ndarray], reach: np.ndarray, many: int = 4_000_000) -> np.ndarray:
    """The smallest number that each line is connected with.  sizes, reach: of each picture; no, corners: of the lines, picture after picture.  Pictures of as many lines go together."""
    out, begins = no.copy(), np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 1]):
        same = np.flatnonzero(sizes == n)
        for at in np.array_split(same, min(len(same), -(-len(same) * n * n // many))):
            places = begins[at][:, None] + np.arange(n)
            least, a0, b0, a1, b1 = (c[places] for c in (no, *corners))
            apart = lambda low, high: np.maximum(low[:, None, :] - high[:, :, None], low[:, :, None] - high[:, None, :])
            near = np.maximum(apart(a0, a1), apart(b0, b1)) <= reach[at][:, None, None]
            near |= np.eye(n, dtype=bool)
            while True:
                lower = np.where(near, least[:, None, :], np.iinfo(np.int64).max).min(axis=2)
                if (lower == least).all():
                    break
                least = lower
            out[places] = least
    return out


def components():
    """A pandas function: no, x0, y0, x1, y1 (a place a line) and the reach -> the smallest number that each line is connected with."""

    @F.pandas_udf("array<long>")
    def found(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for *lines, reach in batches:
            sizes = lines[0].map(len).to_numpy()
            no, *corners = (np.concatenate(c.to_numpy()) if len(c) else np.empty(0) for c in lines)
            yield pd.Series(np.split(least_numbers(sizes, no.astype(np.int64), corners, reach.to_numpy()), np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return found


def tiled_clusters(boxes: DataFrame, key: str) -> DataFrame:
    """key, no, cluster, for pictures of any size."""
    reach = F.col("unit") * GAP
    size = F.greatest(reach * 4, F.lit(1.0))
    span = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - reach) / size).cast("long"), F.floor((F.col(high) + reach) / size).cast("long")))
    dealt = boxes.select(key, "no", *CORNERS, "unit", span("x0", "x1").alias("tx")).select("*", span("y0", "y1").alias("ty"))
    apart = lambda low, high: F.greatest(F.col(f"b.{low}") - F.col(f"a.{high}"), F.col(f"a.{low}") - F.col(f"b.{high}"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "tx", "ty")]
    near = dealt.alias("a").join(dealt.alias("b"), [*same, F.col("a.no") != F.col("b.no"), F.greatest(apart("x0", "x1"), apart("y0", "y1")) <= F.col("a.unit") * GAP])
    pairs = written(near.select(F.col(f"a.{key}").alias(key), F.col("a.no").alias("no"), F.col("b.no").alias("other")).distinct())
    return connected(boxes.select(key, "no"), pairs, key)


def clusters(boxes: DataFrame, key: str) -> DataFrame:
    """Adds cluster: the smallest number of the connected lines.  boxes, a written table: key, no, x0, y0, x1, y1, unit and others; lines at most GAP units apart are connected."""
    boxes = boxes.where("no is not null")
    large = written(boxes.groupBy(key).agg(F.count("*").alias("n_")).where(F.col("n_") > MANY).select(key))
    some = not large.isEmpty()
    small = (boxes.join(large, key, "left_anti") if some else boxes).select(key, F.struct(*(c for c in boxes.columns if c != key)).alias("x"))
    rows = small.groupBy(key).agg(F.collect_list("x").alias("x"))
    of = lambda c: F.transform("x", lambda x: x[c])
    rows = rows.withColumn("cluster", components()(*(of(c) for c in ("no", *CORNERS)), F.get("x", F.lit(0))["unit"] * GAP))
    rows = rows.select(key, F.explode(F.arrays_zip("x", "cluster")).alias("z")).select(key, "z.x.*", "z.cluster")
    if not some:
        return rows
    rest = written(boxes.join(large, key))
    return rows.unionByName(rest.join(tiled_clusters(rest, key), [key, "no"]))


def box_of(condition: Column, over: Window) -> Column:
    """The box around a picture's lines that meet the condition."""
    return F.struct(*(f(F.when(condition, F.col(c))).over(over).alias(c) for c, f in CORNERS.items()))


def around(a: Column, b: Column) -> Column:
    """The box around two boxes; corners that one lacks are the other's."""
    return F.struct(*((F.least if f is F.min else F.greatest)(a[c], b[c]).alias(c) for c, f in CORNERS.items()))


def grown(rows: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """Grows `table`, the box around the lines of `mine` and others to begin with, and sets `mine` for the lines taken in."""
    whole = Window.partitionBy(key)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    for _ in range(rounds):
        room = F.col("unit") * 3
        inside = cx.between(F.col("table.x0") - room, F.col("table.x1") + room) & cy.between(F.col("table.y0") - room, F.col("table.y1") + room)
        rows = rows.withColumn("mine", F.col("mine") | F.coalesce(F.col("cell") & inside, F.lit(False)))
        rows = rows.withColumn("table", around(F.col("table"), box_of(F.col("mine"), whole)))
    return rows


def sodium(rows: DataFrame, key: str) -> DataFrame:
    """The lines of the sodium's row below the table: its name (of those with amounts the first) and, beside it, amounts in milligrams.  rows: key, no, the box, unit, label, value."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    near = rows.where("label or value").select(key, "label", "value", "unit", cx.alias("cx"), cy.alias("cy"), F.struct("no", *CORNERS).alias("line"))
    label, value = near.where("label").alias("a"), near.where("value").alias("b")
    beside = [F.col(f"a.{key}") == F.col(f"b.{key}"), F.col("b.cx") >= F.col("a.cx"), F.abs(F.col("b.cy") - F.col("a.cy")) <= F.col("a.unit")]
    pairs = label.join(value, beside).select(F.col(f"a.{key}").alias(key), F.col("a.line").alias("label"), F.col("b.line").alias("value"))
    lines = pairs.withColumn("least", F.min("label.no").over(Window.partitionBy(key))).where("label.no = least")
    return lines.select(key, F.explode(F.array("value", "label")).alias("x")).select(key, "x.*").distinct()


def joined_regions(lines: DataFrame, key: str) -> DataFrame:
    """The same as `regions` by windows and joins, for pictures of any number of lines."""
    whole = Window.partitionBy(key)
    corners = [f(c).alias(c) for c, f in CORNERS.items()]
    rows = measured_lines(lines, key).withColumn("bare", squeezed(F.col("t")))
    rows = rows.withColumn("words", sum((F.contains("bare", F.lit(w)).cast("int") * (1 << i) for i, w in enumerate(TABLE_WORDS)), F.lit(0))).drop("bare")
    short, listing = F.col("long") < F.col("least_long"), F.regexp_count("t", F.lit("[、，,；;]")) >= LEAST_MARKS
    rows = rows.withColumn("known", F.bit_count(F.bit_or("words").over(whole)) >= LEAST_WORDS)
    rows = rows.withColumns({"cell": short & F.col("t").rlike(r"\d|克|大卡|公毫"), "wide": (F.col("long") >= F.col("least_long")) | listing})
    cells = rows.where(~F.col("known") & short & F.col("t").rlike("|".join(CELL_UNITS))).withColumn("n", F.count("*").over(whole)).where(F.col("n") >= LEAST_CELLS)
    found = clusters(written(cells.select(key, "no", *CORNERS, "unit", "wide")), key)
    sizes = found.groupBy(key, "cluster").agg(F.count("*").alias("n"), *corners, F.collect_list(F.when(F.col("wide"), F.col("no"))).alias("listed")).where(F.col("n") >= LEAST_CELLS)
    dense = written(sizes.groupBy(key).agg(F.max_by(F.struct(F.struct(*CORNERS).alias("box"), "listed"), F.struct("n", -F.col("cluster"))).alias("dense")).select(key, "dense.*"))
    rows = rows.join(dense.select(key, F.col("box").alias("dense")), key, "left").withColumn("mine", F.col("known") & (F.col("words") > 0))
    rows = rows.withColumn("how", F.when(F.col("known"), "words").when(F.col("dense").isNotNull(), "cells"))
    rows = grown(rows.withColumn("table", around(box_of(F.col("mine"), whole), F.col("dense"))), key)
    cx, cy, u = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("unit")
    under = cx.between(F.col("table.x0") - u, F.col("table.x1") + u) & (cy > F.col("table.y1")) & (cy <= F.col("table.y1") + u * 2) & (F.col("y1") - F.col("y0") <= u * 2)
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.select(
        key, "no", "t", *CORNERS, "unit", "first", (F.col("how") == "cells").alias("loose"), sure(~F.col("mine") & F.col("wide")).alias("rest"), sure(under & F.col("t").rlike(SODIUM)).alias("label"), sure(under & F.col("t").rlike(MILLIGRAMS)).alias("value"),
        F.when(F.col("first"), F.col("table")).alias("table"), F.when(F.col("first"), F.col("how")).alias("how"),
    )
    rows = written(rows.where("first or rest or label or value").withColumn("t", F.when(F.col("rest"), F.col("t"))))
    salt = written(sodium(rows, key))
    taken = salt.select(key, "no").unionByName(dense.select(key, F.explode("listed").alias("no"))).distinct()
    rest = rows.where("rest").select(key, "no", "t", *CORNERS, "unit", F.coalesce(F.col("label") | F.col("value") | F.col("loose"), F.lit(False)).alias("open"))
    rest = rest.where("not open").unionByName(rest.where("open").join(taken, [key, "no"], "left_anti")).drop("open")  # others cannot be taken
    blocks = clusters(rest, key).groupBy(key, "cluster").agg(*corners, F.count("*").alias("n"), squeezed(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]), "")).alias("text"))
    anchor = F.lit(False)
    for word in INGREDIENT_WORDS:
        anchor |= F.contains("text", F.lit(word))
    blocks = blocks.select("*", anchor.alias("anchor"), F.length("text").alias("letters"))
    blocks = blocks.withColumns({"anchored": F.max("anchor").over(whole), "rank": F.row_number().over(whole.orderBy(F.desc("letters"), "cluster"))})
    chosen = blocks.where(F.when(F.col("anchored"), F.col("anchor") | (F.col("n") >= 2)).otherwise(F.col("rank") == 1))
    below = chosen.groupBy(key).agg(*corners, F.max("anchored").alias("anchored")).select(key, F.struct(*CORNERS).alias("ingredients"), "anchored")
    low = salt.groupBy(key).agg(*corners).select(key, F.struct(*CORNERS).alias("low"))
    tables = rows.where("first").select(key, "table", "how").join(low, key, "left").select(key, "how", around(F.col("table"), F.col("low")).alias("t"))
    return tables.select(key, F.when(F.col("t.x0").isNotNull(), F.col("t")).alias("nutrition"), "how").join(below, key, "left").select(key, "nutrition", "ingredients", "how", "anchored")


class Texts:
    """What the rules ask of texts: words (a bit each), cell, unit, listing, label, value, and the letters alone; a text's answers are kept, in bounded number."""

    def __init__(self, most: int = 1 << 16):
        self.known, self.most = {}, most
        self.cell, self.unit, self.salt, self.mg = (re.compile(p, re.A) for p in (r"\d|克|大卡|公毫", "|".join(CELL_UNITS), SODIUM, MILLIGRAMS))

    def one(self, t: str) -> tuple:
        letters = re.sub(r"[\W_]+", "", t)
        found = (self.cell.search(t), self.unit.search(t), len(re.findall("[、，,；;]", t)) >= LEAST_MARKS, self.salt.search(t), self.mg.search(t))
        return (sum((w in letters) << i for i, w in enumerate(TABLE_WORDS)), *map(bool, found)), letters

    def of(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        if len(self.known) > self.most:
            self.known.clear()
        rows = []
        for t in texts:
            if (row := self.known.get(t)) is None:
                row = self.one(t)
                if len(t) <= 200:
                    self.known[t] = row
            rows.append(row)
        return np.array([r[0] for r in rows], np.int64).reshape(-1, 6), [r[1] for r in rows]


def found_regions(texts: Texts, boxes: Boxes, pictures: int) -> dict:
    """`regions` for a batch of pictures; those without lines are left out."""
    pic, no = boxes.picture, boxes.no
    every = lambda f, v, start: per_picture(pic, pictures, v, f, start)
    x0, x1, y0, y1 = (f.reduceat(v, boxes.begins) if len(pic) else np.empty(0) for v in (boxes.x, boxes.y) for f in (np.minimum, np.maximum))
    corners, signs = [x0, y0, x1, y1], [(np.minimum, np.inf), (np.minimum, np.inf), (np.maximum, -np.inf), (np.maximum, -np.inf)]
    around = lambda which: [every(f, np.where(which, c, start), start) for c, (f, start) in zip(corners, signs)]
    both = lambda a, b: [f(v, w) for v, w, (f, _) in zip(a, b, signs)]
    flags, letters = texts.of(boxes.texts)
    words, cellish, united, listing, salty, mg = flags[boxes.at].T
    words, cellish, united, listing, salty, mg = words, *(v.astype(bool) for v in (cellish, united, listing, salty, mg))

    n = np.bincount(pic, minlength=pictures)
    begins, there = np.cumsum(n) - n, n > 0
    thick, long = np.minimum(x1 - x0, y1 - y0), np.maximum(x1 - x0, y1 - y0)
    by_thick, by_long = thick[np.lexsort((thick, pic))], long[np.lexsort((long, pic))]
    of = lambda values, place: np.where(there, values[np.where(there, begins + place, 0)], 0.0) if len(values) else np.zeros(pictures)
    unit = 0.5 * of(by_thick, np.maximum(n - 1, 0) // 2) + 0.5 * of(by_thick, n // 2)
    unit = np.where(unit == 0, 1.0, unit)
    u = unit[pic]
    short = long < (of(by_long, np.floor(np.maximum(n - 1, 0) * 0.9).astype(np.int64)) * LONG)[pic]
    wide, cell = ~short | listing, short & cellish
    known = np.bitwise_count(every(np.bitwise_or, words, 0)) >= LEAST_WORDS

    def linked(which: np.ndarray) -> np.ndarray:
        """Which cluster the lines are in."""
        return least_numbers(np.bincount(pic[which], minlength=pictures), no[which], [c[which] for c in corners], unit * GAP)

    def blocks_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lines by cluster and number, which cluster each belongs to, and where clusters begin."""
        cluster = linked(which)
        order = np.lexsort((no[which], cluster, pic[which]))
        new = changes(pic[which][order]) | changes(cluster[order])
        return which[order], np.cumsum(new) - 1, np.flatnonzero(new)

    cells = np.flatnonzero(~known[pic] & short & united)
    cells = cells[np.bincount(pic[cells], minlength=pictures)[pic[cells]] >= LEAST_CELLS]
    line, block, first = blocks_of(cells)
    size, where = np.bincount(block, minlength=len(first)), pic[line[first]]
    best = np.lexsort((np.arange(len(first)), -size, where))
    best = best[changes(where[best])]
    dense = np.zeros(len(pic), bool)
    dense[line[np.isin(block, best[size[best] >= LEAST_CELLS])]] = True

    mine, loose = known[pic] & (words > 0), every(np.logical_or, dense, False)
    table = both(around(mine), around(dense))
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    for _ in range(ROUNDS):
        t, room = [c[pic] for c in table], u * 3
        mine |= cell & (cx >= t[0] - room) & (cx <= t[2] + room) & (cy >= t[1] - room) & (cy <= t[3] + room)
        table = both(table, around(mine))
    t = [c[pic] for c in table]
    under = (cx >= t[0] - u) & (cx <= t[2] + u) & (cy > t[3]) & (cy <= t[3] + u * 2) & (y1 - y0 <= u * 2)
    name, value = np.flatnonzero(under & salty), np.flatnonzero(under & mg)
    a, b = pairs_within(pic[name], pic[value])
    a, b = name[a], value[b]
    beside = (cx[b] >= cx[a]) & (np.abs(cy[b] - cy[a]) <= u[a])
    a, b = a[beside], b[beside]
    chosen = np.isin(a, a[changes(pic[a])])  # lines come by number
    salt = np.zeros(len(pic), bool)
    salt[a[chosen]] = salt[b[chosen]] = True

    rest = np.flatnonzero(~mine & wide & ~salt & ~dense)
    line, block, first = blocks_of(rest)
    where, size = pic[line[first]], np.bincount(block, minlength=len(first))
    at, ends = boxes.at[line], np.append(first[1:], len(line))
    text = [letters[at[i]] if j == i + 1 else "".join(letters[k] for k in at[i:j]) for i, j in zip(first.tolist(), ends.tolist())]
    anchor = np.array([any(w in t for w in INGREDIENT_WORDS) for t in text], bool)
    order = np.lexsort((np.arange(len(first)), -np.array([len(t) for t in text], np.int64), where))
    longest = np.zeros(len(first), bool)
    longest[order[changes(where[order])]] = True
    anchored = per_picture(where, pictures, anchor, np.logical_or, False)
    taken = np.zeros(len(pic), bool)
    taken[line[np.where(anchored[where], anchor | (size >= 2), longest)[block]]] = True

    def boxed(box: list[np.ndarray]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c[there]) for c in box], names=list(CORNERS), mask=pa.array(~np.isfinite(box[0][there])))

    some = np.bincount(where, minlength=pictures)[there] > 0
    return {
        "picture": np.flatnonzero(there), "nutrition": boxed(both(table, around(salt))), "ingredients": boxed(around(taken)),
        "how": pa.array(np.where(known, "words", "cells")[there], pa.string(), mask=~(known | loose)[there]), "anchored": pa.array(anchored[there], mask=~some),
    }


def picture_regions(rows: DataFrame, key: str) -> DataFrame:
    """`regions` of pictures whose boxes come in arrays.  rows: key, boxes (array<struct<no, text, box>>)."""
    box, texts = "struct<x0:double,y0:double,x1:double,y1:double>", Texts()
    return by_picture(rows, key, lambda boxes, n: found_regions(texts, boxes, n), f"nutrition {box}, ingredients {box}, how string, anchored boolean", 2, lambda lines: joined_regions(lines, key))


def regions(lines: DataFrame, key: str) -> DataFrame:
    """key, nutrition, ingredients (boxes, null where none was found), how (words or cells, null without a table), anchored.  lines: key, no, text, box (points)."""
    return picture_regions(boxes_in_rows(lines, key), key)
