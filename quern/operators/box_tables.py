"""Nutrition tables from recognised boxes: which number boxes belong to which field name, by place.

A record's boxes are cut to the surroundings of the table's heading, the field names are
found in them, and numbers are assigned in three ways:

- a box that holds a name and its numbers is its own answer;
- by rank: numbers fall into columns by gaps on the table's main axis; where a column has as
  many members as there are names, the n-th number belongs to the n-th name, however the
  picture is tilted.  A number whose unit does not fit its field refutes the whole ranking;
- by band: otherwise the numbers beside a name within its own height (below it within its
  own width where the name is printed upright).

The main axis follows the names' orientation: upright where most are much higher than wide.
Ranges are joined by tiles, so that a record may have many boxes.  `picture_tables` reads
pictures of few boxes in batches instead, with no joins.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.texts import FULL, HALF, half_width
from quern.operators.pictures import Boxes, by_picture, changes, pairs_within
from quern.operators.regions import written

# Names of the fields, characters before which a name is another word, and the fields of a unit.
NAMES = {
    "calories": ["熱量", "热量"], "protein": ["蛋白質", "蛋白质", "蛋白贸"], "saturated_fat": ["飽和脂肪", "饱和脂肪", "鮑和脂肪", "鲍和脂肪"], "trans_fat": ["反式脂肪"], "fat": ["脂肪"],
    "carbohydrates": ["碳水化合物"], "fiber": ["膳食纖維", "膳食纤維", "膳食织維", "膳食纖维", "膳食纤维", "膳食织维"], "sugar": ["糖"], "sodium": ["鈉", "钠", "纳"],
}
NOT_AFTER = {"fat": "飽饱鮑鲍反式和", "sugar": "蔗葡萄麥芽乳砂果白黑紅寡多海藻糊焦", "sodium": "酸化磷碳"}
UNIT_WORDS = {"kcal": ["大卡", "千卡", "kcal"], "mg": ["毫克", "亳克", "豪克"], "g": ["公克", "公剋"]}
UNIT_FIELDS = {"kcal": ["calories"], "mg": ["sodium"], "g": ["protein", "fat", "saturated_fat", "trans_fat", "carbohydrates", "sugar", "fiber"]}
HEADINGS = ["營養標示", "营养标示", "每一份量", "本包裝含", "本包装含"]
HEADING_NUMBERS = ["每一份量", "本包裝", "營養標示", "参考值", "參考值", "淨重", "內容量"]
BESIDE_NAME = r"[\s\d.,:：()（）%/大卡公克毫克絲升亳克gGmMlL─\-—]*"
TILE = 2048
FOLD = str.maketrans(FULL, HALF)


def name_pattern(field: str) -> str:
    found = "|".join(NAMES[field])
    return f"(?<![{NOT_AFTER[field]}])(?:{found})" if field in NOT_AFTER else f"(?:{found})"


def named_in(field: str, text: Column) -> Column:
    """Whether one of the field's names stands anywhere: cheap, and true of every text that its pattern matches."""
    return reduce(or_, (F.contains(text, F.lit(name)) for name in NAMES[field]))


def label_kind(field: str, text: Column) -> Column:
    """plain: the text is the field's name; with_values: the name and its numbers; else null."""
    tail = F.regexp_replace(text, f"^{name_pattern(field)}", "")
    own = F.when(F.trim(tail) == "", "plain").when(tail.rlike(f"^{BESIDE_NAME}$") & tail.rlike(r"\d"), "with_values")
    found = F.when(text.rlike(f"^{name_pattern(field)}"), own).when(text.rlike(f"^.{name_pattern(field)}") & (F.length(text) <= 8), "plain")
    return F.when(named_in(field, text), found)


def placed_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """key, no, text, cx, cy, w, h.  boxes: key, no (its place, one each a record), text, box (four points or more; others are left out)."""
    xs, ys = F.transform("box", lambda p: F.get(p, F.lit(0))), F.transform("box", lambda p: F.get(p, F.lit(1)))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return boxes.where(F.size("box") >= 4).select(key, "no", F.coalesce("text", F.lit("")).alias("text"), mean(xs).alias("cx"), mean(ys).alias("cy"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def read_texts(texts: DataFrame) -> DataFrame:
    """text, numbers, unit, kinds, hits, head (whether it is a table's heading).  texts: text, each once: boxes hold the same names and amounts over and over."""
    rows = texts.select("text", F.trim(F.replace(half_width(F.col("text")), F.lit("·"), F.lit("."))).alias("t"))
    heading = F.col("t").rlike(r"每\s*100|" + "|".join(HEADING_NUMBERS))
    numbers = F.transform(F.regexp_extract_all("t", F.lit(r"(-?\d+(?:[.,]\d+)?)")), lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double"))
    unit = F.lit(None).cast("string")
    for name, words in reversed(UNIT_WORDS.items()):
        unit = F.when(F.col("t").rlike("(?i)" + "|".join(words)), name).otherwise(unit)
    # Most texts are numbers: only those with a character of some name are held against the patterns.
    any_name = F.col("t").rlike("[" + "".join(sorted({name[-1] for names in NAMES.values() for name in names})) + "]")
    kinds = F.filter(F.array(*(F.struct(F.lit(i).alias("order"), F.lit(f).alias("field"), label_kind(f, F.col("t")).alias("kind")) for i, f in enumerate(NAMES))), lambda x: x["kind"].isNotNull())
    kinds = F.when(any_name, kinds).otherwise(F.array().cast("array<struct<order:int,field:string,kind:string>>"))
    hits = F.when(any_name, sum(F.when(named_in(f, F.col("t")), F.col("t").rlike(name_pattern(f)).cast("int")).otherwise(0) for f in NAMES)).otherwise(0)
    return rows.select("text", F.when(heading, F.array().cast("array<double>")).otherwise(numbers).alias("numbers"), unit.alias("unit"), kinds.alias("kinds"), hits.alias("hits"), F.col("t").rlike("|".join(HEADINGS)).alias("head"))


def tiles(low: Column, high: Column, size: int = TILE) -> Column:
    return F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))


def around_heading(items: DataFrame, key: str) -> DataFrame:
    """The boxes around the heading with most field names near it (three at least; of equal ones the first); all boxes of a record without such a heading."""
    r = F.greatest("w", "h")
    heads = items.where("head").select(key, F.col("no").alias("head"), (F.col("cx") - 6 * r).alias("x0"), (F.col("cx") + 8 * r).alias("x1"), (F.col("cy") - 4 * r).alias("y0"), (F.col("cy") + 10 * r).alias("y1"))
    dealt = heads.select("*", tiles(F.col("x0"), F.col("x1")).alias("tx")).select("*", tiles(F.col("y0"), F.col("y1")).alias("ty"))
    named = items.where("hits > 0").select(key, "cx", "cy", "hits", F.floor(F.col("cx") / TILE).alias("tx"), F.floor(F.col("cy") / TILE).alias("ty"))
    inside = "cx between x0 and x1 and cy between y0 and y1"
    counted = named.join(dealt, [key, "tx", "ty"]).where(inside).groupBy(key, "head", "x0", "x1", "y0", "y1").agg(F.sum("hits").alias("n")).where("n >= 3")
    best = counted.groupBy(key).agg(F.max_by(F.struct("x0", "x1", "y0", "y1"), F.struct("n", -F.col("head"))).alias("b"))
    return items.join(best.select(key, "b.*"), key, "left").where(f"x0 is null or ({inside})").drop("x0", "x1", "y0", "y1")


def names_of(items: DataFrame, key: str) -> DataFrame:
    """key, order, field, kind and the geometry of the first box of every field's name."""
    found = around_heading(items, key).select("*", F.explode("kinds").alias("k")).groupBy(key, F.col("k.order").alias("order"), F.col("k.field").alias("field"))
    first = found.agg(F.min_by(F.struct("no", "k.kind", "cx", "cy", "w", "h", "numbers"), "no").alias("f"))
    return first.select(key, "order", "field", "f.*")


def by_rank(names: DataFrame, numbers: DataFrame, frame: DataFrame, key: str) -> DataFrame:
    """key, field, a, b of records whose columns of numbers are as long as the list of names and whose units fit."""
    axis, cross = F.when(F.col("upright"), F.col("cy")).otherwise(F.col("cx")), F.when(F.col("upright"), F.col("cx")).otherwise(F.col("cy"))
    frame = frame.where("n_names >= 4").select(key, "upright", "n_names", F.when(F.col("upright"), F.col("y1")).otherwise(F.col("x1")).alias("edge"), F.when(F.col("upright"), F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0")).alias("span"))
    placed = numbers.drop("ways").join(frame, key).select("*", axis.alias("axis"), cross.alias("cross")).where("axis > 0")
    along = Window.partitionBy(key).orderBy("axis", "no")
    jump = F.coalesce(F.col("axis") - F.lag("axis").over(along) > F.greatest(F.col("span") * 0.5, F.lit(40)), F.lit(False))
    columns = placed.withColumn("jump", jump.cast("int")).withColumn("column", F.sum("jump").over(along))
    whole, down = Window.partitionBy(key, "column"), Window.partitionBy(key, "column").orderBy("cross", "axis", "no")
    members = columns.withColumns({"m": F.count("*").over(whole), "beyond": F.sum((F.col("axis") > F.col("edge")).cast("int")).over(whole), "place": F.row_number().over(down)})
    members = members.where("m >= n_names and beyond >= m * 0.6").withColumn("place", F.col("place") - (F.col("m") - F.col("n_names"))).where("place > 0")
    order = members.groupBy(key, "column").agg(F.avg("axis").alias("mean")).withColumn("c", F.row_number().over(Window.partitionBy(key).orderBy("mean", "column"))).where("c <= 2")
    values = members.join(order, [key, "column"]).select(key, "place", "c", F.get("numbers", F.lit(0)).alias("v"), "unit")
    listed = names.join(frame.select(key, "upright"), key).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(cross, "order")))
    fits = F.lit(True)
    for unit, fields in UNIT_FIELDS.items():
        fits = F.when(F.col("unit") == unit, F.col("field").isin(fields)).otherwise(fits)
    pairs = listed.select(key, "field", "place").join(values, [key, "place"]).groupBy(key, "field").agg(F.max(F.when(F.col("c") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("c") == 2, F.col("v"))).alias("b"), F.min(F.coalesce(fits, F.lit(True))).alias("fits"))
    return pairs.withColumn("all_fit", F.min("fits").over(Window.partitionBy(key))).where("all_fit").select(key, "field", "a", "b")


def by_band(names: DataFrame, numbers: DataFrame, frame: DataFrame, key: str, size: int = 128) -> DataFrame:
    """key, field, first, second: the first numbers beside (upright: below) every name."""
    upright = F.col("h") > F.col("w") * 1.5
    reach = F.when(upright, F.greatest("w", "mw") * 0.9).otherwise(F.greatest("h", "mh") * 0.7)
    wanted = names.join(frame.select(key, "mw", "mh"), key).select(key, "field", "no", upright.alias("down"), F.when(upright, F.col("cx")).otherwise(F.col("cy")).alias("at"), F.when(upright, F.col("cy")).otherwise(F.col("cx")).alias("from"), reach.alias("reach"))
    wanted = wanted.select("*", tiles(F.col("at") - F.col("reach"), F.col("at") + F.col("reach"), size).alias("tile"))
    spot = lambda down, at, along: F.struct(F.lit(down).alias("down"), F.col(at).alias("x"), F.col(along).alias("y"))
    spots = numbers.select(key, F.col("no").alias("other"), "numbers", F.inline(F.transform("ways", lambda down: F.when(down, spot(True, "cx", "cy")).otherwise(spot(False, "cy", "cx"))))).withColumn("tile", F.floor(F.col("x") / size))
    near = wanted.join(spots, [key, "down", "tile"]).where((F.col("no") != F.col("other")) & (F.abs(F.col("x") - F.col("at")) <= F.col("reach")) & (F.col("y") > F.col("from")))
    nearest = near.withColumn("r", F.row_number().over(Window.partitionBy(key, "field").orderBy("y", "other"))).where("r <= 2")
    flat = nearest.groupBy(key, "field").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r", "numbers"))), lambda x: x["numbers"])).alias("v"))
    return flat.select(key, "field", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(1)).alias("second"))


def box_tables(boxes: DataFrame, key: str) -> DataFrame:
    """key, field, a, b, how: the amounts per serving and per 100 that the boxes' places give; how is rank, same_box or band."""
    placed = written(placed_boxes(boxes, key))  # these are read by several joins
    items = placed.join(written(read_texts(placed.select("text").distinct())), "text").drop("text")
    names = written(names_of(items, key))
    stands = F.coalesce(F.col("h") > F.col("w") * 1.5, F.lit(False))
    frame = names.groupBy(key).agg(
        F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.avg("w").alias("mw"), F.avg("h").alias("mh"), F.count("*").alias("n_names"),
        (F.sum(stands.cast("int")) * 2 > F.count("*")).alias("upright"), F.array_sort(F.collect_set(stands)).alias("ways"),
    )
    within = "cx between x0 - mw * 8 and x1 + mw * 12 and cy between y0 - mh * 8 and y1 + mh * 12"
    numbers = items.where(F.size("numbers") > 0).join(frame, key).where(within).select(key, "no", "cx", "cy", "numbers", "unit", "ways")
    own = names.where("kind = 'with_values'").select(key, "field", F.get("numbers", F.lit(0)).alias("own_a"), F.get("numbers", F.lit(1)).alias("own_b"), F.lit(True).alias("own"))
    ranked = by_rank(names, numbers, frame, key).withColumn("n_ranked", F.count("*").over(Window.partitionBy(key)))
    all_of = names.select(key, "field").join(own, [key, "field"], "left").join(ranked.withColumnsRenamed({"a": "rank_a", "b": "rank_b"}), [key, "field"], "left").join(by_band(names, numbers, frame, key), [key, "field"], "left")
    sure = F.coalesce(F.max("n_ranked").over(Window.partitionBy(key)) >= 4, F.lit(False))
    by, own_first = F.col("n_ranked").isNotNull(), F.col("own").isNotNull()
    first = lambda o, r: F.when(F.col("sure") & by, F.col(r)).when(own_first, F.col(o)).when(by, F.col(r))
    out = all_of.withColumn("sure", sure).select(key, "field", "sure", "first", "second", first("own_a", "rank_a").alias("x"), first("own_b", "rank_b").alias("y"), F.when(F.col("sure") & by, "rank").when(own_first, "same_box").when(by, "rank").alias("told"))
    open_ = ~F.col("sure") & F.col("y").isNull()
    a = F.when(F.col("told").isNull() & open_, F.col("first")).otherwise(F.col("x"))
    b = F.when(open_, F.when(F.col("told").isNull(), F.col("second")).otherwise(F.col("first"))).otherwise(F.col("y"))
    return out.select(key, "field", a.alias("a"), b.alias("b"), F.coalesce("told", F.lit("band")).alias("how")).where("a is not null or b is not null")


class Texts:
    """What the rules ask of texts: first two numbers, how many, unit, heading, hits, and the kind of name a field (0 none, 1 plain, 2 with values).  A text's answers are kept, in bounded number."""

    def __init__(self, most: int = 1 << 16):
        self.known, self.most = {}, most
        self.names = {f: re.compile(name_pattern(f)) for f in NAMES}
        self.any_name, self.beside = re.compile("[" + "".join(sorted({name[-1] for names in NAMES.values() for name in names})) + "]"), re.compile(BESIDE_NAME, re.A)
        self.no_numbers, self.heading = re.compile(r"每\s*100|" + "|".join(HEADING_NUMBERS), re.A), re.compile("|".join(HEADINGS))
        self.units = [re.compile("|".join(words), re.I | re.A) for words in UNIT_WORDS.values()]

    def kind(self, pattern: re.Pattern, t: str) -> int:
        if (m := pattern.match(t)) is None:
            return int(len(t) <= 8 and t[:1] not in ("\n", "\r", "\x85", " ", " ") and pattern.match(t, 1) is not None)
        tail = t[m.end() :]
        return 1 if not tail.strip(" ") else 2 if self.beside.fullmatch(tail) and re.search(r"\d", tail, re.A) else 0

    def one(self, text: str) -> list[float]:
        t = text.translate(FOLD).replace("·", ".").strip(" ")
        numbers = [] if self.no_numbers.search(t) else [float(v.replace(",", ".")) for v in re.findall(r"-?\d+(?:[.,]\d+)?", t, re.A)]
        unit = next((i for i, u in enumerate(self.units) if u.search(t)), -1)
        named = self.any_name.search(t) is not None
        hits = sum(p.search(t) is not None for p in self.names.values()) if named else 0
        kinds = [self.kind(p, t) for p in self.names.values()] if named else [0] * len(NAMES)
        return [*(numbers[i] if i < len(numbers) else np.nan for i in (0, 1)), len(numbers), unit, self.heading.search(t) is not None, hits, *kinds]

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        rows = []
        for t in texts:
            if (row := self.known.get(t)) is None:
                row = self.one(t)
                if len(t) <= 200:
                    self.known[t] = row
            rows.append(row)
        return np.array(rows, float).reshape(-1, 6 + len(NAMES))


def found_tables(texts: Texts, boxes: Boxes, pictures: int) -> dict:
    """`box_tables` for a batch of pictures."""
    pic, no, fields = boxes.picture, boxes.no, len(NAMES)
    read = texts.of(boxes.texts)[boxes.at] if len(pic) else np.empty((0, 6 + fields))
    number, more, count, unit, head, hits = read[:, :6].T
    kinds = read[:, 6:].astype(np.int8)
    extent = lambda v: np.maximum.reduceat(v, boxes.begins) - np.minimum.reduceat(v, boxes.begins) if len(pic) else np.empty(0)
    points = np.diff(np.append(boxes.begins, len(boxes.x)))

    def mean(v: np.ndarray) -> np.ndarray:
        total = np.zeros(len(pic))  # one by one, in order
        for i in range(int(points.max(initial=0))):
            total = total + np.where(i < points, v[np.minimum(boxes.begins + i, len(v) - 1)], 0.0)
        return total / np.maximum(points, 1)

    cx, cy, w, h = mean(boxes.x), mean(boxes.y), extent(boxes.x), extent(boxes.y)

    # The surroundings of the heading with most names near it.
    heads, named = np.flatnonzero(head > 0), np.flatnonzero(hits > 0)
    r = np.maximum(w, h)
    low_x, high_x, low_y, high_y = cx - 6 * r, cx + 8 * r, cy - 4 * r, cy + 10 * r
    a, b = pairs_within(pic[heads], pic[named])
    i, j = heads[a], named[b]
    inside = (cx[j] >= low_x[i]) & (cx[j] <= high_x[i]) & (cy[j] >= low_y[i]) & (cy[j] <= high_y[i])
    near = np.bincount(a[inside], weights=hits[j[inside]], minlength=len(heads))
    best = np.lexsort((np.arange(len(heads)), -near, pic[heads]))
    best = best[changes(pic[heads][best])]
    around = np.full(pictures, -1)
    around[pic[heads[best]]] = np.where(near[best] >= 3, heads[best], -1)
    at = around[pic]
    scope = (at < 0) | (cx >= low_x[at]) & (cx <= high_x[at]) & (cy >= low_y[at]) & (cy <= high_y[at]) if len(pic) else np.zeros(0, bool)

    # The first box of each field's name, and their frame.
    name = np.full((pictures, fields), -1)
    for f in range(fields):
        where = np.flatnonzero(scope & (kinds[:, f] > 0))
        where = where[changes(pic[where])]
        name[pic[where], f] = where
    if not len(pic):
        name = name[:0]
    there, n_names = name >= 0, (name >= 0).sum(axis=1)
    of_names = lambda v, empty: np.where(there, v[name], empty) if len(pic) else np.zeros((0, fields))
    x0, x1, y0, y1 = of_names(cx, np.inf).min(axis=1), of_names(cx, -np.inf).max(axis=1), of_names(cy, np.inf).min(axis=1), of_names(cy, -np.inf).max(axis=1)
    mw, mh = (of_names(v, 0.0).sum(axis=1) / np.maximum(n_names, 1) for v in (w, h))
    stands = of_names(h > w * 1.5, False).astype(bool)
    upright = stands.sum(axis=1) * 2 > n_names
    within = (cx >= (x0 - mw * 8)[pic]) & (cx <= (x1 + mw * 12)[pic]) & (cy >= (y0 - mh * 8)[pic]) & (cy <= (y1 + mh * 12)[pic]) if len(pic) else np.zeros(0, bool)
    numbers = np.flatnonzero((count > 0) & within)

    # By rank: columns by gaps on the main axis, the n-th number of a column to the n-th name across.
    edge, span = np.where(upright, y1, x1), np.where(upright, y1 - y0, x1 - x0)
    ranked = numbers[n_names[pic[numbers]] >= 4]
    turned = upright[pic[ranked]]
    axis, cross = np.where(turned, cy[ranked], cx[ranked]), np.where(turned, cx[ranked], cy[ranked])
    order = np.lexsort((np.arange(len(ranked)), axis, pic[ranked]))
    order = order[axis[order] > 0]
    p, along = pic[ranked[order]], axis[order]
    column = np.cumsum(changes(p) | np.append(True, np.diff(along) > np.maximum(span[p[1:]] * 0.5, 40))[: len(p)]) - 1
    m = np.bincount(column) if len(column) else np.zeros(0, int)
    beyond = np.bincount(column, weights=along > edge[p]) if len(column) else np.zeros(0)
    down = np.lexsort((np.arange(len(order)), cross[order], column))
    order, p, column = order[down], p[down], column[down]
    place = np.arange(len(order)) - (np.cumsum(m) - m)[column] - (m[column] - n_names[p])
    kept = (m[column] >= n_names[p]) & (beyond[column] >= m[column] * 0.6) & (place >= 0)
    box, p, column, place = ranked[order[kept]], p[kept], column[kept], place[kept]
    new = changes(column)
    turn = np.cumsum(new) - 1 if len(new) else np.zeros(0, int)
    first_of = np.zeros(pictures, int)
    first = changes(p)
    first_of[p[first]] = turn[first]
    turn = turn - first_of[p]
    box, p, place, turn = (v[turn < 2] for v in (box, p, place, turn))
    values = np.full((2, pictures, fields), np.nan)
    values[turn, p, place] = number[box]
    across = np.where(upright[:, None], of_names(cx, np.inf), of_names(cy, np.inf)) if len(pic) else np.zeros((0, fields))
    listed = np.lexsort((np.broadcast_to(np.arange(fields), across.shape), np.where(np.isfinite(across), across, np.inf)), axis=1)  # the place's field
    fits = np.array([[f in UNIT_FIELDS[u] for f in NAMES] for u in UNIT_WORDS] + [[True] * fields])
    wrong = np.bincount(p, weights=~fits[unit[box].astype(int), listed[p, place]], minlength=pictures) if len(p) else np.zeros(pictures)
    sure = (np.bincount(p, minlength=pictures) > 0) & (wrong == 0)

    out = np.full((2, pictures, fields), np.nan)
    if len(pic):
        for c in (0, 1):
            np.put_along_axis(out[c], listed, values[c], axis=1)
    out[:, ~sure] = np.nan
    how = np.where(sure, 0, 2)[:, None].repeat(fields, axis=1)

    # A box with its own numbers, else the first numbers beside or below a name.
    open_ = there & ~sure[:, None] if len(pic) else np.zeros((pictures, fields), bool)
    own = open_ & (np.take_along_axis(kinds[name], np.arange(fields)[None, :, None], axis=2)[:, :, 0] == 2) if len(pic) else open_
    how[own] = 1
    for c, v in ((0, number), (1, more)):
        out[c][own] = v[name[own]]
    who, field = np.nonzero(open_ & np.isnan(out[1]))
    at = name[who, field]
    below = h[at] > w[at] * 1.5
    reach = np.where(below, np.maximum(w[at], mw[who]) * 0.9, np.maximum(h[at], mh[who]) * 0.7)
    a, b = pairs_within(who, pic[numbers])
    other, down = numbers[b], below[a]
    x, y = np.where(down, cx[other], cy[other]), np.where(down, cy[other], cx[other])
    close = (other != at[a]) & (np.abs(x - np.where(below, cx[at], cy[at])[a]) <= reach[a]) & (y > np.where(below, cy[at], cx[at])[a])
    a, other, y = a[close], other[close], y[close]
    order = np.lexsort((other, y, a))
    a, other = a[order], other[order]
    nearest = np.flatnonzero(changes(a))
    got, one = a[nearest], other[nearest]
    next_ = np.minimum(nearest + 1, max(len(a) - 1, 0))
    second = np.where(count[one] > 1, more[one], np.where((next_ > nearest) & (a[next_] == got), number[other[next_]], np.nan)) if len(a) else np.empty(0)
    where, what = who[got], field[got]
    told = own[where, what]
    out[1][where, what] = np.where(told, number[one], second)
    out[0][where, what] = np.where(told, out[0][where, what], number[one])

    who, field = np.nonzero(there & ~np.isnan(out).all(axis=0)) if len(pic) else (np.zeros(0, int), np.zeros(0, int))
    cell = lambda v: pa.array(v[who, field], from_pandas=True)
    return {"picture": who, "field": pa.array(np.array(list(NAMES), object)[field], pa.string()), "a": cell(out[0]), "b": cell(out[1]), "how": pa.array(np.array(["rank", "same_box", "band"], object)[how[who, field]], pa.string())}


def picture_tables(rows: DataFrame, key: str) -> DataFrame:
    """`box_tables` of pictures whose boxes come in arrays.  rows: key, boxes (array<struct<no, text, box>>)."""
    texts = Texts()
    return by_picture(rows.where(F.col(key).isNotNull()), key, lambda boxes, n: found_tables(texts, boxes, n), "field string, a double, b double, how string", 4, lambda boxes: box_tables(boxes, key))
