"""Nutrition tables of labels: readings of number sequences, the best whole table, tables from boxes.

The labels are made from orders: the lines of an order give a table's amounts, its key
the serving size, the layout and what is missing.  The three queries have no SQL; their
tests compare them with recursion, exhaustive search and loops over boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import box_tables as B
from quern.operators import readings as R
from quern.plans.registry import query
from quern.sources.tables import spread_by, table

PRINTED = {"calories": "熱量", "protein": "蛋白質", "fat": "脂肪", "saturated_fat": "飽和脂肪", "trans_fat": "反式脂肪", "carbohydrates": "碳水化合物", "sugar": "糖", "sodium": "鈉"}
UNIT = {"calories": "大卡", "sodium": "毫克"}


def number(x: Column) -> Column:
    v = F.round(x.cast("double"), 1)
    return F.when(F.abs(v) < 1e6, v.cast("string")).otherwise(F.format_string("%.1f", v))  # the same digits, and cheaper


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, text: a label for every order, by rows, by columns or backwards, with a serving size or without, some cells missing and stray numbers between."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    sums = spread_by(lines, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("c"), (F.max("l_quantity") / 3).alias("p"), (F.min("l_quantity") / 2).alias("f"), F.max("l_tax").alias("t"), F.max("l_discount").alias("d"), F.count("*").alias("n")
    )
    orders = spread_by(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "o_orderkey").join(sums, "o_orderkey")
    of_100 = {
        "calories": F.round(F.col("p"), 1) * 4 + F.round(F.col("f"), 1) * 9 + F.round(F.coalesce("c", F.lit(3.0)), 1) * 4, "protein": F.col("p"), "fat": F.col("f"), "saturated_fat": F.col("f") * F.col("d") * 5, "trans_fat": F.lit(0.0),
        "carbohydrates": F.coalesce("c", F.lit(3.0)), "sugar": F.coalesce("c", F.lit(3.0)) * F.col("t") * 10, "sodium": F.col("o_totalprice") % 900,
    }
    serving = 20 + k % 181
    cell = lambda f, i, x: F.when((k * 7 + i) % 19 != 0, F.concat(number(x), F.lit(UNIT.get(f, "公克"))))
    per_serving = {f: cell(f, i, F.round(x, 1) * serving / 100) for i, (f, x) in enumerate(of_100.items())}
    per_100 = {f: cell(f, i + 8, x) for i, (f, x) in enumerate(of_100.items())}
    stray = F.when(k % 5 == 0, F.concat(number(k % 97), F.lit("公克")))
    rows = F.array(*(x for f in of_100 for x in (F.lit(PRINTED[f]), per_serving[f], per_100[f])), stray)
    columns = F.array(*per_serving.values(), stray, *per_100.values())
    cells = F.when(k % 3 == 0, rows).when(k % 3 == 1, columns).otherwise(F.reverse(columns))
    head = F.when(k % 4 != 0, F.concat(F.lit("營養標示 每一份量 "), serving.cast("string"), F.lit("公克 ")))
    return orders.select("o_orderkey", F.concat(F.coalesce(head, F.lit("")), F.array_join(cells, " ")).alias("text"))


@query()
def sequence_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every order's label: by unit, as columns forwards and backwards, and aligned with the printed order by rows and by columns."""
    return R.all_readings(order_texts(spark, sf_dir), "o_orderkey")


@query()
def whole_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best table of every order's label, one reading a field, with the other side derived where one is missing."""
    return R.filled(R.text_tables(order_texts(spark, sf_dir), "o_orderkey"))


def order_rows(spark: SparkSession, sf_dir: str, ingredients: bool = False) -> DataFrame:
    """l_orderkey, boxes: a picture for every order, a row a line; some upright, some tilted, some with names and numbers in one box, a heading in most.  Lines of an order come together."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount")
    lines = lines.withColumn("l_linenumber", F.row_number().over(place))  # line numbers are not unique
    fields = list(PRINTED)
    field = F.get(F.array(*map(F.lit, fields)), (n - 1) % len(fields))
    name = F.get(F.array(*(F.lit(PRINTED[f]) for f in fields)), (n - 1) % len(fields))
    unit = F.when(k % 6 == 0, "").when(field == "calories", "大卡").when(field == "sodium", "毫克").otherwise("公克")
    upright, tilt = k % 4 == 0, F.when(k % 3 == 0, 0.2).otherwise(0.0)
    lines = lines.select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", number(F.col("l_quantity")).alias("plain"), number(F.col("l_quantity") * (1 + F.col("l_tax"))).alias("taxed"), name.alias("name"), unit.alias("unit"))
    name = F.col("name")

    boxes: list[str] = []
    columns: dict[str, Column] = {}

    def box(no: Column, text: Column, x: Column, y: Column, w: Column, h: Column, turned: Column = upright) -> None:
        """A text and two opposite corners.  They are columns of a step of their own, as one step for all is a method that the JVM does not compile."""
        either = lambda a, b: F.when(turned, b).otherwise(a)
        i = len(boxes)
        columns.update({f"t{i}": text, f"x{i}": either(x, y), f"y{i}": either(y, x), f"x{i}_": either(x + w, y + h), f"y{i}_": either(y + h, x + w)})
        ends = [F.array(F.col(f"x{i}{p}"), F.col(f"y{i}{q}")) for p, q in (("", ""), ("_", ""), ("_", "_"), ("", "_"))]
        boxes.append(F.when(F.col(f"t{i}").isNotNull(), F.struct(no.cast("long").alias("no"), F.col(f"t{i}").alias("text"), F.array(*ends).alias("box"))))

    d = lambda v: F.lit(float(v))
    y = n * 50.0 + 80
    together = (k + n) % 9 == 0
    first, second = F.concat("plain", "unit"), F.when((k + n) % 8 != 0, F.concat("taxed", "unit"))
    box(F.lit(0), F.when((n == 1) & (k % 7 != 0), "營養標示 每一份量 353公克"), d(40), d(20), d(160), d(30))
    box(n * 4, F.when(together, F.concat(name, first, F.coalesce(second, F.lit("")))).otherwise(name), d(50), y, F.when(together, 200.0).otherwise(90.0), d(30))
    for c, v in ((1, first), (2, second)):
        box(n * 4 + c, F.when(~together, v), d(60 + 200 * c), y + tilt * (60 + 200 * c), d(80), d(30))
    box(n * 4 + 3, F.when(F.col("l_discount") == 0, F.concat(F.lit("No. "), "plain")), F.col("l_quantity") * 40, d(600), d(60), d(30))
    if ingredients:
        listed = F.when((n == 1) & (k % 3 > 0), "成分：水、糖、鹽、").when(k % 5 == 0, "a line of words").otherwise("麵粉、油、香料、")
        box(1000 + n, listed, d(900), n * F.when(k % 4 == 1, 90.0).otherwise(34.0) + 100, F.when((n + k) % 5 == 0, 40.0).otherwise(650.0), d(30), F.lit(False))
    return lines.select("l_orderkey", "l_linenumber", *(c.alias(f) for f, c in columns.items())).select("l_orderkey", F.array(*boxes).alias("boxes"))


def order_boxes(spark: SparkSession, sf_dir: str, ingredients: bool = False) -> DataFrame:
    """l_orderkey, no, text, box: the boxes of the pictures."""
    return order_rows(spark, sf_dir, ingredients).select("l_orderkey", F.inline_outer("boxes")).where("text is not null")  # an inner one did not end within minutes


@query()
def box_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of every order's picture, by rank, by box or by band."""
    return B.picture_tables(order_rows(spark, sf_dir), "l_orderkey")


def order_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, no, text, box: the tables' boxes of every order, its ingredients as long lines beside them, and loose lines."""
    return order_boxes(spark, sf_dir, ingredients=True)


@query()
def label_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the nutrition table and the ingredients stand in every order's picture."""
    from quern.operators import regions as G

    return G.picture_regions(order_rows(spark, sf_dir, ingredients=True), "l_orderkey")
