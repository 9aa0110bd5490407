"""Item matching against a plain edit distance, and field numbers of small texts."""

import random

from quern.operators import items as I


def fewest_edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alike_like_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        room = max(1, min(len(a), len(b)) // 4)
        assert I.alike(a, b) == (bool(a and b) and (a == b or abs(len(a) - len(b)) <= room and fewest_edits(a, b) <= room))


def test_lists(spark):
    rows = [(1, ["salt", "sugar", "salt"], ["salt", "salt", "water"]), (2, None, ["a"]), (3, ["a"], None), (4, [], []), (5, ["abcdefgh", "abcdefgx"], ["abcdefgh"]), (6, ["salt", "malt", "salt"], ["abcdefgh", "abcdefghi"])]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = {r.i: (r.m.hits, r.m.missed, r.m.spurious, r.x) for r in df.select("i", I.matched("a", "b").alias("m"), I.merged("a", "b").alias("x")).collect()}
    assert got[1] == (2, ["water"], ["sugar"], ["salt", "sugar", "water"])
    assert got[2] == (0, ["a"], [], ["a"]) and got[3] == (0, [], ["a"], ["a"]) and got[4] == (0, [], [], [])
    assert got[5] == (1, [], ["abcdefgx"], ["abcdefgh"])
    assert got[6] == (0, ["abcdefgh", "abcdefghi"], ["salt", "malt", "salt"], ["salt", "malt", "abcdefghi"])


def test_field_numbers():
    assert I.field_numbers(None) == {} == I.field_numbers("葡萄糖 5")
    assert I.field_numbers("熱量 100 大卡 50 大卡 蛋白質 2,5公克 1 公克") == {"calories": [100, 50], "protein": [2.5, 1]}
    assert I.field_numbers("飽和脂肪 1 公克 2 公克 反式脂肪 0 0 脂肪 3 4") == {"saturated_fat": [1, 2], "trans_fat": [0, 0], "fat": [3, 4]}
    assert I.field_numbers("脂肪 3 公克 飽和脂肪 1 公克") == {"saturated_fat": [1, None]}  # a match that reaches into another field's place is none
    assert I.field_numbers("熱量 151.6大卡 8% 每日參考值") == {"calories": [151.6, None]}


def test_alike_by_letters_and_digits():
    assert I.alike("Ｓ-a.lt", "Salt") and not I.alike("--", "--") and not I.alike("", "x")
    assert I.match_lists([["", "棕櫚 油"]], [["棕櫚油", ""]]).values.tolist() == [[1, [""], [""]]]


def test_field_numbers_by_gaps():
    assert I.field_numbers("糖" + "x" * 8 + "5") == {"sugar": [5, None]} and I.field_numbers("糖" + "x" * 9 + "5") == {}
    assert I.field_numbers("糖 5 公克" + "x" * 10 + "6") == {"sugar": [5, 6]} and I.field_numbers("糖 5 公克" + "x" * 11 + "6") == {"sugar": [5, None]}
    assert I.field_numbers("脂肪") == {} and I.field_numbers("鈉 " * 3) == {}


def test_equal_texts_are_read_once_and_rows_are_dealt(spark, tmp_path, monkeypatch):
    import pandas as pd

    from quern.plans import queries

    asked = []
    read = I.field_numbers
    monkeypatch.setattr(I, "field_numbers", lambda t: asked.append(t) or read(t))
    got = I.fields_of(pd.Series(["熱量 5大卡", None, "熱量 5大卡", "糖 1", None]))
    assert sorted(asked, key=str) == sorted(["熱量 5大卡", None, "糖 1"], key=str)
    assert got.tolist() == [{"calories": [5.0, None]}, {}, {"calories": [5.0, None]}, {"sugar": [1.0, None]}, {}]
    monkeypatch.undo()
    rows = [(i, 1, i % 6, float(i % 50)) for i in range(64)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries.QUERIES["numbers_by_field"](spark, str(tmp_path))
    assert out.count() == 64 and out.rdd.getNumPartitions() > 1
