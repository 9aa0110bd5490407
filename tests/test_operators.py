"""Operators and functions on small tables with nulls, ties and empty inputs."""

from pyspark.sql import functions as F

from quern.functions import nutrition as N
from quern.functions import texts as X
from quern.functions.labels import label_name
from quern.functions.times import day_key
from quern.operators import grouped as G
from quern.operators import matching as M
from quern.operators import tables as T
from quern.sources import tables as S


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_points_and_grades(spark):
    r = one(spark, at=N.points(F.lit(3.4), N.SUGARS), over=N.points(F.lit(3.5), N.SUGARS), none=N.points(F.lit(None).cast("double"), N.SUGARS))
    assert (r["at"], r["over"], r["none"]) == (0, 1, 0)
    values = [F.lit(float(x)) for x in (1700, 40, 6, 1.3, 20, 2, 10)]
    s = one(spark, s=N.score(*values, drink=F.lit(False)))["s"]
    assert s["points_n"] == 5 + 11 + 5 + 6 and s["score"] == s["points_n"] and s["grade"] == "E"  # protein does not count


def test_solver(spark):
    got = lambda a, b, c: tuple(one(spark, s=N.solved(*(F.lit(x).cast("double") for x in (a, b, c))))["s"])
    assert got(330.8, 93.7, 353) == (330.8, 93.7, "read")
    assert got(30.8, 93.7, 353) == (330.8, 93.7, "repaired_serving")
    assert got(None, 50, 200) == (100.0, 50.0, "derived_serving")
    assert got(None, None, 200) == (None, None, "missing")
    assert got(5, 900, 100)[2] == "inconsistent"


def test_texts(spark):
    r = one(
        spark, name=label_name(F.lit("Ａ’b (x) c")), maker=X.maker_key(F.lit("甲 (股)公司")), none=X.maker_key(F.lit(None).cast("string")), s=X.sentences(F.lit("a 0.07 g. b。 c.")),
        w=X.window_around(F.lit("x" * 150 + "hit" + "y" * 500), ["hit"]), clean=X.clean_lines(F.lit("a b\n|---|\na b\n  c ")), d=X.domain(F.lit("HTTP://Ab.c:80/x")), n=X.mentions(F.lit("aXbXc"), F.lit("X")),
        id=X.coerced_id(F.lit("候選 19")), bad=X.coerced_id(F.lit("x")), day=day_key(F.lit("Mon, 05 Feb 2024 10:00:00 GMT")), raw=day_key(F.lit("2024-02")), b=X.without_brackets(F.lit("a(b(c)d)e")),
    )
    assert (r["name"], r["maker"], r["none"], r["s"]) == ("Abc", "甲", "未知製造商", ["a 0.07 g", "b", "c"])
    assert r["w"].startswith("…" + "x" * 100 + "hit") and len(r["w"]) == 401
    assert (r["clean"], r["d"], r["n"], r["id"], r["bad"], r["day"], r["raw"], r["b"]) == ("a b c", "ab.c:80", 2, 19, None, "2024-02-05", "2024-02", "ae")


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 2)], "k int, p string, q string, r int")
    new = spark.createDataFrame([(2, None, "y", 9), (3, "c", None, 3)], "k int, p string, q string, r int")
    got = T.upsert(old, new, "k", {"p": "overwrite", "q": "keep"}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", 1), (2, None, "y", 2), (3, "c", None, 3)]
    assert T.upsert(old.limit(0), new.limit(0), "k", {}).count() == 0


def test_cache_state(spark):
    rows = spark.createDataFrame([("a", 100, 10), ("a", 200, 10), ("b", 100, -1)], "k string, w long, t long")
    got = {r["k"]: (r["written"], r["state"]) for r in T.cache_state(rows, "k", F.col("w"), F.col("t"), F.lit(210)).collect()}
    assert got == {"a": (200, "HIT"), "b": (100, "STALE")}


def test_new_keys(spark):
    known = spark.createDataFrame([("b", 7)], "name string, id long")
    names = spark.createDataFrame([("c",), ("a",), ("b",), ("a",), (None,)], "name string")
    assert sorted(map(tuple, T.new_keys(names, known, "name", "id").collect())) == [(8, "a"), (9, "c")]


def test_near_misses_like_brute_force(spark):
    import random

    random.seed(3)
    names = ["".join(random.choice("abc") for _ in range(random.randint(6, 14))) for _ in range(60)]
    q = spark.createDataFrame([(x,) for x in names[:30]], "q string")
    n = spark.createDataFrame([(x,) for x in names[30:]], "n string")
    got = {r["q"]: (r["distance"], r["name"]) for r in M.near_misses(q, "q", n, "n").collect()}
    want = {}
    for a in set(names[:30]):
        found = [(d, b) for b in set(names[30:]) if 0 < (d := edits(a, b)) <= len(a) // 4]
        if len(a) >= 8 and found:
            want[a] = min(found)
    assert got == want


def test_longest_contained(spark):
    items = spark.createDataFrame([("red apple",), ("pear",), (None,), ("x",)], "i string")
    names = spark.createDataFrame([("apple",), ("red",), ("pear",), ("app",)], "n string")
    assert {tuple(r) for r in M.longest_contained(items, "i", names, "n").collect()} == {("red apple", "apple", 2), ("pear", "pear", 0)}


def test_overlaps(spark):
    a = spark.createDataFrame([(1, 0, 100), (2, 5, 6)], "i int, a1 long, b1 long")
    b = spark.createDataFrame([(1, 99, 300), (2, 6, 7), (3, 100, 101)], "j int, a2 long, b2 long")
    assert {(r["i"], r["j"]) for r in M.overlapping(a, b, ("a1", "b1"), ("a2", "b2"), 8).collect()} == {(1, 1), (1, 2)}


def test_overlap_of_whole_tables(spark, tmp_path):
    """Orders and lines of any supplier and customer, against brute force."""
    from datetime import datetime, timedelta

    from quern.plans import queries

    first = datetime(1995, 1, 1)
    lines = [(k % 40, k % 7, k % 11, first + timedelta(days=k * 5 % 23), float(k % 50 + 1)) for k in range(300)]
    orders = [(k, 300 + k, first + timedelta(days=k * 3 % 23)) for k in range(50)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for k, number, _, ship, quantity in lines:
        for order, _, day in orders:
            if k == order and ship < day + timedelta(days=3) and day < ship + timedelta(days=int(quantity) % 7 + 1):
                want[k, number] = want.get((k, number), 0) + 1
    got = {(r["l_orderkey"], r["l_linenumber"]): r["n"] for r in queries.QUERIES["interval_overlap_whole"](spark, str(tmp_path)).collect()}
    assert len(want) > 10 and got == want


def slow_runs(text, least=180):
    runs, i = [], 0
    while i < len(text):
        for p in range(1, 17):
            j = i
            while j + p <= len(text) and text[j : j + p] == text[i : i + p]:
                j += p
            if j - i >= least:
                runs.append((i, j, p))
                i = j
                break
        else:
            i += 1
    return runs


def test_runs_in_the_whole_text(spark):
    """Runs at the start, in the middle and at the end, next to each other and on their own, against a plain scan."""
    import hashlib
    import random

    rng = random.Random(3)
    clean = lambda n: "".join(rng.choice("abcdefghijklmnop 公克\U0001f600") for _ in range(n))
    texts = ["ab" * 95 + clean(200), clean(150) + "公克" * 100 + clean(200), clean(100) + "xyz" * 70, "a" * 179, "a" * 180, "ab" * 90 + "a", "abcdefg" * 25 + "abcde", "a" * 200 + "ab" * 120 + "b" * 300, clean(3000), ""]
    for _ in range(60):
        texts.append("".join(clean(rng.randint(0, 30)) + clean(rng.randint(1, 16)) * rng.randint(1, 200) for _ in range(3)))
        texts.append("".join(rng.choice("ab") * rng.randint(1, 150) for _ in range(8)))
    for t in texts:
        assert G.periodic_runs(t) == slow_runs(t)
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    got = {r["k"]: r for r in G.repetitions(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert len(got) == len(rows)
    middle = got[1]
    assert middle["period"] == 0 and middle["tail_start"] is None and middle["removed"] == 200 and [tuple(r) for r in middle["runs"]] == [(150, 350, 2)]
    assert middle["kept_md5"] == hashlib.md5((texts[1][:150] + texts[1][350:]).encode()).hexdigest()
    assert (got[2]["period"], got[2]["tail_start"], got[2]["trimmed"]) == (3, 100, 210)
    assert got[-1]["runs"] == [] and got[-1]["kept_md5"] is None


def test_whole_texts(spark, tmp_path):
    """Texts that differ only after their first characters are different ones."""
    from quern.plans import queries

    same = "the same beginning of sixty characters and more, word by word: "
    spark.createDataFrame([("a", same + "x"), ("b", same + "y"), ("b", same + "z"), ("c", same + "z")], "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, same + "abcdefgh" * 8), (1, 1, same + "12345678" * 8), (2, 0, "QXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQXQX" + "".join(map(chr, range(200, 300)))), (2, 1, "QX" * 30 + "".join(map(chr, range(1000, 1100))))]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    gain = {tuple(r) for r in queries.QUERIES["leave_one_out_gain_whole"](spark, str(tmp_path)).select("source", "found", "only_here", "gain").collect()}
    assert gain == {("a", 1, 1, 1.0), ("b", 2, 1, 0.5), ("c", 1, 0, 0.0)}
    found = {r["conv_id"]: r["edits"] for r in queries.QUERIES["semi_global_edit"](spark, str(tmp_path)).collect()}
    texts = {(c, k): t for c, k, t in turns}
    assert found == {c: min(edits(texts[c, 0], texts[c, 1][a:b]) for a in (0,) for b in range(len(texts[c, 1]) + 1)) for c in (1, 2)}
    merged = {(r["conv_id"], r["turn"]): r["merged"] for r in queries.QUERIES["event_merge_greedy"](spark, str(tmp_path)).collect()}
    assert merged[2, 0] == 0 and merged[2, 1] == 1  # equal for 60 characters, few pairs in common
    assert merged[1, 0] == merged[1, 1] == 0


def test_long_names_contained(spark):
    name = "a dictionary name that is longer than forty characters"
    items = spark.createDataFrame([(name,), (f"the {name} again",)], "i string")
    names = spark.createDataFrame([(name,), ("name",)], "n string")
    assert {tuple(r) for r in M.longest_contained(items, "i", names, "n").collect()} == {(name, name, 0), (f"the {name} again", name, 2)}
    assert M.longest_contained(items, "i", names.limit(0), "n").count() == 0


def test_brackets_edits_repetition():
    items = G.bracket_items("糖, 醬油(水、鹽(海鹽)), 油)x")
    assert [(i["name"], i["path"]) for i in items] == [("糖", []), ("醬油", []), ("水", ["醬油"]), ("鹽", ["醬油"]), ("海鹽", ["醬油", "鹽"]), ("油", []), ("x", [])]
    assert G.bracket_items(None) == []
    for a, b in (("abc", "xxabdxx"), ("kitten", "a sitting b"), ("", "abc"), ("abc", "")):
        assert G.substring_edits(a, b) == min(edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
    assert G.repetition("start " + "ab" * 60) == 2 and G.repetition("all different words here") == 0 and G.repetition(None) == 0


def test_dbscan(spark):
    p = spark.createDataFrame([("g", i, float(x), 0.0) for i, x in enumerate([0, 0.5, 1, 9, 20, 20.4, 20.8])], "g string, k long, x double, y double")
    got = {r["k"]: r["cluster"] for r in G.dbscan(p, "g", "k", "x", "y", 0.6).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: -1, 4: 1, 5: 1, 6: 1}


def test_insert_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("\\connect x\nINSERT INTO t (a, b) VALUES (1, 'it''s, ok');\nINSERT INTO t (a, b) VALUES (2, NULL);\nINSERT INTO u (a) VALUES (3);\n")
    rows = S.insert_dump(spark, str(tmp_path / "d.sql"), "t", ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [("1", "it's, ok"), ("2", None)]


def test_ocr_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"case_id": "c1", "images": [{"path": "p", "lines": [{"text": "x", "score": 0.5, "box": [[1, 2], [5, 2], [5, 9], [1, 9]]}]}]}')
    r = S.ocr_lines(spark, str(tmp_path / "r.json")).first()
    assert (r["case_id"], r["image"], r["line"], r["x0"], r["y0"], r["x1"], r["y1"]) == ("c1", 0, 0, 1.0, 2.0, 5.0, 9.0)


def test_sinks(spark, tmp_path):
    from quern.sources import sinks

    rows = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("b,c", {"y": 0})], "id string, m map<string,int>").coalesce(1)
    assert sinks.segments_csv(rows, str(tmp_path / "csv"), ["id"], "m") == ["x", "y"]
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines() == ["id,x,y", "a,1,2", '"b,c",,0']
    old, new = (spark.createDataFrame(r, "k int, v int, at int") for r in ([(1, 10, 1), (2, 20, 1)], [(2, 21, 2), (3, 30, 2)]))
    assert sorted(map(tuple, sinks.replaced(old, new, "k", "at").collect())) == [(1, 10, 1), (2, 21, 2), (3, 30, 2)]


def test_changes(spark):
    from quern.operators import changes as C

    rows = spark.createDataFrame([(1, "a", "pending"), (2, "b", "done"), (3, "c", "pending")], "k int, v string, s string")
    decisions = spark.createDataFrame([(1, "ok"), (2, "no"), (9, "ok")], "k int, d string")
    assert [tuple(r) for r in C.transitioned(rows, decisions, "k", "s", "pending", "d").collect()] == [(1, "pending", "ok")]
    changes = spark.createDataFrame([(1, "v", "x", 1), (1, "v", "y", 2), (1, "k", "9", 3), (3, "v", None, 5)], "k int, name string, value string, o int")
    assert sorted(map(tuple, C.column_updates(rows, changes, "k", ["v"], "o").collect())) == [(1, "y", "pending"), (2, "b", "done"), (3, "c", "pending")]
    refs = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1), ("h", None)], "p string, r int")
    files = refs.select("p").distinct()
    assert [r["p"] for r in C.unreferenced(files, refs, "p", "r", spark.createDataFrame([(1,)], "r int")).collect()] == ["g"]
    assert C.filtered(rows, s=None, k=[1, 2]).count() == 2


def test_cooled_down(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 300), i) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, s long, i int").repartition(4)
    want, last = set(), {}
    for k, s, i in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        if k not in last or s - last[k] >= 20:
            want.add(i)
            last[k] = s
    assert {r["i"] for r in T.cooled_down(d, "k", "s", ["s", "i"], 20).collect() if r["searched"]} == want


def test_label_functions(spark):
    from quern.functions import labels as L

    r = one(
        spark, deep=L.outside_brackets(F.lit("a" + "(" * 9 + "x" + ")" * 9 + "b{c[d]}")), open=L.outside_brackets(F.lit("a(b")), none=L.outside_brackets(F.lit(None).cast("string")),
        name=L.label_name(F.lit("５’－次黃（x） Ab")), note=L.is_note(F.lit("玉米來源")), item=L.item_name(F.lit(" ●含大豆及其製品。")), score=L.title_score(F.lit("張三 - 一則個人貼文的標題"), F.lit("news")),
        nine=L.number_present(F.lit("9"), F.lit("x 9.0g")), no=L.number_present(F.lit("9"), F.lit("19 9.5")), json=L.greedy_json(F.lit('a {"b": {"c": 1}} d')), bad=L.greedy_json(F.lit("a {b} d")),
        shown=L.display_name(F.lit("鹽"), F.lit(None).cast("string"), F.array(F.lit("食鹽"), F.lit("salt"))), scope=L.evidence_scope(F.lit("https://www.WHO.int/x"), F.lit(None).cast("string")), down=L.must_degrade(F.lit(None).cast("int"), F.lit(False)),
    )
    assert (r["deep"], r["open"], r["none"], r["name"], r["note"], r["item"], r["score"]) == ("ab", "a(b", None, "5-次黃Ab", True, "大豆", 10)
    assert (r["nine"], r["no"], r["json"], r["bad"], r["shown"], r["scope"], r["down"]) == (True, False, '{"b": {"c": 1}}', None, "salt (鹽)", "regulatory_or_authority", False)


def test_short_numbers(spark):
    """Six significant digits as %g prints them, and the readings with a leading digit lost."""
    for v in (330.8, 0.0, 5.0, 68423.46, 0.00123456789, 123456.7, 9.9999999, 1234567.0):
        r = one(spark, s=N.significant(F.lit(v)), c=N.repairs(F.lit(v)))
        assert r["s"] == float(f"{v:g}"), v
        assert all(abs(a - float(f"{d}{v:g}")) <= 1e-6 * max(1, abs(a)) for d, a in zip(range(1, 10), r["c"])), (v, r["c"])


def test_best_member_with_large_keys(spark, tmp_path):
    import duckdb

    from quern.plans import queries

    rows = [(1, "a", 10.01, "x", 0), (900000, "b", 10.0, "x", 0), (5, "c", 1.0, "y", 0), (6, "d", 2.0, "y", 0)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, c_nationkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "n")], "n_nationkey long, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    db = duckdb.connect()
    for t in ("customer", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(db.execute(queries.SQL["group_best_member"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["group_best_member"](spark, str(tmp_path)).collect())) == want
    assert [r[-1] for r in want] == ["b", "d"]


def test_deep_brackets_leave_a_task_in_batches(spark):
    deep = "(".join(f"n{i}" for i in range(3000))
    df = spark.createDataFrame([(1, deep), (2, None), (3, "a(b),(c")], "k long, t string").coalesce(1)
    rows = {(r.k, r.place): r for r in G.flattened(df, "k", "t", most=10_000).collect()}
    assert len(rows) == 3003 and rows[1, 2999].path == ">".join(f"n{i}" for i in range(2999)) and rows[1, 2999].depth == 2999
    assert [(rows[3, i].name, rows[3, i].path, rows[3, i].depth) for i in range(3)] == [("a", "", 0), ("b", "a", 1), ("c", "", 1)]
    assert not any("Python" in n and "Arrow" in n and "Eval" in n for n in G.flattened(df, "k", "t")._jdf.queryExecution().toString().split())  # no text's items are one value
