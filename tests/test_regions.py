"""Regions of pictures against loops with union-find."""

import random
import re
import statistics

from quern.operators import regions as G


def union(boxes):
    return tuple(f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max)))


def grouped(items, unit):
    """Union-find over all pairs; lists of places, by their first."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(items):
        for j, b in enumerate(items[:i]):
            dx, dy = (max(0, b[k] - a[k + 2], a[k] - b[k + 2]) for k in (0, 1))
            if max(dx, dy) <= 1.5 * unit:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i in range(len(items)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def slow(lines):
    """(nutrition, ingredients, how, anchored) of one picture's (no, text, box)."""
    rows = []
    for _, t, box in sorted(lines):
        if box and len(box) >= 2:
            b = union([(p[0], p[1], p[0], p[1]) for p in box])
            rows.append((t or "", b, max(b[2] - b[0], b[3] - b[1]), min(b[2] - b[0], b[3] - b[1]), ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)))
    if not rows:
        return None
    bare = lambda t: "".join(c for c in t if c.isalnum())
    unit = statistics.median(r[3] for r in rows) or 1.0
    least = sorted(r[2] for r in rows)[int(0.9 * (len(rows) - 1))] * 0.45
    words = [[w for w in G.TABLE_WORDS if w in bare(r[0])] for r in rows]
    mine, how = set(), None
    if len({w for ws in words for w in ws}) >= 3:
        mine, how = {i for i, ws in enumerate(words) if ws}, "words"
    else:
        cells = [i for i, r in enumerate(rows) if r[2] < least and any(u in r[0] for u in G.CELL_UNITS)]
        if len(cells) >= 6:
            best = max(grouped([rows[i][1] for i in cells], unit), key=len)
            if len(best) >= 6:
                mine, how = {cells[i] for i in best}, "cells"
    table = union([rows[i][1] for i in mine]) if mine else None
    if mine:
        for _ in range(2):
            for i, r in enumerate(rows):
                (x, y), room = r[4], 3 * unit
                if r[2] < least and re.search(r"\d|克|大卡|公毫", r[0]) and table[0] - room <= x <= table[2] + room and table[1] - room <= y <= table[3] + room:
                    mine.add(i)
            table = union([rows[i][1] for i in mine])
        under = [i for i, r in enumerate(rows) if table[0] - unit <= r[4][0] <= table[2] + unit and table[3] < r[4][1] <= table[3] + 2 * unit and r[1][3] - r[1][1] <= 2 * unit]
        for i in under:
            if re.search(G.SODIUM, rows[i][0]):
                beside = {j for j in under if rows[j][4][0] >= rows[i][4][0] and abs(rows[j][4][1] - rows[i][4][1]) <= unit and re.search(G.MILLIGRAMS, rows[j][0])}
                if beside:
                    table = union([table, *(rows[j][1] for j in beside | {i})])
                    mine |= beside | {i}
                    break
    rest = [i for i, r in enumerate(rows) if i not in mine and (r[2] >= least or len(re.findall("[、，,；;]", r[0])) >= 2)]
    if not rest:
        return table, None, how, None
    blocks = []
    for g in grouped([rows[i][1] for i in rest], unit):
        text = bare("".join(rows[rest[i]][0] for i in g))
        blocks.append((union([rows[rest[i]][1] for i in g]), len(g), text, any(w in text for w in G.INGREDIENT_WORDS)))
    if any(b[3] for b in blocks):
        return table, union([b[0] for b in blocks if b[3] or b[1] >= 2]), how, True
    return table, max(blocks, key=lambda b: len(b[2]))[0], how, False


def picture(rng):
    lines, put = [], lambda t, x, y, w, h: lines.append((len(lines), t, [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]))
    good = rng.random()
    for r, name in enumerate(rng.sample(G.TABLE_WORDS, rng.randint(0, 7))):
        put(name if good < 0.6 else "x量", 900, 40 * r, 90, 20)
        for c in range(2):
            put(f"{rng.randint(0, 99)}.5" + rng.choice(["公克", "大卡", "克", ""]), 1010 + 90 * c, 40 * r + rng.randint(-3, 3), 60, 20)
    if rng.random() < 0.4:
        put("鈉 ", 900, 40 * 7 + rng.randint(0, 30), 60, 20)
        put("30毫克 60 mg", 1000, 40 * 7 + rng.randint(0, 40), 150, 20)
    for _ in range(rng.randint(0, 3)):
        x, y = rng.randint(0, 400), rng.randint(0, 900)
        for k in range(rng.randint(1, 4)):
            put(rng.choice(["成分:水、糖、鹽", "麵粉、油、", "long line of text", ""]) + "字" * rng.randint(0, 9), x, y + k * rng.choice([25, 60]), rng.choice([500, 700, 60]), 20)
    for _ in range(rng.randint(0, 4)):
        put(rng.choice(["12公克", "x", None, "a,b;c", "5"]), rng.randint(-200, 1500), rng.randint(-200, 900), rng.choice([30, 80, 800]), rng.choice([0, 20, 30]))
    return lines + [(99, "成分", None)]


def test_like_loops(spark):
    rng = random.Random(12)
    pictures = {k: picture(rng) for k in range(160)}
    rows = [(k, *line) for k, v in pictures.items() for line in v]
    df = spark.createDataFrame(rows, "k long, no long, text string, box array<array<double>>")
    box = lambda b: None if b is None else tuple(b)
    got = {r.k: (box(r.nutrition), box(r.ingredients), r.how, r.anchored) for r in G.regions(df, "k").collect()}
    want = {k: w for k, v in pictures.items() if (w := slow(v)) is not None}
    assert got == want and {w[2] for w in want.values()} == {"words", "cells", None} and {w[3] for w in want.values()} >= {True, False}


def test_query(spark):
    from quern.plans import label_tables as P

    pictures = {}
    sf = "/root/testdata/sf0.001"
    for r in P.order_pictures(spark, sf).collect():
        pictures.setdefault(r.l_orderkey, []).append((r.no, r.text, r.box))
    box = lambda b: None if b is None else tuple(b)
    got = {r.l_orderkey: (box(r.nutrition), box(r.ingredients), r.how, r.anchored) for r in P.label_regions(spark, sf).collect()}
    for k in list(got)[::7]:
        assert got[k] == slow(pictures[k]), k
    assert len(got) == len(pictures)


def test_connected_by_rows_and_by_tiles(spark, monkeypatch):
    """Pictures of few lines write no tiles; larger ones give the same clusters by tiles."""
    rng = random.Random(5)
    rows = [(k, n, float(x), float(y), x + 60.0, y + 20.0, 20.0) for k in range(6) for n in range(3 * k + 2) for x, y in [(rng.randint(0, 400), rng.randint(0, 300))]]
    boxes = G.written(spark.createDataFrame(rows, "k long, no long, x0 double, y0 double, x1 double, y1 double, unit double"))
    got = []
    for many in (128, 5, 0):
        monkeypatch.setattr(G, "MANY", many)
        got.append({(r.k, r.no): r.cluster for r in G.clusters(boxes, "k").collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows) and len(set(got[0].values())) > 6
    plain = {}
    for k in range(6):
        mine = [r for r in rows if r[0] == k]
        plain |= {(k, mine[i][1]): mine[g[0]][1] for g in grouped([r[2:6] for r in mine], 20.0) for i in g}
    assert got[0] == plain
    monkeypatch.setattr(G, "MANY", 128)
    monkeypatch.setattr(G, "tiled_clusters", None)
    assert G.clusters(boxes, "k").count() == len(rows)


def test_pictures_in_batches_and_by_joins(spark, monkeypatch):
    """Pictures of few plain boxes meet in batches, over several of Spark's and of Arrow's; the rest, with too many boxes or odd ones, goes by joins with the same result."""
    from quern.operators import pictures as P

    rng = random.Random(21)
    pictures = {k: picture(rng) for k in range(40)}
    for k in range(0, 40, 9):  # a point without a number beside plain ones: no batch reads it, and its box is as without it
        pictures[k].append((98, "成分", [[5.0, 3.0], [None, 4.0], [7.0, 9.0]]))
    df = spark.createDataFrame([(k, *line) for k, v in pictures.items() for line in v], "k long, no long, text string, box array<array<double>>")
    ways, joined = [], G.joined_regions
    monkeypatch.setattr(G, "joined_regions", lambda lines, key: ways.extend(r.k for r in lines.select("k").distinct().collect()) or joined(lines, key))
    monkeypatch.setattr(P, "MOST", 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        box = lambda b: None if b is None else tuple(b)
        got = {r.k: (box(r.nutrition), box(r.ingredients), r.how, r.anchored) for r in G.regions(df, "k").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(ways) == {k for k, v in pictures.items() if len(v) > 12 or not k % 9} and len(ways) < 40
    plain = lambda v: [(no, t, b and [p for p in b if None not in p]) for no, t, b in v]
    assert got == {k: w for k, v in pictures.items() if (w := slow(plain(v))) is not None}


def test_lines_are_not_dealt_again(spark):
    """Pictures that come by key are read where they are: one exchange of lines, none of boxes."""
    from quern.operators import pictures as P
    from quern.plans import label_tables as L

    rows = L.order_rows(spark, "/root/testdata/sf0.001", ingredients=True)
    plan = P.with_sizes(rows, "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("Sort [") == 1 and "Generate" not in plan
