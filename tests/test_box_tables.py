"""Box tables against plain loops over each record's boxes."""

import random
import re
from collections import defaultdict

from quern.operators import box_tables as B

FIELDS = list(B.NAMES)


def kind(field, text):
    m = re.match(B.name_pattern(field), text)
    if m:
        tail = text[m.end() :]
        return "plain" if not tail.strip() else "with_values" if re.fullmatch(B.BESIDE_NAME, tail) and re.search(r"\d", tail) else None
    m = re.search(B.name_pattern(field), text)
    return "plain" if m and m.start() <= 1 and len(text) <= 8 else None


def slow_table(boxes):
    """{field: (a, b)} of one record's (no, text, box)."""
    items = []
    for no, text, box in boxes:
        if box and len(box) >= 4:
            xs, ys = [p[0] for p in box], [p[1] for p in box]
            t = (text or "").replace("·", ".").strip(" ")
            nums = [] if re.search(r"每\s*100|" + "|".join(B.HEADING_NUMBERS), t) else [float(v.replace(",", ".")) for v in re.findall(r"-?\d+(?:[.,]\d+)?", t)]
            unit = next((u for u, words in B.UNIT_WORDS.items() if re.search("|".join(words), t, re.I)), None)
            items.append({"no": no, "t": t, "x": sum(xs) / len(xs), "y": sum(ys) / len(ys), "w": max(xs) - min(xs), "h": max(ys) - min(ys), "nums": nums, "unit": unit})
    scope, most = items, 2
    for a in items:
        if any(h in a["t"] for h in B.HEADINGS):
            r = max(a["w"], a["h"])
            near = [i for i in items if a["x"] - 6 * r <= i["x"] <= a["x"] + 8 * r and a["y"] - 4 * r <= i["y"] <= a["y"] + 10 * r]
            n = sum(1 for i in near for f in FIELDS if re.search(B.name_pattern(f), i["t"]))
            if n > most:
                scope, most = near, n
    names, out = [], {}
    for f in FIELDS:
        for i in scope:
            if kind(f, i["t"]):
                names.append((f, i))
                if kind(f, i["t"]) == "with_values":
                    out[f] = (i["nums"][0], i["nums"][1] if len(i["nums"]) > 1 else None)
                break
    if not names:
        return {}
    mw, mh = (sum(i[k] for _, i in names) / len(names) for k in "wh")
    up = sum(i["h"] > i["w"] * 1.5 for _, i in names) * 2 > len(names)
    xs, ys = [i["x"] for _, i in names], [i["y"] for _, i in names]
    nums = [i for i in items if i["nums"] and min(xs) - mw * 8 <= i["x"] <= max(xs) + mw * 12 and min(ys) - mh * 8 <= i["y"] <= max(ys) + mh * 12]
    axis, cross = ("y", "x") if up else ("x", "y")
    ranked, bad = {}, False
    if len(names) >= 4 and nums:
        along = sorted((i for i in nums if i[axis] > 0), key=lambda i: (i[axis], i["no"]))
        at = [i[axis] for _, i in names]
        groups, last = [], None
        for i in along:
            if last is None or i[axis] - last > max((max(at) - min(at)) * 0.5, 40):
                groups.append([])
            groups[-1].append(i)
            last = i[axis]
        columns = []
        for g in groups:
            g = sorted(g, key=lambda i: (i[cross], i[axis], i["no"]))
            if sum(i[axis] > max(at) for i in g) >= len(g) * 0.6 and len(g) >= len(names):
                columns.append(g[len(g) - len(names) :])
        columns.sort(key=lambda g: sum(i[axis] for i in g) / len(g))
        for k, (f, _) in enumerate(sorted(names, key=lambda n: n[1][cross])):
            cells = [c[k] for c in columns[:2]]
            if cells:
                ranked[f] = (cells[0]["nums"][0], cells[1]["nums"][0] if len(cells) > 1 else None)
                bad |= any(c["unit"] and f not in B.UNIT_FIELDS[c["unit"]] for c in cells)
    ranked = {} if bad else ranked
    if len(ranked) >= 4:
        return {**out, **ranked}
    out = {**ranked, **out}
    for f, name in names:
        if f in out and out[f][1] is not None:
            continue
        if name["h"] > name["w"] * 1.5:
            band = sorted((i for i in nums if i is not name and abs(i["x"] - name["x"]) <= max(name["w"], mw) * 0.9 and i["y"] > name["y"]), key=lambda i: (i["y"], i["no"]))
        else:
            band = sorted((i for i in nums if i is not name and abs(i["y"] - name["y"]) <= max(name["h"], mh) * 0.7 and i["x"] > name["x"]), key=lambda i: (i["x"], i["no"]))
        flat = [v for i in band for v in i["nums"]]
        if flat:
            out[f] = (out[f][0], flat[0]) if f in out else (flat[0], flat[1] if len(flat) > 1 else None)
    return out


def quad(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def random_record(rng):
    """A table with a heading, tilt, gaps, noise, upright or not, names with numbers in one box; now and then only noise."""
    boxes, up, tilt = [], rng.random() < 0.4, rng.choice([0, 0, 0.2])
    put = lambda t, x, y, w, h: boxes.append((t, quad(y, x, h, w) if up else quad(x, y, w, h)))
    if rng.random() < 0.7:
        put(rng.choice(["營養標示", "每一份量 353公克"]), 40, 20, 160, 30)
    for r, f in enumerate(rng.sample(FIELDS, rng.randint(1, 9))):
        y, name = 80 + 50 * r, rng.choice(B.NAMES[f])
        unit = {"calories": "大卡", "sodium": "毫克"}.get(f, "公克") if rng.random() < 0.6 else ""
        value = lambda u=unit: f"{rng.randint(0, 400) / 10}{u}"
        style = rng.random()
        if style < 0.15:
            put(f"{name}{value()}{value()}", 50, y, 200, 30)
            continue
        if style < 0.9:
            put(name + rng.choice(["", "", "x"]), 50, y, rng.choice([90, 20]), 30)
        for c in range(rng.choice([2, 2, 2, 1])):
            if rng.random() < 0.93:
                put(rng.choice([value(), value(), value() + " " + value(), value().replace(".", "·")]), 260 + 200 * c, y + tilt * (260 + 200 * c), 80, 30)
    for _ in range(rng.randint(0, 3)):
        put(rng.choice(["12", "地址 5號", "磷酸鈉", "含糖量高的長串文字糖", "１２３", "", None]), rng.randint(-50, 3000), rng.randint(-50, 3000), 60, 30)
    rng.shuffle(boxes) if rng.random() < 0.2 else None
    return boxes


def test_like_loops(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for case in range(250):
        boxes = [(no, t, b) for no, (t, b) in enumerate(random_record(rng))] + [(98, "熱量", None), (99, "12", [[1.0, 2.0]])]
        boxes = [(no, t, None if b is None else [[float(v) for v in p] for p in b]) for no, t, b in boxes]
        rows += [(case, no, t, b) for no, t, b in boxes]
        want[case] = slow_table(boxes)
    df = spark.createDataFrame(rows, "case long, no long, text string, box array<array<double>>")
    got, how = defaultdict(dict), defaultdict(int)
    for r in B.box_tables(df, "case").collect():
        assert r.field not in got[r.case]
        got[r.case][r.field] = (r.a, r.b)
        how[r.how] += 1
    assert set(how) == {"rank", "same_box", "band"} and min(how.values()) > 20
    for case in want:
        assert got.get(case, {}) == want[case], (case, [r for r in rows if r[0] == case])
    assert B.box_tables(df.limit(0), "case").count() == 0


def test_boxes_of_orders(spark):
    from quern.plans import label_tables as P

    sf = "/root/testdata/sf0.001"
    boxes, got = defaultdict(list), defaultdict(dict)
    for r in P.order_boxes(spark, sf).collect():
        boxes[r.l_orderkey].append((r.no, r.text, r.box))
    for r in P.box_table_cells(spark, sf).collect():
        got[r.l_orderkey][r.field] = (r.a, r.b)
    assert len(boxes) > 1000
    for case, b in boxes.items():
        assert got.get(case, {}) == slow_table(sorted(b)), case


def test_texts_are_read_once(spark, monkeypatch):
    """Boxes hold the same texts over and over: each is held against the patterns once, however many boxes have it; none is read as empty."""
    read, seen = B.read_texts, []
    monkeypatch.setattr(B, "read_texts", lambda texts: seen.append(sorted(r.text for r in texts.collect())) or read(texts))
    box = lambda x, y: [[x, y], [x + 80, y], [x + 80, y + 30], [x, y + 30]]
    rows = [(k, no, t, box(x, y)) for k in range(50) for no, (t, x, y) in enumerate([("鈉", 50.0, 80.0), ("５·5毫克", 260.0, 80.0), ("脂肪", 50.0, 130.0), ("5", 260.0, 130.0), ("7", 460.0, 130.0), (None, 50.0, 500.0)])]
    df = spark.createDataFrame(rows, "case long, no long, text string, box array<array<double>>")
    got = sorted((r.case, r.field, r.a, r.b) for r in B.box_tables(df, "case").collect())
    assert got == sorted(x for k in range(50) for x in ((k, "sodium", 5.5, None), (k, "fat", 5.0, 7.0)))
    assert seen == [sorted({t or "" for _, _, t, _ in rows})]


def test_pictures_in_batches_like_loops(spark, monkeypatch):
    """Pictures of few plain boxes meet in batches, over several of Arrow's; those with many boxes or odd ones go by joins."""
    from quern.operators import pictures as P

    rng = random.Random(14)
    rows, want = [], {}
    for case in range(120):
        boxes = [(no, t, b) for no, (t, b) in enumerate(random_record(rng))] + [(98, "熱量", None), (99, "12", [[1.0, 2.0]])]
        if case % 50 == 7:  # no numbers in a point of a box without text: it has no place
            boxes.append((97, "", [[1.0, 2.0], [1.0, 2.0], [None, 2.0], [1.0, 2.0]]))
        rows += [(case, no, t, b and [[v if v is None else float(v) for v in p] for p in b]) for no, t, b in boxes]
        want[case] = slow_table([x for x in boxes if x[0] != 97])
    df = spark.createDataFrame(rows, "case long, no long, text string, box array<array<double>>")
    ways, joined = [], B.box_tables
    monkeypatch.setattr(B, "box_tables", lambda boxes, key: ways.extend(r.case for r in boxes.select("case").distinct().collect()) or joined(boxes, key))
    monkeypatch.setattr(P, "MOST", 28)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = defaultdict(dict)
        for r in B.picture_tables(P.boxes_in_rows(df, "case"), "case").collect():
            assert r.field not in got[r.case]
            got[r.case][r.field] = (r.a, r.b)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = {c: sum(r[0] == c for r in rows) for c in want}
    assert set(ways) == {c for c in want if n[c] > 28 or c % 50 == 7} and 2 < len(ways) < 60
    for case in want:
        assert got.get(case, {}) == want[case], (case, [r for r in rows if r[0] == case])
