"""Ingredient trees, flattening and matching against recursion and loops."""

import random
import re

import pytest

from quern.operators import ingredients as N

TERMS = frozenset(N.GENERIC)


def slow_tree(text):
    """Recursive descent over one level at a time."""

    def level(i):
        nodes, buf, open_ = [], "", None

        def flush():
            nonlocal buf
            if buf.strip():
                if open_:
                    open_[0] = (open_[0] + buf.strip()).strip()
                else:
                    nodes.append([buf.strip(), []])
            buf = ""

        while i < len(text):
            c = text[i]
            if c in N.OPEN:
                children, i = level(i + 1)
                if open_ and not buf.strip():
                    open_[1] += children
                else:
                    open_ = [buf.strip(), children]
                    nodes.append(open_)
                buf = ""
                continue
            if c in N.CLOSE:
                flush()
                return nodes, i + 1
            if c in N.SEPARATORS:
                flush()
                open_ = None
            else:
                buf += c
            i += 1
        flush()
        return nodes, i

    out, i = [], 0
    while i < len(text):
        nodes, i = level(i)
        out += nodes
    return [n for n in out if n[0] or n[1]]


def test_trees_like_recursion():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("ab 、,;(（)）[]") for _ in range(rng.randint(0, 25)))
        assert N.tree(text) == slow_tree(text), text
    assert N.tree("(" * 100_000 + "a") and len(N.tree("a、" * 50_000)) == 50_000


def items(text, substances=()):
    return {r["name"]: (r["kind"], ">".join(r["path"]), r["occurrences"]) for r in N.flat_items(text, TERMS, frozenset(substances))}


def test_decision_table():
    assert items("乳化劑(脂肪酸甘油酯)") == {"脂肪酸甘油酯": ("generic_item", "乳化劑", 1)}
    assert items("香料、水") == {"香料": ("top", "", 1), "水": ("top", "", 1)}
    assert items("辣豆瓣醬(辣椒、黃豆、鹽)、鹽") == {"辣豆瓣醬": ("top", "", 1), "辣椒": ("component", "辣豆瓣醬", 1), "黃豆": ("component", "辣豆瓣醬", 1), "鹽": ("component", "辣豆瓣醬", 2)}
    assert items("醋酸鈉(無水)、豬油(西班牙)、維生素C(抗氧化劑)") == {"醋酸鈉(無水)": ("top", "", 1), "豬油(西班牙)": ("top", "", 1), "維生素C(抗氧化劑)": ("top", "", 1)}
    assert items("香油(大豆油、芝麻油)") == {"香油": ("top", "", 1), "大豆油": ("component", "香油", 1), "芝麻油": ("component", "香油", 1)}
    assert items("香油(大豆油、芝麻油)", ["香油"]) == {"香油(大豆油、芝麻油)": ("top", "", 1)}
    assert items("色素(無水、70%)") == {"色素": ("generic_only", "", 1)}
    assert items("麵包(麵粉、糖、麵糰改良劑(維生素C、酵素製劑))")["維生素C"] == ("component", "麵包>麵糰改良劑", 1)
    assert set(items("黃梔子色素(麥芽糊精、黃梔子色素、水))、鹽、糖")) == {"黃梔子色素", "麥芽糊精", "水", "鹽", "糖"}
    assert set(items("醬(甘草酸鈉),八角),澱粉、糖")) == {"醬", "甘草酸鈉", "八角", "澱粉", "糖"}
    assert items("維生素E(抗氧化劑)等、品質改良劑(醋酸鈉)(無水)") == {"維生素E(抗氧化劑)": ("top", "", 1), "醋酸鈉": ("generic_item", "品質改良劑", 1)}
    assert items(None) == items("") == items("、、()") == {}


def test_candidates_and_keys(spark):
    from pyspark.sql import functions as F

    from quern.functions.labels import label_name

    c = lambda t: N.candidates(t, TERMS)
    assert c("乳化劑(β-胡蘿蔔素)") == ["β-胡蘿蔔素", "乳化劑"] and c("維生素C(抗氧化劑)") == ["維生素C", "抗氧化劑"] and c("醋酸鈉(無水)") == ["醋酸鈉", "無水"]
    assert c("醬(甲油、乙油、丙油)") == ["醬"] and c("複方調味劑(甲酸、乙酸)") == ["甲酸", "乙酸", "複方調味劑"] and c("鹽(x)") == ["鹽"] and c("") == []
    same = ["5'-次黃嘌呤核苷磷酸二鈉", "5’-次黃嘌呤核苷磷酸二鈉", "5′-次黃嘌呤核苷磷酸二鈉", "5-次黃嘌呤核苷磷酸二鈉"]
    assert len({N.key_of(s) for s in same}) == 1 and N.key_of("DL-蘋果酸") == "DL-蘋果酸" and N.key_of("（Ａ） b (c) d") == "bd"
    texts = [*same, "DL-蘋果酸", "Ａ（b）c ‐d", "a(b(c)d)e", "`x´ ", "", "複方 色素"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", label_name(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == {t: N.key_of(t) for t in texts}


def slow_match(norm, knowledge):
    """(id, how) by a loop over the dictionary, longest names first."""
    best = None
    for id_, name, english, aliases in sorted(knowledge, key=lambda a: (-len(a[1] or ""), a[0])):
        n, parts, al = N.key_of(name or ""), [p for p in (N.key_of(x) for x in re.split("[;；、]", name or "")) if p], [N.key_of(a) for a in aliases or [] if a]
        if norm in [n, *parts, *al]:
            hit = (0, len(norm), "equal")
        elif n and n in norm:
            hit = (2, len(n), "name")
        elif any(p in norm for p in parts):
            hit = (2, max(len(p) for p in parts if p in norm), "part")
        elif english and english.lower() in norm.lower():
            hit = (2, len(english), "english")
        elif any(a and a in norm for a in al):
            hit = (2, len(next(a for a in al if a and a in norm)), "alias")
        else:
            continue
        if hit[0] == 2 and (hit[1] / len(norm) < 0.6 or norm.endswith(tuple(N.ORGANISMS)) or norm.upper().startswith("DL-") and any(x.upper().startswith("L-") for x in [n, *parts, *al])):
            continue
        if best is None or (hit[0], -hit[1]) < best[0]:
            best = (hit[0], -hit[1]), id_, hit[2]
    return best and best[1:]


KNOWN = [
    (1, "碳酸鈉、無水碳酸鈉", None, ["蘇打灰"]), (2, "碳酸氫鈉", "Sodium bicarbonate", ["小蘇打"]), (3, "醋酸鈉； 醋酸鈉（無水）", None, None), (4, "醋酸", None, []), (5, "乳酸", "Lactic acid", None), (6, "L-丙胺酸", None, ["L-Ala"]),
    (7, "DL-蘋果酸", None, None), (8, "檸檬酸", "Citric Acid", ["", None, "枸櫞酸"]), (9, "5’-次黃嘌呤核苷磷酸二鈉", None, None), (10, None, "Nothing", ["無名"]), (11, "甜味劑", None, None), (12, "檸檬酸", None, None), (13, "abc", "zz", ["ab", "abcd"]),
]


def test_matching_like_loops(spark):
    rng = random.Random(2)
    names = ["小蘇打", "醋酸鈉(無水)", "活性乳酸菌", "乳酸菌", "DL-丙胺酸", "DL-蘋果酸", "檸檬酸鈉", "焦糖糖漿", "5'-次黃嘌呤核苷磷酸二鈉", "5-次黃嘌呤核苷磷酸二鈉", "甘草(甜味劑)", "甜味劑", "甜味劑(甘草酸鈉、檸檬酸)", "水", "純 水", "citric ACID x", "枸櫞酸", "調味劑(L-丙胺酸、醋酸、乳酸)", "醬(醋酸、乳酸、檸檬酸)", "蘇打灰a", "無名", "無名氏", "abcde", "ab", "NOTHING", "鹽", "L-丙胺酸"]
    texts = [(i, "、".join(rng.choices(names, k=rng.randint(0, 9)))) for i in range(60)] + [(98, None), (99, "abc" * 3000)]
    df = spark.createDataFrame(texts, "i long, t string")
    additives = spark.createDataFrame(KNOWN, "id long, name string, english string, aliases array<string>")
    substances = {N.key_of(n) for _, n, _, _ in KNOWN if n}
    rows = N.matched(N.items_of(df, "i", "t", additives.where("name is not null").select("name")), additives, "i")
    got = {}
    for r in rows.collect():
        assert (r.i, r.place) not in got
        got[r.i, r.place] = (r.name, r.kind, r.occurrences, r.id, r.how, r.basis)
    want = {}
    for i, t in texts:
        for place, x in enumerate(N.flat_items(t, TERMS, frozenset(substances))):
            cands, hit = N.candidates(x["name"], TERMS), None
            outer = N.is_generic(N.key_of(N.outside(x["name"])), TERMS)
            water = N.key_of(x["name"]) in N.WATERS
            if not water and not (outer and len(cands) <= 1):
                hit = next((m for c in cands if not N.is_generic(c, TERMS) and (m := slow_match(c, KNOWN))), None)
            want[i, place] = (x["name"], x["kind"], x["occurrences"], *(hit or (None, None)), "additive_db" if hit else "water" if water else "generic_term" if outer else "none")
    assert got == want and {w[4] for w in want.values()} >= {"equal", "name", "english", None} and len({w[5] for w in want.values()}) == 4
    by = {r.i: r for r in N.coverage(rows, "i").collect()}
    for i in by:
        mine = [want[k] for k in sorted(want) if k[0] == i]
        assert by[i].unlisted == [w[0] for w in mine if w[5] == "none"] and by[i].additives == sum(w[5] == "additive_db" for w in mine)
    assert N.matched(N.items_of(df.limit(0), "i", "t"), additives, "i").count() == 0


def test_query_over_orders(spark):
    from quern.plans import ingredients as P

    sf = "/root/testdata/sf0.001"
    sections = {r.l_orderkey: r.section for r in P.order_sections(spark, sf).where("l_orderkey % 13 = 0").collect()}
    known = [tuple(r) for r in P.part_dictionary(spark, sf).select("id", "name", "english", "aliases").collect()]
    substances = frozenset(N.key_of(k[1]) for k in known)
    got = {(r.l_orderkey, r.place): (r.name, r.id, r.how, r.basis) for r in P.matched_ingredients(spark, sf).where("l_orderkey % 13 = 0").collect()}
    memo, want = {}, {}
    for key, text in sections.items():
        for place, x in enumerate(N.flat_items(text, TERMS, substances)):
            cands, outer = N.candidates(x["name"], TERMS), N.is_generic(N.key_of(N.outside(x["name"])), TERMS)
            hit = None
            if not (outer and len(cands) <= 1):
                for c in cands:
                    if not N.is_generic(c, TERMS):
                        if c not in memo:
                            memo[c] = slow_match(c, known)
                        hit = hit or memo[c]
            want[key, place] = (x["name"], *(hit or (None, None)), "additive_db" if hit else "generic_term" if outer else "none")
    assert len(want) > 100 and got == want


def test_names_are_read_once():
    from quern.operators import ingredients as N

    asked = []
    f = N.remembered(lambda t, *more: asked.append(t) or t + "".join(more), most=2, longest=5)
    assert [f("a"), f("a"), f("a", "b"), f("a"), f("abcdef"), f("abcdef")] == ["a", "a", "ab", "a", "abcdef", "abcdef"]
    assert asked == ["a", "a", "abcdef", "abcdef"]
    assert [f("c"), f("a")] == ["c", "a"] and asked[-2:] == ["c", "a"]  # bounded: the rest was given up


def test_few_and_many_names(spark, monkeypatch):
    """A dictionary of any size gives the same items; a name is looked up once, however many lists hold it."""
    texts = [(i, "、".join(["香油(大豆油、芝麻油)", "檸檬酸鈉", "甘草(甜味劑)", "乳化劑(脂肪酸甘油酯)"][: i % 5])) for i in range(40)] + [(90, None)]
    df = spark.createDataFrame(texts, "i long, t string")
    additives = spark.createDataFrame([*KNOWN, (99, "香油", None, None)], "id long, name string, english string, aliases array<string>")
    asked, look = [], N.known_names
    monkeypatch.setattr(N, "known_names", lambda wanted, names: asked.append(sorted(r.candidate for r in wanted.collect())) or look(wanted, names))
    got = []
    for few in (100_000, 0):
        monkeypatch.setattr(N, "FEW", few)
        got.append(sorted((r.i, r.place, r.name, r.id, r.how, r.basis) for r in N.matched(N.items_of(df, "i", "t", additives.select("name")), additives, "i").collect()))
    assert got[0] == got[1] and len(got[0]) == 8 * (1 + 2 + 3 + 4)
    assert asked[0] == asked[1] and len(asked[0]) == len(set(asked[0])) <= 9
    plan = N.items_of(df, "i", "t", additives.select("name"))._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(N, "FEW", 100_000)
    assert "Join" in plan and "Join" not in N.items_of(df, "i", "t", additives.select("name"))._jdf.queryExecution().executedPlan().toString()
