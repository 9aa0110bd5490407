"""Allergen warnings against a reader that goes through each label's lines."""

import random
import re
from collections import defaultdict

from quern.operators import warnings as W


def about(s):
    return any(w in s for w in W.ABOUT) and not any(w in s for w in W.NOT_ABOUT)


def shortened(s):
    m = re.search(W.FIELD, s)
    if m and m.start() >= 6:
        s = s[: m.start()]
    kept = ""
    for c in re.split(r"(?<=[。;；])|(?=[※*●])", s):
        c = c.strip()
        if c and kept and not about(c):
            break
        kept += c
    ends = [i + len(w) for w in W.ENDINGS for i in range(len(kept)) if kept.startswith(w, i)]
    if ends:
        end = max(ends)
        kept = kept[: end + 1] if kept[end : end + 1] in ("。", ".", "）", ")") else kept[:end]
    return kept.strip("　 ,，、●※*()（）")


def slow(lines):
    lines, best = [(t or "").strip() for t in lines], None
    for i, line in enumerate(lines):
        m = re.search(W.OPENING, line)
        if not m or line[m.start()] == "含" and re.search(r"\d\s*(?:" + "|".join(W.UNITS) + ")", line):
            continue
        if re.match(W.AMOUNTS.removeprefix("(?i)"), line, re.I):
            continue
        parts = [line[m.start() :]]
        for nxt in lines[i + 1 :]:
            if re.match(W.AMOUNTS.removeprefix("(?i)"), nxt, re.I):
                continue
            own = re.match(r"\s*[※*]|\s*" + W.THEIRS, nxt)
            if len(parts) == 4 or not nxt or re.match(W.HEADED, nxt) or parts[-1].endswith(("。", ".")) and not own:
                break
            parts.append(nxt)
        s = shortened(re.sub(r"^\s*[※*●(（]*\s*(?:" + "|".join(W.HEADINGS) + r")\s*[：:]?\s*", "", "".join(parts)))
        if len(s) >= 6 and about(s) and (best is None or len(s) > len(best)):
            best = s
    return best


def test_hand_written_labels(spark):
    labels = {
        1: ["品名：餅乾", "一搖·原產地：台灣·過敏原資訊：本產品含牛奶、大豆及", "其製品。", "內容量：5公克"], 2: ["本產品含咖啡因20mg以下"], 3: ["※含麩質之穀物、雞蛋、", "553毫克730毫克", "芝麻、大豆", "營養標示"],
        4: ["水、乾酪素鈉、含糖", "成分：花生"], 5: ["該生產線亦生產花生。", "※本產品含有蝦、蟹，不適合對其過敏體質者食用。沉澱為黃豆纖維。"], 6: [None, ""], 7: ["含質之穀物1.6公克大豆製品"], 8: ["本產品含有牛奶。品 質乳製品含量50%"],
    }
    rows = [(k, i, t) for k, v in labels.items() for i, t in enumerate(v)]
    got = {r.k: (r.warning, r.allergens) for r in W.allergen_warnings(spark.createDataFrame(rows, "k long, no long, text string"), "k").collect()}
    assert got[1] == ("本產品含牛奶、大豆及其製品。", ["大豆", "牛奶"]) and got[3][0] == "含麩質之穀物、雞蛋、芝麻、大豆"
    assert got[5][0] == "該生產線亦生產花生。※本產品含有蝦、蟹，不適合對其過敏體質者食用。" and got[8][0] == "本產品含有牛奶。"
    assert set(got) == {1, 3, 5, 8}
    assert {k: v for k, v in ((k, slow(v)) for k, v in labels.items()) if v} == {k: v[0] for k, v in got.items()}


def test_random_labels_like_a_reader(spark):
    rng = random.Random(3)
    words = ["本產品含有", "過敏原：", "牛奶", "、大豆", "及其製品", "。", "※", "●", "該生產線亦生產", "含", "蛋", "成分", "：", "沉澱", "保存方式：", "12毫克", "x", " ", "食用", ";", "品質", "淨重", "(", "）", "小麥", "不適合", "有限公司"]
    labels = {k: ["".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(rng.randint(0, 8))] for k in range(600)}
    rows = [(k, i, t) for k, v in labels.items() for i, t in enumerate(v)]
    got = {r.k: r.warning for r in W.allergen_warnings(spark.createDataFrame(rows, "k long, no long, text string"), "k").collect()}
    want = {k: w for k, v in labels.items() if (w := slow(v))}
    assert got == want and len(want) > 150


def test_query(spark):
    from quern.plans import warnings as P

    sf = "/root/testdata/sf0.001"
    labels = defaultdict(list)
    for r in sorted(P.label_lines(spark, sf).collect(), key=lambda r: (r.doc_id, r.no)):
        labels[r.doc_id].append(r.text)
    got = {r.doc_id: r.warning for r in P.allergen_warnings(spark, sf).collect()}
    assert got == {k: w for k, v in labels.items() if (w := slow(v))} and len(got) > 50
