"""Source divergence against plain Python with whole numbers of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import divergence


def brute(rows, least=3, top=200):
    """{(lang, source, part): [(item, value), ...] by rank}."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))) for text, lang, source in rows]
    counts, standing = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        counts[lang, source].update(words)
        standing[lang].update(set(words))
    out = {}
    for lang in standing:
        kept = {t for t, n in standing[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (name, s), c in counts.items() if name == lang}
        share = {s: {t: 1 + 10**9 * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in groups.items()}
        total = Counter()
        for c in groups.values():
            total.update(c)
        whole = {t: 1 + 10**9 * (total[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in groups:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in groups if o != s]
            out[lang, s, "pair"] = sorted(pairs, key=lambda x: (-x[1], x[0].encode()))
            terms = [(t, f(share[s][t], whole[t])) for t in groups[s] if share[s][t] > whole[t]]
            out[lang, s, "term"] = sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:top]
    return {k: v for k, v in out.items() if v}


def as_ranks(df):
    got = defaultdict(list)
    for r in df.orderBy("rank").collect():
        got[r["lang"], r["source"], r["part"]].append((r["item"], r["value"]))
        assert r["rank"] == len(got[r["lang"], r["source"], r["part"]])
    return dict(got)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").withColumn("value", F.lit(1)).withColumn("n", F.lit("x"))


def test_divergence_like_brute_force(spark):
    """Nulls, empty texts, groups and languages without terms, ties, repeated rows, clashing columns, characters of all planes."""
    rng = random.Random(11)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)] + ["Éa", "éa", "ß", "𝒳y", "漢字", "Straße"]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ä", None, "z9"])) for _ in range(150)]
    rows += [(None, "en", "quiet"), ("", "xx", "one"), ("only once", "xx", "two"), ("1 2 3 _-", "de", "digits"), ("same\x00Same[same]same{same", "yy", "s")] + [("Copy copy COPY", "en", "a")] * 9
    got = as_ranks(divergence.audit(frame(spark, rows)))
    assert got == brute(rows)
    assert ("en", "quiet", "pair") in got and ("xx", "one", "pair") in got and ("yy", "s", "pair") not in got
    assert as_ranks(divergence.audit(frame(spark, rows), least=1, top=3)) == {k: v if k[2] == "pair" else v[:3] for k, v in brute(rows, 1).items()}
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_divergence_blocks_and_ranks(spark, monkeypatch):
    """Small blocks, tiles and memory bounds give the same, and ranks end at 200 with ties by bytes."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=4)) for _ in range(900)]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) ** 0.7 for i in range(900)], k=200)), "en", f"s{i % 7}") for i in range(120)]
    want = brute(rows)
    assert max(len(v) for v in want.values()) == 200
    assert as_ranks(divergence.audit(frame(spark, rows))) == want
    shuffled = list(divergence.joint_cells(np.arange(1, 50, dtype=np.uint64)[:, None], most=7))
    cells = {(a, b): n for i, j, k in shuffled for a, b, n in zip(i.tolist(), j.tolist(), k.tolist())}
    assert cells == {(a, b): n for a in range(49) for b in range(49) if (n := ((a + 1) & (b + 1)).bit_count())}
    partial = divergence.counted_terms(frame(spark, rows), most=50).groupBy("source", "term").agg(F.sum("n").alias("n"))
    assert {(r["source"], r["term"]): r["n"] for r in partial.collect() if r["term"]} == {(s, t): n for s in {r[2] for r in rows} for t, n in Counter(w for x in rows if x[2] == s for w in x[0].split()).items()}


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(2000):
        whole = rng.randint(1, 9 * 10**15)
        count = rng.randint(0, whole - 1)
        assert int(divergence.shares(np.array([count]), whole)[0]) == 1 + 10**9 * (count + 1) // whole


@pytest.mark.parametrize("most", [7, 40, 10_000])
def test_words_in_pieces(most):
    text = ("Ab cé-漢字 " * 30 + "x" * 50).encode()
    want = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.decode().lower())
    got = [w.decode() for part in divergence.words_of(text, most) for w in part]
    assert got == want
