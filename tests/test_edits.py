"""Edit traces against a plain table, and by playing them back."""

import random
from collections import Counter

from quern.operators import edits as E


def slow(pattern, text):
    """(edits, ops) from the whole table."""
    cost = [[0] * (len(text) + 1)] + [[i] + [0] * len(text) for i in range(1, len(pattern) + 1)]
    for i, p in enumerate(pattern, 1):
        for j, t in enumerate(text, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (p != t), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    j = min(range(len(text) + 1), key=lambda j: cost[-1][j])
    i, edits, ops = len(pattern), cost[-1][j], []
    while i:
        if j and cost[i - 1][j - 1] + (pattern[i - 1] != text[j - 1]) == cost[i][j]:
            i, j = i - 1, j - 1
            ops += [("sub", i, pattern[i], text[j])] if pattern[i] != text[j] else []
        elif cost[i - 1][j] + 1 == cost[i][j]:
            i -= 1
            ops.append(("del", i, pattern[i], None))
        else:
            j -= 1
            ops.append(("ins", i, None, text[j]))
    return edits, ops[::-1]


def played(pattern, ops):
    """What was read, from the pattern and the operations."""
    out, at = "", 0
    for op, place, _, read in ops:
        out += pattern[at:place]
        at = place + (op != "ins")
        out += read or ""
    return out + pattern[at:]


def test_traces():
    rng = random.Random(6)
    for _ in range(1500):
        pattern, text = ("".join(rng.choice("ab漢😀c") for _ in range(rng.randint(0, 14))) for _ in range(2))
        text = rng.choice([text, text + pattern[:7] + text, pattern])
        edits, ops = E.edit_trace(pattern, text)
        assert (edits, ops) == slow(pattern, text) and edits == len(ops) and played(pattern, ops) in text
    long = "".join(rng.choice("abcd") for _ in range(5000))
    edits, ops = E.edit_trace(long[1000:4000].replace("abc", "ac"), long)
    assert edits == len(ops) == 3000 - len(long[1000:4000].replace("abc", "ac")) and played(long[1000:4000].replace("abc", "ac"), ops) in long


def test_queries(spark):
    from quern.plans import recognition as P

    sf = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): r for r in P.read_turns(spark, sf).collect()}
    counts = Counter()
    for r in P.edit_traces(spark, sf).collect():
        ops = [tuple(o) for o in r.ops]
        text = turns[r.conv_id, r.turn].text
        assert r.edits == len(ops) and played(text, ops) in turns[r.conv_id, r.turn].seen
        if len(text) < 150:
            assert (r.edits, ops) == slow(text, turns[r.conv_id, r.turn].seen)
        counts.update((o[0], o[2], o[3]) for o in ops)
    assert {(r.op, r.expected, r.read): r.n for r in P.character_confusions(spark, sf).collect()} == counts and counts["sub", "e", "c"] > 100
    found = Counter()
    for r in P.sentences_found(spark, sf).collect():
        seen = turns[r.conv_id, r.turn].seen
        edits = 0 if r.item in seen else slow(r.item, seen)[0] if len(r.item) < 80 else r.edits
        assert (r.edits, r.found) == (edits, "exact" if edits == 0 else "fuzzy" if edits <= max(1, len(r.item) // 4) else "missed")
        found[r.found] += 1
    assert len(found) >= 2


def test_nulls_and_items(spark):
    rows = spark.createDataFrame([(1, ["salt", None, "", "sugar"], "salty suger"), (2, None, "x"), (3, ["a"], None), (4, ["abcdefgh"], "xxabcdxxefghxx")], "k int, items array<string>, t string")
    got = {(r.k, r.item): (r.edits, r.found) for r in E.found_items(rows, "k", "items", "t").collect()}
    assert got == {(1, "salt"): (0, "exact"), (1, "sugar"): (1, "fuzzy"), (3, "a"): (1, "fuzzy"), (4, "abcdefgh"): (2, "fuzzy")}
    empty = E.with_trace(rows.selectExpr("k", "cast(null as string) as a", "t"), "a", "t").collect()
    assert all(r.edits == 0 and r.ops == [] for r in empty)


def test_bit_columns(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    for _ in range(300):
        patterns = ["".join(rng.choice("ab漢😀") for _ in range(rng.choice([1, 2, 7, 8, 9, 40]))) for _ in range(rng.randint(1, 6))]
        text = "".join(rng.choice("ab漢😀") for _ in range(rng.randint(0, 50)))
        assert E.fewest_edits(patterns, text, rng.choice([1, 300, 1 << 25])) == [slow(p, text)[0] for p in patterns]
    monkeypatch.setattr(E, "KEPT", 1)  # columns are computed again for the trace
    for _ in range(300):
        pattern, text = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert E.edit_trace(pattern, text) == slow(pattern, text)
    rows = [(i, 0, "user", "one, two. three") for i in range(64)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    from quern.plans import queries

    assert queries.QUERIES["edit_traces"](spark, str(tmp_path)).rdd.getNumPartitions() > 1
    assert {(r.item, r.edits) for r in queries.QUERIES["sentences_found"](spark, str(tmp_path)).collect()} == {(x, slow(x, "user see page 0nc tw0. hrcc end of page")[0]) for x in ("one, two", "three")}
