"""Joins, search, mixing and the pipeline against brute force on small tables."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import knn, line_dedup, mixing, ngram_join, registry, setjoin
from quern.llm.common import counted_arrays, string_hashes


def near_copies(seed=5, families=4, members=30, words=60):
    """Documents in families of copies with a few changed words, some without any relation, and lines in common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(words)]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(words)] = word()
            lines = [" ".join(copy[i : i + 15]) for i in range(0, words, 15)]
            texts.append("\n".join(lines))
    texts += ["\n".join(" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(4)) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), "", "one", "two words", "ONE", "   \n ", "x " * 4000, None]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def brute_components(rows, size, num, den):
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_lines(rows, least=1):
    sets, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        kept, lines = [], (t.encode().split(b"\n") if t else [])
        for line in lines:
            s = set(line.lower().split())
            if len(s) >= least:
                hit = any(5 * len(s & o) >= 4 * len(s | o) for o in sets)
                sets.append(s)
                if hit:
                    continue
            kept.append(line)
        out[i] = None if t is None else b"\n".join(kept).decode()
    return out


@pytest.fixture(params=["as set", "small lists", "hot tokens"])
def limits(request, monkeypatch):
    """The same joins with limits so small that dense, long and hot lists occur."""
    if request.param != "as set":
        for name, value in {"SHORT": 4, "DENSE": 1, "SLACK": 4, "PIVOTS": 2}.items():
            monkeypatch.setattr(setjoin, name, value)
    if request.param == "hot tokens":
        monkeypatch.setattr(setjoin, "HOT", 5)


def test_near_duplicates(spark, limits):
    rows = near_copies()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(d).collect()}
    assert got == brute_components(rows, 3, 90, 100)
    five = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(d, 5, 4, 5).collect()}
    assert five == brute_components(rows, 5, 4, 5)


def test_line_dedup(spark, limits):
    rows = near_copies(8)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(rows)
    for r in line_dedup.dedup_lines(d).collect():
        kept = want[r["doc_id"]]
        assert r["text_md5"] == (None if kept is None else hashlib.md5(kept.encode()).hexdigest())
        text = dict(rows)[r["doc_id"]]
        assert r["n_lines"] == (len(text.split("\n")) if text else 0)
    clash = d.where("doc_id < 40").select("doc_id", "text", *(F.lit(1).alias(c) for c in ("row_", "text_", "id_", "lost_id_", "gone_", "n_lines_", "n_gone_", "a b")))
    assert line_dedup.keep_first_lines(clash).columns == clash.columns and line_dedup.keep_first_lines(clash).count() > 0


def test_short_line_dedup(spark, limits, tmp_path):
    """The query removes later copies of short, one-word and few-distinct-word lines as well; four words match five that hold them."""
    rng = random.Random(2)
    some = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows = [(1, "p q r s\n\none"), (2, "p q r s t\nONE\n \n"), (3, "p q r\np q r\np q r x"), (4, "同じ行です\n" + "na " * 500), (5, "同じ行です\n\n" + "na " * 499), (6, None), (7, "")]
    rows += [(10 + k, "\n".join(some[k * 10 : k * 10 + 10])) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(rows, least=1)
    assert want[2] == " \n" and want[3] == "p q r\np q r x" and want[5] == ""
    for r in registry.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect():
        kept = want[r["doc_id"]]
        assert r["text_md5"] == (None if kept is None else hashlib.md5(kept.encode()).hexdigest()), r["doc_id"]


def test_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f")], "doc_id long, text string")
    more = rows.union(spark.createDataFrame([(None, "q r s t u v"), (None, None)], rows.schema))
    got = sorted(map(tuple, ngram_join.near_duplicates(more).collect()), key=lambda r: (r[0] is None, r[0] or 0, -r[1], r[2] is None))
    assert got == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3), (None, 4, 1), (None, 4, None), (None, 0, None)]
    clash = spark.createDataFrame([(1, "a b c d e f", "x", 9), (2, "a b c d e f\nzz", "y", 9)], "doc_id long, text string, gone string, n_chars long").withColumnRenamed("gone", "a")
    assert [tuple(r) for r in line_dedup.keep_first_lines(clash).orderBy("doc_id").collect()] == [(1, "a b c d e f", "x", 9), (2, "zz", "y", 2)]
    kept = ngram_join.keep_one(clash.withColumn("gone_id", clash.doc_id))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and "gone_id" in kept.columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in setjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 6)).astype(np.float32)
    vectors[100:180] = vectors[7]  # a large group of equal vectors
    rows = [(int(i) * 5, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2001, [1.0, None, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2050, [0.5] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: np.floor(np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v))) * 256).astype(np.int64) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    got: dict = {}
    for r in knn.top_k(d, lambda i: i % 50 == 0, block_rows=40, query_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == want
    assert knn.top_five(d.limit(0)).count() == 0
    twice = d.where("vec_id in (0, 5, 10)").union(d.where("vec_id in (0, 5)"))  # rows that repeat an id ask, and are candidates
    pairs = sorted(((-int(whole[0] @ whole[i]), i) for i in (0, 5, 5, 10)))
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in knn.top_five(twice).collect()) == sorted([(n, i, -s) for n, (s, i) in enumerate(pairs, 1)] * 2)
    assert [tuple(r) for r in knn.top_five(d.where("vec_id in (0, 5)")).collect()] == [(0, 1, 5, int(whole[0] @ whole[5]))]


def test_top_k_prunes(spark):
    """On clustered data a query meets few groups, and the result is that of brute force."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 4
    vectors = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.05
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got, share = knn.search(d, lambda i: i % 50 == 0, block_rows=64)
    assert 0 < share < 0.3
    x = np.floor(vectors * 256).astype(np.int64)
    scores = x[::50] @ x.T
    scores[np.arange(40), np.arange(0, 2000, 50)] = -(1 << 62)
    want = {(q * 50, n + 1, int(i), int(scores[q, i])) for q in range(40) for n, i in enumerate(np.lexsort((np.arange(2000), -scores[q]))[:5])}
    assert {tuple(r) for r in got.collect()} == want


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["s0"] * 5 + ["s1", "s2", "s3", None])) for i in range(400)]
    rows += [(1000, None, "en", "s0"), (1001, "", "en", "s0"), (5, "copy of an id", "en", "s0")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, mixing.mix(d).collect()))
    documents = d.toPandas()  # noqa: F841
    assert [tuple(map(str, r)) for r in got] == sorted([tuple(map(str, r)) for r in duckdb.sql("SELECT * FROM (" + mixing.SQL + ") ORDER BY doc_id, n_tokens").fetchall()], key=lambda r: (int(r[0]), *r[1:4], int(r[4])))
    names = {c: i for i, c in enumerate(mixing.mix(d).columns)}
    leaves: dict = {}
    for r in got:
        key = tuple(r[names[c]] for c in ("domain", "lang", "source"))
        taken, tokens = leaves.get(key, (0, 0))
        leaves[key] = taken + r[names["copies"]] * r[names["n_tokens"]], tokens + r[names["n_tokens"]]
    total = sum(t for _, t in leaves.values())
    assert all(taken <= mixing.MAX_EPOCHS * t for taken, t in leaves.values()) and sum(t for t, _ in leaves.values()) <= total
    taken = mixing.mixed(d.withColumn("copies", d.doc_id))
    assert taken.columns == [*d.columns, "copies"] and taken.count() == sum(r[names["copies"]] for r in got)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mixed(d.limit(0)).count() == 0


def test_shares():
    """The vessel rule in plain Python: shortages go to siblings first, nothing is lost."""

    def fill(budget, children):
        out, left = {}, dict(children)
        while left:
            level = budget / sum(w for _, w in left.values())
            full = {k: c for k, (c, w) in left.items() if c <= level * w}
            if not full:
                return out | {k: int(level * w) for k, (_, w) in left.items()}
            out |= full
            budget -= sum(full.values())
            left = {k: v for k, v in left.items() if k not in full}
        return out

    assert fill(100, {"a": (10, 1), "b": (1000, 1), "c": (1000, 2)}) == {"a": 10, "b": 30, "c": 60}


def test_pipeline(spark):
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in near_copies(9)] + [(5000, "12 34 ??", "en", "s1", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit("x"))
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "source mixing", "SentencePiece encoding"]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        now = corpus_pipeline.materialise(stage(spark, now, ""))
        after = now.collect()
        if k < 4:
            assert now.columns == names
        if k == 0:
            gone = {r["doc_id"]: r["text"] or "" for r in before if r["doc_id"] not in {x["doc_id"] for x in after}}
            assert {r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or "")} <= set(gone)
        if k == 1:
            want = brute_lines([(r["doc_id"], r["text"]) for r in before])
            assert all(want[r["doc_id"]] == r["text"] for r in after)
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {r["doc_id"] for r in before if r["text"].strip() and not want[r["doc_id"]].strip()}
        if k == 2:
            want = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 4, 5)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in want.items() if c == i)
        if k == 3:
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if k == 4:
            assert len(after) == len(before) and all(r["n_tokens"] == len(r["ids"]) for r in after)
    assert corpus_pipeline.run is not None


def test_lost_lines_meet_texts_in_one_way_at_every_size(spark):
    """A broadcast of the lists on small tables only made the shuffle grow faster than the input."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f\nzz"), (3, None)], "doc_id long, text string")
    gone = spark.createDataFrame([(2, [0])], "id long, gone array<int>")
    cut = line_dedup.without_lines(docs, gone)
    assert [(r["row_"]["doc_id"], r["text_"], r["n_gone_"]) for r in cut.orderBy("row_.doc_id").collect()] == [(1, "a b c d e f", 0), (2, "zz", 1), (3, None, 0)]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan


def test_copies_of_postings_count_once():
    join = setjoin.Join(line_dedup.lines, 4, 5, words=2)
    x = np.zeros(6, join.posting)
    x["token"], x["rid"], x["salt"], x["o1"] = [7, 7, 7, 8, 7, 7], [1, 1, 2, 1, 1, 2], [-1, -1, -1, -1, 0, -1], [5, 3, 4, 9, 1, 4]
    got = setjoin.without_copies(x)
    assert sorted(zip(*(got[c].tolist() for c in ("token", "salt", "rid", "o1")))) == [(7, -1, 1, 3), (7, -1, 2, 4), (7, 0, 1, 1), (8, -1, 1, 9)]
    assert len(setjoin.without_copies(x[:0])) == 0


def test_coded_words_give_the_same_records():
    rng = random.Random(3)
    texts = pa.array(["\n".join(" ".join(rng.choice(["a", "bb", "Bb", "ñ" * 9, "x" * 40, "y" * 8, ""]) for _ in range(rng.randint(0, 9))) for _ in range(4)) for _ in range(40)])
    row, place, codes, hashes = line_dedup.lines(texts)
    classes = (np.arange(1 << 16) % 7).astype(np.uint8)
    for least in (1, 3):
        a, b = setjoin.records((row, place, codes, hashes), least, classes), setjoin.records((row, place, hashes[codes]), least, classes)
        assert all((x == y).all() for x, y in zip(vars(a).values(), vars(b).values(), strict=True)) and len(a.n)


def test_word_hashes_depend_on_all_bytes():
    words = ["", "a", "a\0", "\0", "b" * 7, "b" * 8, "b" * 9, "b" * 16, "b" * 17, "ab" * 8, "ba" * 8, "abcdefgh12345678", "12345678abcdefgh"]
    h = string_hashes(pa.array(words))
    assert h[0] == 0 and len(set(h.tolist())) == len(words)
    assert (string_hashes(pa.array(["qqq", *words])[1:]) == h).all() and (string_hashes(pa.array(words[::-1]))[::-1] == h).all()


def test_counts_travel_in_few_bytes(spark):
    def count(batches):
        rows = sum(b.num_rows for b in batches)
        yield "n", np.array([rows, 0, rows << 40], np.int64)
        yield "x", np.array([-rows, rows], np.int64)

    got = counted_arrays(spark.range(0, 1000, 1, 3), count)
    assert got["n"].tolist() == [1000, 0, 1000 << 40] and got["x"].tolist() == [-1000, 1000] and got["n"].dtype == np.int64
