"""Row-by-row operators: licenses, pages, media, pieces, toxicity, languages."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import html_main, langid, licenses, media, pieces, toxicity
from quern.llm.registry import QUERIES

TEXTS = [
    (1, "Released under the MIT License under the mit license."), (2, None), (3, ""), (4, "cc-by-nc 4.0, Apache License, Version 2.0!"), (5, "x " * 30_000 + "apache license version 2"),
    (1, "Released under the MIT License under the mit license."), (6, "Éé under the mit licenses; ça"), (7, "GNU General Public License version 3 or later"), (None, "under the mit license"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    starts, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base(docs):
    got = licenses.digest(docs).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))
    for i, t in TEXTS:
        assert by[i] == {brute_license(t)}
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[7] == "gpl-3-or-later" and "cc-by-nc-4.0" in labels[4] and labels[2] == ""
    assert all(0 <= r["score"] <= 1 for r in got)


def sample(tree, rng):
    """A text that a parsed regex matches."""
    out = ""
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN" if str(arg[0][0]) == "NEGATE":
                out += "z"
            case "IN":
                kind, value = rng.choice(arg)
                out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value)) if str(kind) == "RANGE" else "5"
            case "NOT_LITERAL" | "ANY":
                out += "z"
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
            case "SUBPATTERN":
                out += sample(arg[3], rng)
            case "BRANCH":
                out += sample(rng.choice(arg[1]), rng)
    return out


def test_license_suppression_and_rules(spark):
    from re import _parser

    rng, parse_regex = random.Random(1), _parser.parse
    assert len(licenses.rules()) > 200
    rows = spark.createDataFrame([(1, "GNU Lesser General Public License version 2.1"), (2, "Creative Commons Attribution-ShareAlike 4.0 International"), (3, "BSD 3-Clause License"), (4, "Open RAIL license")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.digest(rows).collect()} == {1: "lgpl-2.1", 2: "cc-by-sa", 3: "bsd-3", 4: "openrail"}
    for label, _, keyword, regex, _, _ in licenses.rules():
        re.compile(regex)
        for _ in range(50):
            match = sample(parse_regex(regex), rng)
            assert re.fullmatch(regex, match) and f" {keyword} " in match, (label, keyword, match)


def test_main_text():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
      <div class="post"><h2>Caf&eacute; &amp; tea</h2><p>First, with  two
      spaces<br>and a break.<p>Second <b>bold</b> text, <a href=x>link</a>.<ul><li>one<li>two</ul><script>x()</script></div>
      <div id="sidebar"><p>Side, side, side, side, side, side</p></div><div class=comments><p>Nice, nice, nice, nice, nice post</p></div><p class="cookie-notice">We use cookies</p><form><p>Mail</p></form><footer>(c)</footer></body></html>"""
    assert html_main.main_text(page) == "Café & tea First, with two spaces and a break. Second bold text, link. one two"
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<nav><p>x</p></nav>") == ""
    assert html_main.main_text("<p>a<p>b") == "a b" and html_main.main_text("plain text") == "plain text"
    assert html_main.main_text("<div>" * 3000 + "<p>deep, text</p>") == "deep, text"
    assert html_main.main_text("<!-- <p>x</p> --><article><p>one &lt;tag&gt;</p></article") == "one <tag>"


def test_main_text_of_nested_layouts():
    """Headings, short sections and lists of references of an article are part of it, whichever child has the points."""
    long = "Long text, with commas, and words enough to score well in any tree. " * 3
    text = " ".join(long.split())
    body = f"<p>{long}</p>" * 6
    menu = "<ul><li><a href=a>Menu one</a><li><a href=b>Menu two</a></ul>"
    got = html_main.main_text
    six = " ".join([text] * 6)
    assert got(f"<body>{menu}<article><h1>Title</h1><div>{body}</div></article>{menu}</body>") == f"Title {six}"
    assert got(f"<main><h1>Title</h1><section><h2>One</h2>{body}</section><section><h2>Two</h2><p>Short.</p></section><blockquote>Said.</blockquote><pre>x = 1</pre><p>End.</p></main>") == f"Title One {six} Two Short. Said. x = 1 End."
    assert got(f"<article><div>{body}</div><h2>References</h2><ol><li><a href=a>First work</a><li><a href=b>Second work</a></ol></article>") == f"{six} References First work Second work"
    assert got(f"<body><div id=page>{menu}<div><h1>Title</h1><div><div>{body}</div></div><div><p>Short.</p></div></div></div>{menu}</body>") == f"Title {six} Short."
    assert got(f"<main><h1>Title</h1><article><div>{body}</div></article><p>End.</p></main>") == f"Title {six} End."


def test_link_lists_within_the_text():
    """Lists of works, a linked sentence and linked cells belong to the text without an article too; menus before it do not."""
    long = "Long text, with commas, and words enough to score well in any tree."
    body, six = f"<p>{long}</p>" * 6, " ".join([long] * 6)
    menu = "<ul><li><a href=a>Menu one</a><li><a href=b>Menu two</a></ul>"
    got = html_main.main_text
    assert got(f"<body><div><h1>T</h1>{body}<h2>References</h2><ol><li><a href=a>First work</a><li><a href=b>Second work</a></ol></div></body>") == f"T {six} References First work Second work"
    assert got(f"<body><div>{body}<div><a href=a>One linked sentence.</a></div><p>End.</p></div></body>") == f"{six} One linked sentence. End."
    assert got(f"<body><div><h1>T</h1>{body}<table><tr><td><a href=a>cell</a></table></div></body>") == f"T {six} cell"
    assert got(f"<body><div><div><a href=a>By one.</a></div>{body}</div></body>") == f"By one. {six}"
    assert got(f"<body><div>{menu}{body}</div></body>") == six and got(f"<body>{menu}<div>{body}</div>{menu}</body>") == six
    assert got(f"<body><form>{body}</form><article><p>tiny</p></article></body>").startswith(six)


def test_main_text_behind_forms_and_names():
    """Forms and names in class drop what they name, and no article text."""
    long = "Long text, with commas, and words enough to score well in any tree."
    body, six = f"<p>{long}</p>" * 6, " ".join([long] * 6)
    got = html_main.main_text
    assert got(f"<body><form id=aspnetForm><nav>x</nav><article><h1>T</h1>{body}</article></form></body>") == f"T {six}"
    assert got(f"<body><form action=/><div><div><h1>T</h1>{body}</div></div></form></body>") == f"T {six}"
    assert got(f"<body><article>{body}<form><p>Your mail</p></form></article><form><p>Search</p></form></body>") == six
    assert got(f"<article>{body}<div class=meta-analysis><p>Pooled.</p></div><section class=discussion><p>We find.</p></section></article>") == f"{six} Pooled. We find."
    assert got(f"<div class=page-with-sidebar><article>{body}</article><div class='side-bar widget'><p>x, y, z</p></div></div>") == six
    for name in ("comments-section", "userComments", "ad-300x250", "cookieNotice", "share-buttons", "sponsored-content"):
        assert got(f"<article>{body}<div class={name}><p>Gone, gone, gone.</p></div></article>") == six, name
    assert got(f"<article>{body}</article><section class=comments>" + "<article><p>Nice, nice, nice.</p></article>" * 30 + "</section>") == six
    assert got(f"<body><h1>T</h1>loose <div>{body}</div><p>End.</p></body>") == f"T loose {six} End."
    began = time.process_time()
    assert got("<div>" * 20_000 + "<p>deep, text</p>" + "</span>" * 20_000) == "deep, text"
    assert got("<span>" * 20_000 + "<li>deep, text" * 300).startswith("deep, text")
    assert got("<article>" + f"<p>{long}</p>" * 20_000 + "</article>") == " ".join([long] * 20_000)
    assert time.process_time() - began < 20


def test_pages_table(spark):
    """Nulls, empty pages, repeated rows and an empty table."""
    rows = spark.createDataFrame([(1, None, "<p>a, b</p>"), (1, None, "<p>a, b</p>"), (None, "u", None), (2, "v", "")], "page_id long, url string, html string").withColumn("a b", F.lit(1))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_main.extract(rows).collect()) == [(0, "", 0), (1, "a, b", 4), (1, "a, b", 4), (2, "", 0)]
    assert html_main.extract(rows.limit(0)).count() == 0


def test_pages_like_their_articles(spark):
    for r in html_main.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), keep=("page_id", "html")).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_media_round_trip(docs):
    for r in media.media_columns(docs, with_media=True).collect():
        text = dict(TEXTS)[r["doc_id"]] if r["doc_id"] != 1 else TEXTS[0][1]
        data = (text or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        rate, frames = media.read_avi(bytes(r["media"]))
        assert rate == 25 and len(frames) * 576 == len(padded) and r["clips"][-1]["end_s"] == len(frames) / 25
        assert [c["start_s"] for c in r["clips"][1:]] == [c["end_s"] for c in r["clips"][:-1]]


def test_media_decoders_agree():
    data = np.random.default_rng(1).integers(0, 256, 576 * 4).astype(np.uint8).tobytes()
    frames = media.read_avi(media.write_avi(media.write_frames(data)))[1]
    fast, _ = media.decode_frames(frames)
    for f, c in zip(frames, fast):
        _, _, _, tables, scan = media.parse_jpeg(f)
        assert (media.decode_scan(scan, 9, tables) == c).all()
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF....")
    assert media.shots(np.array([[9, 0], [9, 0], [9, 0], [0, 9], [0, 9]]), 2) == [0, 3]


def test_pieces():
    v = pieces.vocabulary()

    def every(ends, at):
        return [0] if at == 0 else [s + w for i, w, _ in ends[at] for s in every(ends, i)]

    for chunk in (" hello", "  ab", "été", "\n", " a▁b", " thing."):
        ends, best = pieces.lattice(chunk, v)
        scores = sorted(every(ends, len(ends) - 1), reverse=True)
        assert best[-1] == scores[0] and [s for s, _ in pieces.n_best(chunk, v, 5)] == scores[:5]
    for text in ("Hello  world\n\tx ", "", " a", "▁ a￿　é 漢字 ﬁ😀", "a b c", "x" * 3000):
        found = pieces.segmentations(text, v, 4)
        assert all(pieces.decode(ids, v) == text for _, ids in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({tuple(i) for _, i in found}) == len(found)
        ids, n, score, second, begin, dropped, others, same = (c.to_pylist()[0] for c in pieces.encoded(pa.array([text]), v, pieces.Remembered(v)))
        assert same and n == len(ids) and pieces.decode(ids, v) == text and score == found[0][0]
        assert second == (found[1][0] if len(found) > 1 else None)
        if len(found) > 1:
            assert second_ids(ids, begin, dropped, others) in [i for s, i in pieces.segmentations(text, v, 60) if s == second and i != ids]


def second_ids(ids, begin, dropped, others):
    return ids[:begin] + others + ids[begin + dropped :]


def test_second_segmentations(spark):
    """On every document the second best covers the text, is not the best, and has the second best score by another lattice."""
    listed, v = pieces.listed_pieces(), pieces.vocabulary()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.encode(docs.select("doc_id", "text")).collect():
        if r["second_score"] is None:
            continue
        second = second_ids(r["ids"], r["second_from"], r["second_dropped"], r["second_ids"])
        points = sum(listed[i][1] if listed[i][1] is not None else 0 for i in second)
        assert second != r["ids"] and pieces.decode(second, v) == texts[r["doc_id"]]
        assert points == r["second_score"] or any(listed[i][1] is None for i in second)


def test_pieces_against_a_second_lattice():
    """Best and second best score by plain recursion over the pieces' list, without the code under test."""
    listed = pieces.listed_pieces()
    v, score = pieces.vocabulary(listed), {p: s for p, s in listed if s is not None}
    unknown = min(s for s in score.values() if s > -1_000_000) - pieces.UNKNOWN_PENALTY

    def two(s):
        best = [[0]] + [[] for _ in s]
        for j in range(1, len(s) + 1):
            ways = [b + score[s[i:j]] for i in range(max(0, j - 40), j) if s[i:j] in score for b in best[i]]
            ways += [b + unknown for b in best[j - 1]] if s[j - 1] not in score else []
            best[j] = sorted(ways, reverse=True)[:2]
        return best[-1]

    for text in ("hello there, General", "naïve  café\n\nend ", "漢字かな交じり", "aaaaaaaaaaaa bb", "x😀y"):
        found = pieces.encoded(pa.array([text, text * 3]), v, pieces.Remembered(v, most_bytes=300))
        for t, a, b in zip((text, text * 3), found[2].to_pylist(), found[3].to_pylist()):
            assert [a, b][: len(two("▁" + t.replace(" ", "▁")))] == two("▁" + t.replace(" ", "▁")), t


def test_chunks_searched_together():
    rng, v = random.Random(4), pieces.vocabulary()
    chunks = [" " * rng.randint(1, 3) + "".join(rng.choice("abcdeéth ing".replace(" ", "")) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["a", "漢", " The"]
    chunks = sorted(set(c for c in chunks if v.plain[[ord(x) for x in c]].all()))
    assert pieces.searched_together(chunks, v) == [pieces.packed(*pieces.best_and_gap(c, v)) for c in chunks]


def test_long_text_without_blanks():
    v = pieces.vocabulary()
    text = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(80_000))
    began = time.process_time()
    ids, *_, same = pieces.encoded(pa.array([text]), v, pieces.Remembered(v))
    assert same.to_pylist() == [True] and time.process_time() - began < 10


def test_pieces_query(docs):
    got = pieces.encoded_digest(docs).collect()
    assert len(got) == len(TEXTS) and all(r["round_trip"] for r in got if r["doc_id"] != 2)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] is None and by[3]["n_tokens"] == 0 and by[3]["ids_md5"] == pieces.ids_md5([])


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(["alpha", "beta", "gamma", "delta", "women", "men"], 20).tolist()
        if i % 4 == 0:
            words[0], words[1 + int(rng.integers(19))] = "women", "Stupid,"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "the women and the men"), (1003, "a stupid thing"), (1003, "a stupid thing")]
    d, labels_df = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(2000, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, labels_df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] < 400:
            assert r["predicted"] == (r["doc_id"] % 4 == 0)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert [by[i] for i in (1000, 1001, 1002, 1003)] == [0, 0, 0, 1]
    none = toxicity.toxicity(d, labels_df.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.toxicity(d.limit(0), labels_df).count() == 0


def test_toxicity_like_plain_sums(spark):
    """The scores are the sums of the model's weights over a text's features, computed here by plain loops; ids that repeat train once."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 12).tolist() + (["vile", "women"] if i % 3 == 0 else []))) for i in range(300)]
    rows += [(3, rows[3][1])] * 5 + [(400, "Vile! alpha" * 5_000), (401, "VILE"), (402, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "y", "t", "predicted")})
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    chosen, weights = toxicity.fit(d, marks)
    once = toxicity.fit(d.dropDuplicates(["doc_id"]), marks)
    assert (once[0] == chosen).all() and np.allclose(once[1], weights)
    places = {int(c): i for i, c in enumerate(chosen)}
    for r in toxicity.score(d, (chosen, weights)).collect():
        stripped = {w.strip(toxicity.EDGES).decode() for w in (dict(rows)[r["doc_id"]] or "").lower().encode().split()} - {""}
        found = {"w" + w for w in stripped} | {f"{n}{w[:n]}" for w in stripped for n in (4, 5, 6) if len(w) >= n}
        hashed = {zlib.crc32(t.encode()) % (1 << toxicity.BITS) for t in found}
        z = weights[-1] + sum(weights[places[h]] for h in hashed if h in places)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-8


def test_counterfactual_penalty():
    rows, y = [[0, 1], [0], [2], [2]], np.array([1.0, 1.0, 0.0, 0.0])
    twins = [[0, 3], None, None, None]
    free, tied = (toxicity.fit_weights(rows, twins, y, 4, penalty=p) for p in (0.0, 5.0))
    assert abs(tied[1] - tied[3]) < 0.3 * abs(free[1] - free[3])


def test_language_id(spark):
    german, english = "der die das und nicht ein schule über straße", "the and of to in that for school with"
    rows = [(i, f"{(german if i % 2 else english)} {i}" * 3, "de" if i % 2 else "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "123 !!", "en", "s"), (103, german.upper(), None, None), (103, german.upper(), None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.identify(d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] < 60:
            assert r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en")
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"]
    assert {r["lang_pred"] for r in langid.identify(d.limit(0).union(d.where("doc_id = 103").limit(1))).collect()} == {"und"}


def plain_language(rows, letters):
    """Predictions by plain loops over characters: labels and cosines of every row."""
    def vector(text):
        symbols = [0]
        for c in (text or "").lower() + " ":
            x = 1 + ord(c) % 4095 if c.isalpha() else 0
            if x or symbols[-1]:
                symbols.append(x)
        out = np.zeros(letters.shape[1])
        if any(symbols):
            for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
                out += np.roll(letters[a].astype(float), 2) * np.roll(letters[b].astype(float), 1) * letters[c]
        return out

    sums = {}
    for i, t, k, _ in rows:
        if t is not None and k is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[k] = sums.get(k, 0) + vector(t)
    out = []
    for i, t, _, _ in rows:
        v = vector(t)
        if not v.any():
            out.append((i, "und", 0.0))
            continue
        cosines = {k: round(float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)), 6) for k, s in sums.items() if s.any()}
        best = max(sorted(cosines), key=cosines.get)
        out.append((i, best, min(1.0, max(0.0, cosines[best]))))
    return out


def test_language_id_like_plain_loops(spark):
    texts = {"ru": "Быстрая лиса перепрыгнула через ленивую собаку", "uk": "Швидка лисиця перестрибнула через ледачого пса їжак", "zh": "敏捷的棕色狐狸跳过了懒狗", "ja": "素早い茶色の狐が怠け者の犬を飛び越える", "en": "the quick brown fox, jumps over the lazy dog"}
    rng = np.random.default_rng(3)
    rows = [(i * 4, " ".join(rng.permutation(list(t.replace(" ", "")) if k in "zhja" else t.split()).tolist()), k, "s") for i, (k, t) in enumerate(list(texts.items()) * 12)]
    rows += [(1001, "\U00020001\U00020005", None, "s"), (1002, "12 !", None, "s"), (1003, None, None, "s"), (1004, "", None, "s"), (1005, "the dog " * 4_000, None, "s"), (1005, "the dog " * 4_000, None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(d).collect())
    want = sorted(plain_language(rows, langid.letter_vectors()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)
    assert dict(g[:2] for g in got)[1001] != "und"  # letters of any plane
    right = sum(dict((i, k) for i, _, k, _ in rows).get(g[0]) == g[1] for g in got if g[0] < 1000)
    assert right == 60  # two Cyrillic and two Han languages are told apart


def test_language_stage_has_one_rule(spark):
    """Texts of a language stay at every length; one word repeated and noise go; names cannot clash."""
    rng = np.random.default_rng(7)
    words = "the and of to in that for school with house water people garden morning letter number".split()
    make = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, make(int(rng.integers(20, 300))), "en") for i in range(80)] + [(100 + n, make(n), None) for n in (1, 2, 3, 10, 30, 40, 60, 1000)]
    noise = ["".join(rng.choice(list("qxzjkvwy"), 9)) for _ in range(300)]
    rows += [(200, " ".join(noise), None), (201, "zzz " * 300, None), (202, "1 2", None), (203, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("row_", "text_", "score", "lang_pred", "n_trigrams")})
    kept = langid.keep_identified(d)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows} - {200, 201, 202, 203}
    assert langid.keep_identified(d.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op10_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found[found.held_out].lang_pred == found[found.held_out].lang).mean() > 0.95


def test_the_pipeline_keeps_the_second_best(spark):
    docs = spark.createDataFrame([(1, "hello there", "en", "a", 11), (2, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    made = {r.doc_id: r for r in pieces.tokenised(docs).collect()}
    want = {r.doc_id: r for r in pieces.encode(docs).collect()}
    assert made[1].second_score is not None and all(made[i][c] == want[i][c] for i in (1, 2) for c in pieces.MADE)
