"""Operators whose order or search is intrinsic: they run as pandas functions over groups of bounded size."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.operators.edits import fewest_edits

OPEN, CLOSE = "(（[【{", ")）]】}"
BRACKET_MARKS = OPEN + CLOSE + ",，、;；"
BRACKET_PIECES = re.compile(f"[^{re.escape(BRACKET_MARKS)}]*[{re.escape(BRACKET_MARKS)}]|[^{re.escape(BRACKET_MARKS)}]+")


def merged_events(events: DataFrame, group: str, key: str, title: str, limit: float = 0.10) -> DataFrame:
    """Greedy merging in key order: an event joins the first group whose current title contains it, is contained in it, or shares more than `limit` of its character pairs.

    The group's title is then the longer one.  Order is part of the result, so a `group` is one pandas call.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        reps: list[tuple[str, set[str]]] = []
        out = []
        for k, t in pdf.sort_values(key)[[key, title]].itertuples(index=False):
            t = re.sub(r"\W", "", t or "")
            pairs = {t[i : i + 2] for i in range(len(t) - 1)}
            place = -1
            for i, (rep, rep_pairs) in enumerate(reps):
                both = pairs | rep_pairs
                if t and rep and (t in rep or rep in t) or both and len(pairs & rep_pairs) / len(both) > limit:
                    place = i
                    break
            if place < 0:
                reps.append((t, pairs))
                place = len(reps) - 1
            elif len(t) > len(reps[place][0]):
                reps[place] = t, pairs
            out.append((pdf[group].iloc[0], k, place))
        return pd.DataFrame(out, columns=[group, key, "merged"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return events.select(group, key, title).groupBy(group).applyInPandas(merge, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, merged long")


def dbscan(points: DataFrame, group: str, key: str, x: str, y: str, eps: float, least: int = 3) -> DataFrame:
    """Density clusters of each group's points; -1 is noise.  Clusters are numbered by their smallest key.  Neighbours are found on a grid."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        p = pdf[[x, y]].to_numpy(float)
        cells: dict[tuple[int, int], list[int]] = {}
        for i, (a, b) in enumerate(np.floor(p / eps).astype(int).tolist()):
            cells.setdefault((a, b), []).append(i)
        near = []
        for i, (a, b) in enumerate(np.floor(p / eps).astype(int).tolist()):
            around = [j for da in (-1, 0, 1) for db in (-1, 0, 1) for j in cells.get((a + da, b + db), ())]
            near.append([j for j in around if ((p[i] - p[j]) ** 2).sum() <= eps * eps])
        label, k = [-1] * len(p), 0
        for i in range(len(p)):
            if label[i] >= 0 or len(near[i]) < least:
                continue
            todo, label[i] = [i], k
            while todo:
                for j in near[todo.pop()]:
                    if label[j] < 0:
                        label[j] = k
                        if len(near[j]) >= least:
                            todo.append(j)
            k += 1
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": label})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return points.select(group, key, x, y).groupBy(group).applyInPandas(cluster, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, cluster long")


def bracket_rows(text: str | None) -> Iterator[tuple[str, list[str], str]]:
    """(name, the names around it, and these joined by >) of a comma list's nested items; unmatched closers end nothing, unmatched openers end with the text."""
    around, joined = [], [""]
    for piece in BRACKET_PIECES.findall(text or ""):
        mark = piece[-1] if piece[-1] in BRACKET_MARKS else ""
        name = piece[: len(piece) - len(mark)].strip()
        if name:
            yield name, around, joined[-1]
        if mark and mark in OPEN:
            joined.append(f"{joined[-1]}>{name}" if around else name)
            around.append(name)
        elif mark and mark in CLOSE and around:
            around.pop()
            joined.pop()


def bracket_items(text: str | None) -> list[dict]:
    return [{"name": name, "path": list(around), "depth": len(around)} for name, around, _ in bracket_rows(text)]


def flattened(df: DataFrame, key: str, text: str, most: int = 4_000_000) -> DataFrame:
    """key, place, name, path (joined by >), depth of every item of a bracketed list.

    Paths can be much longer than the text, so rows leave a task in batches of about `most` characters.
    """
    kind = df.schema[key].dataType

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key_", "place", "name", "path", "depth"]
        types = [to_arrow_type(kind), pa.int32(), pa.string(), pa.string(), pa.int32()]
        made: list[tuple] = []
        size = 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                for place, (name, around, path) in enumerate(bracket_rows(t.as_py())):
                    made.append((k.as_py(), place, name, path, len(around)))
                    size += len(name) + len(path) + 100
                    if size >= most:
                        yield batch_of(made)
                        made, size = [], 0
        if made:
            yield batch_of(made)

    rows = df.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(items, f"key_ {kind.simpleString()}, place int, name string, path string, depth int")
    return rows.withColumnRenamed("key_", key)


def substring_edits(pattern: str, text: str) -> int:
    """Fewest edits between a pattern and any part of a text."""
    return fewest_edits([pattern], text)[0] if pattern else 0


def edits_within(df: DataFrame, pattern: str, text: str, keep: list[str]) -> DataFrame:
    @F.pandas_udf("long")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([substring_edits(x or "", y or "") for x, y in zip(a, b)])

    return df.select(*keep, edits(F.col(pattern), F.col(text)).alias("edits"))


def repetition(text: str | None, most_period: int = 16, window: int = 180, share: float = 0.9) -> int:
    """The period of a text's repetitive end, 0 without one."""
    tail = np.frombuffer((text or "")[-window:].encode("utf-32-le"), np.uint32)
    for p in range(1, most_period + 1):
        if len(tail) >= 2 * p + 8 and (tail[p:] == tail[:-p]).mean() >= share:
            return p
    return 0


def periodic_runs(text: str | None, most_period: int = 16, least: int = 180) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches of at least `least` characters in which a unit stands again and again in full.

    From left to right, the shortest period first; a run ends with the last whole unit, and the next one begins at or after that.
    Places where s[i] == s[i + p] stand in stretches; within one, the run from i has a unit more than the matches from i hold.
    """
    s = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    todo: list[tuple[int, int, int]] = []  # (start, period, end of the stretch of matches)
    for p in range(1, most_period + 1):
        matches = (-(-least // p) - 1) * p  # that a run of `least` characters has
        if len(s) < matches + p:
            continue
        same = s[p:] == s[:-p]
        if np.count_nonzero(same) < matches:
            continue
        edges = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
        for k in np.flatnonzero(np.diff(edges) - 1 >= max(matches, 1)).tolist():
            todo.append((int(edges[k]) + 1, p, int(edges[k + 1])))
    heapq.heapify(todo)
    runs, at = [], 0
    while todo:
        start, p, stop = heapq.heappop(todo)
        if start < at:  # what is left of the stretch may still be long enough
            start = at
            if stop >= at and ((stop - at) // p + 1) * p >= least:
                heapq.heappush(todo, (start, p, stop))
            continue
        at = start + ((stop - start) // p + 1) * p
        runs.append((start, at, p))
    return runs


def without_runs(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The text without those runs."""
    edges = [0, *(x for a, b, _ in runs for x in (a, b)), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def degenerate_tail(text: str | None, most_period: int = 16, window: int = 180, share: float = 0.9) -> int | None:
    """Where the repetitive end of a text of at least `window` characters begins: its last unit is followed back while it stands unchanged."""
    if len(text or "") < window or not (p := repetition(text, most_period, window, share)):
        return None
    unit, i = text[-p:], len(text)
    while i >= p and text[i - p : i] == unit:
        i -= p
    return i


def repetitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, period (of the text's end, 0 without one and for short texts), tail_start and trimmed (where that end begins, null without one, and its characters),
    runs (start, end, period of every run in the whole text), removed (their characters) and kept_md5 (of the text without them).
    """

    @F.pandas_udf("period int, tail_start int, trimmed int, runs array<struct<start:int,end:int,period:int>>, removed int, kept_md5 string")
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            runs, tail = periodic_runs(t), degenerate_tail(t)
            digest = None if t is None else hashlib.md5(without_runs(t, runs).encode()).hexdigest()
            out.append((0 if tail is None else repetition(t), tail, 0 if tail is None else len(t) - tail, [dict(zip(("start", "end", "period"), r)) for r in runs], sum(b - a for a, b, _ in runs), digest))
        rows = pd.DataFrame(out, columns=["period", "tail_start", "trimmed", "runs", "removed", "kept_md5"])
        return rows.astype({"period": "int32", "tail_start": "Int32", "trimmed": "int32", "removed": "int32"})

    return df.select(key, found(F.col(text)).alias("f")).select(key, "f.*")


def bootstrap(df: DataFrame, group: str, a: str, b: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """Paired bootstrap of the mean difference b - a by group: mean, 2.5 and 97.5 % limits, share of rounds above 0.

    Every row draws its own Poisson(1) weight for each round, so rounds are sums
    over rows and need no group in one place.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            d = (pdf[b] - pdf[a]).to_numpy(float)
            weights = np.stack([np.random.default_rng([seed, int(k) & 0xFFFFFFFF]).poisson(1.0, rounds) for k in pdf["key_"]]) if len(pdf) else np.zeros((0, rounds))
            for g, at in pdf.groupby(group).indices.items():
                w = weights[at]
                yield pd.DataFrame({group: g, "round": np.arange(rounds), "w": w.sum(axis=0).astype(float), "s": w.T @ d[at], "n": float(len(at)), "t": d[at].sum()})

    rows = df.select(group, a, b, F.xxhash64(*df.columns).alias("key_")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(group).isNotNull())
    sums = rows.mapInPandas(draw, f"`{group}` {kinds[group]}, round int, w double, s double, n double, t double").groupBy(group, "round").agg(*(F.sum(c).alias(c) for c in "wsnt"))
    mean = F.coalesce(F.try_divide("s", "w"), F.lit(0.0))
    return sums.groupBy(group).agg(F.round(F.max(F.col("t") / F.col("n")), 6).alias("mean"), *(F.round(F.percentile(mean, p), 6).alias(name) for p, name in ((0.025, "low"), (0.975, "high"))), F.round(F.avg((mean > 0).cast("double")), 6).alias("wins"))


def page_texts(df: DataFrame, key: str, html: str) -> DataFrame:
    """Visible text of pages, without script, style, nav, header and footer parts."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__()
                self.skip, self.parts = 0, []

            def handle_starttag(self, tag, attrs):
                self.skip += tag in ("script", "style", "nav", "header", "footer")

            def handle_endtag(self, tag):
                self.skip = max(0, self.skip - (tag in ("script", "style", "nav", "header", "footer")))

            def handle_data(self, data):
                if not self.skip and data.strip():
                    self.parts.append(data.strip())

        def one(page: str | None) -> str:
            reader = Reader()
            reader.feed(page or "")
            reader.close()
            return "\n".join(reader.parts)

        return pages.map(one)

    return df.select(key, text(F.col(html)).alias("text"))
