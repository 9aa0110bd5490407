"""Toxicity scores from a counterfactually regularised linear classifier.

Features of a text are its distinct words and their prefixes of 4, 5 and 6
letters.  Of all features, the `n_features` that separate the classes best are
kept, by class counts over the training rows.  Logistic regression is fitted
with a penalty on score changes: each training text that names a group gets a
twin in which group names are swapped, and the squared difference of the twins'
log-odds is added to the loss.  A neutral mention of a group then moves the
score little.

Training uses at most `most_rows` labelled ids, those whose hash comes first, each
once: of conflicting labels of an id the larger counts, of several texts the smallest.
Everything else covers all rows.  Null and empty texts score as a text
without features.  Without labels of both classes the score is the share of
label 1 (0.5 without labels).  Rows are scored one by one, so repeated ones get equal values;
whole texts count, of any length; an empty table gives an empty one.  Only ids, texts
and labels are read, so other columns' names cannot clash.  Features that separate
equally well are taken in the order of their hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, counted_arrays, held_out, lean, materialise

BITS = 18
# Group names; each is swapped for the next one of its line, the last for the first.
GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"], ["wife", "husband"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino"], ["africans", "europeans", "americans", "asians"], ["gay", "straight", "lesbian", "bisexual"],
    ["immigrants", "refugees", "foreigners", "natives"], ["disabled", "blind", "deaf"], ["old", "young"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]
SWAP = {a.encode(): line[(i + 1) % len(line)].encode() for line in GROUPS for i, a in enumerate(line)}
EDGES = b".,;:!?\"'()[]{}<>|*$%&#-_/"


class Features(dict):
    """Raw word -> its hashed features, only those in `chosen` if given (as their places there)."""

    def __init__(self, chosen: np.ndarray | None = None, most: int = 300_000):
        super().__init__()
        self.place = None if chosen is None else {int(c): i for i, c in enumerate(chosen)}
        self.most = most

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        word = raw.strip(EDGES).decode("utf-8", "replace").lower()
        parts = {"w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)} if word else ()
        hashed = {zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts}
        found = tuple(hashed) if self.place is None else tuple(self.place[h] for h in hashed if h in self.place)
        if len(self) >= self.most:
            self.clear()
        self[raw] = found
        return found

    def of(self, words: set[bytes]) -> set[int]:
        found: set[int] = set()
        for w in words:
            if f := self[w]:
                found.update(f)
        return found


def words(data: bytes | None) -> set[bytes]:
    return set(data.lower().split()) if data else set()


def twin(found: set[bytes]) -> set[bytes] | None:
    """The words with group names swapped; None where there are none."""
    swapped = {w: SWAP[w.strip(EDGES)] for w in found if w.strip(EDGES) in SWAP}
    return (found - swapped.keys()) | set(swapped.values()) if swapped else None


def fit_weights(rows: list[list[int]], twins: list[list[int] | None], labels: np.ndarray, n: int, penalty: float = 0.5, ridge: float = 1e-4, steps: int = 800, weight: float = 2.5) -> np.ndarray:
    """Weights and, last, the bias; accelerated gradient steps on the mean loss, label 1 counting `weight` times."""
    importance = np.where(labels == 1, weight, 1.0)
    flat = lambda xs: (np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.array([i for x in xs for i in x], np.int64))
    r, c = flat(rows)
    pairs = [(a, b) for a, b in zip(rows, twins) if b is not None]
    ra, ca = flat([a for a, _ in pairs])
    rb, cb = flat([b for _, b in pairs])
    m, k = len(rows), len(pairs)
    positive = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    w, ahead = np.zeros(n + 1), np.zeros(n + 1)
    w[n] = ahead[n] = np.log(positive / (1 - positive))

    def spread(errors: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The gradient for errors a row, with the penalty's and the ridge's parts at v."""
        grad = np.append(np.bincount(c, errors[r], n), errors.sum()) / m
        if k:
            gap = np.bincount(ra, v[ca], k) - np.bincount(rb, v[cb], k)
            grad[:n] += 2 * penalty * (np.bincount(ca, gap[ra], n) - np.bincount(cb, gap[rb], n)) / k
        grad[:n] += ridge * v[:n]
        return grad

    # The step is one over the largest curvature, by power iteration on the Hessian's bound.
    v = np.ones(n + 1) / (n + 1) ** 0.5
    for _ in range(30):
        v = spread(importance * (np.bincount(r, v[c], m) + v[n]) / 4, v)
        steepest = max(np.linalg.norm(v), 1e-9)
        v = v / steepest
    for step in range(steps):
        z = np.bincount(r, ahead[c], m) + ahead[n]
        new = ahead - spread(importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels), ahead) / (1.05 * steepest)
        ahead, w = new + step / (step + 3) * (new - w), new
    return w


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", n_features: int = 4096, most_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(chosen features, weights with the bias last).  The labelled sample has at most `most_rows` ids and is broadcast."""
    picked = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    rows = documents.select(id_col, text).join(F.broadcast(picked), id_col).groupBy(id_col).agg(F.min(text).alias("t"), F.first("y").alias("y"))
    rows = materialise(rows.select("t", "y", id_col))  # one row an id, `most_rows` at most

    def count(batches: Iterator[pa.RecordBatch]):
        seen, totals, features = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64), Features()
        for batch in batches:
            for data, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                seen[y, list(features.of(words(data)))] += 1
                totals[y] += 1
        yield "seen", seen.ravel()
        yield "totals", totals

    got = counted_arrays(rows, count)
    if not got or not got["totals"].sum():
        return np.zeros(0, np.int64), np.zeros(1)
    seen, totals = got["seen"].reshape(2, -1).astype(float), got["totals"].astype(float)
    if not totals.all():
        share = min(max(totals[1] / totals.sum(), 1e-3), 1 - 1e-3)
        return np.zeros(0, np.int64), np.array([np.log(share / (1 - share))])
    rate = seen / totals[:, None]
    pooled = seen.sum(axis=0) / totals.sum()
    z = np.abs(rate[1] - rate[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / totals[0] + 1 / totals[1]))
    z[seen.sum(axis=0) < 2] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:n_features])
    chosen = chosen[z[chosen] > 3.5]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(chosen)
        for batch in batches:
            own, other = [], []
            for data in as_bytes(batch.column(0)):
                found = words(data)
                own.append(sorted(features.of(found)))
                swapped = twin(found)
                other.append(None if swapped is None else sorted(features.of(swapped)))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(own, kind), pa.array(other, kind)], [id_col, "y", "own", "other"])

    kind = documents.schema[id_col].dataType.simpleString()
    sample = rows.mapInArrow(lean(extract), f"`{id_col}` {kind}, y int, own array<int>, other array<int>").collect()
    sample.sort(key=lambda r: (r[0], r[2]))
    return chosen, fit_weights([r[2] for r in sample], [r[3] for r in sample], np.array([r[1] for r in sample], float), len(chosen))


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col and the columns in `keep`, with score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = [id_col, *keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights = shared.value
        features, known = Features(chosen), weights.tolist()
        for batch in batches:
            z = np.array([known[-1] + sum(known[i] for i in sorted(features.of(words(d)))) for d in as_bytes(batch.column(len(carried)))])
            scores = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32())], [*carried, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*carried, text).mapInArrow(lean(rows), ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "score double, predicted int"]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query: learns from labels outside the held-out fifth, scores all documents."""
    model = fit(documents, labels.where(~held_out("doc_id", 5, 0)))
    return score(documents.withColumn("held_out", held_out("doc_id", 5, 0)), model, keep=("held_out",))
