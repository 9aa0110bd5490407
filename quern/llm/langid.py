"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn for its symbol: a letter's symbol
is its code point modulo 4095, so that all letters below U+0FFF, a to z among them,
have one of their own.  Runs of other characters are one gap symbol.  A trigram is
bound by multiplying its symbols' vectors, the first rotated twice and the second
once; a text is the bundle (sum) of its trigrams' vectors and so is a language's
prototype.  A text takes the language whose prototype has the largest cosine.

Null text, or text without a letter: `und` with score 0.  So is every text where no
labelled text exists to learn from, as in an empty table.  Ties go to the language
that sorts first.  Whole texts count, of any length, in portions of bounded size.
Rows are scored one by one, so repeated rows get equal values.  Only the columns named
are read; `keep_identified` carries all others in a struct, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import counted_arrays, held_out, lean, portions

SYMBOLS = 4096
DIMENSIONS = 1024
SEED = 20240607


@functools.cache
def symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 no letter, else 1 + code point modulo 4095."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(letter, 1 + points % (SYMBOLS - 1), 0).astype(np.uint16)


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions)).astype(np.int8) * 2 - 1


def bound(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The vectors of trigrams."""
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters[a], 2, axis=1) * np.roll(letters[b], 1, axis=1) * letters[c]


def trigrams(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of all trigrams of a text; runs of other characters count as one gap."""
    s = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if s.any() else s[:0]


def bundles(found: list[np.ndarray], letters: np.ndarray) -> np.ndarray:
    """The summed trigram vectors of every list of codes; all sums are of whole numbers and exact."""
    out = np.zeros((len(found), letters.shape[1]))
    coded = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)).dictionary_encode()
    distinct, at = coded.dictionary.to_numpy(), coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    order = np.argsort(at, kind="stable") if len(distinct) > 2048 else slice(None)
    row, at = row[order], at[order]
    for i in range(0, len(distinct), 2048):
        span = slice(*np.searchsorted(at, [i, i + 2048])) if len(distinct) > 2048 else slice(None)
        size = min(2048, len(distinct) - i)
        counts = np.bincount(row[span] * size + at[span] - i, minlength=len(found) * size).reshape(len(found), size)
        out += counts.astype(np.float32) @ bound(distinct[i : i + 2048], letters).astype(np.float32)
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, most_languages: int = 10_000) -> tuple[dict[str, np.ndarray], float]:
    """(unit prototypes by language, how alike two trigrams of a language are), from every row with a language.

    A prototype is one array of `dimensions` sums; more than `most_languages` of them are refused.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("k")).where("t is not null and k is not null")
    if rows.select("k").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")

    def count(batches: Iterator[pa.RecordBatch]):
        table, letters = symbol_table(), letter_vectors(dimensions)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j in portions(batch.column(0), 2_000_000):
                texts, langs = batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()
                by: dict[str, list[np.ndarray]] = {}
                for t, k in zip(texts, langs):
                    if (codes := trigrams(t, table)).size:
                        by.setdefault(k, []).append(codes)
                names = sorted(by)
                together = [np.concatenate(by[k]) for k in names]
                for k, codes, v in zip(names, together, bundles(together, letters)):
                    sums[k] = sums.get(k, 0) + np.append(v.astype(np.int64), len(codes))
        return sums.items()

    out, alike = {}, []
    for k, v in sorted(counted_arrays(rows, count).items()):
        norm = np.linalg.norm(v[:-1].astype(np.float64))
        out[k] = v[:-1] / max(norm, 1e-12)
        alike.append((norm / max(v[-1], 1)) ** 2)
    return out, float(np.mean(alike)) if alike else 0.0


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col and the columns in `keep`, with lang_pred, score (cosine, 0 to 1) and n_trigrams."""
    names = sorted(prototypes)
    profiles = np.stack([prototypes[k] for k in names]) if names else np.zeros((1, DIMENSIONS))
    carried = [id_col, *keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, letters = symbol_table(), letter_vectors(profiles.shape[1])
        for batch in batches:
            texts = batch.column(len(carried))
            for i, j in portions(texts, 2_000_000):
                found = [trigrams(t, table) if t and names else np.zeros(0, np.int64) for t in texts.slice(i, j - i).to_pylist()]
                bundle = bundles(found, letters)
                norms = np.maximum(np.linalg.norm(bundle, axis=1), 1e-12)
                cosines = np.round(bundle @ profiles.T / norms[:, None], 6)
                best, some = cosines.argmax(axis=1), np.array([f.size > 0 for f in found])
                labels = [names[b] if ok else "und" for b, ok in zip(best, some)]
                scores = np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
                columns = [pa.array(labels, pa.string()), pa.array(scores), pa.array([f.size for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[: len(carried)], *columns], [*carried, "lang_pred", "score", "n_trigrams"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "lang_pred string, score double, n_trigrams long"])
    return df.select(*carried, text).mapInArrow(lean(score), schema)


def identify(df: DataFrame) -> DataFrame:
    """The contract's query: learns from documents outside the held-out quarter, predicts for all."""
    rows = df.select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    prototypes, _ = fit(rows.where(~F.col("held_out")))
    return predict(rows, prototypes, keep=("held_out",)).drop("n_trigrams")


def keep_identified(docs: DataFrame, share: float = 0.4) -> DataFrame:
    """Pipeline stage: drops documents in no learned language, and leaves the columns as they are.

    A text of n trigrams of a language, two of which are alike to the degree q, has an
    expected cosine of sqrt(n q / (1 + n q)) with its prototype.  Texts that reach less
    than `share` of that are rejected, less a deviation of 1 / sqrt(n) for the chance of
    few trigrams: one rule for all lengths.  So are texts without a letter (`und`).
    """
    prototypes, alike = fit(docs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row_"), docs["text"].alias("text_"))  # so that no name can clash
    scored = predict(rows, prototypes, text="text_", id_col="row_")
    n = F.col("n_trigrams").cast("double")
    expected = F.sqrt(n * alike / (1 + n * alike))
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= expected * share - 1 / F.sqrt(n))).select("row_.*")
