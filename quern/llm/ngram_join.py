"""Near-duplicate documents: n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its word n-grams; a text with fewer words
is one n-gram.  See `setjoin` for the join.  Each document takes one to four
shared prefix tokens, whichever its estimated cost (lists scanned plus candidates
to verify) makes cheapest.

Null, empty and blank texts have empty sets and link with nothing.  Equal sets
are one record, so copies of any number cost one.  A row repeated with its id
stays repeated, with equal values.  Rows without id are compared like the others
(their component has the smallest id that is there, null if none is); ids must stay
below 2**63 - 1.  Whole texts are cut into words, of any length.  Other columns are
not read, so their names cannot clash; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialise, mix, word_hashes
from quern.llm.setjoin import Join, candidates, components, in_question, matching, members, remaining_pairs, sets_of

NO_ID = (1 << 63) - 1  # stands for a null id, after all others


def ngrams(size: int):
    """Flat word n-grams of texts, for `Join.flat`."""

    def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths, h = word_hashes(texts)
        row = np.repeat(np.arange(len(texts)), lengths)
        left = np.repeat(lengths, lengths) - (np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths))  # words from here to the end
        gram = np.zeros(len(h), np.uint64)
        for i in range(size):
            word = np.concatenate((h[i:], np.zeros(min(i, len(h)), np.uint64)))
            gram = np.where(left > i, mix(gram * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(i + 1)), gram)
        first = left == np.repeat(lengths, lengths)
        use = (left >= size) | (first & (np.repeat(lengths, lengths) < size))
        return row[use], np.zeros(int(use.sum()), np.int64), gram[use]

    return flat


def linked(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links, itself included); one row per input row."""
    join = Join(ngrams(size), num, den, most_matches=4)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("t"))
    found, classes = members(rows, join)
    first = materialise(found.groupBy("rid").agg(F.min("o1").alias("o1")))
    pairs, long_rows = candidates(rows, join, found, classes)
    asked = materialise(in_question(pairs, long_rows).join(first, "rid"))
    sets = sets_of(rows, join, asked)
    edges = materialise(matching(sets, pairs, join))
    groups = components(edges)
    spent = [first, pairs, long_rows, asked, sets, edges]
    if not long_rows.isEmpty():
        named = materialise(long_rows.join(groups, long_rows.rid == groups.id, "left").select(long_rows["*"], F.coalesce("component", "rid").alias("component")).distinct())
        # Of each list, the largest component need not meet itself: the others' rows meet all rows.
        largest = named.groupBy("token", "component").count().groupBy("token").agg(F.max(F.struct("count", "component"))["component"].alias("largest"))
        undecided = named.join(largest, "token").where("component <> largest").drop("largest")
        more = materialise(remaining_pairs(named, pairs, join, undecided, F.col("l.component") != F.col("r.component")))
        spent += [named, more]
        if not more.isEmpty():
            further = materialise(matching(sets, more, join))
            spent += [further, groups]
            groups = components(edges.union(further))
    first = first.join(groups, first.rid == groups.id, "left").select("rid", "o1", F.coalesce("component", "rid").alias("component"))
    smallest = first.groupBy("component").agg(F.min("o1").alias("component_id"))
    full = found.join(first.join(smallest, "component").select("rid", "component_id"), "rid").select("o1", F.col("n").cast("long").alias("n_shingles"), "component_id")
    full = materialise(full)
    discard(*spent, found, groups)
    blank = rows.where(F.col("t").isNull() | ~F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    out = full.union(blank.select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.nullif("o1", F.lit(NO_ID)).alias(id_col), "n_shingles", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's query: three words, 100 * common >= 90 * union."""
    return linked(docs, 3, 90, 100)


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: five words, Jaccard 0.8; of each group the smallest id stays.  Rows without id stay.

    Only ids that go are joined to the documents.
    """
    gone = linked(docs, 5, 4, 5).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
