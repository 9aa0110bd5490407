"""Near-duplicate lines: an exact set-similarity join over all lines.

A line's set holds its distinct words (bytes between white space, A-Z in lower
case).  Lines are compared across and within documents; two match at a Jaccard
similarity of 0.8 or more.  A line goes if it matches any earlier one, in the
order of document id and line number.  Only blank lines always stay.  Sets of up
to three words match equal sets only; four words also match five that hold them.

Null texts stay null, empty ones empty, texts of rows without id stay as they are.
Line numbers count from 0, split at newlines only; texts and lines may have any
length.  Rows that share an id count as one document whose lines coincide: equal
lines at the same number are one line there.  Other columns are carried along under
any name; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.llm.common import as_bytes, discard, lean, materialise, word_codes
from quern.llm.setjoin import Join, candidates, in_question, matching, members, remaining_pairs, sets_of


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat words of all lines, as places in their distinct hashes, for `Join.flat`."""
    split = pc.split_pattern(texts, "\n")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths, words, hashes = word_codes(split.flatten())
    row, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, lengths), np.repeat(place, lengths), words, hashes


def later(pairs: DataFrame) -> DataFrame:
    """(rid, at) of the later line set of every pair (a, b, at_a, at_b)."""
    side = lambda s: F.struct(F.col(s).alias("rid"), F.col(f"at_{s}").alias("at"))
    return pairs.select(F.when(F.col("at_a") < F.col("at_b"), side("b")).otherwise(side("a")).alias("x")).select("x.*").distinct()


def repeated_lines(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id long, gone array<int>: the line numbers that go, for every document that loses some."""
    join = Join(lines, num, den, words=2, publish_from=-(-num // max(den - num, 1)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    found, classes = members(rows, join)
    first = materialise(found.groupBy("rid").agg(F.min(F.struct("o1", "o2")).alias("at"), F.count("*").alias("times")))
    pairs, long_rows = candidates(rows, join, found, classes)
    asked = materialise(in_question(pairs, long_rows).join(first.select("rid", "at"), "rid"))
    sets = sets_of(rows, join, asked.select("rid", "at.o1", "at"))
    gone = materialise(later(matching(sets, pairs, join, "at")))
    spent = [found, first, pairs, long_rows, asked, sets, gone]
    if not long_rows.isEmpty():
        # Lines that no first record of a list removed meet all earlier lines of their lists.
        placed = long_rows.distinct().join(asked, "rid")
        undecided = placed.join(gone.select("rid"), "rid", "left_anti")
        more = materialise(remaining_pairs(placed, pairs, join, undecided, F.col("r.at") < F.col("l.at")))
        spent.append(more)
        if not more.isEmpty():
            gone = gone.union(later(matching(sets, more, join, "at")))
    # What goes: all but the first place of a set, and the first place of a set that matches an earlier one.
    again = first.where("times > 1").select("rid", "at")
    lost = found.join(again, "rid").where(F.struct("o1", "o2") != F.col("at")).select("o1", "o2").union(gone.select("at.o1", "at.o2"))
    out = materialise(lost.groupBy(F.col("o1").alias("id")).agg(F.sort_array(F.collect_set("o2")).alias("gone")))
    discard(*spent)
    return out


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """row_ (the other columns, as a struct, so that no name can clash), text_ without its lost lines, n_lines_ and n_gone_ (0 where nothing is lost)."""
    others = F.struct(*(docs[c] for c in docs.columns if c != text))
    side = gone.select(F.col("id").alias("lost_id_"), F.col("gone").alias("gone_"))
    rows = docs.select(others.alias("row_"), docs[id_col].cast("long").alias("id_"), docs[text].alias("text_"))
    # The lists of lost lines grow with the documents, so they are hashed and never broadcast; the texts need no sort.
    rows = rows.join(side.hint("shuffle_hash"), F.col("id_") == F.col("lost_id_"), "left").select("row_", "text_", "gone_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, lost = [], [], []
            for data, numbers in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                parts = data.split(b"\n") if data else []
                if numbers:
                    drop = set(numbers)
                    data = b"\n".join(p for i, p in enumerate(parts) if i not in drop)
                texts.append(data)
                counts.append(len(parts))
                lost.append(len(numbers or ()))
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(counts, pa.int32()), pa.array(lost, pa.int32())], ["row_", "text_", "n_lines_", "n_gone_"])

    schema = StructType([rows.schema["row_"], rows.schema["text_"], StructField("n_lines_", IntegerType()), StructField("n_gone_", IntegerType())])
    return rows.mapInArrow(lean(cut), schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The query: each document's counts and the digest of what stays."""
    rows = docs.select("doc_id", "text")
    cut = without_lines(rows, repeated_lines(rows))
    return cut.select("row_.doc_id", F.col("n_lines_").cast("long").alias("n_lines"), F.col("n_gone_").cast("long").alias("n_removed"), F.length("text_").cast("long").alias("n_chars_kept"), F.md5(F.col("text_")).alias("text_md5"))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without repeated lines; those of which nothing is left go.  Columns as before, n_chars is counted anew."""
    cut = without_lines(docs, repeated_lines(docs)).where((F.col("n_gone_") == 0) | (F.trim(F.translate("text_", "\n\r\t", "   ")) != ""))
    columns = {c: F.col("row_").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text_")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_gone_") > 0, F.length("text_").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return cut.select(*(columns[c].alias(c) for c in docs.columns))
