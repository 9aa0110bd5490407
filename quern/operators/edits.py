"""Recognition errors: the edits between an expected text and the best matching part of what was read, and their counts.

The part of the read text begins and ends anywhere at no cost.  Of equal alignments a
match or substitution comes before a missing character, and that before an extra one;
the part that ends first is taken.  A column of the table of costs is two numbers with a
bit for every pattern character (Myers' bit vectors), so a text character takes a dozen
operations on them.  Columns are kept for the trace; of long pairs only those at intervals
of the square root of the text's length, and those between are computed again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACE = "struct<edits:int,ops:array<struct<op:string,at:int,expected:string,read:string>>>"
KEPT = 1 << 26  # bits of columns kept at once


def places_of(patterns: list[str]) -> tuple[dict[str, int], int, list[int]]:
    """Each character's bits, all bits, and each pattern's last one.  Patterns stand side by side with a free bit between, which ends carries."""
    at, bits, whole, last = 0, {}, 0, []
    for p in patterns:
        for i, c in enumerate(p, at):
            bits.setdefault(c, []).append(i)
        whole |= ((1 << len(p)) - 1) << at
        at += len(p) + 1
        last.append(at - 2)
    packed = {}
    for c, places in bits.items():
        flags = bytearray((at >> 3) + 1)
        for i in places:
            flags[i >> 3] |= 1 << (i & 7)
        packed[c] = int.from_bytes(flags, "little")
    return packed, whole, last


def fewest_edits(patterns: list[str], text: str, most: int = 1 << 25) -> list[int]:
    """Fewest edits between each pattern (none empty) and any part of the text, all in one pass over it."""
    if not patterns:
        return []
    bits, whole, last = places_of(patterns)
    up, down, size = whole, 0, (whole.bit_length() + 7) // 8
    last = np.array(last)
    costs = np.array([len(p) for p in patterns], np.int64)
    least = costs.copy()
    for begin in range(0, len(text), step := max(1, most // (8 * max(size, len(patterns))))):
        more, less = [], []
        for c in text[begin : begin + step]:
            eq = bits.get(c, 0)
            same = ((((eq & up) + up) ^ up) | eq | down) & whole
            plus, minus = down | whole & ~(same | up), same & up
            more.append(plus.to_bytes(size, "little"))
            less.append(minus.to_bytes(size, "little"))
            plus, minus = plus << 1 & whole, minus << 1 & whole
            up, down = minus | whole & ~(same | plus), plus & same
        rise, fall = ((np.frombuffer(b"".join(x), np.uint8).reshape(-1, size)[:, last >> 3] >> (last & 7).astype(np.uint8) & 1).astype(np.int64) for x in (more, less))
        row = costs + np.cumsum(rise - fall, axis=0)
        costs, least = row[-1], np.minimum(least, row.min(axis=0))
    return least.tolist()


def edit_trace(pattern: str, text: str) -> tuple[int, list[tuple[str, int, str | None, str | None]]]:
    """(edits, [(sub, del or ins, place in the pattern, expected, read)]) of the best part of the text."""
    if not pattern:
        return 0, []
    m, n = len(pattern), len(text)
    bits, whole, _ = places_of([pattern])
    step = max(1, n if m * n <= KEPT else math.isqrt(n))
    up, down, cost, edits, end = whole, 0, m, m, 0
    kept: list[tuple[int, int]] = []  # the columns before each interval
    diagonal: list[int] = []  # of one interval: where the cost equals that of a character less on both sides
    rising: list[int] = []  # and where it is one more than that of a character less of the pattern

    def passed(up: int, down: int, begin: int, cost: int, edits: int, end: int) -> tuple[int, int, int, int, int]:
        diagonal.clear()
        rising.clear()
        for j, c in enumerate(text[begin : begin + step], begin + 1):
            eq = bits.get(c, 0)
            same = ((((eq & up) + up) ^ up) | eq | down) & whole
            plus, minus = down | whole & ~(same | up), same & up
            cost += (plus >> (m - 1)) - (minus >> (m - 1))
            if cost < edits:
                edits, end = cost, j
            plus, minus = plus << 1 & whole, minus << 1
            up, down = (minus | ~(same | plus)) & whole, plus & same
            diagonal.append(same)
            rising.append(up)
        return up, down, cost, edits, end

    for begin in range(0, n, step):
        kept.append((up, down))
        up, down, cost, edits, end = passed(up, down, begin, cost, edits, end)
    held = len(kept) - 1  # the interval whose columns are there
    i, at, ops = m, end, []
    while i > 0:
        if at and pattern[i - 1] == text[at - 1]:
            i, at = i - 1, at - 1
            continue
        if at:
            if held != (at - 1) // step:
                held = (at - 1) // step
                passed(*kept[held], held * step, 0, 0, 0)
            column = at - 1 - held * step
            if not diagonal[column] >> (i - 1) & 1:
                ops.append(("sub", i - 1, pattern[i - 1], text[at - 1]))
                i, at = i - 1, at - 1
                continue
            if not rising[column] >> (i - 1) & 1:
                ops.append(("ins", i, None, text[at - 1]))
                at -= 1
                continue
        ops.append(("del", i - 1, pattern[i - 1], None))
        i -= 1
    return edits, ops[::-1]


def with_trace(df: DataFrame, pattern: str, text: str) -> DataFrame:
    """Adds edits and ops; a null counts as ''."""

    @F.pandas_udf(TRACE)
    def trace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            made = [edit_trace(x or "", y or "") for x, y in zip(a, b)]
            ops = [[dict(zip(("op", "at", "expected", "read"), o)) for o in m[1]] for m in made]
            yield pd.DataFrame({"edits": [m[0] for m in made], "ops": ops})

    # Not deterministic, so that no filter on the result is pushed below and traces everything a second time.
    return df.withColumn("trace_", trace.asNondeterministic()(pattern, text)).select("*", "trace_.*").drop("trace_")


def confusions(traced: DataFrame) -> DataFrame:
    """op, expected, read, n: how often each character was read as another, missed or added."""
    return traced.select(F.explode("ops").alias("o")).groupBy("o.op", "o.expected", "o.read").agg(F.count("*").alias("n"))


def found_items(df: DataFrame, key: str, items: str, text: str) -> DataFrame:
    """key, place, item, edits, found of every expected item: exact where the text holds it, fuzzy within a quarter of its length (one edit at least), else missed.

    Only items that the text does not hold are aligned with it, all of a text's in one pass.  Empty items are left out.
    """
    kind = "array<struct<place:int,item:string,edits:int>>"

    @F.pandas_udf(kind)
    def fewest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, texts in batches:
            out = []
            for listed, t in zip(lists, texts):
                there = [(place, x) for place, x in enumerate([] if listed is None else listed) if x]
                edits = dict.fromkeys((x for _, x in there if x in (t or "")), 0)
                left = list(dict.fromkeys(x for _, x in there if x not in edits))
                edits |= zip(left, fewest_edits(left, t or ""))
                out.append([{"place": place, "item": x, "edits": edits[x]} for place, x in there])
            yield pd.Series(out, dtype=object)

    rows = df.select(key, F.explode(fewest(items, text)).alias("x")).select(key, "x.*")
    room = F.greatest(F.lit(1), F.floor(F.length("item") / 4))
    return rows.withColumn("found", F.when(F.col("edits") == 0, "exact").when(F.col("edits") <= room, "fuzzy").otherwise("missed"))
