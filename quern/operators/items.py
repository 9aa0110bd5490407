"""Item lists of two readers: fuzzy equality, one-to-one matching, merging; and numbers by field in recognised text.

Lists are those of one record, so they are short; each function takes Arrow batches of records.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.grouped import substring_edits

LEAST_FUZZY = 6  # items of fewer characters are one only if they are equal

# A nutrition table's fields in the order in which they are looked for, what must not stand before them, numbers, and the mark of a column of daily values.
FIELDS = {
    "calories": "熱量|热量", "protein": "蛋白[質质贸]", "saturated_fat": "[飽饱鮑鲍]和脂肪", "trans_fat": "反式脂肪", "fat": "脂肪",
    "carbohydrates": "碳水化合物", "fiber": "膳食[纖纤织]維|膳食[纖纤织]维", "sugar": "糖", "sodium": "[鈉钠纳]",
}
NOT_AFTER = {"sugar": "蔗葡萄麥芽乳砂果白黑紅寡多海藻糊焦", "sodium": "酸化磷碳", "fat": "飽饱鮑鲍反式和不", "protein": "豆乳大分離濃縮水解"}
DAILY = "每日[參参]考值?|[參参]考值百分比"
UNITS = "大卡|公克|毫克|公絲|公升|毫升|kcal|g|mg|ml"
GAPS = 8, 10  # characters from a name to its number, and from that number's unit to the second one

NAMES = {key: re.compile((f"(?<![{NOT_AFTER[key]}])" if key in NOT_AFTER else "") + f"(?:{names})") for key, names in FIELDS.items()}
NUMBER = re.compile(rf"(\d+(?:[.,]\d+)?)\s*(?:{UNITS})?")


def plain(item: str | None) -> str:
    """An item's letters and digits, in compatible form (NFKC)."""
    return "".join(c for c in unicodedata.normalize("NFKC", item or "") if c.isalnum())


def alike_table(wanted: list[str], got: list[str]) -> np.ndarray:
    """Which item of one list is which of the other: at most as many edits as a quarter of the shorter one's length, one at least.

    Items are compared by their letters and digits; one without any is like nothing.
    """
    a, b = [plain(x) for x in wanted], [plain(x) for x in got]
    rows, columns = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    shorter = np.minimum.outer(rows, columns)
    room = np.maximum(shorter // 4, 1)
    table = (shorter > 0) & (np.abs(np.subtract.outer(rows, columns)) <= room)
    for i, j in np.argwhere(table):
        table[i, j] = a[i] == b[j] or substring_edits(a[i], b[j]) <= room[i, j]
    return table


def alike(a: str, b: str) -> bool:
    return bool(alike_table([a], [b])[0, 0])


def match_lists(got: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """Each wanted item takes the first alike item that is still free; what remains on either side.  A null list is an empty one."""

    def match(items: list[str], others: list[str]) -> tuple[int, list[str], list[str]]:
        free, met = np.ones(len(items), bool), np.zeros(len(others), bool)
        for w, row in enumerate(alike_table(others, items)):
            places = np.flatnonzero(row & free)
            if places.size:
                free[places[0]], met[w] = False, True
        return int(met.sum()), [x for x, m in zip(others, met) if not m], [x for x, f in zip(items, free) if f]

    return pd.DataFrame([match(*(list(x) if x is not None else [] for x in pair)) for pair in zip(got, wanted)], columns=["hits", "missed", "spurious"])


def merge_lists(base: pd.Series, more: pd.Series) -> pd.Series:
    """Both readers' items, each once: of alike ones the longest (the first of equals), in their order.  Short items are one only if equal."""

    def merge(items: list[str]) -> list[str]:
        lengths, table, kept = np.array([len(x) for x in items]), alike_table(items, items), np.zeros(len(items), bool)
        for i in np.flatnonzero(lengths < LEAST_FUZZY):
            table[i] = [x == items[i] for x in items]
        for i in np.argsort(-lengths, kind="stable"):
            kept[i] = not (table[i] & kept).any()
        return [x for x, k in zip(items, kept) if k]

    return pd.Series([merge([x for side in pair if side is not None for x in side]) for pair in zip(base, more)])


def field_numbers(text: str | None) -> dict[str, list[float | None]]:
    """Field -> [first, second number behind its name].  No two fields share a place; a table of daily values has no second number.

    Names and numbers are two lists of places.  A name is given the next number if that is near
    enough, and that number the one after it.  What names claim is then granted in the order of FIELDS and
    of places; a name inside its own field's last claim claims nothing.  Signs are not read.
    """
    line = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").replace("·", ".").replace("、", " "))
    numbers = list(NUMBER.finditer(line))
    if not numbers:
        return {}
    starts, ends = [n.start() for n in numbers], [n.end() for n in numbers]
    value = lambda n: float(numbers[n][1].replace(",", "."))
    daily = re.search(DAILY, line) is not None
    claims: list[tuple[int, int]] = []  # granted, one a field at most
    out = {}
    for key, name in NAMES.items():
        behind = 0
        for m in name.finditer(line):
            begin, end = m.span()
            n = bisect.bisect_left(starts, end)
            if begin < behind or n == len(starts) or starts[n] - end > GAPS[0]:
                continue
            has_next = n + 1 < len(starts) and starts[n + 1] - ends[n] <= GAPS[1]
            behind = ends[n + has_next]
            if not any(begin < e and b < behind for b, e in claims):
                claims.append((begin, behind))
                out[key] = [value(n), value(n + 1) if has_next and not daily else None]
                break
    return out


def fields_of(text: pd.Series) -> pd.Series:
    """Equal texts of a batch are read once."""
    codes, distinct = pd.factorize(text, use_na_sentinel=False)
    found = np.empty(len(distinct), dtype=object)
    found[:] = [field_numbers(None if pd.isna(t) else t) for t in distinct]
    return pd.Series(found[codes], dtype=object)


def matched(got: Column, wanted: Column) -> Column:
    return F.pandas_udf(match_lists, "struct<hits:int,missed:array<string>,spurious:array<string>>")(got, wanted)


def merged(base: Column, more: Column) -> Column:
    return F.pandas_udf(merge_lists, "array<string>")(base, more)


def numbers_by_field(text: Column) -> Column:
    return F.pandas_udf(fields_of, "map<string,array<double>>")(text)
