"""Ingredient lists: nested brackets as trees, flattening by what the brackets mean, matching with a dictionary in ordered stages.

Flattening looks at what stands before a bracket and in it:

    a generic term with items          the items stand for it; without any left, the term alone
    three parts or more, or parts
    that are no notes                  a food with its recipe: the food and all its parts
    notes, origins or generic terms    a substance with a note: one item, written as printed

Matching takes an item's candidate names in order; the first that the dictionary knows
wins.  For a candidate, equal names come before contained ones and longer before shorter
ones.  An item's entry depends on its name alone, so each name is looked up once.  All comparisons are equi-joins on distinct names: whole candidates first, then
parts of those that are left, of the lengths that the dictionary has.  The dictionary
may have any size; so may the texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.fields import CLOSE, OPEN, SEPARATORS
from quern.functions.labels import APOSTROPHES, CANON, NOTES, label_name
from quern.functions.texts import FULL, HALF
from quern.operators.components import written
from quern.sources.tables import spread

# Generic terms, places of origin, waters, endings of organisms.
GENERIC = "品質改良劑 糊料 香辛料 色素 酸味劑 安定劑 凝固劑 膠質 酵素 萃取物 營養強化劑 乳化劑 抗氧化劑 防腐劑 著色劑 調味劑 甜味劑 香料 膨脹劑 粘稠劑 黏稠劑 保色劑 漂白劑".split()
ORIGINS = (
    "台灣 臺灣 中國 大陸 香港 美國 加拿大 墨西哥 巴西 阿根廷 智利 秘魯 尼加拉瓜 哥斯大黎加 日本 韓國 泰國 越南 印尼 馬來西亞 菲律賓 新加坡 印度 澳洲 紐西蘭 西班牙 義大利 法國 德國 荷蘭 比利時 英國 愛爾蘭 "
    "丹麥 瑞士 奧地利 波蘭 俄羅斯 烏克蘭 土耳其 埃及 南非 以色列 沙烏地阿拉伯 挪威 瑞典 芬蘭 希臘 葡萄牙"
).split()
WATERS = ["水", "純水", "熱水", "冰水", "蒸餾水", "礦泉水", "飲用水", "water"]
ORGANISMS = ["菌", "菌種", "菌粉", "黴", "酵母"]
NOTE_STARTS, NOTE_ENDS, LEADS, TAILS = ["來自", "源自", "取自", "添加", "約"], ["來源"], ["含", "添加", "另含", "並含"], ["及其製品", "及製品", "等"]
PARTS, SHARE = 3, 0.6  # parts of a food with a recipe; the least share of a name that a contained one covers

EDGE = " 　\t\r\n。，,、;；:：●•·※*"
FOLD = str.maketrans(dict(zip(FULL, HALF)) | CANON)
NOTED = re.compile(f"^(?:{'|'.join(NOTE_STARTS)})|(?:{'|'.join(NOTE_ENDS)})$|^\\d+(?:\\.\\d+)?%?$")
PIECES = re.compile("([" + re.escape(OPEN + CLOSE + SEPARATORS) + "])")
FEW = 100_000  # names that go to every task
MOST_NESTED = 200  # brackets deeper than this are read as text


def remembered(f: Callable, most: int = 1 << 14, longest: int = 200) -> Callable:
    """Results for short texts are kept in bounded number: lists repeat their names."""
    known: dict = {}

    @functools.wraps(f)
    def found(text: str, *more):
        if len(text) > longest:
            return f(text, *more)
        if (value := known.get((text, *more), known)) is known:
            if len(known) >= most:
                known.clear()
            value = known[text, *more] = f(text, *more)
        return value

    return found


@remembered
def key_of(name: str) -> str:
    """`label_name` for one text."""
    return re.sub(r"\(.*?\)|\s+", "", re.sub(APOSTROPHES, "", name.translate(FOLD)))


@remembered
def outside(name: str) -> str:
    """What stands outside of brackets, innermost pairs first."""
    while True:
        name, n = re.subn(r"[（(\[{][^（()）\[\]{}]*[)）\]}]", "", name)
        if not n:
            return name


@remembered
def bare(name: str) -> str:
    name = name.strip(EDGE)
    name = re.sub(f"^(?:{'|'.join(LEADS)})", "", name)
    return re.sub(f"(?:{'|'.join(TAILS)})$", "", name).strip()


@remembered
def noted(name: str) -> bool:
    key = key_of(name)
    return not key or key in NOTES or key in ORIGINS or bool(NOTED.search(key))


def is_generic(key: str, terms: frozenset[str]) -> bool:
    return key in terms or key.startswith("複方") and key[2:] in terms


def tree(text: str) -> list[list]:
    """[name, children] nodes.  Text after a bracket goes on with its name; a bracket right after another adds to the same node; a closing bracket too many ends a part, and one too few ends with the text."""
    top: list[list] = []
    levels: list[tuple[list, list | None]] = []  # the lists around, with their open node
    nodes, node, words = top, None, ""

    def finished() -> None:
        nonlocal words
        if word := words.strip():
            if node is None:
                nodes.append([word, []])
            else:
                node[0] = (node[0] + word).strip()
        words = ""

    for piece in PIECES.split(text):
        if piece and piece in OPEN and len(levels) < MOST_NESTED:
            word = words.strip()
            if node is None or word:
                node = [word, []]
                nodes.append(node)
            words = ""
            levels.append((nodes, node))
            nodes, node = node[1], None
        elif piece and piece in CLOSE:
            finished()
            nodes, node = levels.pop() if levels else (top, None)
        elif piece and piece in SEPARATORS:
            finished()
            node = None
        else:
            words += piece
    while True:
        finished()
        if not levels:
            return [n for n in top if n[0] or n[1]]
        nodes, node = levels.pop()


def outer_names(text: str | None) -> list[str]:
    """Keys of all names before a bracket: what a dictionary of substances is asked for."""
    found, todo = set(), tree(text or "")
    while todo:
        name, children = todo.pop()
        if children:
            found.add(key_of(outside(bare(name))))
            todo += children
    return sorted(found)


def flat_items(text: str | None, generic: frozenset[str], substances: frozenset[str]) -> list[dict]:
    """name, path, kind (top, compound, component, generic_item, generic_only) and occurrences of every item; items with one key are one."""
    found: dict[str, dict] = {}

    def put(name: str, path: tuple[str, ...], kind: str) -> bool:
        name = bare(name)
        key = key_of(name)
        if noted(name):
            return False
        if key in found:
            found[key]["occurrences"] += 1
            return False
        found[key] = {"name": name, "path": list(path), "kind": kind, "occurrences": 1}
        return True

    def below(nodes: list[list], path: tuple[str, ...], kind: str) -> int:
        new = 0
        for name, children in nodes:
            name = bare(name)
            outer = key_of(outside(name))
            if not children:
                new += put(name, path, kind)
            elif is_generic(outer, generic):
                new += below(children, (*path, name), "generic_item") or put(name, path, "generic_only")
            elif len(children) >= PARTS or not (outer in substances or all(noted(c) or is_generic(key_of(c), generic) for c, _ in children)):
                new += put(name, path, "compound" if path else "top")
                new += below(children, (*path, name), "component")
            else:
                inner = "、".join(c for c, _ in children if c)
                new += put(f"{name}({inner})" if inner else name, path, kind)
        return new

    below(tree(text or ""), (), "top")
    return list(found.values())


@remembered
def candidates(name: str, generic: frozenset[str]) -> list[str]:
    """Names to look up, in order: outside of brackets, then the parts inside; the parts first for a generic term, none of them for a food with a recipe."""
    outer = key_of(outside(name))
    inside = re.search(r"(?s)[（({\[](.*)[）)}\]]", name)
    parts = [key_of(p) for p in re.split("[、,，/]", inside[1])] if inside else []
    if outer and not is_generic(outer, generic) and sum(map(bool, parts)) >= PARTS:
        parts = []
    parts = [p for p in parts if len(p) >= 2]
    return list(dict.fromkeys(c for c in (parts + [outer] if is_generic(outer, generic) else [outer, *parts]) if c))


ITEM = "array<struct<name:string,path:array<string>,kind:string,occurrences:int,candidates:array<string>,generic:boolean,water:boolean>>"


def items_of(sections: DataFrame, key: str, text: str, substances: DataFrame | None = None, generic: list[str] = GENERIC) -> DataFrame:
    """key, place, name, path, kind, occurrences, candidates, generic, water of every item.  substances: names (column name) of known substances, of any number."""
    terms = frozenset(generic)

    @F.pandas_udf("array<string>")
    def asked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(outer_names)

    rows = sections.select(key, F.col(text).alias("text_"))
    if substances is None:
        return unfolded(rows, key, flat_texts(terms, frozenset())("text_"))
    names = written(substances.select(label_name(F.col("name")).alias("name")).where("name is not null").distinct())
    few = names.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return unfolded(rows, key, flat_texts(terms, frozenset(r["name"] for r in few))("text_"))
    rows = spread(rows)
    wanted = rows.select(key, F.explode(asked("text_")).alias("name"))
    known = wanted.join(names, "name").groupBy(key).agg(F.collect_set("name").alias("known"))
    return unfolded(spread(rows.join(known, key, "left")), key, flat_texts(terms)("text_", "known"))


def unfolded(rows: DataFrame, key: str, items: Column) -> DataFrame:
    return rows.select(key, F.posexplode(items).alias("place", "item_")).select(key, "place", "item_.*")


def flat_texts(generic: frozenset[str], substances: frozenset[str] | None = None) -> Callable:
    """An Arrow function: the items of texts, column by column.  Substances are the same for all texts or come with each."""

    @remembered
    def asked_of(name: str) -> tuple[list[str], bool, bool]:
        return candidates(name, generic), is_generic(key_of(outside(name)), generic), key_of(name) in WATERS

    def items(texts: list, known: list) -> pa.Array:
        ends, names, paths, path_ends, kinds, times, asked, asked_ends, terms, waters = [0], [], [], [0], [], [], [], [0], [], []
        for text, substances in zip(texts, known):
            for r in flat_items(text, generic, substances):
                found, term, water = asked_of(r["name"])
                names.append(r["name"])
                paths += r["path"]
                path_ends.append(len(paths))
                kinds.append(r["kind"])
                times.append(r["occurrences"])
                asked += found
                asked_ends.append(len(asked))
                terms.append(term)
                waters.append(water)
            ends.append(len(names))
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        text = lambda values: pa.array(values, pa.string())
        columns = {
            "name": text(names), "path": lists(path_ends, text(paths)), "kind": text(kinds), "occurrences": pa.array(times, pa.int32()),
            "candidates": lists(asked_ends, text(asked)), "generic": pa.array(terms, pa.bool_()), "water": pa.array(waters, pa.bool_()),
        }
        return lists(ends, pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))

    if substances is None:

        @F.arrow_udf(ITEM)
        def of_each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, known in batches:
                yield items(texts.to_pylist(), [frozenset(k or ()) for k in known.to_pylist()])

        return of_each

    @F.arrow_udf(ITEM)
    def of_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield items(texts.to_pylist(), [substances] * len(texts))

    return of_all


def dictionary_names(additives: DataFrame) -> DataFrame:
    """id, length (of the name), way (0 name, 1 part of a name, 2 English name, 3 alias), at, term, l_form of every name.  additives: id, name, english, aliases."""
    name = label_name(F.coalesce("name", F.lit("")))
    parts = F.transform(F.split(F.coalesce("name", F.lit("")), "[;；、]"), label_name)
    aliases = F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(a != "", F.lit(False))), label_name)
    l_form = F.exists(F.concat(F.array(name), parts, aliases), lambda t: F.upper(t).startswith("L-"))
    entry = lambda way: lambda t, i: F.struct(F.lit(way).alias("way"), i.alias("at"), t.alias("term"))
    lists = (F.array(name), parts, F.array(F.lower(F.coalesce("english", F.lit("")))), aliases)
    terms = F.flatten(F.array(*(F.transform(v, entry(way)) for way, v in enumerate(lists))))
    rows = additives.select("id", F.length("name").alias("length"), l_form.alias("l_form"), F.explode(F.filter(terms, lambda t: t["term"] != "")).alias("t"))
    return rows.select("id", "length", "l_form", "t.*")


def known_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """candidate, id, way (equal or the name's way), matched: the best entry of every candidate that has one.  wanted: distinct candidate.

    Names equal the candidate; else the entry's name, a part of it, its English name or its first
    alias stands in the candidate, in this order of ways, covers SHARE of it and is no organism's; a DL- form never
    takes an L- entry.  Of several entries the longest match wins, then the longest name, then the smallest id.
    """
    equal = wanted.join(names.where("way <> 2"), F.col("candidate") == F.col("term"))
    equal = equal.select("candidate", "id", "length", F.lit("equal").alias("how"), F.length("candidate").alias("matched"))
    left = wanted.join(equal.select("candidate"), "candidate", "left_anti").where(~F.col("candidate").rlike(f"(?:{'|'.join(ORGANISMS)})$"))
    lengths = names.select(F.length("term").alias("n")).distinct()
    sized = lengths.agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    parts = left.join(F.broadcast(sized), F.lit(True)).select("candidate", F.explode("lengths").alias("n")).where(F.col("n") < F.length("candidate") + 1)
    at = F.explode(F.sequence(F.lit(1), F.length("candidate") - F.col("n") + 1))
    parts = parts.select("candidate", "n", at.alias("p")).select("candidate", F.expr("substring(candidate, p, n)").alias("s"))
    both = parts.select("candidate", F.explode(F.array(F.struct(F.lit(False).alias("english"), F.col("s").alias("term")), F.struct(F.lit(True).alias("english"), F.lower("s").alias("term")))).alias("k")).select("candidate", "k.*").distinct()
    inside = both.join(names.withColumn("english", F.col("way") == 2), ["english", "term"])
    first = F.struct("way", F.when(F.col("way") == 1, -F.length("term")).otherwise(F.col("at")), F.length("term").alias("n"))
    hits = inside.groupBy("candidate", "id", "length", "l_form").agg(F.min(first).alias("f")).select("candidate", "id", "length", "l_form", F.element_at(F.array(*map(F.lit, ("name", "part", "english", "alias"))), F.col("f.way") + 1).alias("how"), F.col("f.n").alias("matched"))
    racemic = F.upper("candidate").startswith("DL-")
    hits = hits.where((F.col("matched") / F.length("candidate") >= SHARE) & ~(racemic & F.col("l_form"))).drop("l_form")
    order = F.struct(-F.col("matched"), -F.col("length"), "id")
    return equal.unionByName(hits).groupBy("candidate").agg(F.min_by(F.struct("id", "how", "matched"), order).alias("x")).select("candidate", "x.*")


def matched(items: DataFrame, additives: DataFrame, key: str, generic: list[str] = GENERIC) -> DataFrame:
    """The items with id, candidate and how of their entry, and basis: additive_db, water, generic_term or none."""
    terms, asks = [*generic, *(f"複方{g}" for g in generic)], ["name", "candidates", "generic", "water"]
    items = written(items)  # read twice: for the names, and for the items with them
    names = written(items.select(asks).distinct())  # lists repeat their names, and an entry depends on the name alone
    asked = names.where(~F.col("water") & ~(F.col("generic") & (F.size("candidates") <= 1))).select("name", F.col("candidates").alias("of"), F.posexplode("candidates").alias("turn", "candidate"))
    asked = asked.where(~F.col("candidate").isin(terms))
    known = known_names(asked.select("candidate").distinct(), dictionary_names(additives))
    first = asked.join(known, "candidate").groupBy("name", "of").agg(F.min_by(F.struct("candidate", "id", "how"), "turn").alias("m"))
    basis = F.when(F.col("m").isNotNull(), "additive_db").when(F.col("water"), "water").when(F.col("generic"), "generic_term").otherwise("none")
    first = first.withColumnsRenamed({"of": "candidates"})
    told = written(names.join(first, ["name", "candidates"], "left").select(*asks, "m", basis.alias("basis")))
    out = items.join(F.broadcast(told) if told.count() <= FEW else told, asks)
    return out.select(key, "place", "name", "path", "kind", "occurrences", "m.candidate", "m.id", "m.how", "basis")


def coverage(rows: DataFrame, key: str) -> DataFrame:
    """key, additives, waters, generic_terms, unknown (how many items each basis has) and unlisted, the names of those without one, in order."""
    count = lambda b: F.sum((F.col("basis") == b).cast("long"))
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("basis") == "none", F.struct("place", "name")))), lambda x: x["name"])
    return rows.groupBy(key).agg(count("additive_db").alias("additives"), count("water").alias("waters"), count("generic_term").alias("generic_terms"), count("none").alias("unknown"), names.alias("unlisted"))
