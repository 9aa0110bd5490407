"""Source divergence audit with count-level bitmaps.

For every language, the terms that stand in at least `LEAST` of its documents are
kept.  They are dealt to blocks of up to 1024 terms; in a block, one bitset of
term ids is stored for each (source, count).  AND plus popcount of two sources'
bitsets gives the joint cells of (count here, count there); each is multiplied by
the divergence f of its two probabilities.  Cells with a count of zero are never
stored: they follow by complement, as

    sum of f over all terms = sum over cells (a, b > 0) of n * (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
        + sum over a of size(a) * (f(a, 0) - f(0, 0)) + sum over b of size(b) * (f(0, b) - f(0, 0)) + V * f(0, 0)

Terms of a block are neighbours in the order of their counts, so frequent terms,
whose counts all differ, share small blocks and rare terms large ones.

A null text, lang or source counts as ''.  Terms are runs of ASCII letters and of
characters from U+0080 on; only A-Z are lower-cased.  Every row is a document,
so repeated rows count repeatedly.  A group without terms takes part with zeros;
where a language keeps no term, the value of its pairs is 0.  Texts of any length
are read whole, in pieces; an empty table gives an empty one; other columns are
not read.  Counts may reach 9 * 10**15 in a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, discard, lean, materialise, short_batches

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK, LEVELS, CELLS = 1024, 1500, 65_536
FOUND = "lang string, source string, part string, item string, value long"


def words_of(data: bytes, most: int = 4_000_000) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data = data.translate(TERMS)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= most else data.rfind(b" ", at, at + most) + 1 or len(data)
        end = end if end > at else len(data)
        yield data[at:end].split()
        at = end


def counted_terms(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """lang, source, term, n, docs: partial counts, and a row with an empty term for every group.  A task keeps about `most` entries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for text, *group in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, docs = counts.setdefault(tuple(group), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in words_of(text):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(n) for n, _ in counts.values()) > most:
                yield from taken(counts)
                counts = {}
        yield from taken(counts)

    def taken(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang], pa.string()).take(np.zeros(len(terms), np.int64)), "source": pa.array([source], pa.string()).take(np.zeros(len(terms), np.int64)),
                "term": pa.array(terms, pa.binary()).cast(pa.string()), "n": pa.array([0, *n.values()], pa.int64()), "docs": pa.array([0, *(docs[t] for t in terms[1:])], pa.int64()),
            })

    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return texts.mapInArrow(lean(rows), "lang string, source string, term string, n long, docs long")


BLOCKS = "lang string, terms array<string>, totals array<long>, sources array<string>, counts array<long>, bits binary"


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of count-level bitmaps from rows lang, term, source, n, total that are sorted by lang, total and term."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows >= CELLS:
            table = pa.concat_tables(held).combine_chunks()
            starts = term_starts(table)
            if len(starts) > 64:  # the last term may go on, and blocks begin at whole units of 64 terms
                cut = int(starts[(len(starts) - 1) // 64 * 64])
                yield from blocks_of(table.slice(0, cut))
                held = [table.slice(cut).combine_chunks()]
            else:
                held = [table]
            rows = held[0].num_rows
    if rows:
        yield from blocks_of(pa.concat_tables(held).combine_chunks())


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    made = column.combine_chunks().dictionary_encode()
    made = made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary.to_pylist()


def term_starts(table: pa.Table) -> np.ndarray:
    """Rows at which another term or language begins."""
    term, lang = coded(table["term"])[0], coded(table["lang"])[0]
    return np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])])


def blocks_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    starts = term_starts(table)
    lang, langs = coded(table["lang"])
    source, sources = coded(table["source"])
    n, totals = table["n"].to_numpy().astype(np.int64), table["total"].to_numpy()[starts]
    names = table["term"].combine_chunks().take(pa.array(starts)).to_pylist()
    edges = np.append(starts, len(n))
    of_lang, at = lang[starts], 0
    while at < len(starts):
        until = at + int((np.r_[of_lang[at:], -1] != of_lang[at]).argmax())
        size = min(BLOCK, until - at)
        while True:
            rows = slice(int(edges[at]), int(edges[at + size]))
            order = np.lexsort((n[rows], source[rows]))
            s, c = source[rows][order], n[rows][order]
            level = np.cumsum(np.r_[False, (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
            if level[-1] < LEVELS or size <= 64:
                break
            size = max(64, size // 2)
        term = np.repeat(np.arange(size), np.diff(edges[at : at + size + 1]))[order]
        bits = np.zeros((level[-1] + 1, -(-size // 64) * 64), bool)
        bits[level, term] = True
        first = np.flatnonzero(np.diff(level, prepend=-1))
        packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
        yield block(langs[of_lang[at]], names[at : at + size], totals[at : at + size].tolist(), [sources[i] for i in s[first]], c[first].tolist(), packed)
        at += size


def block(lang: str, terms: list[str], totals: list[int], sources: list[str], counts: list[int], bits: bytes) -> pa.RecordBatch:
    texts, longs = pa.list_(pa.string()), pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({"lang": [lang], "terms": pa.array([terms], texts), "totals": pa.array([totals], longs), "sources": pa.array([sources], texts), "counts": pa.array([counts], longs), "bits": pa.array([bits], pa.binary())})


def stored_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The index: blocks with their terms, totals and bitsets, written to the shared folder.  Groups' names stand in rows without terms."""
    rows = counted_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = rows.withColumn("docs", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term)).where((F.col("docs") >= least) | (F.col("term") == ""))
    return materialise(kept.select("lang", "term", "source", "n", "total").sortWithinPartitions("lang", F.desc("total"), "term", "source").mapInArrow(lean(split_markers), BLOCKS))


def split_markers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the terms; rows with an empty term become blocks without terms."""

    def terms() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            empty = np.array([t == "" for t in batch.column("term").to_pylist()], bool)
            if empty.any():
                groups.extend(zip(*(c.to_pylist() for c in table.select(["lang", "source"]).filter(pa.array(empty)).columns)))
            yield from table.filter(pa.array(~empty)).to_batches()

    groups: list[tuple[str, str]] = []
    yield from bitmaps(terms())
    for lang, source in groups:
        yield block(lang, [], [], [source], [0], b"")


def words_in(row: dict) -> np.ndarray:
    """Levels x 64-bit words."""
    return np.frombuffer(row["bits"], np.uint64).reshape(len(row["counts"]), -1)


def level_sizes(blocks: DataFrame) -> DataFrame:
    """lang, source, count, size: how many terms have that count; count 0 with size 0 for every group; source null: how many terms the language keeps."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                if not row["terms"]:
                    for source in row["sources"]:
                        sizes[row["lang"], source, 0] += 0
                    continue
                for source, count, size in zip(row["sources"], row["counts"], np.bitwise_count(words_in(row)).sum(axis=1, dtype=np.int64).tolist()):
                    sizes[row["lang"], source, count] += size
                sizes[row["lang"], None, 0] += len(row["terms"])
        keys = list(sizes)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "source": pa.array([k[1] for k in keys], pa.string()), "count": pa.array([k[2] for k in keys], pa.int64()), "size": pa.array([sizes[k] for k in keys], pa.int64())})

    return blocks.mapInArrow(lean(rows), "lang string, source string, count long, size long")


def shares(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole) by long division, three digits a step."""
    left, out = np.asarray(count, np.int64) + 1, 0
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def joint_cells(words: np.ndarray, most: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(level, level, n) of all pairs of levels that share terms, by AND and popcount, in tiles of `most` levels."""
    for i in range(0, len(words), most):
        for j in range(0, len(words), most):
            left, right = words[i : i + most], words[j : j + most]
            n = np.zeros((len(left), len(right)), np.int32)
            for w in range(words.shape[1]):
                a, b = np.flatnonzero(left[:, w]), np.flatnonzero(right[:, w])
                n[np.ix_(a, b)] += np.bitwise_count(left[a, w, None] & right[None, b, w])
            a, b = np.nonzero(n)
            yield a + i, b + j, n[a, b].astype(np.int64)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND: by pair the sum over joint cells, which lacks the zeros; by group the TOP terms of this task's blocks."""
    sums: dict[str, np.ndarray] = {}
    best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
    names: dict[str, list[str]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            lang, whole = row["lang"], np.array(row["of_sources"]) + row["v"]
            names[lang] = row["all_sources"]
            at = {s: i for i, s in enumerate(names[lang])}
            group, counts, words = np.array([at[s] for s in row["sources"]]), np.array(row["counts"]), words_in(row)
            p, zero = shares(counts, whole[group]), shares(np.zeros(len(whole), np.int64), whole)
            total = sums.setdefault(lang, np.zeros((len(whole), len(whole)), np.int64))
            for a, b, n in joint_cells(words):
                other = group[a] != group[b]
                a, b, n = a[other], b[other], n[other]
                ga, gb = group[a], group[b]
                f = divergence(p[a], p[b]) - divergence(p[a], zero[gb]) - divergence(zero[ga], p[b]) + divergence(zero[ga], zero[gb])
                np.add.at(total, (ga, gb), n * f)
            level, term = np.nonzero(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"))
            q = shares(np.array(row["totals"]), row["total"] + row["v"])
            above = p[level] > q[term]
            level, term = level[above], term[above]
            f = divergence(p[level], q[term])
            order = np.argsort(group[level], kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(group[level][order])) + 1) if len(order) else []:
                kept = best.setdefault((lang, names[lang][group[level[part[0]]]]), [])
                least = -kept[TOP - 1][0] if len(kept) >= TOP else 0
                kept += [(-v, row["terms"][t].encode()) for v, t in zip(f[part].tolist(), term[part].tolist()) if v >= least]
                kept.sort()
                del kept[TOP:]
    for lang, total in sums.items():
        a, b = np.nonzero(total)
        yield found(lang, [names[lang][i] for i in a], "pair", [names[lang][i] for i in b], total[a, b])
    for (lang, source), kept in best.items():
        yield found(lang, [source] * len(kept), "term", [t.decode() for _, t in kept], [-v for v, _ in kept])


def found(lang: str, sources: list[str], part: str, items: list[str], values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(items), pa.string()), "source": pa.array(sources, pa.string()), "part": pa.array([part] * len(items), pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})


def share_column(count: Column, whole: Column) -> Column:
    return (F.lit(1) + F.call_function("div", (count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))).cast("long")


def divergence_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence, and the terms that set a source apart from its language (at most `top` <= TOP)."""
    short_batches(docs.sparkSession)
    blocks = stored_bitmaps(docs, least)
    sizes = materialise(level_sizes(blocks).groupBy("lang", "source", "count").agg(F.sum("size").alias("size")))
    groups = sizes.where("source is not null").groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("size")).alias("n"))
    kept = sizes.where("source is null").groupBy("lang").agg(F.sum("size").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("total")).join(kept, "lang", "left").fillna(0, ["v"])
    groups = materialise(groups.join(langs, "lang").withColumn("whole", F.col("n") + F.col("v")))
    every = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"), F.first("v").alias("v"), F.first("total").alias("total"))
    every = materialise(every.select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("of_sources"), "v", "total"))
    salts = 32
    salted = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = blocks.where(F.size("terms") > 0).withColumn("salt", F.pmod(F.xxhash64(F.col("terms")[0]), F.lit(salts)).cast("int"))
    made = materialise(dealt.join(salted, ["lang", "salt"]).drop("salt").mapInArrow(lean(compared), FOUND))

    here, there = groups.select("lang", "source", "v", "whole"), groups.select("lang", F.col("source").alias("item"), F.col("whole").alias("other"))
    pairs = here.join(there, "lang").where("source <> item")
    zero_p, zero_q = share_column(F.lit(0), F.col("whole")), share_column(F.lit(0), F.col("other"))
    neither = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * divergence_column(zero_p, zero_q)).otherwise(0).alias("value"))
    level = sizes.where("source is not null and size > 0").join(groups.select("lang", "source", "whole"), ["lang", "source"])
    p = share_column(F.col("count"), F.col("whole"))
    one_side = level.join(there, "lang").where("source <> item").select(
        "lang", "source", "item", "size", p.alias("p"), zero_p.alias("p0"), zero_q.alias("q0")
    )
    as_group = one_side.select("lang", "source", "item", (F.col("size") * (divergence_column(F.col("p"), F.col("q0")) - divergence_column(F.col("p0"), F.col("q0")))).alias("value"))
    as_other = one_side.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("size") * (divergence_column(F.col("q0"), F.col("p")) - divergence_column(F.col("q0"), F.col("p0")))).alias("value"))
    parts = neither.unionAll(as_group).unionAll(as_other).unionAll(made.where("part = 'pair'").select("lang", "source", "item", "value"))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    terms = made.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = materialise(ranked.unionAll(terms.select(ranked.columns)))
    discard(blocks, sizes, groups, every, made)
    return out


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(v.v), 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v USING (lang) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(g.n + g.v AS HUGEINT) AS p
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
lp AS (SELECT k.lang, k.term, 1 + CAST({SCALE} AS HUGEINT) * (k.total + 1) // CAST(v.n + v.v AS HUGEINT) AS q FROM kept k JOIN v USING (lang)),
term AS (SELECT cell.lang, cell.source, 'term' AS part, cell.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM cell JOIN lp USING (lang, term) WHERE cell.n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= {TOP}
"""
