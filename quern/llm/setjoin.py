"""Exact set-similarity self-joins: pairs of token sets with Jaccard >= num / den.

Tokens are ordered by rarity.  Rarity is read from a table of counts over all
records, each token counted in one of 2**16 to 2**24 buckets, as the number of rows
asks for; where buckets hold many tokens, most of what a bucket holds in the median is
taken off.  Any fixed order gives the same result, a good one gives few candidates.  Two sets that
reach the threshold share the l smallest of their common tokens within their
first n - ceil(t n) + l tokens, for every l up to their overlap; so each record
publishes such a prefix.  A record whose prefix tokens are frequent takes a larger l:
the prefix grows, and its partners must share more of it.  A pair is held to the
smaller l of its two records.

Published tokens travel as packed blocks, dealt by token to buckets of bounded
size.  Every token has a list; lists of tokens counted more than `HOT` times are
dealt on, by record, to parts that share a few records.  Lists of up to `SHORT` records give all their
pairs that pass the length, positional and bitmap filters (the last: a parity
bitmap, whose differing bits bound the symmetric difference), unless these are
more than `DENSE` a record and `SLACK`.  From dense and longer lists come only the pairs with
the first `PIVOTS` records; what those pairs leave undecided is joined again, see
`remaining_pairs`.  Candidates are verified on the whole sets.

Records are known by a 64-bit hash of their set, so equal sets are one record.
Hashing 64 bits wide, two sets or tokens are taken for one with probability
about m**2 / 2**65 among m of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import counted_arrays, discard, lean, materialise, mix, portions

BUCKET_BITS = 16, 24  # least, most: 16 buckets a row
FILTER_BITS = 20, 26
SEEN = 500_000  # records that a task remembers to pass over copies; copies that it forgets do no harm
PART = 50_000  # rows of a list that meet the undecided ones in one place
SHORT, DENSE, SLACK, PIVOTS = 1024, 4, 64, 8
HOT, BUCKET_BYTES = 100_000, 8_000_000


@dataclass(frozen=True)
class Join:
    """What to join: `flat` turns texts into (row, place in the row, token) arrays, sorted by row and place; or a fourth array has the tokens and the third their places in it."""

    flat: Callable[[pa.Array], tuple[np.ndarray, ...]]
    num: int
    den: int
    least: int = 1
    most_matches: int = 1
    words: int = 4  # of 64 bits in a bitmap; a power of two
    publish_from: int = 1  # sets of fewer tokens reach the threshold only with equal sets, which are one record, and publish nothing

    @property
    def posting(self) -> np.dtype:
        return np.dtype([("token", "<i8"), ("rid", "<i8"), ("o1", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("salt", "<i4"), ("matches", "<i1"), ("pivot", "<i1"), *((w, "<i8") for w in self.bits)])

    @property
    def bits(self) -> list[str]:
        return [f"w{i}" for i in range(self.words)]


@dataclass
class Records:
    """Token sets in flat form: record i has tokens[start[i] : start[i] + n[i]], in rarity order if keys are given."""

    row: np.ndarray
    place: np.ndarray
    start: np.ndarray
    n: np.ndarray
    rid: np.ndarray
    tokens: np.ndarray
    keys: np.ndarray


def bits_for(rows: int, limits: tuple[int, int], more: int) -> int:
    """Bits of a table for that many rows, 2**more a row within the limits."""
    return min(max(int(rows).bit_length() + more, limits[0]), limits[1])


def rarity(counts: np.ndarray) -> np.ndarray:
    """Classes 0..255 of counts: 0 none, 1 one, then rising with the logarithm.

    In a crowded table, where the median bucket holds more than 16, the excess over 16 is
    taken off, so that tokens do not seem frequent for their neighbours' sake; below that
    the counts themselves give the finer order.
    """
    above = np.maximum(counts - max(0, int(np.median(counts)) - 16), 2)
    return np.where(counts <= 1, counts, np.minimum(255, 2 + np.floor(7 * np.log2(above)))).astype(np.uint8)


def typical(classes: np.ndarray) -> np.ndarray:
    """About the count that a class stands for."""
    return np.where(classes <= 1, classes, 2.0 ** ((classes.astype(float) - 2) / 7))


def records(flat: tuple[np.ndarray, ...], least: int, classes: np.ndarray | None = None) -> Records:
    """Distinct tokens of every (row, place), those with at least `least` of them; flat: what `Join.flat` returns."""
    row, place, tokens, *coded = flat
    tokens, codes = (coded[0], tokens) if coded else (tokens, None)
    change = np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1]))) if len(row) else np.zeros(0, bool)
    at = np.cumsum(change) - 1
    keys = tokens >> np.uint64(8)
    if classes is not None:
        keys = keys | (classes[tokens >> np.uint64(65 - len(classes).bit_length())].astype(np.uint64) << np.uint64(56))
    if codes is not None:  # few distinct tokens are put in order, then plain numbers are sorted
        order = np.argsort(keys)
        keys, tokens = keys[order], tokens[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        rank = np.empty(len(keys), np.uint64)
        rank[order] = np.cumsum(new) - 1
        keys, tokens, width = keys[new], tokens[new], np.uint64(len(keys).bit_length())
        both = np.sort((at.astype(np.uint64) << width) | rank[codes])
        both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
        at, rank = (both >> width).astype(np.int64), both & ((np.uint64(1) << width) - np.uint64(1))
        keys, tokens, once = keys[rank], tokens[rank], np.ones(len(at), bool)
    else:
        if len(at) and at[-1] < 1 << 16:  # two sorts of plain numbers are faster than one by two keys
            order = np.argsort(keys)
            order = order[np.argsort(at[order].astype(np.uint16), kind="stable")]
        else:
            order = np.lexsort((keys, at))
        at, keys, tokens = at[order], keys[order], tokens[order]
        once = np.concatenate(([True], (at[1:] != at[:-1]) | (keys[1:] != keys[:-1]))) if len(at) else np.zeros(0, bool)
    n = np.bincount(at[once], minlength=int(change.sum()))
    ok = n >= max(1, least)
    once &= ok[at]
    tokens, keys, n = tokens[once], keys[once], n[ok]
    start = np.cumsum(n) - n
    rid = np.add.reduceat(mix(tokens >> np.uint64(8)), start) if len(n) else np.zeros(0, np.uint64)
    return Records(row[change][ok], place[change][ok], start, n, mix(rid).view(np.int64), tokens, keys)


def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(ids, texts) of a batch in portions of bounded size; rows without id or text are left out."""
    batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
    ids, texts = batch.column(0).to_numpy(), batch.column(1)
    for i, j in portions(texts):
        yield ids[i:j], texts.slice(i, j - i)


class Seen(dict):
    """Record -> its earliest (document, place) so far in a task, of the last `SEEN` records or so."""

    def new(self, keys: list[int], places: list[tuple[int, int]]) -> np.ndarray:
        """Where a record is met for the first time, or earlier than before."""
        out = np.zeros(len(keys), bool)
        for i, (key, place) in enumerate(zip(keys, places)):
            old = self.get(key)
            if old is None or place < old:
                self[key] = place
                out[i] = True
        if len(self) > SEEN:
            self.clear()
        return out


def members(docs: DataFrame, join: Join) -> tuple[DataFrame, np.ndarray]:
    """(rid, o1 = the document, o2 = the record's place in it, n) of every record, as a written table, and the rarity classes."""
    bits = bits_for(docs.count(), BUCKET_BITS, 4)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        pending: list[np.ndarray] = []
        seen = Seen()
        for batch in batches:
            for ids, texts in parts(batch):
                r = records(join.flat(texts), join.least)
                new = seen.new(r.rid.tolist(), [(0, 0)] * len(r.n))  # copies would make their tokens seem frequent
                pending.append((r.tokens[np.repeat(new, r.n)] >> np.uint64(64 - bits)).astype(np.int32))
                if sum(map(len, pending)) > 2_000_000:
                    counts += np.bincount(np.concatenate(pending), minlength=len(counts)).astype(np.int32)
                    pending = []
                none = pa.nulls(len(r.n), pa.string()), pa.nulls(len(r.n), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r.rid), pa.array(ids[r.row]), pa.array(r.place.astype(np.int32)), pa.array(r.n.astype(np.int32)), *none], names)
        if pending:
            counts += np.bincount(np.concatenate(pending), minlength=len(counts)).astype(np.int32)
        size = 1 << 16
        for i in range(0, len(counts), size):
            piece = counts[i : i + size]
            data = piece.astype(np.uint8 if piece.max() < 256 else np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([f"{i // size:03d}"]), pa.array([data])], names)

    names = ["rid", "o1", "o2", "n", "chunk", "counts"]
    both = materialise(docs.mapInArrow(lean(scan), "rid long, o1 long, o2 int, n int, chunk string, counts binary"))

    def counted(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(data, np.uint8 if len(data) == 1 << 16 else np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + piece if chunk in sums else piece
        return sums.items()

    found = counted_arrays(both.where("chunk is not null").select("chunk", "counts"), counted)
    counts = np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(1 << bits, np.int64)
    table = materialise(both.where("chunk is null").select("rid", "o1", "o2", "n"))
    discard(both)
    return table, rarity(counts)


def prefixes(r: Records, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(matches that each record asks for, flat mask of the tokens that it publishes)."""
    needed = -(-join.num * r.n // join.den)
    first = r.n - needed + 1
    classes = (r.keys >> np.uint64(56)).astype(np.uint8)
    running = np.concatenate(([0.0], np.cumsum(typical(classes))))
    best, cost = np.ones(len(r.n), np.int64), np.full(len(r.n), np.inf)
    for matches in range(1, join.most_matches + 1):
        length = first + matches - 1
        scanned = running[np.minimum(r.start + length, len(r.keys))] - running[r.start]
        estimate = scanned + 8.0 * np.maximum(0, scanned - length) / matches
        better = (estimate < 0.9 * cost) & (matches <= needed)
        best, cost = np.where(better, matches, best), np.where(better, estimate, cost)
    position = np.arange(len(r.keys)) - np.repeat(r.start, r.n)
    return best, (position < np.repeat(first + best - 1, r.n)) & (classes != 1)  # a count of one: no other record has it


def bitmaps(r: Records, words: int) -> list[np.ndarray]:
    """Parities of the tokens by their last bits, as words of 64 bits."""
    word, bit = (r.tokens >> np.uint64(6)) & np.uint64(words - 1), np.uint64(1) << (r.tokens & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), r.start).view(np.int64) if len(r.n) else np.zeros(0, np.int64) for i in range(words)]


def buckets_for(found: DataFrame, join: Join) -> int:
    """How many buckets keep each near `BUCKET_BYTES`; more if there are more shuffle partitions."""
    published = found.agg(F.sum(F.col("n") * (1 - join.num / join.den) + 1 + join.most_matches)).first()[0] or 0
    return max(int(published * join.posting.itemsize / BUCKET_BYTES) + 1, 2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def postings(docs: DataFrame, join: Join, classes: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, data): packed rows for the tokens that records publish; a record once a partition, or again where it lies earlier."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # one byte a bucket, 16 MB at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for ids, texts in parts(batch):
                r = records(join.flat(texts), join.least, shared.value)
                o1 = ids[r.row]
                new = seen.new(r.rid.tolist(), list(zip(o1.tolist(), r.place.tolist())))
                matches, published = prefixes(r, join)
                published &= np.repeat(new & (r.n >= join.publish_from), r.n)
                which = np.repeat(np.arange(len(r.n)), r.n)[published]
                out = np.zeros(len(which), join.posting)
                out["token"], out["rid"], out["o1"], out["n"] = r.keys[published].view(np.int64), r.rid[which], o1[which], r.n[which]
                out["pos"], out["matches"], out["salt"] = (np.arange(len(r.keys)) - np.repeat(r.start, r.n))[published], matches[which], -1
                for w, column in zip(join.bits, bitmaps(r, join.words)):
                    out[w] = column[which]
                often = typical((r.keys[published] >> np.uint64(56)).astype(np.uint8))
                if (hot := often > HOT).any():
                    pieces, spread = np.ceil(often[hot] / HOT).astype(np.int64), mix(out["rid"][hot].view(np.uint64))
                    pivot = spread < (PIVOTS / often[hot] * 2.0**64).astype(np.uint64)
                    out["salt"][hot], out["pivot"][hot] = (spread >> np.uint64(32)).astype(np.int64) % pieces, pivot
                    every = np.repeat(out[hot][pivot], pieces[pivot])  # the shared records go to all parts
                    every["salt"] = np.concatenate([np.arange(k) for k in pieces[pivot]]) if pivot.any() else 0
                    keep = np.ones(len(out), bool)
                    keep[np.flatnonzero(hot)[pivot]] = False
                    out = np.concatenate((out[keep], every))
                bucket = (mix(out["token"].view(np.uint64) + (out["salt"] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, out = bucket[order], out[order]
                edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
                data = [part.tobytes() for part in np.split(out, edges[1:])] if len(edges) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array(data, pa.binary())], ["bucket", "data"])

    return docs.mapInArrow(lean(scan), "bucket int, data binary")


def may_match(a: dict[str, np.ndarray], i: np.ndarray, b: dict[str, np.ndarray], j: np.ndarray, join: Join) -> np.ndarray:
    """Where rows i of a and j of b, which share a token, pass the length, bitmap and positional filters; as places in i.

    Only the first l shared tokens of a pair need to pass, l being the matches it is held to: so up to this one it shares l at most.
    """
    na, nb = a["n"][i].astype(np.int64), b["n"][j].astype(np.int64)
    needed = -(-join.num * (na + nb) // (join.num + join.den))
    room = na + nb - 2 * needed  # most differing tokens
    left = np.flatnonzero((np.minimum(na, nb) * join.den >= join.num * np.maximum(na, nb)) & (a["rid"][i] != b["rid"][j]))
    differ = np.zeros(len(left), np.int64)
    for w in join.bits:
        differ += np.bitwise_count((a[w][i[left]] ^ b[w][j[left]]).view(np.uint64))
        ok = differ <= room[left]
        left, differ = left[ok], differ[ok]
    pa_, pb = a["pos"][i[left]].astype(np.int64), b["pos"][j[left]].astype(np.int64)
    before = np.minimum(np.minimum(pa_, pb) + 1, np.minimum(a["matches"][i[left]], b["matches"][j[left]]))
    return left[before + np.minimum(na[left] - pa_ - 1, nb[left] - pb - 1) >= needed[left]]


def without_copies(x: np.ndarray) -> np.ndarray:
    """Postings with each (token, salt, rid) once, in the earliest document: every task that met a record has published it."""
    order = np.argsort(mix(mix(x["rid"].view(np.uint64)) + x["token"].view(np.uint64) + x["salt"].astype(np.uint64)))
    before, after = order[:-1], order[1:]
    same = np.ones(len(before), bool)
    for c in ("token", "rid", "salt"):
        same &= x[c][before] == x[c][after]
    if not same.any():
        return x
    begins = np.flatnonzero(np.concatenate(([True], ~same)))
    out = x[order[begins]]
    out["o1"] = np.minimum.reduceat(x["o1"][order], begins)
    return out


def listed(blocks: DataFrame, join: Join) -> DataFrame:
    """From postings: kind 0 candidate pairs (a < b); kind 1 the rows of dense and long lists, with rid in `a`.  Memory: one bucket."""
    bits = join.bits

    def pairs(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        m = len(a)
        blank = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in bits)]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need.astype(np.int32)), *blank], names)

    def star(pivots: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows of a long list against a few of its records, and themselves."""
        p, m = len(pivots), len(x)
        for at in range(0, m, 20_000):
            k = min(20_000, m - at)
            i, j = np.repeat(np.arange(p), k), np.tile(np.arange(at, at + k), p)
            ok = may_match(pivots, i, x, j, join)
            yield pairs(pivots["rid"][i[ok]], x["rid"][j[ok]], np.zeros(len(ok)))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(x["rid"].copy()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *(pa.array(x[c].copy()) for c in ("token", "n", "pos", *bits))], names)

    def solve(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The lists of one bucket."""
        x = without_copies(x)
        x = x[np.lexsort((x["o1"], x["salt"], x["token"]))]
        begins = np.flatnonzero(np.concatenate(([True], (x["token"][1:] != x["token"][:-1]) | (x["salt"][1:] != x["salt"][:-1]))))
        sizes = np.diff(np.append(begins, len(x)))
        of = np.repeat(np.arange(len(sizes)), sizes)
        by_length = np.lexsort((x["n"], of))
        n = x["n"][by_length].astype(np.int64)
        found, counts, dense = [], np.zeros(len(sizes), np.int64), (sizes > SHORT) | (x["salt"][begins] >= 0)
        # The shorter of two records shares 2 t / (1 + t) of its own tokens at least, so its first shared ones stand that far from its end.
        early = x["pos"] < x["n"] - -(-2 * join.num * x["n"].astype(np.int64) // (join.num + join.den)) + x["matches"]
        left, ahead = np.flatnonzero(~dense[of] & (sizes[of] > 1) & early[by_length]), 1
        columns = {c: np.ascontiguousarray(x[c]) for c in ("rid", "n", "pos", "matches", *bits)}
        while len(left):  # each row with the one that follows `ahead` places later in its list, while lengths allow
            left = left[left + ahead < len(n)]
            left = left[(of[left] == of[left + ahead]) & (n[left] * join.den >= join.num * n[left + ahead])]
            for at in range(0, len(left), 100_000):
                i, j = by_length[left[at : at + 100_000]], by_length[left[at : at + 100_000] + ahead]
                if len(ok := may_match(columns, i, columns, j, join)):
                    found.append((i[ok], j[ok]))
                    counts += np.bincount(of[i[ok]], minlength=len(sizes))
            if (crowded := (counts > DENSE * sizes + SLACK) & ~dense).any():
                dense |= crowded
                left = left[~dense[of[left]]]
                found = [(i[keep], j[keep]) for i, j in found for keep in (~dense[of[i]],)]
            ahead += 1
        if found:
            i, j = (np.concatenate(side) for side in zip(*found))
            yield pairs(x["rid"][i], x["rid"][j], np.minimum(x["matches"][i], x["matches"][j]))
        for at, size in zip(begins[dense].tolist(), sizes[dense].tolist()):
            rows = x[at : at + size]
            pivots = rows[rows["pivot"] > 0]
            yield from star(pivots if len(pivots) else rows[:PIVOTS], rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield from solve(np.frombuffer(b"".join(held), join.posting))
                    held = []
                now = bucket
                held.append(data.as_buffer().to_pybytes())
        if held:
            yield from solve(np.frombuffer(b"".join(held), join.posting))

    names = ["kind", "a", "b", "need", "token", "n", "pos", *bits]
    schema = "kind int, a long, b long, need int, token long, n int, pos int, " + ", ".join(f"{b} long" for b in bits)
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(scan), schema)


def sets_of(docs: DataFrame, join: Join, wanted: DataFrame) -> DataFrame:
    """(rid, tokens, further columns of `wanted`) of the records in `wanted`: a written table of rid, o1 (a document that has the record) and any more.

    Filters of fixed size pick the documents to cut into words and then the records; what they let through besides does no harm.
    """
    spark = docs.sparkSession
    size = 1 << bits_for(wanted.count(), FILTER_BITS, 7)
    mask = size - 1

    def marks(batches: Iterator[pa.RecordBatch]):
        found = np.zeros((2, size), bool)
        for batch in batches:
            for k in (0, 1):
                found[k, (mix(batch.column(k).to_numpy().view(np.uint64)) & np.uint64(mask)).astype(np.int64)] = True
        yield "rid", np.packbits(found[0])
        yield "document", np.packbits(found[1])

    got = counted_arrays(wanted.select("rid", "o1"), marks, merge="or")
    none = np.zeros(size // 8, np.uint8)
    shared = spark.sparkContext.broadcast((got.get("rid", none), got.get("document", none)))

    def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = (mix(keys.view(np.uint64)) & np.uint64(mask)).astype(np.int64)
        return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, documents = shared.value
        seen = Seen()
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(has(documents, batch.column(0).to_numpy()))) if batch.num_rows else batch
            for _, texts in parts(batch):
                r = records(join.flat(texts), join.least)
                keep = np.flatnonzero(has(rids, r.rid))
                mine = np.zeros(len(r.n), bool)
                mine[keep[seen.new(r.rid[keep].tolist(), [(0, 0)] * len(keep))]] = True
                keep = mine
                offsets = np.concatenate(([0], np.cumsum(r.n[keep]))).astype(np.int32)
                tokens = r.tokens[np.repeat(keep, r.n)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r.rid[keep]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], ["rid", "tokens"])

    found = docs.mapInArrow(lean(scan), "rid long, tokens array<long>").dropDuplicates(["rid"])
    return materialise(found.join(wanted.drop("o1"), "rid"))


def matching(sets: DataFrame, pairs: DataFrame, join: Join, *more: str) -> DataFrame:
    """The pairs (a, b) that reach the threshold, with columns of `sets` for both, named c_a and c_b."""
    side = lambda s, tokens: sets.select(F.col("rid").alias(s), F.col("tokens").alias(tokens), *(F.col(c).alias(f"{c}_{s}") for c in more))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(common * join.den >= (F.size("x") + F.size("y") - common) * join.num).select("a", "b", *(f"{c}_{s}" for c in more for s in "ab"))


def candidates(docs: DataFrame, join: Join, found: DataFrame, classes: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs, rows of dense and long lists), both written out."""
    rows = materialise(listed(postings(docs, join, classes, buckets_for(found, join)), join))
    pairs = rows.where("kind = 0")
    if join.most_matches > 1:
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("times"), F.min("need").alias("need")).where("times >= need")
    pairs = materialise(pairs.select("a", "b").distinct())
    long_rows = materialise(rows.where("kind = 1").select(F.col("a").alias("rid"), "token", "n", "pos", *join.bits))
    discard(rows)
    return pairs, long_rows


def in_question(pairs: DataFrame, long_rows: DataFrame) -> DataFrame:
    """rid of every record that a verification may need."""
    return pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).union(long_rows.select("rid")).distinct()


def join_condition(join: Join):
    """The filters of `may_match` for columns of two long-list rows, l and r, that share a token."""
    na, nb = F.col("l.n").cast("long"), F.col("r.n").cast("long")
    needed = F.ceil((na + nb) * join.num / (join.num + join.den) - F.lit(1e-9))
    differ = sum((F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}"))) for w in join.bits), F.lit(0))
    fits = F.least("l.pos", "r.pos") + 1 + F.least(na - F.col("l.pos") - 1, nb - F.col("r.pos") - 1) >= needed
    return (F.least(na, nb) * join.den >= F.greatest(na, nb) * join.num) & fits & (differ <= na + nb - 2 * needed)


def remaining_pairs(long_rows: DataFrame, known: DataFrame, join: Join, undecided: DataFrame, differ) -> DataFrame:
    """Pairs of long lists that the first records did not decide: rows of `undecided` against all of their lists.

    `differ` is a condition on l (undecided) and r; pairs in `known` are left out.  A list of more than `PART` rows is
    dealt to parts by record, and its undecided rows go to all of them.
    """
    parts = long_rows.groupBy("token").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    dealt = long_rows.join(parts, "token", "left").withColumn("part", F.pmod(F.xxhash64("rid"), F.coalesce("parts", F.lit(1))).cast("int"))
    asking = undecided.join(parts, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.rid") != F.col("r.rid"))
    pairs = asking.alias("l").join(dealt.alias("r"), same & differ & join_condition(join))
    pairs = pairs.select(F.least("l.rid", "r.rid").alias("a"), F.greatest("l.rid", "r.rid").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(id, component = its smallest id) of every id in the edges (a, b): large-star and small-star until nothing changes."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, after = None, state(now)
    while before != after:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then, now = now, materialise(small)
        discard(then)
        before, after = after, state(now)
    out = materialise(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v")).distinct())
    discard(now)
    return out
