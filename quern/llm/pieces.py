"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes pieces of a given vocabulary (a parameter; nothing is trained):
blanks are written as U+2581 with one put in front, and every way to cover the
text by pieces is a path of the piece lattice.  A forward Viterbi pass gives the
best score from the start to every place.  A backward A-star search from the end
takes these scores as its heuristic; as they are exact, complete paths leave the
queue best first.  Characters in no piece, and U+2581 itself, become byte pieces.

No piece crosses the start of a run of blanks (the vocabulary is checked for
that), so the lattice falls apart there, and so it does between any two
characters that are neighbours in no piece.  These parts are searched on their own
and remembered within a task, in bounded memory, and a text's N best come from its
parts' N best.  A text of any length is whole; texts are taken in portions of about
2 MB, and the distinct chunks of a portion are looked up once.  Best paths of new chunks are found together,
the search's first results; of the chunk that the second best changes, the queue gives
the second.  Equal scores go to
the path found first, a fixed rule.  decode(encode(t)) == t.

Null texts have null ids, empty ones no ids and score 0.  Rows are independent, so
repeated ones get equal values; an empty table gives an empty one.  A kept column that
bears a name of the result's is an error (`tokenised` drops it).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.common import gathered, lean, portions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10
NO_GAP = 1 << 62  # of a chunk with one way only
MADE = ["ids", "n_tokens", "score", "second_score", "second_from", "second_dropped", "second_ids", "round_trip"]
BUILT: dict[str, Vocabulary] = {}  # a worker's tables, by the digest of the pieces


@dataclass
class Vocabulary:
    automaton: object  # finds all pieces in a text, by their ends: the id
    scores: list[int]  # id -> score
    single: set[str]  # characters that are pieces
    joins: set[str]  # pairs of neighbouring characters in pieces
    byte_ids: list[int]
    out: list[bytes]  # id -> bytes
    unknown: int
    lines: bool  # whether a newline is a chunk of its own: no piece has one

    def __post_init__(self) -> None:
        self.chunks = r"\n| +[^ \n]*|[^ \n]+" if self.lines else r" +[^ ]*"
        self.lengths = [len(o.decode("utf-8", "replace")) for o in self.out]  # id -> characters
        self.piece_lengths, self.piece_scores = np.array(self.lengths), np.array(self.scores)
        self.plain = np.zeros(0x110000, bool)  # characters that are pieces, a blank as itself
        self.plain[[32 if c == BLANK else ord(c) for c in self.single]] = True
        self.out_data = np.frombuffer(b"".join(self.out), np.uint8)
        self.out_lengths = np.array([len(o) for o in self.out])
        self.out_starts = np.cumsum(self.out_lengths) - self.out_lengths


def listed_pieces(model_file: str = MODEL) -> list[tuple[str, int | None]]:
    """Pieces and scores by id; no score where a piece is not matched with text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = lambda i: not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    return [(model.id_to_piece(i) if plain(i) or model.is_byte(i) else "", round(model.get_score(i)) if plain(i) else None) for i in range(model.get_piece_size())]


def vocabulary(listed: list[tuple[str, int | None]] | None = None) -> Vocabulary:
    """The search's tables, built within each task from the list of pieces."""
    import ahocorasick

    ids, byte_ids, out = {}, [-1] * 256, []
    for i, (piece, score) in enumerate(listed or listed_pieces()):
        if score is not None:
            ids[piece] = i, score
            out.append(piece.replace(BLANK, " ").encode())
        elif piece:
            byte_ids[int(piece[3:5], 16)] = i
            out.append(bytes([byte_ids.index(i)]))
        else:
            out.append(b"")
    if -1 in byte_ids:
        raise ValueError("the vocabulary needs byte pieces")
    if any(BLANK in p.lstrip(BLANK) for p in ids):
        raise ValueError("a piece crosses the start of a word")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p, (i, _) in ids.items():
        automaton.add_word(p, i)
    automaton.make_automaton()
    joins = {p[i : i + 2].replace(BLANK, " ") for p in ids for i in range(len(p) - 1)}
    usual = [s for _, s in ids.values() if s > -1_000_000]
    scores = [score or 0 for _, score in listed or listed_pieces()]
    return Vocabulary(automaton, scores, {p for p in ids if len(p) == 1}, joins, byte_ids, out, min(usual, default=0) - UNKNOWN_PENALTY, not any("\n" in p for p in ids))


def lattice(chunk: str, v: Vocabulary) -> tuple[list[list[tuple[int, int, tuple[int, ...]]]], list[int]]:
    """Edges by their end (start, score, ids), and the best score from the start to every place."""
    blanks = len(chunk) - len(chunk.lstrip(" "))
    s = BLANK * blanks + (chunk[blanks:].replace(BLANK, "\uffff") if BLANK in chunk else chunk[blanks:])  # U+FFFF is in no piece
    n = len(s)
    ends: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
    best = [0] + [-(1 << 62)] * n
    for last, piece in v.automaton.iter(s):  # by rising ends, so all earlier places are final
        j, score = last + 1, v.scores[piece]
        i = j - v.lengths[piece]
        ends[j].append((i, score, (piece,)))
        if best[i] + score > best[j]:
            best[j] = best[i] + score
    if not v.single.issuperset(s):
        for j in range(1, n + 1):
            if s[j - 1] not in v.single:
                ends[j].append((j - 1, v.unknown, tuple(v.byte_ids[b] for b in chunk[j - 1].encode())))
            best[j] = max(best[i] + score for i, score, _ in ends[j])
    return ends, best


def n_best(chunk: str, v: Vocabulary, n: int) -> list[tuple[int, list[int]]]:
    """The n best (score, ids) of one chunk, best first, by A-star search from the end.

    A state's promise, what is behind it plus the best score up to it, is the exact
    score of its best completion.  So a state taken from the queue goes straight to
    the start along the steps that keep its promise, and only the side steps on that
    way enter the queue, no more than the results that are still wanted.
    """
    ends, best = lattice(chunk, v)
    found: list[tuple[int, list[int]]] = []
    queue: list[tuple] = [(-best[-1], len(ends) - 1, 0, 0, None)]  # of equal promise the one nearest to the start comes first
    count = 0
    while queue and len(found) < n:
        promise, at, _, behind, path = heapq.heappop(queue)
        wanted = n - len(found) - 1
        while at:
            straight = None
            for i, score, ids in ends[at]:
                ahead = behind + score + best[i]
                if straight is None and ahead == -promise:
                    straight = i, behind + score, (ids, path)
                elif wanted:
                    count += 1
                    heapq.heappush(queue, (-ahead, i, count, behind + score, (ids, path)))
            at, behind, path = straight
        if len(queue) > 4 * wanted + 16:
            queue = heapq.nsmallest(wanted, queue)  # sorted, so a heap; what is below these cannot be among the n best
        out: list[int] = []
        while path is not None:
            out += path[0]
            path = path[1]
        found.append((behind, out))
    return found


def best_and_gap(chunk: str, v: Vocabulary) -> tuple[int, int, list[int]]:
    """(best score, how much less the second best has, best ids): the search of `n_best`, ended when it would take its second state."""
    ends, best = lattice(chunk, v)
    at, second, out = len(ends) - 1, -NO_GAP, []
    behind, promise = 0, best[-1]
    while at:
        straight = None
        for i, score, ids in ends[at]:
            ahead = behind + score + best[i]
            if straight is None and ahead == promise:
                straight = i, behind + score, ids
            elif ahead > second:
                second = ahead
        at, behind, ids = straight
        out.append(ids)
    return promise, promise - second if second > -NO_GAP else NO_GAP, [i for ids in reversed(out) for i in ids]


def searched_together(chunks: list[str], v: Vocabulary) -> list[bytes]:
    """`best_and_gap` of many chunks at once, packed; all their characters are pieces.

    The chunks' lattices stand one behind the other.  Scores go forward one place at a
    time in all of them, and the first states go backward one step at a time.
    """
    joined = "\uffff".join(chunks).replace(" ", BLANK)
    lengths = np.array([len(c) for c in chunks])
    begin = np.cumsum(lengths + 1) - lengths - 1
    edges = np.fromiter(itertools.chain.from_iterable(v.automaton.iter(joined)), np.int64).reshape(-1, 2)
    piece, to = edges[:, 1], edges[:, 0] + 1
    start, score = to - v.piece_lengths[piece], v.piece_scores[piece]
    best = np.full(len(joined) + 1, -(1 << 62))
    best[begin] = 0
    place = to - np.repeat(begin, lengths + 1)[to - 1]
    order = np.argsort(place.astype(np.int16), kind="stable")
    bounds = np.searchsorted(place[order], np.arange(1, lengths.max() + 2))
    for a, b in zip(bounds, bounds[1:]):
        now = order[a:b]
        ends = to[now]
        first = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
        best[ends[first]] = np.maximum.reduceat(best[start[now]] + score[now], first)
    behind = best[to] - best[start] - score  # by how much a step falls short of its place's best
    straight = np.zeros(len(joined) + 1, np.int64)
    exact = np.flatnonzero(behind == 0)[::-1]
    straight[to[exact]] = exact  # the first such step of every place
    behind[straight[to[exact]]] = NO_GAP
    nodes = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    side = np.full(len(joined) + 1, NO_GAP)
    side[to[nodes]] = np.minimum.reduceat(behind, nodes)
    at, gap, who = begin + lengths, np.full(len(chunks), NO_GAP), np.arange(len(chunks))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    total = best[at]
    while len(who):
        gap[who] = np.minimum(gap[who], side[at])
        step = straight[at]
        steps.append((who, piece[step]))
        at = start[step]
        left = at > begin[who]
        at, who = at[left], who[left]
    chunk = np.concatenate([w for w, _ in steps[::-1]])
    order = np.argsort(chunk, kind="stable")
    n = np.bincount(chunk, minlength=len(chunks))
    size = n + 4
    out = np.zeros(int(size.sum()), np.int32)
    head = np.cumsum(size) - size
    out[head[:, None] + np.arange(4)] = np.stack((total, gap), axis=1).view(np.int32)
    out[gathered(head + 4, n)] = np.concatenate([p for _, p in steps[::-1]])[order]
    data, edges_of = out.tobytes(), (4 * np.append(head, len(out))).tolist()
    return [data[a:b] for a, b in zip(edges_of, edges_of[1:])]


class Remembered(dict):
    """Chunk -> packed (score, gap, ids), kept for one task.  `most_bytes` bounds it: when full, what was not used since the last time goes."""

    def __init__(self, v: Vocabulary, most_bytes: int = 24_000_000):
        super().__init__()
        self.v, self.most_bytes, self.bytes = v, most_bytes, 0
        self.older: dict[str, bytes] = {}
        self.seconds: dict[str, list[int]] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        return self.kept(chunk, self.search(chunk) if found is None else found)

    def all_of(self, chunks: list[str]) -> list[bytes]:
        """The packed results of distinct chunks; new ones of up to 60 plain characters are searched together."""
        found = [self.get(c) or self.older.get(c) for c in chunks]
        new = [i for i, f in enumerate(found) if f is None and len(chunks[i]) <= 60 and "\uffff" not in chunks[i]]
        if new:
            joined = np.frombuffer("\uffff".join([chunks[i] for i in new]).encode("utf-32-le"), np.uint32)
            apart = joined == 0xFFFF
            odd = np.bincount(np.cumsum(apart)[~apart & ~self.v.plain[joined]], minlength=len(new)) > 0
            new = [i for i, x in zip(new, odd.tolist()) if not x]
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                for i, f in zip(part, searched_together([chunks[i] for i in part], self.v)):
                    found[i] = f
        for i, (c, f) in enumerate(zip(chunks, found)):
            found[i] = self.kept(c, f) if f is not None else self[c]
        return found

    def kept(self, chunk: str, found: bytes) -> bytes:
        if len(chunk) < 100 and chunk not in self:
            self.bytes += len(found) + 4 * len(chunk) + 200  # with the objects' and the table's overhead
            if self.bytes > self.most_bytes:
                self.older = dict(self)
                self.clear()
                self.bytes = 0
            self[chunk] = found
        return found

    def search(self, chunk: str) -> bytes:
        """The chunk's parts, cut where no piece can join two characters, are searched on their own."""
        if not (cuts := self.cuts(chunk)):
            return packed(*best_and_gap(chunk, self.v))
        parts = [unpacked(self[chunk[i:j]]) for i, j in zip([0, *cuts], [*cuts, len(chunk)])]
        return packed(sum(p[0] for p in parts), min(p[1] for p in parts), [i for p in parts for i in p[2]])

    def cuts(self, chunk: str) -> list[int]:
        return [] if BLANK in chunk else [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.v.joins]

    def second(self, chunk: str) -> list[int]:
        """Ids of the chunk's second best way, which has one: the A-star search of the part whose second is nearest to its best."""
        found = self.seconds.get(chunk)
        if found is None:
            edges = [0, *self.cuts(chunk), len(chunk)]
            parts = [chunk[i:j] for i, j in zip(edges, edges[1:])]
            known = [unpacked(self[p]) for p in parts]
            at = min(range(len(parts)), key=lambda i: (known[i][1], -i))
            known[at] = n_best(parts[at], self.v, 2)[1]
            found = [i for p in known for i in p[-1]]
            if len(self.seconds) >= 20_000:
                self.seconds.clear()
            if len(chunk) < 1000:
                self.seconds[chunk] = found
        return found


def packed(score: int, gap: int, ids: list[int]) -> bytes:
    return struct.pack(f"<qq{len(ids)}i", score, gap, *ids)


def unpacked(data: bytes) -> tuple[int, int, list[int]]:
    score, gap, *ids = struct.unpack(f"<qq{len(data) // 4 - 4}i", data)
    return score, gap, ids


def merged(a: list, b: list, n: int) -> list:
    """The n best sums of two lists that are sorted best first."""
    queue, out, seen = [(-(a[0][0] + b[0][0]), 0, 0)], [], {(0, 0)}
    while queue and len(out) < n:
        score, i, j = heapq.heappop(queue)
        out.append((-score, (a[i][1], b[j][1])))
        for x in ((i + 1, j), (i, j + 1)):
            if x[0] < len(a) and x[1] < len(b) and x not in seen:
                seen.add(x)
                heapq.heappush(queue, (-(a[x[0]][0] + b[x[1]][0]), *x))
    return out


def segmentations(text: str, v: Vocabulary, n: int) -> list[tuple[int, list[int]]]:
    """The n best segmentations of a text as (score, ids)."""
    best: list = [(0, None)]
    known: dict = {}
    for chunk in re.findall(v.chunks, " " + text) if text else []:
        if chunk not in known:
            known[chunk] = n_best(chunk, v, n)
        best = merged(best, known[chunk], n)
    out = []
    for score, path in best:
        ids: list[list[int]] = []
        while path is not None:
            path, last = path
            ids.append(last)
        out.append((score, [i for part in reversed(ids) for i in part]))
    return out


def chunk_codes(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts that are not empty: the bytes with a blank in front of each, the texts' starts, the distinct chunks, each chunk's code, each text's first chunk."""
    with_blank = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(with_blank.buffers()[1], np.int64)[with_blank.offset : with_blank.offset + len(with_blank) + 1]
    data = np.frombuffer(with_blank.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    blank = data == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    if v.lines:
        ends = data == 10
        first |= ends
        first[1:] |= ends[:-1]
    first[starts] = True
    at = np.flatnonzero(first)
    chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
    return data, starts, chunks.dictionary, chunks.indices.to_numpy(), np.searchsorted(at, starts)


def encoded(texts: pa.Array, v: Vocabulary, known: Remembered) -> list[pa.Array]:
    """ids, n_tokens, score, second_score, second_from, second_dropped, second_ids, round_trip of one portion of texts.

    The second best changes one chunk, the last one of those whose second way is nearest to the best.
    """
    usable = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
    at = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
    there = texts.is_valid().to_numpy(zero_copy_only=False)
    n_tokens, scores, gaps, same = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.full(len(texts), NO_GAP), np.ones(len(texts), bool)
    ids = np.zeros(0, np.int32)
    begin_at, dropped, others = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [None] * len(texts)
    if len(at):
        data, starts, distinct, codes, first = chunk_codes(texts.filter(usable), v)
        found = known.all_of(distinct.to_pylist())
        size = np.array([len(f) // 4 for f in found])
        blob, begin = np.frombuffer(b"".join(found), np.int32), np.cumsum(size) - size
        head = blob[begin[:, None] + np.arange(4)].view(np.int64)  # (score, gap) of every distinct chunk
        n = size[codes] - 4
        ids = blob[gathered(begin[codes] + 4, n)]
        n_tokens[at] = np.add.reduceat(n, first)
        scores[at], gaps[at] = np.add.reduceat(head[codes, 0], first), np.minimum.reduceat(head[codes, 1], first)
        gap, owner = head[codes, 1], np.repeat(np.arange(len(at)), np.diff(np.append(first, len(codes))))
        least = np.flatnonzero((gap == gaps[at][owner]) & (gap < NO_GAP))
        last = np.full(len(at), -1)
        last[owner[least]] = least  # of several the last assignment holds
        ahead = np.cumsum(n) - n
        names = distinct.take(pa.array(codes[last[last >= 0]])).to_pylist()
        for row, place, chunk in zip(np.flatnonzero(last >= 0).tolist(), last[last >= 0].tolist(), names):
            begin_at[at[row]], dropped[at[row]], others[at[row]] = ahead[place] - ahead[first[row]], n[place], known.second(chunk)
        # Decoding: the ids' bytes must be the texts, each with its blank in front.
        lengths = v.out_lengths[ids]
        token = np.concatenate(([0], np.cumsum(n_tokens[at])))
        byte = np.concatenate(([0], np.cumsum(lengths)))[token]
        back = v.out_data[gathered(v.out_starts[ids], lengths)]
        if len(back) == len(data) and (byte[:-1] == starts).all() and (back == data).all():
            pass
        else:
            want = np.append(starts, len(data))
            same[at] = [(back[byte[i] : byte[i + 1]].tobytes() == data[want[i] : want[i + 1]].tobytes()) for i in range(len(at))]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_tokens))), pa.int32(), mask=np.append(~there, False)), pa.array(ids, pa.int32()))
    lone = ~there | (gaps == NO_GAP)
    second = [pa.array(scores - gaps, pa.float64(), mask=lone), pa.array(begin_at, mask=lone), pa.array(dropped, mask=lone), pa.array(others, pa.list_(pa.int32()))]
    return [lists, *(pa.array(x, mask=~there) for x in (n_tokens, scores)), *second, pa.array(same, mask=~there)]


def decode(ids: list[int], v: Vocabulary) -> str:
    return b"".join([v.out[i] for i in ids])[1:].decode("utf-8", "replace")


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model_file: str = MODEL) -> DataFrame:
    """The columns in `keep`, with ids array<int>, n_tokens, score, the second best segmentation, and round_trip.

    The second best has second_score; its ids are the first second_from of ids, then second_ids, then ids without
    the second_dropped next ones.  All four are null where there is one way only.
    """
    listed = listed_pieces(model_file)  # as many as the vocabulary has, read once on the driver
    key = hashlib.sha256(repr(listed).encode()).hexdigest()
    names = [*keep, *MADE]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the search makes many small tuples and no cycles
        try:
            if key not in BUILT:  # once a worker
                BUILT.clear()
                BUILT[key] = vocabulary(listed)
            known = Remembered(v := BUILT[key])
            for batch in batches:
                for i, j in portions(batch.column(len(keep))):
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *encoded(part.column(len(keep)), v, known)], names)
        finally:
            gc.enable()

    if clashing := set(keep) & set(MADE):
        raise ValueError(f"rename {sorted(clashing)}: the result has columns of these names")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>, n_tokens long, score double, second_score double, second_from long, second_dropped long, second_ids array<int>, round_trip boolean"])
    return df.select(*keep, text).mapInArrow(lean(rows), schema)


def ids_md5(ids: list[int]) -> str:
    return hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()


def encoded_digest(df: DataFrame) -> DataFrame:
    """The query: counts, scores, the ids' digest and what the second best segmentation changes, for every document."""
    from pyspark.sql import functions as F

    out = encode(df.select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "score", "second_score", "second_from", "second_dropped", "second_ids", "round_trip", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def tokenised(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents as piece ids with their second best segmentation, without text and n_chars; columns that have a name of the result's give way to it."""
    made = ("text", "n_chars", *MADE)
    return encode(docs, keep=tuple(c for c in docs.columns if c not in made))
