"""Exact top-k search by inner product: a Voronoi join over pivot cells.

Vectors are quantised to whole numbers, floor(256 * x).  A bounded sample gives
pivots; every vector belongs to its nearest pivot's cell.  Cells are summed up by
their size, radius, widest angle to the pivot and range of norms.  Neighbouring
small cells form one group, large ones are dealt to blocks of bounded size, so that
small tables have blocks for all cores too.

A query first meets a block of its own cell's group.  Its k-th best score there is a
floor under its k-th best of all.  For a cell with pivot p, radius r, widest angle a
and largest norm m, no product exceeds q.p + |q| r, nor |q| m cos(angle(q, p) - a).
A query is sent to the groups that have a cell whose bound reaches the floor, and
to no other; the blocks' best are merged.  `search` also says what share of
all pairs that left.

Results are exact.  Ties go to the smaller id.  Vectors that are null, empty or
hold null or non-finite components take no part, nor do rows without id; of vectors
of unequal length the shorter counts as padded with zeros.  Rows that repeat an id
are rows of their own: each asks, and each is a candidate of the others.  Products
are exact while their sums stay below 2**63.  Other columns are not read; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, lean, materialise

NONE = np.iinfo(np.int64).min


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """row long (a number of its own for every row), id long, v array<long>; only vectors that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<long> column, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums fit into 53 bits, else in 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles between all rows of x and y; pi where one is zero, which no bound takes amiss."""
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    return np.where(norms > 0, np.arccos(np.clip((x @ y.T) / np.maximum(norms, 1e-300), -1, 1)), np.pi)


def assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """row, id, v with the nearest pivot's cell, the distance and the angle to it and the norm."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(2), p.shape[1]).astype(np.float64)
                cell = ((p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
                norm = np.linalg.norm(x, axis=1)
                of = np.linalg.norm(p, axis=1)[cell] * norm
                angle = np.where(of > 0, np.arccos(np.clip((x * p[cell]).sum(axis=1) / np.maximum(of, 1e-300), -1, 1)), np.where(norm > 0, np.pi, 0))
                columns = [pa.array(cell, pa.int32()), pa.array(np.linalg.norm(x - p[cell], axis=1)), pa.array(angle), pa.array(norm)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], ["row", "id", "v", "cell", "far", "angle", "norm"])

    return rows.mapInArrow(lean(add), "row long, id long, v array<long>, cell int, far double, angle double, norm double")


def bounds(q: np.ndarray, pivots: np.ndarray, far: np.ndarray, angle: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For queries (rows) and cells (columns): what no product exceeds, with room for rounding."""
    q, p = q.astype(np.float64), pivots.astype(np.float64)
    norms = np.linalg.norm(q, axis=1)[:, None]
    by_radius = q @ p.T + norms * far[None, :]
    cosine = np.cos(np.maximum(angles(q, p) - angle[None, :] - 1e-6, 0))
    by_angle = norms * np.where(cosine >= 0, most[None, :], least[None, :]) * cosine
    room = (norms * (most + np.linalg.norm(p, axis=1))[None, :]) * 1e-9 + 1e-3
    return np.minimum(by_radius, by_angle) + room


def chain(pivots: np.ndarray) -> list[int]:
    """The pivots from neighbour to neighbour."""
    p, left, out = pivots.astype(np.float64), np.ones(len(pivots), bool), []
    at = 0
    while left.any():
        left[at] = False
        out.append(int(at))
        away = ((p - p[at]) ** 2).sum(axis=1)
        away[~left] = np.inf
        at = int(away.argmin())
    return out


def best_of_block(rows: np.ndarray, ids: np.ndarray, data: np.ndarray, query_rows: np.ndarray, asked: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in the block, score) of the k best of a block for every query; the block is sorted by id."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(asked), step):
        scores = products(asked[at : at + step], data)
        scores[query_rows[at : at + step][:, None] == rows[None, :]] = NONE
        kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else np.full((len(scores), 1), NONE + 1)
        above, equal = scores > kth, scores == kth
        wanted = k - above.sum(axis=1, keepdims=True)
        i, j = np.nonzero((above | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= wanted)) & (scores != NONE))
        found.append((i + at, j, scores[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(df: DataFrame, query_filter, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", most_pivots: int = 512, block_rows: int | None = None, query_rows: int = 16_384) -> tuple[DataFrame, float]:
    """(query_id, rank, vec_id, score; the share of all pairs that had to be scored).  query_filter: a condition on `id`.

    Bounded: pivots (at most `most_pivots`, a deterministic sample) and the cells'
    summaries, the rows of a block (`block_rows`, in expectation; by default two blocks a core, of 64 to 16,384 rows) and
    the queries that it meets at a time (`query_rows`).
    """
    spark = df.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = materialise(quantised(df, id_col, vector))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return nothing, 0.0
    block_rows = block_rows or int(min(16_384, max(64, n // (2 * spark.sparkContext.defaultParallelism))))
    sample = rows.orderBy(F.xxhash64("id"), "row").limit(int(min(most_pivots, max(1, n**0.5)))).collect()
    pivots = np.unique(np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in sample], np.int64), axis=0)
    cells = materialise(assigned(rows, pivots))
    discard(rows)
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("angle").alias("angle"), F.min("norm").alias("least"), F.max("norm").alias("most")).toPandas().set_index("cell")
    far, angle, least, most, size = (summary[c].reindex(range(len(pivots)), fill_value=0).to_numpy() for c in ("far", "angle", "least", "most", "n"))
    # Groups of cells: (first block, blocks) by group, and the group of every cell.
    group_of, sizes, filled = np.zeros(len(pivots), np.int64), [], block_rows
    for c in chain(pivots):
        if filled + size[c] > block_rows:
            sizes.append(0)
            filled = 0
        group_of[c] = len(sizes) - 1
        sizes[-1] += int(size[c])
        filled += size[c]
    blocks = np.maximum(1, -(-np.array(sizes) // block_rows))
    first = np.cumsum(blocks) - blocks
    of_cell = spark.createDataFrame([(c, int(g), int(first[g]), int(blocks[g])) for c, g in enumerate(group_of)], "cell int, grp int, first int, blocks int")  # a row a pivot, and so are the other broadcast tables
    placed = cells.select("row", "id", "v", "cell").join(F.broadcast(of_cell), "cell")
    data = placed.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("int"))
    queries = placed.where(query_filter(F.col("id")))
    kinds = "qrow long, query_id long, row long, vec_id long, score long"

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in kinds.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        left, right = left.combine_chunks().sort_by([("id", "ascending"), ("row", "ascending")]), right.combine_chunks()
        column = lambda t, name: t.column(name).combine_chunks()
        row, ids, qrow, qid = (column(t, c).to_numpy() for t, c in ((left, "row"), (left, "id"), (right, "qrow"), (right, "qid")))
        i, j, score = best_of_block(row, ids, matrix(column(left, "v"), width), qrow, matrix(column(right, "qv"), width), k)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, (qrow[i], qid[i], row[j], ids[j], score))})

    def solved(data: DataFrame, asked: DataFrame) -> DataFrame:
        return data.groupBy("block", "part").cogroup(asked.groupBy("qblock", "qpart")).applyInArrow(solve, kinds)

    def dealt(queries: DataFrame, counts: dict[int, int]) -> DataFrame:
        """Into how many parts the queries of each group are dealt."""
        return spark.createDataFrame([(g, -(-counts.get(g, 0) // query_rows) or 1) for g in range(len(sizes))], "grp int, parts int")

    def meeting(queries: DataFrame, wanted: DataFrame) -> DataFrame:
        """What each query finds in the first block of its own group (`wanted` null) or in all other blocks of the groups it asks."""
        counts = {r["grp"]: r["n"] for r in queries.groupBy("grp").agg(F.count("*").alias("n")).collect()}
        parts = F.broadcast(dealt(queries, counts))
        asked = queries.join(parts, "grp").select("qrow", "qid", "qv", "own", F.pmod(F.xxhash64("qrow"), F.col("parts")).cast("int").alias("qpart"), F.explode(wanted).alias("qblock"))
        rows = data.join(parts, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return solved(rows.select("row", "id", "v", "block", "part"), asked.where("own is null or own <> qblock").select("qrow", "qid", "qv", "qpart", "qblock"))

    asking = queries.select(F.col("row").alias("qrow"), F.col("id").alias("qid"), F.col("v").alias("qv"), "grp", "first", "blocks")
    near = materialise(meeting(asking.withColumn("own", F.lit(None).cast("int")), F.array("first")))
    floors = near.groupBy("qrow").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                limit = part.column(4).fill_null(NONE).to_numpy()
                ok = bounds(matrix(part.column(2), width), pivots, far, angle, least, most) >= limit[:, None].astype(np.float64) * (1 - np.sign(limit[:, None]) * 1e-12)
                ok &= size[None, :] > 0
                groups = np.zeros((len(limit), len(sizes)), bool)
                for c in np.flatnonzero(ok.any(axis=0)).tolist():
                    groups[:, group_of[c]] |= ok[:, c]
                i, g = np.nonzero(groups)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(limit) + 1)), pa.int32()), pa.array(g, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], ["qrow", "qid", "qv", "own", "groups"])

    wide = asking.join(floors, "qrow", "left").select("qrow", "qid", "qv", F.col("first").alias("own"), "floor")
    found = materialise(wide.mapInArrow(lean(reach), "qrow long, qid long, qv array<long>, own int, groups array<int>"))
    spans = F.broadcast(of_cell.select("grp", "first", "blocks").distinct())
    asks = found.withColumn("grp", F.explode("groups")).drop("groups").join(spans, "grp")
    meets = asks.groupBy("grp").agg(F.count("*").alias("n")).collect()
    asked_all = found.count()
    share = sum(r["n"] * sizes[r["grp"]] for r in meets) / max(1, asked_all * n)
    rest = meeting(asks, F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id", "row")
    best = near.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialise(best.select("query_id", "rank", "vec_id", "score"))
    discard(cells, near, found)
    return out, share


def top_k(df: DataFrame, query_filter, k: int = 5, **how) -> DataFrame:
    """query_id, rank, vec_id, score; see `search`."""
    return search(df, query_filter, k, **how)[0]


def top_five(df: DataFrame) -> DataFrame:
    """The contract's query: every row whose id is divisible by 50 asks for its five best."""
    return top_k(df, lambda i: i % 50 == 0)
