"""Prefix tries of conversations by a van Emde Boas recursion.

A trie node is a distinct sequence of first turns.  Sequences are cut at half of
their depth, the halves again, and so on: each depth d is the cut of exactly one
range, whose length is the lowest set bit of d.  A cut prefix is named by the hash
of the name at its range's start and of the turns between; so all ranges' prefixes
are named, and all upper tries and lower forests built, in parallel and by one
shuffle on the names.  Totals come from below: in round k, ranges of 2**k levels
are joined in pairs.  What the lower forest's roots have in total is grafted to
the upper trie's leaf and to its ancestors within the upper range.  After log2 of
the depth such rounds each node has its subtree's total, for N log D / 2 rows sent.

Positions within a conversation come from a range partitioning and the counts of
the partitions before, and sequences travel in blocks of SPAN turns, so a
conversation may hold any share of the rows.  The list of conversations that end
at a node is hashed as a stream in order of ids; its memory does not grow, but the
hash of one list is one task's work.

Names are 128 bits of SHA-256; two of m nodes share one with probability m**2 / 2**129.
Turns of a conversation are ordered by turn, null first, and equal turns by the
SHA-256 of role and text.  A null role or text counts as ''.  Rows with a null
conv_id belong to no conversation.  An empty table has no nodes, not even a root.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, lean, materialise, short_batches

SPAN = 1024
ROOT = b"\0" * 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
SHARED, MOST_SHARED = 100, 6


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:16]


def symbol(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), symbol, chars of every turn, in the shared folder."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    order = [F.asc_nulls_first("turn"), F.col("symbol")]
    thin = conversations.where("conv_id is not null").select("conv_id", "turn", symbol(role, text).alias("symbol"), F.length(text).alias("chars"))
    thin = materialise(thin)
    ranged = materialise(thin.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(before))
    # a partition goes on with at most one conversation that began earlier, so these are as few as partitions
    goes_on = materialise(counts.where("before > 0").select("conv_id", "part", "before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    turns = materialise(
        ranged.withColumn("place", place).join(F.broadcast(goes_on), ["conv_id", "part"], "left")
        .select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "symbol", "chars")
    )
    discard(thin, ranged, goes_on)
    return turns


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, depth, symbol, chars) and all conv_id.

    The first h turns of conv_id - conv_id % SHARED, then a conversation's own turns after its first h; h = crc32(conv_id) % MOST_SHARED.
    """
    heads = turns.where(F.col("pos") < MOST_SHARED).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol", "chars"))).alias("turns"))
    convs = materialise(turns.select("conv_id").distinct())
    own = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED)
    info = own.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("taken", F.when(F.col("h") > 0, F.slice("turns", 1, F.greatest("h", F.lit(1)))))
    info = materialise(info.select("conv_id", "h", "taken", F.coalesce(F.size("taken"), F.lit(0)).alias("k")))
    first = info.select("conv_id", F.posexplode("taken").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.symbol", "t.chars")
    rest = turns.join(info.select("conv_id", "h", F.greatest("k", F.lit(0)).alias("k")), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).cast("long").alias("depth"), "symbol", "chars")
    return first.unionAll(rest), convs


def prefix_names(root: bytes, symbols: list[bytes]) -> list[bytes]:
    """Names of the prefixes of 1, 2, ... turns below `root`: each from the name at its range's start and the turns since."""
    names = [root]
    for i in range(1, len(symbols) + 1):
        low = i & -i
        names.append(digest(names[i - low], digest(*symbols[i - low : i])))
    return names[1:]


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, block, root, names, chars: node names along every conversation, SPAN depths a row."""
    block = F.floor((F.col("depth") - 1) / SPAN).cast("long")
    blocks = materialise(rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "symbol", "chars"))).alias("t")).select("conv_id", "block", "t.symbol", "t.chars"))

    def full_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([digest(*s) for s in batch.column(2).to_pylist()], pa.binary())], ["conv_id", "block", "digest"])

    def cut_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, found in zip(*(c.to_pylist() for c in batch.columns)):
                name, roots = ROOT, []
                for x in found:
                    name = digest(name, x["digest"])
                    roots.append(name)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(roots), pa.int64()), pa.array([x["block"] + 1 for x in found], pa.int64()), pa.array(roots, pa.binary())], ["conv_id", "block", "root"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, symbols = batch.column(4).to_pylist(), batch.column(2).to_pylist()
            names = [prefix_names(r or ROOT, s) for r, s in zip(roots, symbols)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r or ROOT for r in roots], pa.binary()), pa.array(names, pa.list_(pa.binary())), batch.column(3)], ["conv_id", "block", "root", "names", "chars"])

    full = blocks.where(F.size("symbol") == SPAN).select("conv_id", "block", "symbol").mapInArrow(lean(full_blocks), "conv_id long, block long, digest binary")
    roots = full.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "digest"))).alias("x")).mapInArrow(lean(cut_names), "conv_id long, block long, root binary")
    out = materialise(blocks.join(roots, ["conv_id", "block"], "left").select("conv_id", "block", "symbol", "chars", "root").mapInArrow(lean(named), "conv_id long, block long, root binary, names array<binary>, chars array<int>"))
    discard(blocks)
    return out


def own_totals(way: DataFrame) -> DataFrame:
    """Nodes below the root: name, parent, depth, conv_id, n_convs, n_children, and leaves and saved of the node alone."""
    at = way.select("conv_id", "block", "root", "names", F.posexplode(F.arrays_zip("names", "chars")).alias("at", "x"))
    parent = F.when(F.col("at") == 0, F.col("root")).otherwise(F.get("names", F.col("at") - 1))
    rows = at.select("conv_id", F.col("x.names").alias("name"), parent.alias("parent"), (F.col("block") * SPAN + F.col("at") + 1).alias("depth"), F.col("x.chars").alias("chars"))
    nodes = materialise(rows.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.count("*").alias("n_convs")))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    out = materialise(
        nodes.join(children, "name", "left").select(
            "name", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        )
    )
    discard(nodes)
    return out


def grafted(nodes: DataFrame, way: DataFrame, span: int) -> DataFrame:
    """Joins ranges of `span` depths in pairs: leaves and saved of each lower forest go to the nodes above it in the upper range."""
    lower = nodes.where((F.col("depth") - 1) % (2 * span) == span)
    cuts = lower.groupBy("parent").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.min("conv_id").alias("conv_id"), (F.max("depth") - 1).alias("mid"))
    first, last = F.floor((F.col("mid") - span) / SPAN), F.floor((F.col("mid") - 1) / SPAN)
    cuts = cuts.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("mid") - span - F.col("block") * SPAN, F.lit(0)).cast("int")
    until = F.least(F.col("mid") - F.col("block") * SPAN, F.lit(SPAN)).cast("int")
    above = cuts.join(way.select("conv_id", "block", "names"), ["conv_id", "block"]).select(F.explode(F.slice("names", begin + 1, until - begin)).alias("name"), "l", "s")
    more = above.groupBy("name").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    return materialise(
        nodes.join(more, "name", "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")
    )


def ends_of(way: DataFrame, convs: DataFrame) -> DataFrame:
    """name, ends: SHA-256 of the ascending ids of the conversations that end at a node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for at, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if at != name:
                    if running:
                        done.append((name, running.hexdigest()))
                    name, running = at, hashlib.sha256(str(conv).encode())
                else:
                    running.update(b",%d" % conv)
            yield table(done)
        if running:
            yield table([(name, running.hexdigest())])

    def table(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["name", "ends"])

    last = way.groupBy("conv_id").agg(F.max_by(F.element_at("names", -1), "block").alias("name"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("name", F.lit(ROOT)).alias("name"), "conv_id")
    return ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(lean(rows), "name binary, ends string")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of all conversations.  rows: conv_id, depth (1, 2, ... without gaps), symbol, chars; convs: every conv_id once, turnless ones too."""
    top = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).first()
    way = paths(rows)
    nodes = own_totals(way)
    depth, span = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while span < depth:
        nodes, old = grafted(nodes, way, span), nodes
        discard(old)
        span *= 2
    below = nodes.where("depth = 1").agg(F.count("*").alias("c"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("l"), F.coalesce(F.sum("saved"), F.lit(0)).alias("s"))
    root = below.where(F.lit(top["n"] > 0)).select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(top["conv_id"]).cast("long").alias("conv_id"),
        F.lit(top["n"]).cast("long").alias("n_convs"), F.col("c").alias("n_children"), F.col("l").alias("leaves"), F.col("s").alias("saved"),
    )
    every = nodes.unionByName(root)
    parents = every.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(ends_of(way, convs), "name", "left").join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )
    out = materialise(out)
    discard(way, nodes)
    return out


def shared_beginnings(conversations: DataFrame) -> DataFrame:
    """The query: the trie of the rebuilt conversations."""
    short_batches(conversations.sparkSession)
    turns = ordered_turns(conversations)
    out = prefix_trie(*rebuilt(turns))
    discard(turns)
    return out


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS x
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))),
    lambda r, b: list_reduce(list_prepend(xor(r, b), CAST(range(8) AS BIGINT[])), lambda y, i: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.conv_id, c.h, count(o.pos) AS k FROM c LEFT JOIN o ON o.conv_id = c.base AND o.pos <= c.h GROUP BY ALL),
s AS (
  SELECT c.conv_id, o.pos AS depth, o.x, length(o.text) AS chars FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT o.conv_id, o.pos - k.h + k.k, o.x, length(o.text) FROM o JOIN k ON o.conv_id = k.conv_id AND o.pos > k.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
p AS (SELECT conv_id, depth, chars, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, max(depth) OVER (PARTITION BY conv_id) AS until FROM s),
n AS (SELECT prefix, any_value(above) AS above, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n, string_agg(CASE WHEN depth = until THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY prefix),
kids AS (SELECT above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
w AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children, (n - 1) * chars AS saved FROM n LEFT JOIN kids ON kids.above = n.prefix),
sums AS (SELECT a.prefix, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(w.saved) AS saved FROM w JOIN p a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.prefix)
SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN sums USING (prefix) LEFT JOIN n up ON w.depth > 0 AND up.prefix = w.above
"""
