"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: unless the session sets another size, Arrow batches hold 1000 rows, which bounds the workers' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to the columns that the caller needs."""
    short_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).  Where it is unset, a temporary one in local mode, an error on a cluster."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows go to a table in the shared folder and are read back from it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `materialise` wrote and that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For mapInArrow: gives the worker's free memory back when the task ends, as idle workers stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return rows


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def portions(texts: pa.Array, most_bytes: int = 2_000_000) -> list[tuple[int, int]]:
    """(from, to) of consecutive rows of about that many bytes each."""
    if not len(texts):
        return []
    until = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(until)) + 1).tolist(), len(texts)]
    return list(zip(edges, edges[1:]))


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every (start, length), one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def string_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of a string array's bytes (0 for an empty string): the mixed pieces of eight bytes, each with its place, are summed and mixed again."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    out = np.zeros(len(words), np.uint64)
    lengths = np.diff(offsets)
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    data = np.concatenate((np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from every place on
    lengths, starts = lengths[some], offsets[:-1][some] - offsets[0]
    pieces = -(-lengths // 8)
    ends = np.cumsum(pieces)
    place = np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)
    over = np.maximum(8 * (place + 1) - np.repeat(lengths, pieces), 0).astype(np.uint64)  # bytes of a last piece behind its word
    value = eight[np.repeat(starts, pieces) + 8 * place] & (~np.uint64(0) >> (over << np.uint64(3)))
    salt = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out[some] = np.add.reduceat(mix(mix(value + salt) ^ salt), ends - pieces) + lengths.astype(np.uint64)
    return mix(out)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (between ASCII white space, A-Z in lower case) a text, all words in order as places in the last array, and the 64-bit hashes of distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, hashes = coded.indices.to_numpy(), string_hashes(coded.dictionary)
    if not hashes.all():  # white space at an end of a text leaves an empty word, whose hash is 0
        real = (hashes != 0)[codes]
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths))
        codes = codes[real]
    return lengths, codes, hashes


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words a text, and the 64-bit hashes of all words in order, see `word_codes`."""
    lengths, codes, hashes = word_codes(texts)
    return lengths, hashes[codes]


def counted_arrays(
    df: DataFrame,
    count: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[str, np.ndarray]]],
    merge: str = "sum",
    fan_in: int = 256,
) -> dict[str, np.ndarray]:
    """Arrays of a fixed size by key, summed (or or-ed) over all partitions.

    `count` turns a partition into (key, array) pairs.  Partial arrays meet in
    groups of `fan_in` tasks and these by key, read one by one, so a task holds one
    array a key.  Keys must be few and arrays bounded: the result is one array a
    key, on the driver.
    """

    def packed(key: str, at: int, array: np.ndarray) -> pa.RecordBatch:
        """Long integers travel in as few bytes as they need."""
        kind = array.dtype.str
        if array.dtype == np.int64 and len(array) and array.min() >= 0:
            array = array.astype(np.min_scalar_type(array.max()))
        data = zlib.compress(array.tobytes(), 1)
        return pa.RecordBatch.from_pydict({"key": [key], "at": pa.array([at], pa.int64()), "data": [data], "kind": [f"{array.dtype.str} {kind}"]})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() // fan_in
        for key, array in count(batches):
            yield packed(key, at, array)

    def unpacked(data: bytes, kind: str) -> np.ndarray:
        narrow, wide = kind.split()
        return np.frombuffer(zlib.decompress(data), np.dtype(narrow)).astype(np.dtype(wide), copy=False)

    def merged(batches: Iterator[pa.RecordBatch], together: bool = False) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                array = unpacked(row["data"], row["kind"])
                key = row["key"], 0 if together else row["at"]
                if key not in sums:
                    sums[key] = array.copy()
                elif merge == "sum":
                    sums[key] += array
                else:
                    sums[key] |= array
        for (key, at), array in sums.items():
            yield packed(key, at, array)

    schema = "key string, at long, data binary, kind string"
    parts = df.mapInArrow(lean(partial), schema).repartition("key", "at").mapInArrow(lean(merged), schema)
    parts = parts.repartition("key").mapInArrow(lean(lambda batches: merged(batches, together=True)), schema)
    return {r["key"]: unpacked(bytes(r["data"]), r["kind"]) for r in parts.collect()}


def held_out(column: str, modulus: int, remainder: int):
    """True where crc32 of the id's decimal text leaves that remainder."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))
