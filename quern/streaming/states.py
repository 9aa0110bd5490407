"""Keyed state over event streams: cooldowns and caches with a time to live.

The streams read parquet folders as they grow.  `finished` runs what is there
and returns the result as a table in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder(spark: SparkSession) -> str:
    import tempfile

    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    where = where or tempfile.mkdtemp(prefix="quern-")
    return f"{where}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream.  File streams watch folders, so a table that is one file is watched by its name in its folder."""
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    if found.inputFiles()[0].endswith(f"/{name}.parquet"):
        return spark.readStream.schema(found.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return spark.readStream.schema(found.schema).parquet(path)


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now."""
    spark, where = df.sparkSession, folder(df.sparkSession)
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/rows")


def cooldowns(events: DataFrame, key: str, seconds: str, days: int = 7) -> DataFrame:
    """key, seconds, accepted: an event counts only if `days` have gone since the last one that did.  State: one time a key."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(seconds, kind="stable")
        accepted = []
        for t in rows[seconds]:
            ok = last is None or t - last >= days * 86400
            last = t if ok else last
            accepted.append(ok)
        state.update((int(last),))
        yield pd.DataFrame({key: k[0], seconds: rows[seconds].to_numpy(), "accepted": accepted})

    return events.select(key, seconds).groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{seconds}` long, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)


WINDOW, MOST_PERIOD, SHARE = 180, 16, 0.9  # characters at the end that are tested, longest unit, share of matches


def matches_behind(tail: str, new: str, before: list[int]) -> list[int]:
    """For each period p up to MOST_PERIOD: how many characters at the very end equal the one p places before."""
    s, n = np.frombuffer((tail + new).encode("utf-32-le"), np.uint32), len(new)
    out = []
    for p, m in enumerate(before, 1):
        same = np.zeros(n, bool)
        known = min(n, len(s) - p)  # new characters with one p places before
        if known > 0:
            same[n - known :] = s[len(s) - known :] == s[len(s) - known - p : len(s) - p]
        others = np.flatnonzero(~same)
        out.append(m + n if not others.size else n - 1 - int(others[-1]))
    return out


def early_stops(pieces: DataFrame, key: str, no: str, text: str, every: int = 64) -> DataFrame:
    """key, read, kept, period: streams of text that are to be stopped, as their end repeats one unit.

    After each piece that brings `every` characters or more since the last test, the last WINDOW characters are
    tested, if there are as many: a unit of `period` characters explains a SHARE of them.  `read` characters were
    there then, `kept` of them stand before the unit's repetition.  Pieces of a key come in the order of `no`, as a
    stream's do; how batches cut them does not matter.  State: WINDOW characters and MOST_PERIOD counts a key.
    Null or empty pieces bring nothing, later pieces of a stopped key neither, and pieces without key are left out.
    """
    from quern.operators.grouped import repetition

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, total, since, behind, stopped = state.get if state.exists else ("", 0, 0, [0] * MOST_PERIOD, False)
        rows, out = pd.concat(list(parts)).sort_values(no, kind="stable"), []
        for piece in rows[text]:
            if stopped:
                break
            if not piece:
                continue
            behind = matches_behind(tail, piece, behind)
            tail, total, since = (tail + piece)[-WINDOW:], total + len(piece), since + len(piece)
            if since >= every:
                since = 0
                p = repetition(tail, MOST_PERIOD, WINDOW, SHARE) if total >= WINDOW else 0
                if p:
                    stopped = True
                    out.append((k[0], total, total - p * (1 + behind[p - 1] // p), p))
        state.update((tail, int(total), int(since), [int(m) for m in behind], stopped))
        yield pd.DataFrame(out, columns=[key, "read", "kept", "period"])

    held = "tail string, total long, since long, behind array<long>, stopped boolean"
    rows = pieces.where(F.col(key).isNotNull()).select(key, no, text)
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, read long, kept long, period int", held, "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, ts: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Counts and sums by hour, closed by a watermark: windows that ended `late` before the newest event are final."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("hour"), *keys, "n", "total")
