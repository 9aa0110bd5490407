"""Early stops of text streams against a loop over the whole text, for several cuts into batches."""

import os
import random

import pytest

from quern.plans import queries
from quern.streaming import states as S

SCHEMA = "k string, no int, text string"


def period(s):
    return next((p for p in range(1, 17) if sum(s[i] == s[i - p] for i in range(p, len(s))) / (len(s) - p) >= 0.9), None)


def by_loop(pieces):
    text, since = "", 0
    for piece in pieces:
        text, since = text + (piece or ""), since + len(piece or "")
        if piece and since >= 64:
            since = 0
            p = period(text[-180:]) if len(text) >= 180 else None
            if p:
                unit, i = text[-p:], len(text)
                while i >= p and text[i - p : i] == unit:
                    i -= p
                return len(text), i, p


def streams(seed):
    rng = random.Random(seed)
    for k in range(40):
        whole = "".join(rng.choice("甲乙丙ab😀") for _ in range(rng.randint(0, 300)))
        unit = "".join(rng.choice("甲乙丙ab😀") for _ in range(rng.randint(1, 20)))
        whole += unit * rng.choice([0, 3, 60]) + rng.choice(["", "x", "yz" * 5])
        pieces = []
        while whole:
            n = rng.choice([1, 3, 17, 64, 90])
            pieces.append(whole[:n])
            whole = whole[n:]
        yield str(k), [*pieces, None, ""]


@pytest.mark.parametrize("cuts", [1, 4])
def test_early_stops_like_a_loop(spark, tmp_path, cuts):
    expected, files = {}, [[] for _ in range(cuts)]
    for k, pieces in streams(cuts):
        stop = by_loop(pieces)
        if stop:
            expected[k] = stop
        for no, piece in enumerate(pieces):
            files[no * cuts // len(pieces)].append((k, no, piece))
    files[0].append((None, 0, "z" * 400))
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (part,) = (f for f in os.listdir(f"{tmp_path}/{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/{i}/{part}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.k: (r.read, r.kept, r.period) for r in S.finished(S.early_stops(stream, "k", "no", "text")).collect()}
    assert got == expected and 5 < len(got) < 40


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        assert queries.QUERIES["stream_early_stops"](spark, sf).count() > 0
