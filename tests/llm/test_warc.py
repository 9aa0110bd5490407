"""WARC archives: round trips, records inside payloads, assembly."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import warc
from quern.llm.common import materialise

NESTED = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n"
PAGES = [
    (1, "https://a.example/x?y=1#z", "<p>one</p>"), (2, "https://a.example/é 漢\r\nX: y", "<p>Zwei é 漢字 𝒳</p>"), (3, None, None), (4, "u", ""), (5, "v", "<p>one</p>"), (5, "v", "<p>one</p>"), (5, "v2", "<p>one</p>"),
    (6, "w", NESTED), (7, "w", NESTED + "\r\n\r\n"), (8, "w", "\r\n\r\n\r\n\r\n"), (None, "n", "<p>null id</p>"), (None, "n", "<p>null id</p>"), (9, "x", "long " * 200_000), (10, "y", NESTED * 40), (11, "y", "WARC/1.0"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit(1)).withColumn("key", F.lit("k")).withColumn("sha", F.lit("s"))


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 11])
def test_pages_come_back(spark, least):
    """Nulls, empty and long texts, ties and repeated rows, payloads that hold records."""
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(frame(spark), least).collect()]
    want = []
    for html in {h or "" for _, _, h in PAGES}:
        ids = sorted((i for i, _, h in PAGES if (h or "") == html), key=lambda i: (i is not None, i), reverse=True)
        n = len(html.encode())
        for k, i in enumerate(ids):
            again = k > 0 and n >= least
            want.append((i, n, digest(html), "revisit" if again else "response", ids[0] if again else None))
    assert Counter(rows) == Counter(want)


def test_archives_are_warc(spark, tmp_path):
    """The files hold whole records: versions, lengths, digests and identifiers as the format asks for."""
    warc.write_archives(frame(spark), f"{tmp_path}/w", records_a_file=7)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) >= 6
    found = []
    for f in files:
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            headers = dict(x.split(": ", 1) for x in lines[1:])
            n = int(headers["Content-Length"])
            found.append((headers, rest[:n]))
            assert rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]
    kinds = Counter(h["WARC-Type"] for h, _ in found)
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(PAGES)
    ids = {h["WARC-Record-ID"]: h for h, _ in found}
    assert len(ids) == len(found) and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    for h, block in found:
        if h["WARC-Type"] == "response":
            assert h["WARC-Payload-Digest"] == "sha1:" + digest(block.partition(b"\r\n\r\n")[2].decode())
        elif h["WARC-Type"] == "revisit":
            assert ids[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
        else:
            assert ids[h["WARC-Concurrent-To"]]["WARC-Type"] in ("response", "revisit")
    captures = warc.transactions(materialise(warc.read_records(spark, f"{tmp_path}/w"))).collect()
    assert len(captures) == len(PAGES) and all(len(c["requests"]) == len(c["metadata"]) == 1 for c in captures)
    texts = Counter(bytes(c["response"]["payload"]).decode() for c in captures if c["response"]["type"] == "response")
    assert texts == Counter({h or "" for _, _, h in PAGES})


def write(path, *records, end=b""):
    out = b""
    for headers, block in records:
        out += b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    path.write_bytes(out + end)


def test_assembly_in_any_direction(spark, tmp_path):
    """Links from the response, over a request, to nothing; several metadata records; warcinfo; folded lines; plain files."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    write(tmp_path / "a.warc", ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x\r\n"), ([("WARC-Type", "response"), ("WARC-Record-ID", "<r1>"), ("WARC-Concurrent-To", "<q1>"), ("Content-Type", "application/http;\r\n msgtype=response")], http))
    write(tmp_path / "b.warc", ([("WARC-Type", "request"), ("WARC-Record-ID", "<q1>")], b"GET /"), ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m1>"), ("WARC-Concurrent-To", "<q1>")], b"a: 1"), ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m2>"), ("WARC-Concurrent-To", "<r1>"), ("WARC-Concurrent-To", "<q1>")], b"a: 2"))
    write(tmp_path / "c.warc", ([("WARC-Type", "request"), ("WARC-Record-ID", "<q2>"), ("WARC-Concurrent-To", "<gone>")], b"GET /2"), ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m3>"), ("WARC-Concurrent-To", "<gone>")], b"x"), ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m4>")], b"\xff\xfe"), ([("WARC-Type", "resource"), ("WARC-Record-ID", "<s1>"), ("Content-Type", "text/plain")], b""))
    records = materialise(warc.read_records(spark, str(tmp_path)))
    assert records.count() == 9
    rows = {c["capture"]: c for c in warc.transactions(records).collect()}
    assert set(rows) == {"<r1>", "<gone>", "<m4>", "<s1>"}
    one = rows["<r1>"]
    assert [q["record_id"] for q in one["requests"]] == ["<q1>"] and [m["record_id"] for m in one["metadata"]] == ["<m1>", "<m2>"]
    assert bytes(one["response"]["payload"]) == b"body" and one["response"]["http"].startswith("HTTP/1.1 200") and one["response"]["content_type"] == "application/http; msgtype=response"
    assert rows["<gone>"]["response"] is None and len(rows["<gone>"]["requests"]) == len(rows["<gone>"]["metadata"]) == 1
    assert bytes(rows["<m4>"]["metadata"][0]["payload"]) == b"\xff\xfe" and rows["<s1>"]["response"]["payload_bytes"] == 0 and rows["<s1>"]["requests"] == []


def test_broken_archives_are_errors(spark, tmp_path):
    write(tmp_path / "a.warc", ([("WARC-Type", "response")], b"x"), end=b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="no end"):
        warc.read_records(spark, str(tmp_path / "a.warc")).collect()
    (tmp_path / "b.warc").write_bytes(b"something else\r\n\r\n")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_records(spark, str(tmp_path / "b.warc")).collect()


def test_records_in_random_pieces():
    """However a file is cut at separators, and if the reader misses some, the records are the same."""
    rng = random.Random(2)
    blocks = [rng.choice([b"", b"x", NESTED.encode(), b"\r\n", b"\r\n\r\n", b"a\r\n\r\nb"]) * rng.randint(0, 3) for _ in range(60)]
    data = b"".join(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    pieces = data.split(warc.BETWEEN.encode())
    merged, at = [], 0
    while at < len(pieces):
        n = rng.randint(1, 2)
        merged.append(warc.BETWEEN.encode().join(pieces[at : at + n]))
        at += n
    for cut in (pieces, merged, [data]):
        assert [b for _, b in warc.records_in((("f", 0), p) for p in cut)] == blocks


def test_empty_table(spark):
    assert warc.archived(frame(spark).limit(0)).count() == 0
