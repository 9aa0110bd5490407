"""Texts as motion-JPEG clips in AVI files, and shot detection on what is read back.

Writing: a text's UTF-8 bytes are padded with 255 to whole frames of 576 bytes.
A frame is a grey picture of 24 x 24 pixels, nine blocks of 64 coefficients.  One
byte b is one quantised coefficient: b itself from 128 on, b - 255 below.  These
are exactly the values of JPEG's magnitude category 8, whose eight extra bits
are b, so baseline entropy coding keeps every byte (DC as differences).

Reading: the RIFF chunks are walked, the frames are found by the idx1 index,
each frame's coefficients are decoded (any baseline Huffman table; tables with
one code of eight bits, as written here, are decoded for all frames at once),
and pixels come from an integer inverse DCT.  A shot begins where the histogram
difference of neighbouring frames exceeds mean + 1.5 deviations of the last
eight differences (and a floor).  Clips are timed by the header's frame rate.

Null and empty texts are one frame of padding.  Values depend on the text alone, so
repeated rows get equal ones; an empty table gives an empty one.  Texts of any length
are whole; frames are decoded 512 at a time.  The files written here always meet the
table with one code of eight bits; `decode_scan` serves all others.  Only the id and
the text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import as_bytes, lean

SIDE, BLOCKS, FRAME, FPS = 24, 9, 576, 25
# The zigzag order of ITU T.81, figure A.6.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header(side: int = SIDE) -> bytes:
    one_code = bytes([0] * 7 + [1] + [0] * 8)  # a single code of eight bits
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\x00" + bytes([1] * 64))
        + segment(0xC0, struct.pack(">BHHB", 8, side, side, 1) + b"\x01\x11\x00")
        + segment(0xC4, b"\x00" + one_code + b"\x08")
        + segment(0xC4, b"\x10" + one_code + b"\x08")
        + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


HEADER = jpeg_header()


def write_frames(payload: bytes) -> list[bytes]:
    """JPEG pictures of a payload whose length is a multiple of 576."""
    coded = np.zeros((len(payload) // FRAME, FRAME, 2), np.uint8)
    coded[:, :, 1] = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    return [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in coded]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], side: int = SIDE, fps: int = FPS) -> bytes:
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(part := chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(part)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, length) of the chunks between two offsets."""
    while at + 8 <= end:
        name, length = struct.unpack_from("<4sI", data, at)
        if at + 8 + length > end:
            raise ValueError("a chunk exceeds its parent")
        yield name, at + 8, length
        at += 8 + length + (length & 1)


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames, as the index lists them."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, movi, index = float(FPS), 0, None
    for name, at, length in chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[at : at + 4] if name == b"LIST" else name
        if kind == b"hdrl":
            for inner, a, n in chunks(data, at + 4, at + length):
                if inner == b"LIST" and data[a : a + 4] == b"strl":
                    for leaf, b, _ in chunks(data, a + 4, a + n):
                        if leaf == b"strh":
                            scale, ticks = struct.unpack_from("<II", data, b + 20)
                            rate = ticks / max(scale, 1)
        elif kind == b"movi":
            movi = at
        elif kind == b"idx1":
            index = [struct.unpack_from("<4sIII", data, at + i) for i in range(0, length, 16)]
    if index is None:
        raise ValueError("no index")
    base = movi if not index or data[movi + index[0][2] : movi + index[0][2] + 4] == index[0][0] else 0
    return rate, [data[base + o + 8 : base + o + 8 + n] for name, _, o, n in index if name[2:] in (b"dc", b"db")]


def parse_jpeg(frame: bytes) -> tuple[int, int, np.ndarray, dict[int, tuple[bytes, bytes]], bytes]:
    """Height, width, quantiser (zigzag order), Huffman tables and the stuffed scan of a grey baseline picture."""
    at, height, width, quant, tables = 2, 0, 0, np.ones(64, np.int32), {}
    while True:
        marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            quant = np.frombuffer(body[1:65], np.uint8).astype(np.int32)
        elif marker == 0xC0:
            height, width, parts = struct.unpack(">HHB", body[1:6])
            if parts != 1 or height % 8 or width % 8:
                raise ValueError("only grey pictures of whole blocks")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDA:
            return height, width, quant, tables, frame[at : frame.rindex(b"\xff\xd9")]


def huffman_codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, how_many in enumerate(lengths, 1):
        for _ in range(how_many):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode_scan(scan: bytes, blocks: int, tables: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
    """Coefficients of a scan as blocks x 64, in zigzag order, DC as coded differences; for any baseline tables."""
    bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))
    dc, ac, at, out = huffman_codes(*tables[0x00]), huffman_codes(*tables[0x10]), 0, np.zeros((blocks, 64), np.int32)
    for block in out:
        k = 0
        while k < 64:
            codes, n = (ac if k else dc), 1
            while (n, int(bits[at : at + n], 2)) not in codes:
                n += 1
                if n > 16:
                    raise ValueError("no such code")
            symbol = codes[n, int(bits[at : at + n], 2)]
            at += n
            run, size = symbol >> 4, symbol & 15
            if k and symbol == 0:
                break
            k += run
            if size:
                v = int(bits[at : at + size], 2)
                block[k] = v if v >= 1 << (size - 1) else v - (1 << size) + 1
                at += size
            k += 1
    return out


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coefficients (frame, block, 64), DC as differences, and each frame's quantiser."""
    alike = [f.startswith(HEADER) and f.endswith(b"\xff\xd9") for f in frames]
    if all(alike):
        scans = [f[len(HEADER) : -2].replace(b"\xff\x00", b"\xff") for f in frames]
        if all(len(s) == 2 * FRAME for s in scans):
            pairs = np.frombuffer(b"".join(scans), np.uint8).reshape(len(frames), FRAME, 2)
            if not pairs[:, :, 0].any():  # each code is 00000000, category 8
                values = pairs[:, :, 1].astype(np.int32)
                return np.where(values >= 128, values, values - 255).reshape(len(frames), BLOCKS, 64), [np.ones(64, np.int32)] * len(frames)
    coefficients, quantisers = [], []
    for f in frames:
        height, width, quant, tables, scan = parse_jpeg(f)
        coefficients.append(decode_scan(scan, height * width // 64, tables))
        quantisers.append(quant)
    return np.stack(coefficients), quantisers


def idct_matrix() -> np.ndarray:
    """Zigzag coefficients to pixels, in whole 2048ths: sums stay below 2**24, so float32 products are exact."""
    n = np.arange(8)
    basis = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, np.sqrt(0.5), 1) / 2
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 2048).astype(np.float32)


def shots(histograms: np.ndarray, floor: int, memory: int = 8) -> list[int]:
    """First frames of the shots: differences above mean + 1.5 deviations of the last `memory` ones, and above the floor."""
    differences = np.abs(np.diff(histograms, axis=0)).sum(axis=1).tolist()
    starts = [0]
    for i, d in enumerate(differences):
        last = differences[max(0, i - memory) : i]
        mean = sum(last) / len(last) if last else 0.0
        spread = (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5 if last else 0.0
        if d > floor and last and d > mean + 1.5 * spread:
            starts.append(i + 1)
    return starts


def pixel_histograms(coefficients: np.ndarray, quantisers: list[np.ndarray], idct: np.ndarray) -> np.ndarray:
    """Each frame's histogram of 16 grey levels."""
    frames = len(coefficients)
    values = coefficients * np.stack(quantisers)[:, None, :]
    values[:, :, 0] = np.cumsum(coefficients[:, :, 0], axis=1) * np.array([q[0] for q in quantisers])[:, None]
    dc = values[:, :, :1] * np.float32(idct[0, 0])  # alone, as its sum may be large
    values[:, :, 0] = 0
    pixels = values.reshape(-1, 64).astype(np.float32) @ idct
    pixels = np.clip(((pixels.reshape(frames, -1, 64) + dc).astype(np.int64) >> 11) + 128, 0, 255)
    bins = (pixels >> 4).reshape(frames, -1) + 16 * np.arange(frames)[:, None]
    return np.bincount(bins.ravel(), minlength=16 * frames).reshape(frames, 16)


def clips(histograms: np.ndarray, pixels: int, rate: float) -> list[tuple[float, float, int, int]]:
    """(start s, end s, first frame, brightest histogram bin) of each shot."""
    starts = shots(histograms, pixels // 8)
    ends = [*starts[1:], len(histograms)]
    return [(a / rate, b / rate, a, int(histograms[a:b].sum(axis=0).argmax())) for a, b in zip(starts, ends)]


def read_back(avi: bytes, idct: np.ndarray, step: int = 512) -> tuple[bytes, list[tuple[float, float, int, int]]]:
    """(payload, clips) of a file, decoded `step` frames at a time."""
    rate, frames = read_avi(avi)
    payload, histograms, pixels = [], [], 0
    for at in range(0, len(frames), step):
        coefficients, quantisers = decode_frames(frames[at : at + step])
        payload.append(np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes())
        histograms.append(pixel_histograms(coefficients, quantisers, idct))
        pixels = coefficients.shape[1] * 64
    return b"".join(payload), clips(np.concatenate(histograms), pixels, rate)


def media_columns(df: DataFrame, text: str = "text", id_col: str = "doc_id", with_media: bool = False) -> DataFrame:
    """One row a document: sizes, digests, a summary string and its timed clips; with_media adds the file itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idct = idct_matrix()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "media")}
                for data in as_bytes(part.column(1)):
                    data = data or b""
                    avi = write_avi(write_frames(data + b"\xff" * (-len(data) % FRAME if data else FRAME)))
                    back, found = read_back(avi, idct)
                    out["n_bytes"].append(len(data))
                    out["payload_bytes"].append(len(back))
                    out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                    out["tail_crc32"].append(zlib.crc32(back[-32:]))
                    out["media_bytes"].append(len(avi))
                    out["media_sha256"].append(hashlib.sha256(avi).hexdigest())
                    out["feature"].append(f"frames={len(back) // FRAME};shots={len(found)};longest={max(b - a for a, b, _, _ in found):.2f}s;cuts=" + ",".join(str(c[2]) for c in found[1:]))
                    out["clips"].append([{"start_s": a, "end_s": b, "first_frame": f, "peak_bin": p} for a, b, f, p in found])
                    out["media"].append(avi if with_media else None)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int32()), ("peak_bin", pa.int32())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], [id_col, *out])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s:double,end_s:double,first_frame:int,peak_bin:int>>, media binary"
    out = df.select(id_col, text).mapInArrow(lean(rows), schema)
    return out if with_media else out.drop("media")


def digests(df: DataFrame) -> DataFrame:
    """The contract's query."""
    return media_columns(df).drop("clips")
