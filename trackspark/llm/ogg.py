"""Texts kept as 8-bit samples in Ogg pages: write, check, take apart and measure.

A document becomes one Ogg bitstream with two multiplexed logical streams: ``samples`` (packets of
576 unsigned 8-bit samples, 255-padded) and ``marks`` (one packet for each samples page: the
CRC-32 of the samples in it). Reading verifies every page checksum, joins packets from the lacing
values (over page borders too), separates the logical streams by serial number and turns granule
positions into times. Nothing of the writer's state is used by the reader.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackspark.llm.common import map_rows, texts

FRAME = 576
RATE = 8000
PAGE_FRAMES = 85  # 85 packets of 3 lacing values: 255 segments, the most a page can list
_HEAD = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sII")  # magic, samples a second, samples a packet
_SAMPLES, _MARKS = b"SMPL8bit", b"MARKcrc\0"
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """The page checksum: CRC-32 by 0x04C11DB7, most significant bit first, zero start and end.

    It is the mirror image of zlib's CRC over mirrored bytes.
    """
    raw = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def page(body: bytes, lacing: bytes, serial: int, number: int, granule: int, flags: int = 0) -> bytes:
    """flags: 1 continued packet, 2 first page, 4 last page."""
    rest = lacing + body
    blank = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + rest
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the frame size."""
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def encode(payload: bytes) -> bytes:
    """The bitstream of a payload of whole frames; serial numbers come from the payload alone."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload is not a positive number of whole frames")
    serial = zlib.crc32(payload)
    marks = serial ^ 0x5A5A5A5A
    frame = lace(FRAME)
    out = [
        page(_ID.pack(_SAMPLES, RATE, FRAME), lace(_ID.size), serial, 0, 0, 2),
        page(_ID.pack(_MARKS, RATE, FRAME), lace(_ID.size), marks, 0, 0, 2),
    ]
    step = FRAME * PAGE_FRAMES
    for n, at in enumerate(range(0, len(payload), step), 1):
        body = payload[at : at + step]
        last = 4 if at + step >= len(payload) else 0
        end = at + len(body)
        out.append(page(body, frame * (len(body) // FRAME), serial, n, end, last))
        out.append(page(struct.pack("<I", zlib.crc32(body)), lace(4), marks, n, end, last))
    return b"".join(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, int, int]]:
    """``(serial, number, granule, flags, lacing, body start, body end)`` of each verified page."""
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise ValueError("cut page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one should start")
        start = at + _HEAD.size + n
        lacing = data[at + _HEAD.size : start]
        end = start + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("cut page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page {number} of stream {serial}: wrong checksum")
        yield serial, number, granule, flags, lacing, start, end
        at = end


def demultiplex(data: bytes) -> dict[int, dict]:
    """By serial number: ``packets``, and ``ends``, the (packets so far, granule) of each page."""
    streams: dict[int, dict] = {}
    for serial, number, granule, flags, lacing, start, _ in pages(data):
        s = streams.setdefault(serial, {"packets": [], "ends": [], "open": [], "next": 0, "closed": False})
        if number != s["next"] or s["closed"] or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(s["open"]):
            raise ValueError(f"stream {serial}: page {number} is out of order")
        s["next"] += 1
        s["closed"] = bool(flags & 4)
        at = begin = start
        for size in lacing:
            at += size
            if size < 255:
                s["packets"].append(b"".join([*s["open"], data[begin:at]]))
                s["open"] = []
                begin = at
        if begin < at or lacing[-1:] == b"\xff":
            s["open"].append(data[begin:at])
        s["ends"].append((len(s["packets"]), granule))
    if any(s["open"] or not s["closed"] for s in streams.values()):
        raise ValueError("a stream ends within a packet")
    return streams


def decode(data: bytes) -> tuple[bytes, list[float]]:
    """Samples, and the time in seconds at which each samples page ends."""
    by_kind = {s["packets"][0][:8]: s for s in demultiplex(data).values()}
    samples, marks = by_kind[_SAMPLES], by_kind[_MARKS]
    _, rate, _ = _ID.unpack(samples["packets"][0])
    payload = b"".join(samples["packets"][1:])
    times, at, done = [], 0, 1
    for (count, granule), mark in zip(samples["ends"][1:], marks["packets"][1:], strict=True):
        size = sum(map(len, samples["packets"][done:count]))
        if granule != at + size or struct.unpack("<I", mark)[0] != zlib.crc32(payload[at : at + size]):
            raise ValueError("a page's samples do not fit its granule position or its mark")
        at, done = granule, count
        times.append(granule / rate)
    return payload, times


def features(payload: bytes, times: list[float]) -> str:
    """Duration, page count, mean, deviation, zero crossings and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    dev = max(0.0, float(counts @ (values * values)) / len(x) - mean * mean) ** 0.5
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    bins = ",".join(map(str, counts.reshape(16, 16).sum(1)))
    return f"seconds={times[-1]:.6f};pages={len(times)};mean={mean:.6f};dev={dev:.6f};crossings={crossings};bins={bins}"


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string())]
    + [("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(text: str) -> tuple:
    raw = text.encode()
    media = encode(pad(raw))
    payload, times = decode(media)
    sha = hashlib.sha256
    return len(raw), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha(media).hexdigest(), features(payload, times)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the text stored as Ogg, read back and measured.

    A null text is empty (one frame of 255); a null id stays null; repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches):
        for b in batches:
            rows = zip(*map(_digest, b["text"]), strict=True)
            yield dict(zip(_SCHEMA.names, [b["doc_id"], *map(list, rows)], strict=True))

    return map_rows(texts(df, id_col, text_col), run, _SCHEMA, _DDL)


def media_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: the Ogg bytes themselves, for a sink of the caller's choice."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                yield {"doc_id": [i], "media": [encode(pad(text.encode()))]}

    return map_rows(texts(df, id_col, text_col), run, schema, "doc_id long, media binary")
