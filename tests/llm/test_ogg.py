"""Ogg: exact round trips, and damage that a reader must notice."""

import hashlib
import zlib

import pytest

from trackspark.llm import ogg


def naive_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    for d in (b"", b"a", b"OggS" + bytes(range(256))):
        assert ogg.checksum(d) == naive_crc(d)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 85, 576 * 85 + 1, 300_000])
def test_round_trip(size):
    raw = (bytes(range(256)) * (size // 256 + 1))[:size]
    payload = ogg.pad(raw)
    assert len(payload) % 576 == 0 and len(payload) - size <= 576 and payload[:size] == raw
    back, times = ogg.decode(ogg.encode(payload))
    assert back == payload and times[-1] == len(payload) / ogg.RATE and times == sorted(times)


def test_packet_over_pages():
    """A packet whose lacing values run on to the next page is one packet."""
    body = bytes(1000)
    first = ogg.page(body[:510], b"\xff\xff", 9, 0, -1, 2)
    second = ogg.page(body[510:], b"\xff" + bytes([235]), 9, 1, 1000, 5)
    assert ogg.demultiplex(first + second)[9]["packets"] == [body]
    exact = ogg.page(bytes(255), b"\xff\x00", 9, 0, 255, 6)
    assert ogg.demultiplex(exact)[9]["packets"] == [bytes(255)]


def test_damage():
    media = bytearray(ogg.encode(ogg.pad(b"some text" * 200)))
    media[-20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.decode(bytes(media))
    media[-20] ^= 1
    with pytest.raises(ValueError):
        ogg.decode(bytes(media[:-700]))
    with pytest.raises(ValueError, match="out of order"):
        ogg.demultiplex(ogg.page(b"a", b"\x01", 5, 1, 0, 2))


def test_table(awkward, empty):
    rows = ogg.media_digests(awkward).collect()
    texts = {(r["doc_id"], r["text"] or "") for r in awkward.collect()}
    assert len(rows) == 11
    known = {hashlib.sha256(ogg.pad(t.encode())).hexdigest(): t for _, t in texts}
    for r in rows:
        raw = known[r["payload_sha256"]].encode()
        assert r["n_bytes"] == len(raw) and r["tail_crc32"] == zlib.crc32(ogg.pad(raw)[-32:]) and r["media_bytes"] > r["payload_bytes"]
    same = [r[1:] for r in rows if r["n_bytes"] == len("plain words here")]
    assert len(same) == 4 and len(set(same)) == 1
    assert ogg.media_digests(empty).count() == 0
    files = ogg.media_files(awkward).collect()
    assert sorted(hashlib.sha256(f["media"]).hexdigest() for f in files) == sorted(r["media_sha256"] for r in rows)
