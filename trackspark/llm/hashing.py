"""Strong 64-bit hashes in numpy: of single words, of arrays, and of the substrings of a byte string."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A random 64-bit number for each byte.
BYTES = np.random.default_rng(20_240_917).integers(0, 1 << 64, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ordered pairs."""
    x = a * _A + b
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def sixteen_and_seven(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each 16-byte and of each 7-byte substring, by doubling."""
    h = BYTES[data]
    for step in (1, 2):
        h = pair(h[:-step], h[step:])
    seven = pair(h[:-3], h[3:])
    for step in (4, 8):
        h = pair(h[:-step], h[step:])
    return h, seven


_PLACES = np.random.default_rng(20_240_918).integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def split_words(texts: list[bytes], letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, ends, first)`` of the words of the texts, A-Z lower-cased.

    Words are what stands between ASCII white space; with ``letters`` they are runs of letters and
    digits (all bytes beyond ASCII count as such) and Latin-1 capitals are lower-cased too. Starts and
    ends are bytes within all texts joined by a newline; ``first`` has each text's first word, and the
    end. Of words over 1024 bytes the places repeat, which only long permutations could exploit.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = ~(_OTHER if letters else _SPACE)[data]
    if letters and len(data):
        capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        data = data.copy()
        data[1:][capital] += 0x20
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    first = np.searchsorted(starts, np.concatenate([[0], sizes]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    values = BYTES[_LOWER][data[inside]]
    values *= _PLACES[(np.arange(len(values)) - np.repeat(at, lengths)) & 1023]
    return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64)), starts, ends, first
