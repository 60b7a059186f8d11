"""Whole-document token ids and character spans from a tokenizer whose tokens never cross white space.

``word_bpe_49k`` drops white space and splits the rest into pieces by a fixed pattern, so a text's
ids are the ids of its words in order. Words repeat, so each Python worker keeps bounded caches of
words and pieces; what is missing is encoded by the tokenizer's own merges, once. Words outside
Latin-1, and those that may hold a special token, go to the whole tokenizer. The tests compare all
of this with whole-text encoding by the library.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

MAX_CACHED = 250_000
GROUP_CHARS = 1 << 20  # texts whose words are looked up together
JOINED = 256  # unseen words in one call
# Fixed value: the split pattern in the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Python's str.split() cuts at these, the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
_pack = struct.Struct("<I").pack
_WORKER: dict[tuple[str, bool], WordTokens] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a letter: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(256 + k) for k, b in enumerate(others)}


class Cache(dict):
    """A dictionary that learns what it misses. Two generations: what is used again outlives a clearing."""

    def __init__(self, most: int, learn: Callable):
        super().__init__()
        self.most, self.learn, self.old = most, learn, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.learn(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


class WordTokens:
    """Ids as little-endian unsigned 32-bit bytes; with ``spans``, starts and ends in code points."""

    def __init__(self, path: str, spans: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.cut = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.with_spans = spans
        self.words = Cache(MAX_CACHED, self._word)
        self.pieces = Cache(MAX_CACHED, self._piece)
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([_pack(t.id) for t in self.merges(piece)])

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self.pieces[word.lower()]
        elif max(word) > "\xff":  # may need composition
            return self._whole(word)[0]
        if "<|" in word:
            return self._whole(word)[0]
        return b"".join(map(self.pieces.__getitem__, self.cut(word.lower())))

    def _whole(self, text: str) -> tuple[bytes, np.ndarray]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.asarray(e.ids, "<u4").tobytes(), np.asarray(e.offsets, np.int64).reshape(-1, 2)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray | None]]:
        """``(ids, spans)`` of each text, in order; spans are None unless asked for."""
        if self.with_spans:
            yield from self._encode_spans(texts)
            return
        for text in texts:
            if any(c in text for c in _ODD):
                yield self._whole(text)[0], None
                continue
            yield b"".join(map(self.words.__getitem__, text.split())), None

    # With spans.

    def _learn(self, needed: set[str]) -> None:
        """All words of a group of texts; of a full cache only what the group needs is kept."""
        words = list(needed.difference(self.ids))
        if len(self.ids) + len(words) > MAX_CACHED:
            kept = needed.intersection(self.ids)
            self.ids = {w: self.ids[w] for w in kept}
            self.spans = {w: self.spans[w] for w in kept}
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            starts = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, spans = np.asarray(e.ids, "<u4"), np.asarray(e.offsets, "<i4").reshape(-1, 2)
            word = np.searchsorted(starts, spans[:, 0], "right") - 1
            ends = np.cumsum(np.bincount(word, minlength=len(part))).tolist()
            data, rel = ids.tobytes(), (spans - starts[word][:, None]).astype("<i4").tobytes()
            a = 0
            for w, b in zip(part, ends, strict=True):
                self.ids[w] = data[4 * a : 4 * b]
                self.spans[w] = rel[8 * a : 8 * b]
                a = b

    def _found(self, text: str, words: list[str]) -> tuple[bytes, np.ndarray]:
        ids = b"".join(map(self.ids.__getitem__, words))
        parts = list(map(self.spans.__getitem__, words))
        rel = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2).astype(np.int64)
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 8
        return ids, rel + np.repeat(word_starts(text), counts)[:, None]

    def _encode_spans(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        for group in _groups(texts):
            out: list = [None] * len(group)
            late: dict[int, list[str]] = {}
            for k, text in enumerate(group):
                if any(c in text for c in _ODD):
                    out[k] = self._whole(text)
                    continue
                words = text.split()
                try:
                    out[k] = self._found(text, words)
                except KeyError:
                    late[k] = words
            if late:
                self._learn(set(chain.from_iterable(late.values())))
            for k, words in late.items():
                out[k] = self._found(group[k], words)
            yield from out


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


_SPACES = np.array(sorted(i for i in range(0x3001) if chr(i).isspace()), np.uint32)


def word_starts(text: str) -> np.ndarray:
    """Where each item of ``text.split()`` starts."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (c == 32) | (c == 10)
    odd = np.flatnonzero((c < 32) | (c >= 0x85) & (c <= 0x3000))
    space[odd] |= np.isin(c[odd], _SPACES)
    return np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(c) else np.zeros(0, np.int64)


def word_tokens(path: str, spans: bool = False) -> WordTokens:
    """One for each Python worker."""
    if (path, spans) not in _WORKER:
        _WORKER[path, spans] = WordTokens(path, spans)
    return _WORKER[path, spans]
