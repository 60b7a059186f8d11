"""Words of a batch of texts as a dictionary and numbers, so that Python sees each distinct word once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 22


def groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of a text column of about ``size`` bytes, each with its first row."""
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, column.slice(start, stop - start)
        start = stop


def split(column: pa.Array, every_space: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(distinct words, number of each word in order, first word of each text and the end)``.

    Words are cut at ASCII white space, with ``every_space`` at all white space; nulls are empty. An
    empty word may stand at either end of a text.
    """
    cut = pc.utf8_split_whitespace if every_space else pc.ascii_split_whitespace
    lists = cut(column.fill_null(""))
    encoded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(), (offsets - offsets[0]).astype(np.int64)


class Remembered:
    """A bounded cache in two generations: what is used again outlives the next clearing."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, words: list, learn) -> list:
        """The value of each word; ``learn(missing)`` gives those of the words not known yet."""
        found = list(map(self.young.get, words))
        missing = []
        for k, v in enumerate(found):
            if v is None:
                v = self.old.get(words[k])
                if v is None:
                    missing.append(k)
                else:
                    found[k] = self.young[words[k]] = v
        if missing:
            new = [words[k] for k in missing]
            for k, w, v in zip(missing, new, learn(new), strict=True):
                found[k] = self.young[w] = v
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        return found


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
