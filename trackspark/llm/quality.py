"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy node arrays.

The statistics of a whole text are counted on Arrow buffers, many texts at a time: words and lines are
dictionary-encoded, windows of eight words are found again by a hash and then compared word by word.
All are shares, so that a text's length says nothing about its quality.

The trees are fitted in numpy on the statistics of a bounded sample of labelled rows. Where a share can
only speak against a text (repeats, symbols, ...), splits that would let the score rise with it are
refused and the leaves below are held within bounds, so the whole ensemble is monotonic in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import texts
from trackspark.llm.words import groups

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # the base rule
#: Bound of the training sample: labelled rows, by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 60, 3, 32, 0.2, 20, 1.0
THRESHOLD = 0.5

#: The features, and in which direction the score may move with each (0: either).
FEATURES = {
    "word_length": 0,
    "symbols": -1,  # for each word
    "punctuation": 0,  # characters
    "digits": 0,
    "capitals": -1,  # of the letters A-Z and a-z
    "line_words": 0,
    "repeated_lines": -1,
    "repeated_words": -1,  # in windows
    "echoes": -1,  # words equal to the one before
    "commonest_word": -1,
    "bare_words": -1,  # without a letter or digit
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# White space and symbols of the contract.
SPACE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
_BYTE = np.arange(256)
_IS = {
    "char": (_BYTE & 0xC0) != 0x80,
    "space": np.isin(_BYTE, list(SPACE)),
    "symbol": np.isin(_BYTE, list(SYMBOLS)),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "punctuation": (_BYTE > 32) & (_BYTE < 127) & np.array([not chr(b).isalnum() for b in _BYTE]),
}


def _split(column: pa.Array, cut) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(distinct pieces, number of each piece, its text)`` of the non-empty pieces in order."""
    lists = cut(column)
    coded = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(column)), np.diff(lists.offsets.to_numpy()))
    ids = coded.indices.to_numpy()
    real = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
    return coded.dictionary, ids[real].astype(np.int64), owner[real]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def repeated_words(ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts its words in windows of ``WINDOW`` words that it holds twice or more."""
    starts = len(ids) - WINDOW + 1
    if starts < 2:
        return np.zeros(n, np.int64)
    h = np.zeros(starts, np.uint64)
    for k in range(WINDOW):
        h = _mix(h + ids[k : k + starts].astype(np.uint64))
    h = _mix(h + owner[:starts].astype(np.uint64))
    at = np.flatnonzero(owner[:starts] == owner[WINDOW - 1 :])
    order = np.sort(h[at])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(twice, h[at]), len(twice) - 1)
    at = at[twice[place] == h[at]]
    # The hash only chose them: equal windows are equal words of one text.
    rows = np.stack([owner[at], *(ids[at + k] for k in range(WINDOW))], 1)
    by = np.lexsort(rows.T)
    same = (rows[by][1:] == rows[by][:-1]).all(1)
    again = np.zeros(len(at), bool)
    again[by[1:][same]] = again[by[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[at[again]] += 1
    edges[at[again] + WINDOW] -= 1
    return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=n)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` and ``FEATURES`` of each text of a column without nulls."""
    n = len(column)
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    def count(name: str) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_IS[name][data], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    c = {name: count(name) for name in _IS}
    words, ids, owner = _split(column, pc.ascii_split_whitespace)
    n_words = np.bincount(owner, minlength=n)
    lines, line, of = _split(column, lambda x: pc.split_pattern(x, "\n"))
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool) if len(lines) else np.zeros(0, bool)
    line, of = line[worded[line]], of[worded[line]]
    n_lines = np.bincount(of, minlength=n)
    distinct = np.bincount(np.unique(of * (len(lines) + 1) + line) // (len(lines) + 1), minlength=n)
    repeated = repeated_words(ids, owner, n)
    echo = np.flatnonzero((ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1]))
    kinds, uses = np.unique(owner * (len(words) + 1) + ids, return_counts=True)
    commonest = np.zeros(n, np.int64)
    np.maximum.at(commonest, kinds // (len(words) + 1), uses)
    bare = pc.invert(pc.match_substring_regex(words, r"[0-9A-Za-z]|[^\x00-\x7F]")).to_numpy(zero_copy_only=False).astype(bool) if len(words) else np.zeros(0, bool)
    chars = c["char"] - c["space"]

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": c["symbol"],
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeated,
        "word_length": ratio(chars, n_words),
        "symbols": ratio(c["symbol"], n_words),
        "punctuation": ratio(c["punctuation"], chars),
        "digits": ratio(c["digit"], chars),
        "capitals": ratio(c["upper"], c["upper"] + c["lower"]),
        "line_words": ratio(n_words, n_lines),
        "repeated_lines": ratio(n_lines - distinct, n_lines),
        "repeated_words": ratio(repeated, n_words),
        "echoes": ratio(np.bincount(owner[echo], minlength=n), n_words),
        "commonest_word": ratio(commonest, n_words),
        "bare_words": ratio(np.bincount(owner[bare[ids]], minlength=n), n_words),
    }


@dataclass
class Forest:
    """All trees as flat arrays, one row a tree: node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # of the leaves
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees for each row of ``x`` (rows x features): one step a level for all trees."""
        out = np.full(len(x), self.start)
        tree = np.arange(len(self.feature))[None, :]
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            for _ in range(self.depth):
                right = np.take_along_axis(rows, self.feature[tree, node], 1) > self.threshold[tree, node]
                node = 2 * node + 1 + right
            out[a : a + 4096] += self.value[tree, node - (2**self.depth - 1)].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def train(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest | None:
    """Newton boosting on the logistic loss over quantile bins; None without labels of both classes."""
    if not len(y) or y.min() == y.max():
        return None
    n_features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    z = np.full(len(y), start)
    shape = (trees, 2**depth - 1)
    feature, threshold, value = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(2**depth - 1):
            low, high = bounds[k]
            bounds[2 * k + 1] = bounds[2 * k + 2] = bounds[k]
            rows = np.flatnonzero(node == k)
            best, chosen = 1e-9, None
            if len(rows) >= 2 * LEAST_ROWS:
                gs, hs = g[rows], h[rows]
                whole = gs.sum() ** 2 / (hs.sum() + RIDGE)
                for j in range(n_features):
                    size = len(cuts[j]) + 1
                    b = binned[rows, j]
                    sums = [np.cumsum(np.bincount(b, w, size))[:-1] for w in (gs, hs, None)]
                    gl, hl, nl = sums
                    gr, hr, nr = gs.sum() - gl, hs.sum() - hl, len(rows) - nl
                    left, right = (np.clip(a / (c + RIDGE), low, high) for a, c in ((gl, hl), (gr, hr)))
                    gain = 2 * (gl * left + gr * right) - (hl + RIDGE) * left**2 - (hr + RIDGE) * right**2 - whole
                    gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS) | (signs[j] * (right - left) < 0)] = -1
                    if size > 1 and gain.max() > best:
                        i = int(gain.argmax())
                        best, chosen = gain[i], (j, i, left[i], right[i])
            if chosen is None:
                node[rows] = 2 * k + 1  # everything goes left
                continue
            j, i, left, right = chosen
            feature[t, k], threshold[t, k] = j, cuts[j][i]
            middle = (left + right) / 2
            if signs[j] < 0:
                bounds[2 * k + 1], bounds[2 * k + 2] = (middle, high), (low, middle)
            elif signs[j] > 0:
                bounds[2 * k + 1], bounds[2 * k + 2] = (low, middle), (middle, high)
            node[rows] = 2 * k + 1 + (binned[rows, j] > i)
        leaf = node - (2**depth - 1)
        sums = [np.bincount(leaf, w, 2**depth) for w in (g, h)]
        limits = np.array([bounds[2**depth - 1 + k] for k in range(2**depth)])
        value[t] = rate * np.clip(sums[0] / (sums[1] + RIDGE), limits[:, 0], limits[:, 1])
        z += value[t][leaf]
    return Forest(feature, threshold, value, start, depth)


_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts and the features of each row; a null text is an empty one, all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in groups(batch.column(1)):
                s = statistics(part)
                ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([ids] + [pa.array(s[c].astype(np.int64)) for c in COUNTS] + [pa.array(s[c]) for c in FEATURES], names=["doc_id", *COUNTS, *FEATURES])

    return texts(df, id_col, text_col).mapInArrow(run, _DDL)


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents, by a hash of the id.

    An id labelled twice is of low quality if one label says so; of rows that repeat an id one counts.
    """
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    ids = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(most)
    ids = F.broadcast(ids)  # at most ``most`` rows of two numbers
    rows = document_statistics(docs.join(ids, "doc_id", "left_semi")).join(ids, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"), F.min("quality").alias("quality"))
    found = sorted((r["doc_id"], tuple(r["x"]), r["quality"]) for r in rows.collect())
    return np.array([x for _, x, _ in found]).reshape(len(found), len(FEATURES)), np.array([q for *_, q in found], np.float64)


def judge_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and ``score`` of each row.

    A text of under 20 words, or with over 30% of them in repeated windows, fails; of the others those
    are kept that the trees score at the threshold or above. Without labels of both classes every text
    that does not fail is kept (its score is null). A null or empty text has zero counts and fails; a
    null id stays; repeated rows give equal rows; other columns are ignored; an empty table gives an
    empty table.
    """
    docs = texts(df, id_col, text_col)
    forest = train(*training_sample(docs, labels), list(FEATURES.values()))
    names = list(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in groups(batch.column(1)):
                s = statistics(part)
                failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])
                score = forest.score(np.stack([s[c] for c in names], 1)) if forest else None
                kept = ~failed if score is None else ~failed & (score >= threshold)
                score = pa.nulls(len(part), pa.float64()) if score is None else pa.array(score)
                columns = [batch.column(0).slice(at, len(part)), *(pa.array(s[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept), score]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return docs.mapInArrow(run, ddl)
