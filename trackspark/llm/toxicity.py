"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed parts (itself and its character n-grams, with
word borders), a window of words the mean of its words, and a softmax over two classes reads that
mean; embeddings and softmax are trained together. Unseen misspellings share most of their n-grams
with the words they come from. A document is scored by its worst window, so a few toxic words are
not washed out by a long text; training picks each document's worst window in the same way.

The model is fitted on a bounded, documented sample of labelled rows. Scoring needs one number for
each hashed part (its embedding's projection on the softmax margin), so workers get 2**17 floats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import map_rows, slices, texts

BUCKETS = 1 << 17
DIM = 8
WINDOW, STRIDE = 16, 8
GRAMS = (3, 4, 5)
# Bounds of the training sample: rows of either class, and the longest text in it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 3000, 6000, 32_768
STEPS, REFRESH, BATCH, RATE, SEED = 2400, 100, 64, 0.25, 7
TOXIC_WEIGHT = 3.0  # a missed toxic text against a clean one suspected
THRESHOLD = 0.7
MAX_CACHED = 150_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The distinct words of a text, in order of their first places."""
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' parts, word after word, and how many each word has."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = [np.add.reduceat(_mix(c + (place.astype(np.uint64) << np.uint64(32))), np.cumsum(sizes) - sizes)]
    owner = [np.arange(len(words))]
    for n in GRAMS:
        if n <= len(c):
            h = np.zeros(len(c) - n + 1, np.uint64)
            for k in range(n):
                h = _mix(h + c[k : len(c) - n + 1 + k])
            own = word[: len(h)] == word[n - 1 :]
            found.append(h[own])
            owner.append(word[: len(h)][own])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    flat = (_mix(np.concatenate(found)[order]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return flat, np.bincount(owners, minlength=len(words))


def worst(values: np.ndarray) -> tuple[float, int, int]:
    """The highest window mean of a text's word values, and that window."""
    n = len(values)
    total = np.concatenate([[0.0], np.cumsum(values)])
    if n <= WINDOW:
        return total[n] / n, 0, n
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    means = (total[starts + WINDOW] - total[starts]) / WINDOW
    k = int(np.argmax(means))
    return float(means[k]), int(starts[k]), int(starts[k]) + WINDOW


@dataclass
class Model:
    margin: np.ndarray  # of each bucket: embedding times (toxic - clean) weights
    bias: float
    share: float  # of toxic rows in the sample
    fitted: bool = True

    def words(self, words: list[str]) -> list[float]:
        """The value of each word: its parts' mean."""
        flat, counts = parts(words)
        return (np.add.reduceat(self.margin[flat], np.cumsum(counts) - counts) / counts).tolist()

    def score(self, values: np.ndarray) -> float:
        """Of a text with these word values."""
        if not len(values) or not self.fitted:
            return self.share
        z = self.bias + worst(values)[0]
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


class Scorer:
    """Scores texts with a bounded cache of word values."""

    def __init__(self, model: Model):
        self.model, self.values = model, {}

    def __call__(self, text: str) -> float:
        words = words_of(text)
        try:
            found = [self.values[w] for w in words]
        except KeyError:
            if len(self.values) > MAX_CACHED:
                self.values.clear()
            new = [w for w in words if w not in self.values]
            self.values.update(zip(new, self.model.words(new), strict=True))
            found = [self.values[w] for w in words]
        return self.model.score(np.array(found))


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the rows' entries, row after row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def train(sample: list[tuple[str, int]], seed: int = SEED) -> Model:
    """Mini-batch Adagrad on the softmax loss; the classes weigh 1 to ``TOXIC_WEIGHT`` in total."""
    labels = np.array([y for _, y in sample], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, float(labels.mean()) if len(labels) else 0.0, fitted=False)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t, _ in sample]
    if not index:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, float(labels.mean()), fitted=False)
    vocabulary = list(index)
    pieces = [parts(vocabulary[a : a + 20_000]) for a in range(0, len(vocabulary), 20_000)]
    flats = np.concatenate([f.astype(np.int32) for f, _ in pieces])
    counts_of = np.concatenate([c for _, c in pieces])
    del index, vocabulary, pieces
    starts_of = np.cumsum(counts_of) - counts_of
    rng = np.random.default_rng(seed)
    emb = np.zeros((BUCKETS, DIM), np.float32)  # parts that training never saw stay neutral
    soft = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full_like(x, 1e-6) for x in (emb, soft, bias)]
    weight = len(labels) / (2.0 * np.bincount(labels, minlength=2)) * (1.0, TOXIC_WEIGHT)
    batches = max(1, len(docs) // BATCH)
    epochs = -(-STEPS // batches)
    for epoch in range(epochs):
        if epoch < max(2, epochs // 6):  # a random stretch of each document
            firsts = [int(rng.integers(max(1, len(d) - 4 * WINDOW + 1))) for d in docs]
            bags = [d[a : a + 4 * WINDOW] for a, d in zip(firsts, docs, strict=True)]
        elif epoch % max(1, REFRESH // batches) == 0 or epoch == max(2, epochs // 6):  # its worst window, as it will be scored
            word = np.add.reduceat((emb @ (soft[:, 1] - soft[:, 0]))[flats], starts_of) / counts_of
            bags = [d[slice(*worst(word[d])[1:])] if len(d) else d for d in docs]
        rate = RATE * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(docs)), batches):
            at = np.array([k for k in at if len(bags[k])], np.int64)
            if not len(at):
                continue
            sizes = np.array([len(bags[k]) for k in at])
            kinds, inverse = np.unique(np.concatenate([bags[k] for k in at]), return_inverse=True)
            counts = counts_of[kinds]
            flat = flats[_ragged(starts_of[kinds], counts)]
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            vectors = np.add.reduceat(emb[flat], first) / counts[:, None]
            own = np.repeat(np.arange(len(at)), sizes)
            means = np.add.reduceat(vectors[inverse], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
            z = means @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            g = p * (weight[labels[at]] / len(at))[:, None]
            g_means = (g @ soft.T) / sizes[:, None]
            g_kinds = np.stack([np.bincount(inverse, g_means[own, j], len(kinds)) for j in range(DIM)], 1) / counts[:, None]
            touched, place = np.unique(flat, return_inverse=True)
            spread = np.repeat(g_kinds, counts, 0)
            g_emb = np.stack([np.bincount(place, spread[:, j], len(touched)) for j in range(DIM)], 1).astype(np.float32)
            seen[0][touched] += g_emb**2
            emb[touched] -= rate * g_emb / np.sqrt(seen[0][touched])
            for x, s, gx in ((soft, seen[1], means.T @ g), (bias, seen[2], g.sum(0))):
                s += gx**2
                x -= rate * gx / np.sqrt(s)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), float(labels.mean()))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``toxic`` + ``clean`` labelled texts of at most ``chars`` characters, by a hash of the id.

    Only rows that are not held out; an id labelled twice is toxic if one label says so.
    """
    known = labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [known.filter(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, toxic), (0, clean))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most toxic + clean rows
    rows = texts(docs).filter(F.char_length("text") <= chars).join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return [(r["text"], int(r["toxic"])) for r in rows.orderBy(*order).collect()]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row, from the whole text alone.

    A null or empty text, or one without words, gets the share of toxic rows in the sample; a null id
    is not held out; repeated rows give equal scores; with no usable label, or labels of one class,
    every score is that share (0 without labels); other columns are ignored; an empty table
    gives an empty table.
    """
    docs = texts(df, id_col, text_col)
    model = train(training_sample(docs, labels))

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            scores = list(map(scorer, b["text"]))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_rows(docs.withColumn("held_out", held_out(F.col("doc_id"))), run, _SCHEMA, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(df: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with their columns, that score below the threshold; rows with a null text stay."""
    model = train(training_sample(df, labels))
    at = df.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches):
            yield b.filter(pa.array([t is None or scorer(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
