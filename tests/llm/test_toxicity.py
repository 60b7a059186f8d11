"""Toxicity: accuracy on rows that no label was learnt from, and unseen spellings."""

import zlib

import numpy as np
import pytest

from trackspark.llm import toxicity


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    clean = [f"{a}{b}{c}" for a in ("ba", "lo", "me", "ri", "tu") for b in ("na", "st", "ver", "ko") for c in ("", "ly", "ing", "ed")]
    sample = []
    for k in range(400):
        words = rng.choice(clean, 60).tolist()
        if k % 2:
            words[rng.integers(60)] = ("grumblefool", "nastywretch")[k // 2 % 2]
        sample.append((" ".join(words), k % 2))
    return toxicity.train(sample), clean, rng


def test_unseen_spelling(model):
    m, clean, rng = model
    score = toxicity.Scorer(m)
    for bad in ("grumblefool", "grumblefoool", "gruumblefool", "NastyWretch!", "nastywretchs"):
        words = rng.choice(clean, 300).tolist()
        assert score(" ".join(words)) < 0.5
        assert score(" ".join([*words, bad])) >= 0.7, bad
    assert score("") == m.share == 0.5


def test_windows():
    v = np.zeros(100)
    v[57] = 16.0
    mean, a, b = toxicity.worst(v)
    assert mean == 1.0 and a <= 57 < b
    assert toxicity.worst(np.array([1.0, 3.0])) == (2.0, 0, 2)


def test_parts_are_local():
    """A word's parts do not depend on its neighbours."""
    alone = [toxicity.parts([w])[0].tolist() for w in ("idea", "é", "中文字")]
    flat, counts = toxicity.parts(["idea", "é", "中文字"])
    assert [sorted(x) for x in alone] == [sorted(x) for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    test = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(y and p for y, p in test)
    # A twelfth of these toxic labels stands on texts without any such word, and three of the four
    # languages have a few dozen toxic examples each: the recall is bounded by that.
    assert hit / sum(p for _, p in test) > 0.9 and hit / sum(y for y, _ in test) > 0.7


def test_awkward(spark, awkward, empty):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (8, None), (3, 0), (4, 0), (5, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(awkward, no_labels).collect()} == {0.0}
    rows = toxicity.score_toxicity(awkward, some).collect()
    assert len(rows) == 11 and not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    assert toxicity.score_toxicity(empty, some).count() == 0
    kept = toxicity.without_toxic(awkward, no_labels)
    assert kept.columns == awkward.columns and kept.count() == 11
