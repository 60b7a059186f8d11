"""Document statistics against plain counting, monotonic trees, held-out labels, odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm import quality

DDL = "doc_id long, text string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def counts(texts):
    s = quality.statistics(pa.array([t or "" for t in texts]))
    return [tuple(int(s[c][k]) for c in quality.COUNTS) for k in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#\x0b\x1c\x85 ", max_size=80), max_size=6))
def test_counts_of_any_text(texts):
    assert counts(texts) == [plain(t) for t in texts]


def test_counts_of_whole_documents(small, awkward):
    random.seed(3)
    made = [" ".join(random.choice("ab") for _ in range(n)) for n in (7, 8, 9, 15, 300, 5000)]
    texts = [r["text"] for r in small.collect()] + [r["text"] for r in awkward.collect()] + made
    assert counts(texts) == [plain(t) for t in texts]
    # A hash that never tells windows apart only chooses more of them.
    mix, quality._mix = quality._mix, lambda x: x * np.uint64(0)
    try:
        assert counts(made) == [plain(t) for t in made]
    finally:
        quality._mix = mix


def test_slices_of_a_column_count_alike():
    column = pa.array(["x", "a b c", "", "d e f g"])
    assert quality.statistics(column.slice(1, 3))["n_words"].tolist() == [3, 0, 4]


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + np.sin(9 * x[:, 1]) + 0.3 * rng.standard_normal(3000)) > 0.8).astype(float)
    y = 1 - y
    free, bound = quality.train(x, y, [0, 0, 0]), quality.train(x, y, [-1, 0, 1])
    base = np.repeat(rng.random((200, 3)), 50, 0)
    for j, sign in ((0, -1), (2, 1)):
        moved = base.copy()
        moved[:, j] = np.tile(np.linspace(0, 1, 50), 200)
        steps = np.diff(bound.margin(moved).reshape(200, 50), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert ((bound.score(x) >= 0.5) == y).mean() > 0.85
    assert ((free.score(x) >= 0.5) == y).mean() > 0.85

    def walk(forest, row):
        out = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            out += v[k - len(f)]
        return out

    assert np.allclose([walk(bound, r) for r in x[:100]], bound.margin(x[:100]))


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").dropna()
    known, other = labels.filter("crc32(cast(doc_id as string)) % 3 != 1"), labels.filter("crc32(cast(doc_id as string)) % 3 = 1")
    rows = quality.judge_quality(docs, known).join(other, "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 500 and len(bad) > 50
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_query_rows(small, awkward, empty, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for docs in (small, awkward, empty):
        rows = quality.judge_quality(docs, labels).collect()
        want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, *plain(r["text"])) for r in docs.collect()))
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in quality.COUNTS)) for r in rows) == want
        for r in rows:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])


def test_labels_that_teach_nothing(awkward, spark):
    nothing = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, quality int")
    for labels in (nothing, nothing.limit(0), one):
        rows = quality.judge_quality(awkward, labels).collect()
        assert all(r["kept"] == (not r["base_failed"]) and r["score"] is None for r in rows)
