"""Repeated strings against brute force over every 50-byte window."""

import hashlib
import random

import numpy as np

from trackspark.llm import prefix_free


def brute(rows):
    first = {}
    for d, x in rows:
        b = (x or "").encode()
        for p in range(len(b) - 49 if d is not None else 0):
            first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    out = []
    for d, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if d is not None else 0):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, prefix_free.remove_repeats(df).collect()), key=repr) == brute(rows)


def test_documents(spark, small):
    """Copies that start and end anywhere, ids that repeat, periodic and long texts."""
    random.seed(3)
    rows = [(r["doc_id"], r["text"]) for r in small.collect()][:80]
    whole = rows[3][1]
    rows += [(1000 + i, random.choice(rows)[1][random.randint(0, 200) :][: random.randint(20, 900)] + random.choice(rows)[1][-70:]) for i in range(120)]
    rows += [(None, whole), (5, rows[9][1]), (5, rows[9][1]), (5, rows[10][1]), (6, None), (7, "")]
    rows += [(2000, "a" * 5000), (2001, "a" * 300), (2002, "ab" * 100), (2003, "ba" * 100), (2004, "é" * 40), (2005, "xé" * 40), (-1, whole[7:207])]
    rows += [(3000, "".join(x or "" for _, x in rows) * 2)]
    compare(spark, rows)


def test_borders(spark):
    """Exactly 49, 50 and 51 shared bytes; touching and overlapping spans; windows from two documents."""
    random.seed(8)
    letters = lambda n: "".join(random.choices("abcdefghij ", k=n))
    a, b = letters(400), letters(400)
    rows = [(1, a), (2, b)]
    rows += [(10 + k, letters(30) + a[100 : 149 + k] + letters(30)) for k in range(3)]
    rows += [(20, a[:60] + b[40:100]), (21, letters(9) + a[50:110] + a[70:160]), (22, a[200:230] + b[200:230]), (23, a[:50]), (24, a[:49])]
    compare(spark, rows)


def test_chunks(spark, monkeypatch):
    """Texts longer than the stretch that is hashed at once."""
    random.seed(5)
    text = "".join(random.choices("abcdefgh ", k=prefix_free.CHUNK + 4000))
    compare(spark, [(1, text), (2, text[3000:-500]), (3, "z" * 77 + text[prefix_free.CHUNK - 200 :])])


def test_awkward(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, prefix_free.remove_repeats(awkward).collect()), key=repr) == brute(rows)
    assert prefix_free.remove_repeats(empty).count() == 0
    kept = {hashlib.sha256(r["kept"]).hexdigest() for r in prefix_free.kept_texts(awkward).collect()}
    assert kept == {r[-1] for r in brute(rows)}
