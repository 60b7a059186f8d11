"""Decontamination: exact leaks, recall of edited ones, and the edit distance itself."""

import random

import numpy as np

from trackspark.llm import cgk

random.seed(9)
VOCAB = [f"{a}{b}" for a in ("th", "on", "re", "ing", "er", "an") for b in ("a", "es", "nd", "ou", "st", "ti", "ly", "he")]
ITEMS = [(i, " ".join(random.choices(VOCAB, k=random.randint(15, 60)))) for i in range(60)]


def edited(text, share):
    w = text.split()
    for _ in range(max(1, round(share * len(w)))):
        k, op = random.randrange(len(w)), random.random()
        if op < 0.5:
            w[k] = random.choice(VOCAB)
        elif op < 0.75:
            w.insert(k, random.choice(VOCAB))
        else:
            del w[k]
    return " ".join(w)


def test_best_end_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            last, row[0] = row[0], row[0] + 1
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for _ in range(150):
        a, b = random.choices(range(3), k=random.randint(1, 7)), random.choices(range(3), k=random.randint(0, 9))
        every = [(distance(a, b[s:e]), e) for e in range(len(b) + 1) for s in range(e + 1)]
        assert cgk.best_end(a, b)[0] == min(d for d, _ in every)


def test_recall_and_clean_texts():
    index = cgk.build(ITEMS)
    for share, least in ((0, 1.0), (0.05, 0.97), (0.1, 0.93), (0.15, 0.9)):
        texts, want = [], []
        for i, t in ITEMS * 3:
            host = random.choices(VOCAB, k=300)
            host.insert(random.randint(0, 300), edited(t, share) if share else t)
            texts.append(" ".join(host))
            want.append(i)
        found = {(k, ITEMS[n][0]) for k, n, *_ in cgk._found(texts, index, cgk.SHARE)}
        assert sum((k, i) in found for k, i in enumerate(want)) >= least * len(want), share
    clean = [" ".join(random.choices(VOCAB, k=400)) for _ in range(300)]
    assert not list(cgk._found(clean, index, cgk.SHARE))


def test_index_against_brute_force(small, spark):
    """Whatever the exact check would accept anywhere in the small corpus is found."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in cgk.leaks(small, items).collect()}
    known = [(r["item_id"], cgk.hashing.split_words([r["text"].encode()], letters=True)[0]) for r in items.collect()]
    for d in small.collect():
        codes = cgk.hashing.split_words([d["text"].encode()], letters=True)[0].tolist()
        for i, c in known:
            edits, _ = cgk.best_end(c.tolist(), codes)
            if edits <= 0.1 * len(c):
                assert got[d["doc_id"], i] == edits
            if (d["doc_id"], i) in got:
                assert edits <= cgk.SHARE * len(c)


def test_all_edits_allowed():
    """With as many edits as the operator accepts nothing is missed, at any length."""
    for length in (1, 4, 5, 9, 10, 15, 16, 31, 32, 33, 47, 64):
        items = [(i, " ".join(random.choices(VOCAB, k=length))) for i in range(150)]
        index = cgk.build(items)
        texts = []
        for _, t in items:
            passage = edited(t, int(cgk.SHARE * length) / length) if int(cgk.SHARE * length) else t
            texts.append(" ".join([*random.choices(VOCAB, k=30), passage, *random.choices(VOCAB, k=30)]))
        found = {(k, items[n][0]) for k, n, *_ in cgk._found(texts, index, cgk.SHARE)}
        assert all((k, k) in found for k in range(150)), length


def test_all_shares_against_brute_force(small, spark):
    """The hits are the pairs that the exact check accepts, at the operator's own share and others."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    texts = [r["text"] for r in small.orderBy("doc_id").limit(60).collect()]
    texts += [" ".join([*random.choices(VOCAB, k=9), edited(r["text"], 0.19), *random.choices(VOCAB, k=9)]) for r in items]
    codes = [cgk.hashing.split_words([t.encode()], letters=True)[0].tolist() for t in texts]
    for share in (0.0, 0.2, 0.3):
        index = cgk.build([(r["item_id"], r["text"]) for r in items], share)
        got = {(k, n): e for k, n, e, *_ in cgk._found(texts, index, share)}
        want = {(k, n): cgk.best_end(c.tolist(), t)[0] for k, t in enumerate(codes) for n, (_, c) in enumerate(index.items)}
        assert got == {(k, n): e for (k, n), e in want.items() if e <= int(share * len(index.items[n][1]))}


def test_spans_and_words():
    text = "Eh, é: The QUICK brown-fox\n jumped over; ÉTÉ lazy dogs again and again!"
    index = cgk.build([(1, "the quick brown fox jumped over été lazy dogs"), (2, None or ""), (3, "...")])
    (k, n, edits, a, b), = cgk._found([None, text], index, 0.2)
    assert (k, edits, text[a:b]) == (1, 0, "The QUICK brown-fox\n jumped over; ÉTÉ lazy dogs")


def test_blocks_and_awkward(spark, awkward, empty, monkeypatch):
    items = spark.createDataFrame([(1, "plain words here"), (1, "plain words here"), (2, None), (3, ""), (None, "of one long text many words")], "item_id long, text string")
    want = sorted(map(tuple, cgk.leaks(awkward, items).collect()), key=repr)
    assert {(r[0], r[1]) for r in want} == {(1, 1), (4, 1), (None, 1), (7, None)}
    monkeypatch.setattr(cgk, "ITEM_ROWS", 1)
    assert sorted(map(tuple, cgk.leaks(awkward, items).collect()), key=repr) == want
    kept = cgk.decontaminate(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == 6
    none = items.limit(0)
    assert cgk.leaks(awkward, none).count() == 0 and cgk.decontaminate(awkward, none).count() == 11
    assert cgk.leaks(empty, items).count() == 0


def test_walks_agree_on_equal_windows():
    codes = np.random.default_rng(1).integers(1, 1 << 60, 200, np.uint64)
    alone = {n: int(k[0]) for n, k in cgk.walk_keys(codes[40:80], np.zeros(1, np.int64), [16])}
    inside = {n: int(k[0]) for n, k in cgk.walk_keys(codes, np.array([40]), [16])}
    assert alone == inside
