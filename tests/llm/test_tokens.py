"""Tokens of whole texts, their attribution to sections, and packing, against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackspark.llm import attribution, packing, tokens

PATH = tokens.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "",
    "  ",
    "İstanbul Å été <|endoftext|> a\x1cb it's ΣΣ x y 12 中文 don't '' --'s",
    "É\x07\x7f¼½ ²a µ ª º ÀÉÎ ß 'S 'Ll x'RE " + "".join(map(chr, range(33, 256))),
    "á b c d " * 50,
]


def library_ids(text: str) -> bytes:
    return np.asarray(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_and_spans(small, monkeypatch):
    texts = [r["text"] for r in small.collect()] + ODD
    plain = [a for a, _ in tokens.WordTokens(PATH, False).encode(texts)]
    both = list(tokens.WordTokens(PATH, True).encode(texts))
    monkeypatch.setattr(tokens, "MAX_CACHED", 500)  # caches that overflow all the time
    tight = [a for a, _ in tokens.WordTokens(PATH, False).encode(texts)]
    tight_both = list(tokens.WordTokens(PATH, True).encode(texts))
    for text, a, (b, spans), c, (d, spans2) in zip(texts, plain, both, tight, tight_both, strict=True):
        e = LIBRARY.encode(text, add_special_tokens=False)
        assert a == b == c == d == np.asarray(e.ids, "<u4").tobytes()
        want = np.asarray(e.offsets, np.int64).reshape(-1, 2)
        assert np.array_equal(spans, want) and np.array_equal(spans2, want)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_brute_force(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.sort(rng.choice(61, rng.integers(2, 9), replace=False))
        spans = np.stack([cuts[:-1], cuts[1:]], 1)
        edges = np.sort(rng.choice(61, 2 * rng.integers(1, 5), replace=False)).reshape(-1, 2)
        got, crossing = attribution.attribute(spans, edges[:, 0], edges[:, 1], rule)
        want, cross = np.zeros(len(edges)), np.zeros(len(edges), int)
        for a, b in spans:
            over = [max(0, min(b, e) - max(a, s)) for s, e in edges]
            if max(over) == b - a:
                want[int(np.argmax(over))] += 1
                continue
            for k, o in enumerate(over):
                cross[k] += o > 0
                want[k] += o / (b - a) if rule == "split" else 0
            if rule == "majority" and max(over):
                want[int(np.argmax(over))] += 1
            if rule == "first":
                for k, (s, e) in enumerate(edges):
                    want[k] += s <= a < e
        assert np.allclose(got, want) and crossing.tolist() == cross.tolist()


def test_section_table(spark, awkward, empty):
    rows = attribution.count_tokens(awkward, width=7).collect()
    texts = {r["text"] or "" for r in awkward.collect()}
    totals = {len(library_ids(t)) // 4 for t in texts}
    docs = defaultdict(lambda: [0, 0])
    for r in rows:
        docs[r["doc_tokens"]][0] += r["n_tokens"]
    assert {r["doc_tokens"] for r in rows} == totals
    assert sum(r["section"] == 0 for r in rows) == 11
    # Every token has one section: the sums over the copies of a text are multiples of its tokens.
    assert all(v[0] % k == 0 if k else v[0] == 0 for k, v in docs.items())
    given = spark.createDataFrame([(1, 5, 0, 8), (1, 9, 8, 16), (3, 0, 0, 0), (99, 0, 0, 5), (2, None, 0, 3)], "doc_id long, section long, start long, end long")
    got = sorted(map(tuple, attribution.count_tokens(awkward, sections=given).collect()))
    assert [(g[0], g[1], g[4]) for g in got] == [(1, 5, 1.0), (1, 9, 2.0), (3, 0, 0.0)]
    assert attribution.count_tokens(empty).count() == 0


def check_pieces(rows, ids):
    """ids: the multiset of documents as bytes with the end id."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(b) // 4 for _, b in ids)
    by_id = defaultdict(set)
    for i, b in ids:
        by_id[i].add(b)
    for r in rows:
        assert any(zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and len(b) // 4 == r["doc_tokens"] for b in by_id[r["doc_id"]])
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_packing(small, awkward, empty):
    for df in (small, awkward):
        end = np.array([2], "<u4").tobytes()
        ids = [(r["doc_id"], library_ids(r["text"] or "") + end) for r in df.collect()]
        rows = packing.pack(df, window=20_000).collect()
        check_pieces(rows, ids)
    by_doc = defaultdict(list)
    for r in packing.pack(small).collect():
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
    for p in by_doc.values():
        at = 0
        for start, length in sorted(p):
            assert start == at
            at += length
    assert packing.pack(empty).count() == 0


def test_costs_are_balanced():
    """Better than first-fit by descending size, and full."""
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 3000).astype(int) + 1)
    n = int(lengths.sum()) // 4096
    cost = lambda parts: sum((b - a) + (b - a) ** 2 / 2048 for _, a, b in parts)
    packed = packing.balance(lengths, n, 4096)
    assert all(sum(b - a for _, a, b in p) == 4096 for p in packed)
    costs = np.array([cost(p) for p in packed])
    naive, room, at = [], 0, []
    for k in np.argsort(-lengths):
        if room < lengths[k]:
            naive.append([])
            room = 4096
        naive[-1].append((k, 0, lengths[k]))
        room -= lengths[k]
    assert costs.std() < np.std([cost(p) for p in naive])
    with pytest.raises(ValueError):
        packing.pack(None, size=1000)
