"""The audit against plain Python over odd rows, hot texts and every small group."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from trackspark.llm import divergence

DDL = "doc_id long, text string, lang string, source string, term string, n long, value string"


def plain(rows, least=3, top=200):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower))
        groups.add((lang, source))
        docs.update((lang, t) for t in found)
        counts[lang, source].update(found)
        counts[lang, None].update(found)
    out = []
    for lang, s in sorted(groups):
        kept = sorted(t for la, t in docs if la == lang and docs[la, t] >= least)
        v = len(kept)

        def p(source):
            n = {t: counts[lang, source][t] for t in kept}
            return {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + v) for t in kept}

        mine, whole = p(s), p(None)
        pairs = []
        for t in sorted(x for la, x in groups if la == lang and x != s):
            q = p(t)
            pairs.append((-sum((mine[x] - q[x]) ** 2 // q[x] for x in kept), t.encode(), t))
        terms = [(-((mine[x] - whole[x]) ** 2 // whole[x]), x.encode(), x) for x in kept if counts[lang, s][x] and mine[x] > whole[x]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(k, *r, "x", 1, "y") for k, r in enumerate(rows)], DDL).repartition(4)
    got = divergence.divergence(df, **kw)
    assert sorted(map(tuple, got.collect())) == plain(rows, **({"least": kw["least_docs"]} if "least_docs" in kw else {}))
    return got


def made(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" for k in range(30)] + ["É", "é", "straße", "don't", "A-B", "\x1c", "中文", "1", "_"]
    return [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de"]), rng.choice("ABCD")) for _ in range(n)]


def test_against_plain_python(spark):
    odd = [(None, "en", "A"), ("", "en", "Z"), ("word word", None, None), ("123 ...", "fr", "only"), ("one two", "es", "S"), ("é É Word wORD", "en", "É")]
    check(spark, made(120) + odd + made(120)[:40])
    check(spark, made(30, 2), least_docs=1)
    check(spark, [("zz a zz", "en", s) for s in "ABC"])
    check(spark, [(None, None, None)])
    check(spark, [])


def test_hot_text_is_sent_and_cut_once(spark, monkeypatch):
    rows = [("the hot text again and again", "en", "AB"[k % 2]) for k in range(2000)] + made(60)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "sid": pa.array([0, 1, 0, 0], pa.int32()), "text": [b"x y", b"x y", b"z", b"x y"]})
    out = [r for b in divergence._collapse(iter([batch, batch])) for r in b.to_pylist()]
    assert [r["text"] for r in out if r["text"]] == [b"x y", b"z"]
    assert sorted((r["sid"], r["copies"]) for r in out if not r["text"]) == [(0, 2), (0, 4), (1, 2)]
    check(spark, rows)


def test_counts_leave_in_many_pieces(spark):
    rows = made(60) + [("the hot text again and again", "en", "AB"[k % 2]) for k in range(200)]
    texts = sorted({(t.encode(), la) for t, la, _ in rows})
    batches = [pa.RecordBatch.from_pylist([{"h": t[:20], "lang": la, "sid": 0, "copies": None, "text": t}, {"h": t[:20], "lang": la, "sid": 3, "copies": 2, "text": None}], divergence._TEXTS) for t, la in texts]
    whole = pa.Table.from_batches(list(divergence._count(iter(batches))))
    most, divergence.MOST_ENTRIES = divergence.MOST_ENTRIES, 5
    try:
        pieces = pa.Table.from_batches(list(divergence._count(iter(batches))))
    finally:
        divergence.MOST_ENTRIES = most
    assert len(pieces) > len(whole)

    def joined(table, size):
        rows = table.sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks().to_batches(max_chunksize=size)
        return [r for b in divergence._join_counts(3)(iter(rows)) for r in b.to_pylist()]

    want = joined(whole, 10_000)
    assert want and want == joined(pieces, 10_000) == joined(pieces, 1) == joined(pieces, 7)


def test_many_sources(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("abcdefgh", k=12)), "en", f"s{k % 40}") for k in range(200)]
    check(spark, rows)
    used = [[{"sid": s, "p": 5 + s * k, "p0": 2 + s} for s in range(0, 40, k)] for k in range(1, 9)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 8, "uses": used})

    def sums():
        total = Counter()
        for b in divergence._pairs(iter([batch, batch])):
            for r in b.to_pylist():
                total[r["s"], r["t"], r["p"]] += r["n"]
        return {k: v for k, v in total.items() if v}

    want = sums()
    monkeypatch.setattr(divergence, "WIDE", 3)
    monkeypatch.setattr(divergence, "MOST_PAIRS", 50)
    assert want == sums()


def test_equal_values_rank_by_bytes(spark):
    rows = [(f"same {w}", "en", s) for s in ("b", "a", "ä", "B") for w in ("x", "y", "z") for _ in range(3)]
    ranked = [r["item"] for r in check(spark, rows).filter("part = 'pair' and source = 'b'").orderBy("rank").collect()]
    assert ranked == ["B", "a", "ä"]
