"""The Jaccard join against brute force over all shingles."""

import random
import re

import pytest

from trackspark.llm import components, token_groups


def brute(rows, n=3, num=90):
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    inverted = {}
    for i, (d, _) in enumerate(rows):
        if d is None:
            continue
        both = {}
        for t in sets[i]:
            for j in inverted.get(t, ()):
                both[j] = both.get(j, 0) + 1
            inverted.setdefault(t, []).append(i)
        for j, k in both.items():
            if 100 * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(d), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((d, len(sets[i]), None if d is None else root(d)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("size", "num", "group"), [(3, 90, 8), (5, 80, 256)])
def test_families(spark, small, monkeypatch, size, num, group):
    """A family of near copies over several parts, chains, one-word texts, ids that repeat."""
    monkeypatch.setattr(token_groups, "GROUP", group)
    random.seed(3)
    rows = [(r["doc_id"], r["text"]) for r in small.collect()][:120]
    base = rows[3][1].split()
    for i in range(120):
        w = list(base)
        for _ in range(random.randint(0, 12)):
            w[random.randrange(len(w))] = f"zz{random.randint(0, 30)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(None, rows[0][1]), (5, rows[9][1]), (5, rows[9][1]), (6, None), (2000, "a"), (2001, "A  "), (2002, "a b"), (2003, " \t")]
    rows += [(2004, "a\xa0b c d e"), (2005, "A\xa0B c d e"), (2006, "É f g h"), (2007, "é f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, token_groups.near_duplicates(df, size=size, num=num).collect()), key=repr) == brute(rows, size, num)


def test_awkward(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, token_groups.near_duplicates(awkward).collect()), key=repr) == brute(rows)
    assert token_groups.near_duplicates(empty).count() == 0
    kept = token_groups.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_one_of_repeated_rows(spark):
    long = "many words of one long text that is repeated here"
    rows = [(1, long, "a"), (1, long, "a"), (1, long, "b"), (2, long, "c"), (3, "another text of its own words", "d"), (3, "third text under the same id again", "e"), (4, None, "f"), (4, None, "f"), (None, long, "g"), (None, long, "g"), (5, "single row with its words", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for n in (1, 3) for r in token_groups.one_of_each(df.repartition(n)).collect()]
    assert sorted(r[0] or 0 for r in kept) == sorted([0, 0, 1, 3, 4, 5] * 2)
    assert len(set(kept)) == 5 and set(kept) <= set(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (9, 5), (9, 9), (3, 5), (7, 8)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 5: 3, 9: 3, 8: 7}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
