"""Grid cells against full search, the whole operator against plain Python, odd rows."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from trackspark.llm import vector_codes as vc

DDL = "vec_id long, embedding array<float>, label int, code string, v int"


def full(values, entries):
    d = ((values[:, None, :] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("width", [1, 2, 8, 20])
def test_cells_against_full_search(width):
    rng = np.random.default_rng(width)
    for spread in (3, 40, 5000, 1 << 23):
        entries = rng.integers(-spread, spread + 1, (16, width))
        entries[5] = entries[2]  # ties go to the lower index
        grid = vc.Grid(entries, most=300)  # small, so that the cache is emptied on the way
        for _ in range(4):
            values = rng.integers(-2 * spread, 2 * spread + 1, (500, width))
            values[:100] = values[0]
            code, error = grid.nearest(values)
            want, least = full(values, entries)
            assert (code == want).all() and (error == least).all()


def test_cache_is_used_and_prunes():
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (16, 2))
    grid = vc.Grid(entries)
    values = rng.integers(-1000, 1000, (5000, 2))
    grid.nearest(values)
    cells = len(grid.hashes)
    grid.nearest(values)
    assert len(grid.hashes) == cells < 200
    assert grid.open.mean() < 0.7


def test_cells_under_one_hash(monkeypatch):
    monkeypatch.setattr(vc, "_hash", lambda cells: np.zeros(len(cells), np.uint64))
    rng = np.random.default_rng(2)
    entries, values = rng.integers(-900, 900, (16, 8)), rng.integers(-900, 900, (400, 8))
    code, error = vc.Grid(entries).nearest(values)
    want, least = full(values, entries)
    assert (code == want).all() and (error == least).all()


def plain(rows):
    """``(id, code, error, label error)`` rows and the digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) if kept else 0
    width = dim // 8 if dim % 8 == 0 else 0
    usable = [width > 0 and len(r[1]) == dim and max(map(abs, r[1])) < vc.LARGEST for r in kept]
    q = [[[math.floor(Fraction(x) * 4096) for x in r[1]][p * width : (p + 1) * width] for p in range(8)] if u else None for r, u in zip(kept, usable)]
    books = [[list(v[p]) for v in q[:16] if v] for p in range(8)] if width else []

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p, book in enumerate(books):
            groups = {}
            for v in filter(None, q):
                groups.setdefault(nearest(v[p], book)[1], []).append(v[p])
            for k, vs in groups.items():
                book[k] = [sum(c) // len(vs) for c in zip(*vs)]
    out, totals = [], {}
    for r, v in zip(kept, q):
        found = [nearest(v[p], books[p]) for p in range(8)] if v else None
        error = sum(d for d, _ in found) if found else None
        out.append([r[0], "".join(f"{k:02x}" for _, k in found) if found else None, error, r[2]])
        if error is not None:
            totals[r[2]] = totals.get(r[2], 0) + error
    for o in out:
        total, most = totals.get(o[3]), max([x[2] for x in out if x[3] == o[3] and x[2] is not None], default=0)
        o.append(total if most < 1 << 63 and (total or 0) < 1 << 63 else None)
    out = [[i, code, e if e is None or e < 1 << 63 else None, total] for i, code, e, _, total in out]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(map(str, out)), digest


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(3)
    # What the table holds are 32-bit floats.
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = vc.compress(df).collect()
    want, digest = plain(stored)
    assert sorted(str([r["vec_id"], r["code"], r["error"], r["label_error"]]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_against_plain_python(spark):
    random.seed(7)
    rows = [(random.randrange(200), [random.gauss(0, 0.2) for _ in range(16)], random.choice([None, 1, 2])) for _ in range(150)]
    odd = [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [float("nan")] * 16, 1), (1003, [float("-inf")] * 16, None)]
    odd += [(1004, [0.5] * 8, 9), (1005, [], 1), (None, [0.25] * 16, 1), (1006, [-0.0] * 16, None), (1007, [1e25] * 16, 3), (1008, [3e9, -3e9] * 8, 4)]
    check(spark, rows + odd + rows[:20])
    check(spark, rows[:5] + rows[:5])


def test_odd_tables(spark):
    check(spark, [])
    check(spark, [(1, None, 1)])
    check(spark, [(1, [0.5] * 9, 1), (2, [0.5] * 8, None)])  # the first sets a length that cannot be cut
    check(spark, [(i, [1e9 * i] * 8, 1) for i in range(20)])


def test_query_against_sql(spark):
    import duckdb

    from trackspark.llm.queries import QUERIES

    fn, sql = QUERIES["op12_grid_cell_codes"]
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in fn(spark, "/root/testdata/sf0.001").collect()) == want
