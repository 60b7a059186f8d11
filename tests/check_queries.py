"""Compare registered queries with their SQL twins: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

import __spark_entry__ as entry
from trackspark.session import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return "~"
        if isinstance(v, float) or type(v).__name__ in ("float64", "float32"):
            f = float(v) + 0.0
            return str(int(f)) if f == f // 1 and abs(f) < 1e15 else repr(f)
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf[cols].itertuples(index=False))


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    t0 = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    dt = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"unchecked, {len(got)} rows {dt:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return len(a) > 0, f"{len(a)} rows {dt:.1f}s"
    sa, sb = set(a), set(b)
    cols = sorted(got.columns)
    ours, theirs = sorted(sa - sb), sorted(sb - sa)
    lines = [f"{len(a)} vs {len(b)} rows, {len(ours)} / {len(theirs)} differ"]
    for x, y in list(zip(ours, theirs))[:4]:
        lines.append("  " + str([(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:12]))
    return False, "\n".join(lines)


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    names = sys.argv[2:] or list(entry.queries())
    session = get_session()
    con = connect(sf_dir)
    bad = unchecked = 0
    for n in names:
        try:
            ok, note = compare(session, con, sf_dir, n)
        except Exception as exc:  # keep going: this is a report
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        unchecked += note.startswith("unchecked")
        print(("ok  " if ok else "FAIL"), n, note, flush=True)
    print(f"{len(names) - bad - unchecked}/{len(names)} match, {unchecked} have no SQL twin")
    sys.exit(bool(bad))
