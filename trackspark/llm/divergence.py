"""Source divergence audit: how far the word use of one source is from another's, in each language.

Identical texts of a language are collapsed before anything is counted. A task sends each text that it
meets once, and its copies as numbers by source; equal texts then stand side by side in a sorted partition,
are cut into terms once, and add their copies to the counts and document frequencies of every source.
Terms travel with the counts of all sources together, summed inside the task first.

Two sources are compared over all kept terms of the language, but only terms that one of them has are
evaluated: every other term gives the same value, which is multiplied. Terms that only one has depend
on their count alone and come from a histogram; terms that both have correct them.

Everything is integer arithmetic: p = 1 + floor(SCALE (count + 1) / (N + V)), f = floor((p-q)^2 / q).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.words import ragged
from trackspark.session import cut_lineage

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
#: Texts whose copies a task remembers, and (term, source) entries that it gathers, before they are sent on.
MOST_TEXTS, MOST_ENTRIES = 200_000, 2_000_000
#: Source pairs evaluated at once, and the side of the largest table of pairs kept in a task.
MOST_PAIRS, WIDE = 1_000_000, 1000
#: Fixed value: the terms of the contract, read in UTF-8 (every byte beyond ASCII belongs to a term).
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

_TEXTS = pa.schema([("h", pa.binary()), ("lang", pa.string()), ("sid", pa.int32()), ("copies", pa.int64()), ("text", pa.binary())])
_TERMS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("packed", pa.list_(pa.int64()))])
_USE = pa.struct([("sid", pa.int32()), ("n", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n_lang", pa.int64()), ("uses", pa.list_(_USE))])
_PAIRS = pa.schema([("lang", pa.string()), ("s", pa.int32()), ("t", pa.int32()), ("p", pa.int64()), ("n", pa.int64())])


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of the task once, without a source, and rows of copies without a text.

    Only after ``MOST_TEXTS`` numbers of copies is a text that comes again sent again.
    """
    copies: Counter = Counter()
    sent: set = set()

    def numbers() -> pa.RecordBatch:
        rows = list(zip(*((h, lang, sid, n, None) for (h, lang, sid), n in copies.items()), strict=True))
        return _batch(_TEXTS, rows)

    for b in batches:
        langs, sids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        digests = [hashlib.blake2b(memoryview(t.as_buffer() or b""), digest_size=20).digest() for t in texts]
        new = []
        for k, key in enumerate(zip(digests, langs, strict=True)):
            if key not in sent:
                sent.add(key)
                new.append(k)
        copies.update(zip(digests, langs, sids, strict=True))
        if new:
            some = texts.take(pa.array(new))
            none = pa.nulls(len(new), pa.int32()), pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in new], pa.binary()), pa.array([langs[k] for k in new], pa.string()), *none, some], schema=_TEXTS)
        if len(copies) > MOST_TEXTS:
            yield numbers()
            copies.clear()
            sent.clear()
    if copies:
        yield numbers()


class _Entries:
    """(term, source, count, documents) of a task, added up before they are sent."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple[str, bytes], int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, terms: Counter, copies: dict[int, int]) -> None:
        if not terms:
            return
        ids = self.ids
        at = np.array([ids.setdefault((lang, t), len(ids)) for t in terms], np.int64)
        n = np.fromiter(terms.values(), np.int64, len(terms))
        for sid, m in copies.items():
            self.parts.append(np.stack([at, np.full(len(at), sid), n * m, np.full(len(at), m)]))
            self.size += len(at)

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        at, sid, n, m = np.concatenate(self.parts, 1)
        order = np.lexsort((sid, at))
        at, sid = at[order], sid[order]
        first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(sid, prepend=-1) != 0))
        packed = np.stack([sid[first], np.add.reduceat(n[order], first), np.add.reduceat(m[order], first)], 1).ravel()
        ends = 3 * np.searchsorted(at[first], np.arange(len(self.ids) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(packed))
        langs, terms = zip(*self.ids, strict=True)
        whole = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.string()), lists], schema=_TERMS)
        for k in range(0, len(whole), 20_000):
            yield whole.slice(k, 20_000)
        self.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of text: each text is cut once, whatever number of sources and tasks sent it."""
    entries = _Entries()
    last, terms, copies = None, Counter(), {}
    for b in batches:
        keys, texts = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(4)
        for k, (key, sid, m) in enumerate(zip(keys, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            if key != last:
                if last is not None:
                    entries.add(last[1], terms, copies)
                    if entries.size > MOST_ENTRIES:
                        yield from entries.out()
                last, copies = key, {}
                terms = Counter(TERM.findall(texts[k].as_py().lower()))  # texts stand before numbers
            if m is not None:
                copies[sid] = copies.get(sid, 0) + m
    if last is not None:
        entries.add(last[1], terms, copies)
    yield from entries.out()


def _join_counts(least_docs: int):
    """For ``mapInArrow`` over rows in order of (lang, term): kept terms with the counts of their sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last term of the batch before, which may go on

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            lang, term, packed = (c.chunk(0) for c in rows.columns)
            group = np.cumsum(_changes(lang, term)) - 1
            sid, n, m = packed.flatten().to_numpy().reshape(-1, 3).T
            at = np.repeat(group, np.diff(packed.offsets.to_numpy()) // 3)
            order = np.lexsort((sid, at))
            at, sid = at[order], sid[order]
            first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(sid, prepend=-1) != 0))
            n, m = (np.add.reduceat(x[order], first) for x in (n, m))
            at, sid = at[first], sid[first]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            kept = np.add.reduceat(m, starts) >= least_docs
            sizes = np.diff(np.append(starts, len(at)))
            entry = np.repeat(kept, sizes)
            uses = pa.StructArray.from_arrays([pa.array(sid[entry], pa.int32()), pa.array(n[entry])], fields=list(_USE))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[kept])), pa.int32()), uses)
            place = pa.array(np.flatnonzero(_changes(lang, term))[kept])
            yield pa.RecordBatch.from_arrays([lang.take(place), term.take(place), pa.array(np.add.reduceat(n, starts)[kept]), lists], schema=_KEPT)

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows.cast(held.schema)])
            rows = rows.combine_chunks()
            cut = int(np.flatnonzero(_changes(rows.column(0).chunk(0), rows.column(1).chunk(0)))[-1])
            if cut:
                yield from out(rows.slice(0, cut))
            held = _summed(rows.slice(cut))
        if held is not None:
            yield from out(held)

    return run


def _changes(lang: pa.Array, term: pa.Array) -> np.ndarray:
    """Whether a row has another lang or term than the row before."""
    new = np.ones(len(lang), bool)
    for c in (lang, term):
        other = pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        new[1:] = other if c is lang else new[1:] | other
    return new


def _summed(rows: pa.Table) -> pa.Table:
    """The rows of one term as a single row, so that a frequent term is never held in many."""
    rows = rows.combine_chunks()
    if rows.num_rows < 2:
        return rows
    sid, n, m = rows.column(2).chunk(0).flatten().to_numpy().reshape(-1, 3).T
    kinds, place = np.unique(sid, return_inverse=True)
    total = np.zeros((2, len(kinds)), np.int64)
    np.add.at(total[0], place, n)
    np.add.at(total[1], place, m)
    packed = pa.array([np.stack([kinds, *total], 1).ravel()], rows.schema.field(2).type)
    return pa.table([rows.column(0)[:1], rows.column(1)[:1], packed], schema=rows.schema)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, n_lang, uses``: the kept terms with ``(sid, n)`` of each source that has them.

    ``docs``: lang, sid, text without nulls. A list has at most one entry for each source of the language,
    of which the report has a row for each pair.
    """
    rows = docs.select("lang", F.col("sid").cast("int"), F.col("text").cast("binary"))
    rows = rows.mapInArrow(_collapse, "h binary, lang string, sid int, copies long, text binary")
    rows = rows.repartition("h").sortWithinPartitions("h", "lang", F.col("text").isNull())
    terms = rows.mapInArrow(_count, "lang string, term string, packed array<long>")
    terms = terms.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return terms.mapInArrow(_join_counts(least_docs), "lang string, term string, n_lang long, uses array<struct<sid:int,n:long>>")


def _values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources share add to the value of the pair, and how many terms have each p.

    Rows ``(lang, s, t, null, sum)`` and ``(lang, s, null, p, terms)``. Sums are kept as a table of pairs
    for each language; with more than ``WIDE`` sources they leave the task stretch by stretch.
    """
    tables: dict[str, np.ndarray] = {}
    shares: dict[str, Counter] = {}

    def pair_rows(lang: str, s: np.ndarray, t: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return _batch(_PAIRS, [[lang] * len(s), s, t, pa.nulls(len(s), pa.int64()), value])

    def share_rows(lang: str) -> pa.RecordBatch:
        s, p = np.array(list(shares[lang]), np.int64).reshape(-1, 2).T
        return _batch(_PAIRS, [[lang] * len(s), s, pa.nulls(len(s), pa.int32()), p, list(shares[lang].values())])

    for b in batches:
        langs = b.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = b.column(1).take(pa.array(np.flatnonzero(langs.indices.to_numpy() == code)))
            size = np.diff(rows.offsets.to_numpy()).astype(np.int64)
            sid, p, p0 = (rows.flatten().field(c).to_numpy().astype(np.int64) for c in ("sid", "p", "p0"))
            known = shares.setdefault(lang, Counter())
            kinds, n = np.unique(np.stack([sid, p]), axis=1, return_counts=True)
            known.update(dict(zip(map(tuple, kinds.T.tolist()), n.tolist(), strict=True)))
            if len(known) > MOST_ENTRIES // 4:
                yield share_rows(lang)
                known.clear()
            # Each entry meets all entries of its term.
            first, count = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
            ends = np.cumsum(count)
            a = 0
            while a < len(sid):
                e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_PAIRS, "right")))
                i, j = np.repeat(np.arange(a, e), count[a:e]), ragged(first[a:e], count[a:e])
                a, other = e, sid[i] != sid[j]
                i, j = i[other], j[other]
                value = _values(p[i], p[j]) - _values(p[i], p0[j]) - _values(p0[i], p[j]) + _values(p0[i], p0[j])
                s, t = sid[i], sid[j]
                if not len(s):
                    continue
                side = int(max(s.max(), t.max())) + 1
                table = tables.get(lang)
                if side <= WIDE:
                    if table is None or len(table) < side:
                        old, tables[lang] = table, np.zeros((side, side), np.int64)
                        if old is not None:
                            tables[lang][: len(old), : len(old)] = old
                    np.add.at(tables[lang], (s, t), value)
                else:
                    keys, place = np.unique(s * side + t, return_inverse=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, place, value)
                    yield pair_rows(lang, keys // side, keys % side, total)
    for lang, table in tables.items():
        s, t = np.nonzero(table)
        yield pair_rows(lang, s, t, table[s, t])
    for lang in shares:
        if shares[lang]:
            yield share_rows(lang)


def share(n: Column | str, total: Column | str, v: Column | str) -> Column:
    """p of a count: a long; large counts are multiplied as decimals."""
    n, total, v = (F.col(c) if isinstance(c, str) else c for c in (n, total, v))
    large = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    quotient = F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * F.lit(SCALE), total + v))
    return F.lit(1) + quotient.otherwise(F.call_function("div", large, (total + v).cast("decimal(20,0)")))


def term_value(p: Column | str, q: Column | str) -> Column:
    """f: p and q are at most ``SCALE`` + 1, so the square fits a long."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(df: DataFrame, part: str, source: str) -> DataFrame:
    order = Window.partitionBy("lang", source).orderBy(F.desc("value"), "item")
    return df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order))


def divergence(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of a table with ``lang, source, text``.

    Part ``pair``: every other source of the language, by the sum of f over all kept terms. Part
    ``term``: the ``top`` terms that the source uses more than its language does. Nulls in the three
    columns are empty strings; a text without terms still makes its group occur; equal values rank by
    item; repeated rows count as often as they stand; a language with one source has no pairs and one
    without kept terms gives value 0; other columns are ignored; an empty table gives an empty table.
    """
    docs = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # One row for each source of a language, numbered from 0.
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    names = cut_lineage(docs.select("lang", "source").distinct().withColumn("sid", number), "sources")
    kept = cut_lineage(term_counts(docs.join(names, ["lang", "source"]), least_docs), "terms")

    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = kept.select("lang", F.inline("uses")).groupBy("lang", "sid").agg(F.sum("n").alias("total"))
    groups = names.join(totals, ["lang", "sid"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "v"])
    # p0 is the share of a term that the source does not have.
    p0 = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), "total", "v"))
    groups = cut_lineage(groups.withColumn("p0", p0), "groups")
    # Totals by number: one row a language, with an entry for each source.
    listed = F.array_sort(F.collect_list(F.struct("sid", "total", "p0"))).alias("totals")
    by_lang = groups.groupBy("lang").agg(listed, F.first("v").alias("v"), F.first("total_lang").alias("total_lang"))
    own = lambda x: F.get(F.col("totals"), x["sid"])
    entry = lambda x: F.struct(x["sid"].alias("sid"), share(x["n"], own(x)["total"], F.col("v")).alias("p"), own(x)["p0"].alias("p0"))
    used = kept.join(by_lang, "lang").select("lang", "term", F.transform("uses", entry).alias("uses"), share("n_lang", "total_lang", "v").alias("q"))

    above = used.select("lang", F.col("term").alias("item"), "q", F.inline("uses")).filter("p > q")
    terms = _ranked(above.select("lang", "sid", "item", term_value("p", "q").alias("value")), "term", "sid").filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms = terms.join(names, ["lang", "sid"]).select(*columns)

    a = groups.select("lang", F.col("sid").alias("s"), F.col("p0").alias("s0"), "v")
    b = groups.select("lang", F.col("sid").alias("t"), F.col("p0").alias("t0"))
    both = a.join(b, "lang").filter("s != t")

    def part(df: DataFrame, s: str, t: str, value: Column, times: str) -> DataFrame:
        return df.select("lang", F.col(s).alias("s"), F.col(t).alias("t"), (value.cast("decimal(20,0)") * F.col(times).cast("decimal(18,0)")).cast("decimal(38,0)").alias("value"))

    sums = cut_lineage(used.select("lang", "uses").mapInArrow(_pairs, "lang string, s int, t int, p long, n long"), "pairs")
    nothing = part(both, "s", "t", F.coalesce(term_value("s0", "t0"), F.lit(0).cast("long")), "v")
    by_share = sums.filter("p is not null").groupBy("lang", "s", "p").agg(F.sum("n").alias("m")).join(a.drop("v"), ["lang", "s"]).join(b, "lang").filter("s != t")
    mine = part(by_share, "s", "t", term_value("p", "t0") - term_value("s0", "t0"), "m")
    theirs = part(by_share, "t", "s", term_value("t0", "p") - term_value("t0", "s0"), "m")
    shared = sums.filter("p is null").select("lang", "s", "t", F.col("n").cast("decimal(38,0)").alias("value"))
    pairs = nothing.unionByName(mine).unionByName(theirs).unionByName(shared)
    pairs = pairs.groupBy("lang", "s", "t").agg(F.sum("value").cast("long").alias("value"))
    source = names.select("lang", F.col("sid").alias("s"), "source")
    item = names.select("lang", F.col("sid").alias("t"), F.col("source").alias("item"))
    return _ranked(pairs.join(source, ["lang", "s"]).join(item, ["lang", "t"]), "pair", "source").select(*columns).unionByName(terms)
