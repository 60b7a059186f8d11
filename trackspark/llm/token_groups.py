"""Exact n-gram Jaccard join by a token-group matrix.

A document's tokens are its distinct word shingles, hashed to 64 bits. Two documents link when
``den * intersection >= num * union``.

1. Equal token sets become one class; its smallest document stands for it.
2. Tokens have one global order, rare ones first (frequencies from 2**18 counters over all documents).
   A set of n tokens can only link to sets that share one of its first ``n - ceil(t n) + 1`` tokens.
3. Classes that share such a token are dealt into groups: by the most shared one, and groups of more
   than ``GROUP`` at random into parts. A part also gets the group's few anchors, so parts of one
   family of near copies connect through them.
4. Inside a part, classes are linked one after the other: each found component keeps the union of its
   tokens, and only components whose union can hold enough of the new class's tokens are opened.
5. Across parts, the token-group matrix (prefix token, part, components, sizes and places in it) names
   the parts each class must still query: those where enough tokens can follow a first common one.
   Parts that lie in the class's own component as a whole are left out.
   There, again, only components whose union qualifies are opened.

No pair of documents becomes a row before its link is proven, and each class sends a link for each
component it touches, not for each partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm import hashing
from trackspark.llm.common import slices, texts
from trackspark.llm.components import components
from trackspark.session import cut_lineage

SHINGLE, NUM, DEN = 3, 90, 100
COUNTERS = 1 << 18
GROUP = 256
ANCHORS = 4


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: lower-cased A-Z, words between ASCII white space."""
    h = hashing.split_words([text.encode()])[0]
    if not len(h):
        return h
    if len(h) < size:
        whole = hashing.mix(np.full(1, len(h), np.uint64))
        for k in range(len(h)):
            whole = hashing.pair(whole, h[k : k + 1])
        return whole
    n = len(h) - size + 1
    s = h[:n]
    for k in range(1, size):
        s = hashing.pair(s, h[k : k + n])
    return np.unique(hashing.mix(s))


def needed(n: int, num: int, den: int) -> int:
    """Tokens that any partner of a set of n tokens shares with it."""
    return -(-num * n // den)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = common(a, b)
    return den * both >= num * (len(a) + len(b) - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def _counted(size: int):
    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                s = shingles(text, size)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["counter", "n"])

    return run


def token_counters(docs: DataFrame, size: int) -> np.ndarray:
    """How often the tokens of each counter occur in all documents: 2**18 numbers at any size."""
    rows = docs.mapInArrow(_counted(size), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(COUNTERS, np.int64)
    for r in rows:
        out[r["counter"]] = r["n"]
    return out


_SETS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("prefix", pa.list_(pa.int64()))])
_SETS_DDL = "doc_id long, text_key long, n long, h1 long, h2 long, prefix array<long>"


def _sets(size: int, num: int, den: int, counters):
    """Each document's set size, 128-bit set hash and prefix in token order."""

    def run(batches):
        freq = counters.value
        for b in slices(batches):
            out: list[list] = [[], [], [], []]
            for text in b.column("text").to_pylist():
                s = shingles(text, size)
                n = len(s)
                order = np.lexsort((s, freq[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))[: n - needed(n, num, den) + 1] if n else []
                for o, v in zip(out, (n, np.bitwise_xor.reduce(hashing.mix(s)), np.add.reduce(hashing.mix(~s)), s[order].view(np.int64)), strict=True):
                    o.append(v)
            h1, h2 = (np.array(o, np.uint64).view(np.int64) for o in out[1:3])
            columns = [b.column("doc_id"), b.column("text_key"), out[0], h1, h2, out[3]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _SETS.types, strict=True)], schema=_SETS)

    return run


class Part:
    """Members of one part in components, each with the union of its tokens."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.groups: list[dict] = []

    def touching(self, s: np.ndarray, skip: int | None = None) -> Iterator[dict]:
        """Components with a member that links to ``s``; ``skip``: a label that need not be opened."""
        need = needed(len(s), self.num, self.den)
        for g in self.groups:
            if skip is not None and g["label"] == skip or common(s, g["union"]) < need:
                continue
            if any(linked(s, m, self.num, self.den) for m in g["sets"]):
                yield g

    def add(self, label: int, s: np.ndarray, found: list[dict]) -> None:
        """``found`` components and the new member become one."""
        g = {"label": label, "union": s, "sets": [s]}
        for old in found:
            g["union"] = np.union1d(g["union"], old["union"])
            g["sets"] += old["sets"]
            self.groups.remove(old)
        self.groups.append(g)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they travel between the steps."""
    zip_ = zstandard.ZstdCompressor(level=1).compress
    for b in slices(batches):
        packed = pa.array([zip_(t.as_py().encode()) for t in b.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), packed], names=["doc_id", "text_key", "packed"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows with the text, their last column, opened."""
    unzip = zstandard.ZstdDecompressor().decompress
    for b in slices(batches):
        for *row, packed in zip(*b.columns, strict=True):
            yield *(x.as_py() for x in row), unzip(packed.as_py()).decode()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def _inside(size: int, num: int, den: int):
    """Rows (home, sub, rep, text) in that order to links within each part."""

    def run(batches):
        now, part, pairs = None, Part(num, den), []
        for home, sub, rep, text in _by_part(batches):
            if (home, sub) != now:
                now, part = (home, sub), Part(num, den)
            s = shingles(text, size)
            found = list(part.touching(s))
            pairs += [(rep, g["label"]) for g in found]
            part.add(found[0]["label"] if found else rep, s, found)
            if len(pairs) >= 10_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return run


def _across(size: int, num: int, den: int):
    """Rows (home, sub, query, rep, component, text), members before queries, to links between parts."""

    def run(batches):
        now, part, pairs = None, Part(num, den), []
        for home, sub, query, rep, component, text in _by_part(batches):
            if (home, sub) != now:
                now, part = (home, sub), Part(num, den)
            s = shingles(text, size)
            if query:
                pairs += [(rep, g["label"]) for g in part.touching(s, component)]
            else:
                part.add(component, s, [g for g in part.groups if g["label"] == component])
            if len(pairs) >= 10_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return run


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``component``; a class without links is its own."""
    return rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: the smallest id reachable by links.

    A text with fewer words than a shingle is one shingle; a null or empty text, or one of white
    space, has none and links with nothing. Rows with one id are one document for its links (each
    with its own set size); equal rows give equal results; a null id has a null component and links
    with nothing; other columns are ignored; an empty table gives an empty table. Sets are compared by
    64-bit hashes of shingles and 128-bit hashes of sets.
    """
    spark = df.sparkSession
    docs = texts(df, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    counters = spark.sparkContext.broadcast(token_counters(docs, size))
    sets = cut_lineage(docs.mapInArrow(_sets(size, num, den, counters), _SETS_DDL), "sets")

    known = sets.filter("doc_id is not null and n > 0")
    classes = known.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.first("prefix").alias("prefix"))
    classes = cut_lineage(classes.select("n", "h1", "h2", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("text_key"), "prefix"), "classes")
    rep_of = known.select("doc_id", "n", "h1", "h2").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).select("doc_id", "rep")
    rep_of = cut_lineage(rep_of, "reps")
    # An id with several texts stands in several classes, which it connects.
    first = rep_of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("m")).filter("m > b").select("doc_id", "b")
    same_id = rep_of.join(first, "doc_id").select(F.col("rep").alias("a"), "b")

    # Prefix tokens that classes share; a class without one has no links.
    prefix = classes.select("rep", "text_key", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = prefix.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    prefix = cut_lineage(prefix.join(shared, "token"), "prefix")
    # The most shared one of its tokens is home to a class: a family of near copies meets there.
    homes = prefix.groupBy("rep", "text_key").agg(F.max_by("token", F.struct("m", "token")).alias("home"))
    anchor = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "text_key")) for k in range(ANCHORS)]
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"), F.array(*anchor).alias("anchors"))
    placed = homes.join(sizes.select("home", "parts"), "home").withColumn("sub", F.pmod(F.xxhash64("rep", "text_key"), "parts").cast("int"))
    placed = cut_lineage(placed.select("rep", "text_key", "home", "sub", "parts"), "parts")
    anchors = sizes.filter("parts > 1").select("home", "parts", F.explode("anchors").alias("x"))
    anchors = anchors.select(F.col("x.rep").alias("rep"), F.col("x.text_key").alias("text_key"), "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"))
    members = placed.select("rep", "text_key", "home", "sub").unionByName(anchors).distinct()

    # The texts of these classes only; one shuffle of the documents.
    wanted = placed.select(F.col("rep").alias("doc_id"), "text_key")
    packed = docs.filter("doc_id is not null").mapInArrow(_packed, "doc_id long, text_key long, packed binary")
    own = packed.join(wanted, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).withColumnRenamed("doc_id", "rep")
    own = cut_lineage(own, "class-texts")

    rows = members.join(own, ["rep", "text_key"]).select("home", "sub", "rep", "packed")
    inside = rows.repartition("home", "sub").sortWithinPartitions("home", "sub", "rep").mapInArrow(_inside(size, num, den), "a long, b long")
    inside = cut_lineage(inside.unionByName(same_id), "links-inside")
    found = components(inside)

    # The token-group matrix, without tokens whose classes all lie in one part or one component.
    cells = _labelled(prefix.select("rep", "text_key", "n", "pos", "token").join(placed, ["rep", "text_key"]), found)
    group = F.struct("home", "sub")
    open_tokens = cells.groupBy("token").agg(F.min(group).alias("g0"), F.max(group).alias("g1"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    cells = cut_lineage(cells.join(open_tokens.filter("g0 < g1 and c0 < c1").select("token"), "token"), "cells")
    # Of a pair's first common token, at places i and j of sets of n and m tokens, all common ones come
    # from there on: n - i and m - j must reach num / (num + den) * (n + m).
    reach = F.max(den * F.col("n") - (num + den) * F.col("pos")).alias("reach")
    matrix = cells.groupBy("token", "home", "sub").agg(*[f(c).alias(f"{name}_{c}") for c in ("component", "n") for name, f in (("min", F.min), ("max", F.max))], reach)
    q, m = cells.alias("q"), matrix.alias("m")
    ask = q.join(
        m,
        (F.col("q.token") == F.col("m.token"))
        & (F.struct("q.home", "q.sub") < F.struct("m.home", "m.sub"))
        & ~((F.col("min_component") == F.col("max_component")) & (F.col("min_component") == F.col("q.component")))
        & (F.col("q.n") * num <= F.col("max_n") * den)
        & ((F.col("q.n") + F.col("min_n")) * num <= (F.col("q.n") - F.col("q.pos")) * (num + den))
        & (F.col("q.n") * num <= F.col("reach"))
        & (F.col("min_n") * num <= F.col("q.n") * den),
    ).select("m.home", "m.sub", "q.rep", "q.text_key", "q.component")
    ask = cut_lineage(ask.distinct(), "asks")
    asked = ask.select("home", "sub").distinct()
    answering = _labelled(placed.join(asked, ["home", "sub"]).select("rep", "text_key", "home", "sub"), found)
    both = answering.withColumn("query", F.lit(False)).unionByName(ask.withColumn("query", F.lit(True)))
    rows = both.join(own, ["rep", "text_key"]).select("home", "sub", "query", "rep", "component", "packed")
    across = rows.repartition("home", "sub").sortWithinPartitions("home", "sub", "query", "rep").mapInArrow(_across(size, num, den), "a long, b long")
    across = cut_lineage(across, "links-across")
    found = components(inside.unionByName(across))

    label = _labelled(rep_of, found).groupBy("doc_id").agg(F.min("component").alias("component"))
    return sets.select("doc_id", "n").join(label, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row, with its columns, of each component: of the smallest id the row whose text has the least hash.

    Of equal rows one stays; rows with a null id all stay.
    """
    found = near_duplicates(df, id_col, text_col, size, num, den)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = df.join(gone, df[id_col] == gone["__gone"], "left_anti")
    # Only ids that stand in several rows need a choice; the others are not shuffled with their texts.
    many = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__many")).count().filter("count > 1").select("__many")
    single = left.join(many, left[id_col] == many["__many"], "left_anti")
    again = left.join(many, left[id_col] == many["__many"], "left_semi")
    row = F.struct(F.xxhash64(text_col).alias("__hash"), F.struct(*[F.col(c) for c in df.columns]).alias("__row"))
    chosen = again.groupBy(F.col(id_col).alias("__id")).agg(F.min(row).alias("__least"))
    return single.unionByName(chosen.select("__least.__row.*").select(*df.columns))
