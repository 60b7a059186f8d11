"""Token counts of the sections of documents, from one encoding of the whole document.

A section's count is not the count of its text alone: the document is encoded once, each token's
character span is joined to the sections' intervals, and a token that crosses a border is given to
one section by the chosen rule:

* ``majority`` - the section with most of its characters, the earlier one on a tie;
* ``first``    - the section that holds its first character;
* ``split``    - to each section by its share of the characters (counts are then fractions).

Characters outside every section count for nothing; a token that lies outside all sections, wholly,
belongs to none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import map_rows, texts
from trackspark.llm.tokens import default_tokenizer, word_tokens

SECTION_CHARS = 1000
RULES = ("majority", "first", "split")


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross its border.

    ``starts``/``ends``: disjoint sections in ascending order. Spans ascend too, so a sorted search
    gives the first and last section of each token; only crossing tokens are looked at again.
    """
    n = len(starts)
    tokens, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(spans):
        return tokens, crossing
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    lo = np.searchsorted(ends, a, "right")  # the first section that ends after the token's start
    hi = np.searchsorted(starts, b, "left") - 1  # the last one that starts before its end
    inside = (lo == hi) & (a >= starts[np.minimum(lo, n - 1)]) & (b <= ends[np.minimum(lo, n - 1)])
    tokens += np.bincount(lo[inside], minlength=n)
    for k in np.flatnonzero(~inside & (lo <= hi)):
        s = np.arange(lo[k], hi[k] + 1)
        share = np.minimum(ends[s], b[k]) - np.maximum(starts[s], a[k])
        crossing[s] += 1
        if rule == "split":
            tokens[s] += share / (b[k] - a[k])
        elif rule == "majority":
            tokens[s[np.argmax(share)]] += 1
        elif starts[s[0]] <= a[k]:
            tokens[s[0]] += 1
    return tokens, crossing


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
    + [("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())]
)
_DDL = "doc_id long, section long, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def sections_of(text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their newline, cut every ``width`` characters; an empty text is one empty section."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    cuts = np.unique(np.concatenate([[0, len(c)], np.flatnonzero(c == 10) + 1]))
    parts = [np.arange(a, b, width) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    starts = np.concatenate(parts) if parts else np.zeros(1, np.int64)
    return starts, np.append(starts[1:], len(c))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: DataFrame | None = None, rule: str = "majority", width: int = SECTION_CHARS, tokenizer: str | None = None) -> DataFrame:
    """A row for each section of each document, with the document's own token count beside it.

    ``sections``: ``doc_id, section, start, end`` (code points, disjoint inside a document); without
    it the sections are the lines of the text, long lines cut every ``width`` characters. Given
    sections are joined by id: documents without one give no row, sections without a document
    neither, sections with a null in them are ignored, repeated documents repeat their rows. A null
    text is empty; an empty text has one empty section with no tokens (or its given ones); null ids
    stay null and match no given section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_tokenizer()
    docs = texts(df, id_col, text_col)
    if sections is not None:
        spans = sections.select("doc_id", F.struct("start", "end", "section").alias("s")).dropna()
        spans = spans.filter("s.start is not null and s.end is not null and s.section is not null")
        per_doc = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("given"))  # a document's own
        docs = docs.join(per_doc, "doc_id")

    def run(batches):
        enc = word_tokens(path, spans=True)
        for b in batches:
            parts: list[tuple] = []
            for k, (text, (_, spans)) in enumerate(zip(b["text"], enc.encode(b["text"]), strict=True)):
                if "given" in b:
                    g = b["given"][k]
                    names = [s["section"] for s in g]
                    starts, ends = (np.array([s[c] for s in g], np.int64) for c in ("start", "end"))
                else:
                    starts, ends = sections_of(text, width)
                    names = np.arange(len(starts))
                tokens, crossing = attribute(spans, starts, ends, rule)
                parts.append(([b["doc_id"][k]] * len(starts), names, starts, ends, tokens, crossing, np.full(len(starts), len(spans))))
            ids, *rest = zip(*parts, strict=True)
            yield dict(zip(_SCHEMA.names, [[i for x in ids for i in x], *map(np.concatenate, rest)], strict=True))

    return map_rows(docs, run, _SCHEMA, _DDL)
