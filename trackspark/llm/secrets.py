"""Secret scan: named credentials, access keys, long hex, and strings a token vocabulary cannot shorten.

A public byte-pair vocabulary packs natural words, paths and identifiers into few tokens, but needs
a token for every one or two characters of a random string. Candidates are runs of key characters;
known digests, UUIDs and identifiers built from plain words and numbers are excluded first. In a run that is
shortened as a whole, a name or path may hide a secret, so its stretches are tried too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from trackspark.llm.common import map_rows, slices, texts

# The three base patterns, as the scan's contract gives them.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough

LEAST = 20  # characters of a random string
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PIECES = re.compile(r"[^A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z0-9]+(?:=+$)?")  # with the padding that ends a run
REPEATED = re.compile(r"(.{1,4}?)\1{3,}")
SHORT = 3  # plain pieces of random text seldom have more characters for each token
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
UUID_INSIDE = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])")
DIGEST_SIZES = frozenset({32, 40, 48, 56, 64, 96, 128})  # hex digits of the common digests
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
MAX_CHARS_PER_TOKEN = 2.0

_ENCODERS: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The vocabulary, loaded once in each Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def known(run: str) -> bool:
    """A digest or a UUID."""
    return bool(len(run) in DIGEST_SIZES and ALL_HEX.fullmatch(run) or UUID.fullmatch(run))


def plain(piece: str, enc, max_ratio: float) -> bool:
    """A number, or a word in one letter case or capitalised that the vocabulary shortens,
    or up to four such letters over and over.

    Words in capitals are asked for in small letters, which the vocabulary knows better; short words
    need be one token only.
    """
    if not piece.isalpha():
        return piece.isdigit()
    if not (piece.islower() or piece.isupper() or piece.istitle()):
        return False
    if REPEATED.fullmatch(piece):
        return True
    return any(n == 1 or len(piece) > max_ratio * n for n in (len(enc.encode_ordinary(p)) for p in dict.fromkeys((piece, piece.lower()))))


def excluded(run: str, enc, max_ratio: float = MAX_CHARS_PER_TOKEN) -> bool:
    """A digest, a UUID, or an identifier: every piece is plain."""
    return known(run) or all(plain(p, enc, max_ratio) for p in PIECES.split(run) if p)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def stretches(run: str, enc, max_ratio: float) -> list[tuple[int, int]]:
    """``(start, end)`` of the secrets inside a run that also holds a name, a path or other words.

    Of the stretches from piece to piece with enough characters and few of them for each token, the
    longest is taken, then the longest on either side of it. None begins or ends with a plain piece of
    over ``SHORT`` characters a token, reaches over a digest or UUID, or has plain pieces only.
    """
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*UUID_INSIDE.finditer(run), None]:
        pieces = [(at + w.start(), at + w.end()) for w in WORD.finditer(run[at : m.start() if m else len(run)])]
        at = m.end() if m else at
        group: list[tuple[int, int]] = []
        for a, e in pieces:
            if known(run[a:e]):
                out += _longest(run, group, enc, max_ratio)
                group = []
            else:
                group.append((a, e))
        out += _longest(run, group, enc, max_ratio)
    return sorted(out)


def _longest(run: str, pieces: list[tuple[int, int]], enc, max_ratio: float) -> list[tuple[int, int]]:
    if not pieces or pieces[-1][1] - pieces[0][0] < LEAST:
        return []
    odd = [not plain(run[a:e].rstrip("="), enc, max_ratio) for a, e in pieces]
    if not any(odd):
        return []
    # A stretch has few enough characters for each token if its gain from first to last piece is not negative.
    tokens = [len(enc.encode_ordinary(run[a:e])) for a, e in pieces]
    gaps = [len(enc.encode_ordinary(run[e:a])) for (_, e), (a, _) in zip(pieces, pieces[1:], strict=False)]
    before, after, gain = [], [], 0.0
    for k, (a, e) in enumerate(pieces):
        before.append(gain)
        gain += max_ratio * tokens[k] - (e - a)
        after.append(gain)
        if k < len(gaps):
            gain += max_ratio * gaps[k] - (pieces[k + 1][0] - e)
    edge = [o or e - a <= SHORT * n for o, n, (a, e) in zip(odd, tokens, pieces, strict=True)]
    seen = [0, *accumulate(odd)]

    def holds(i: int, k: int) -> bool:
        return pieces[k][1] - pieces[i][0] >= LEAST and after[k] >= before[i] and seen[k + 1] > seen[i]

    out, todo = [], [(0, len(pieces))]
    while todo:
        lo, hi = todo.pop()
        # Starts whose gain is a new low, in order; ends from the right: each start is met once.
        starts: list[int] = []
        for k in range(lo, hi):
            if edge[k] and (not starts or before[k] < before[starts[-1]]):
                starts.append(k)
        best = (0, 0, 0)
        for k in range(hi - 1, lo - 1, -1):
            if edge[k]:
                while starts and (starts[-1] > k or before[starts[-1]] <= after[k]):
                    i = starts.pop()
                    if i <= k and seen[k + 1] > seen[i]:
                        best = max(best, (pieces[k][1] - pieces[i][0], i, k))
        size, i, k = best
        if size >= LEAST:
            todo += [(lo, i), (k + 1, hi)]
            # Words between two secrets are not part of either.
            for words, at in groupby(range(i, k + 1), lambda n: not edge[n]):
                p, *_, q = [*at] * 2
                if words and pieces[q][1] - pieces[p][0] >= LEAST // 2 and holds(i, p - 1) and holds(q + 1, k):
                    todo += [(i, p), (q + 1, k + 1)]
                    break
            else:
                out.append((pieces[i][0], pieces[k][1]))
    return out


def random_spans(text: str, enc, max_ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Runs with few characters for each token, apart from what is excluded; else such stretches of a run."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if excluded(run, enc, max_ratio):
            continue
        if len(run) <= max_ratio * len(enc.encode_ordinary(run)):
            out.append((m.start(), 3, m.end()))
        else:
            out += [(m.start() + a, 3, m.start() + e) for a, e in stretches(run, enc, max_ratio)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64())]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())]
)
_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row for each input row, whole texts scanned; spans are code points, ends exclusive.

    A null or empty text has no spans (empty strings, zero counts); a null id stays null; repeated
    rows give repeated results; other columns are ignored; spans of two kinds at one start stand in
    the order of ``KINDS``; an empty table gives an empty table.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            out: dict[str, list] = {n: [] for n in _SCHEMA.names}
            out["doc_id"] = b["doc_id"]
            for text in b["text"]:
                base = base_spans(text)
                added = random_spans(text, enc, max_ratio)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted(base + added)))
                out["n_random"].append(len(added))
            yield out

    return map_rows(texts(df, id_col, text_col), run, _SCHEMA, _DDL)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", vocabulary: str | None = None, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The same rows and columns with every found span of ``text_col`` replaced by ``mark``.

    Overlapping or touching spans become one mark; a null text stays null.
    """
    path = vocabulary or default_vocabulary()
    at = df.columns.index(text_col)

    def run(batches):
        enc = encoder(path)
        for b in slices(batches):
            new = []
            for text in b.column(at).to_pylist():
                spans = merged(base_spans(text) + random_spans(text, enc, max_ratio)) if text else []
                cuts, done = [], 0
                for a, e in spans:
                    cuts += [text[done:a], mark]
                    done = e
                new.append("".join([*cuts, text[done:]]) if spans else text)
            kind = b.schema.field(at).type
            yield b.set_column(at, b.schema.field(at), pa.array(new, kind))

    return df.mapInArrow(run, df.schema)
