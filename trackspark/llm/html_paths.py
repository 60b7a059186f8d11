"""Main text of HTML pages by tag-path ratios.

A page becomes a list of blocks (text between block-level tags), each with its path of block tags
from the root. Text length and punctuation are summed for every path and divided by the path's
blocks; both ratios are smoothed over the page's order of blocks, fused as a product, and the paths
above a share of the weighted mean are content paths. The article is an ``article`` or ``main`` around
most of their text, or else the deepest element that holds most of it, widened on both sides to all
content blocks and to the headings and paragraphs beside it. Its blocks are the result, less what tags,
roles or class names mark as boilerplate and, but in an ``article``, less menus of links. An element that only its class, id or ``form``
marks is no boilerplate if it holds most of the page's content text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import map_rows

# Element kinds of HTML.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|select|object|xmp|canvas|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var br wbr img".split()
)
SKIPPED = frozenset("nav footer aside form button dialog menu head datalist optgroup option fieldset legend input map embed frameset frame".split())
# A start tag here ends an open element of the second set, up to the nearest of the third.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"])}
CLOSES |= {"tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
CLOSES |= {t: frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"]) for t in ("thead", "tbody", "tfoot")}
SCOPE = frozenset("html body article section main div table ul ol dl blockquote header footer nav aside form td th figure".split())
NOTED = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs comment comments disqus respond footer newsletter subscribe subscription popup modal overlay social share sharing related "
    "recommended login signin signup toolbar masthead pagination pager tags widget skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr blockquote figcaption caption center address".split())
ROOTS = frozenset("html body main article".split())

_NODE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?…、。，！？¿¡]")
SHARE = 0.5  # a content path's score against the text-weighted mean score
HELD = 0.8  # the article's core holds this much of the content paths' text
LINKS = 0.6  # a path with more link text than this and no punctuation is a menu
MOST, NEARLY_ALL = 0.5, 0.9  # of the content text: in a wrapper of a compound name or a form; in one that a whole name marks
WRAPPERS = frozenset(["form", "fieldset"])
NEGATED = frozenset("no not non with without has have hide hidden".split())  # the names after these are those of other elements
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def noted(token: str) -> float:
    """Of a class or id: 0 if it marks no boilerplate, else the share of the content text from which its element stays."""
    if token in NOTED:
        return NEARLY_ALL
    words = _WORDS.findall(token)
    if any(w in NOTED and NEGATED.isdisjoint(words[:k]) for k, w in enumerate(words)):
        return MOST
    return 0.0


def boilerplate(tag: str, attrs: str, in_article: bool) -> float:
    """Whether an element and all below it are left out, by what its own tag says: 0 if not.

    Else the share of the page's content text from which it stays after all; over 1 if it never does.
    """
    if tag in SKIPPED and tag not in WRAPPERS or tag == "header" and not in_article:
        return 2.0
    share = MOST if tag in WRAPPERS else 0.0
    if not attrs or tag in ROOTS:
        return share
    for name, a, b, c in _MARKS.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return 2.0
        if name == "role" and value in ROLES:
            share = max(share, MOST if tag == "form" and value == "form" else 2.0)
        if name in ("class", "id"):
            share = max([share, *map(noted, value.split())])
            if value in ("header", "site-header", "page-header", "top-header"):
                share = max(share, NEARLY_ALL)
    return share


def blocks(page: str, kept: frozenset[int] = frozenset(), dropped: dict[int, list[float]] | None = None) -> list[tuple[tuple[int, ...], tuple[str, ...], str, int]]:
    """``(element numbers, path, text, link characters)`` of each block, in page order.

    The elements ``kept`` stay whatever their tags say. Of what is left out for itself and not within
    another, ``dropped`` gets by element number the share from which it stays and its raw characters.
    """
    out: list[tuple] = []
    stack: list[tuple[str, int, str, bool]] = []  # tag, element number, name in paths, inline
    skip = links = in_article = 0
    words: list[str] = []
    linked: list[str] = []
    count = open_drop = 0

    def flush() -> None:
        nonlocal words, linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                own = [s for s in stack if not s[3]]
                out.append((tuple(s[1] for s in own), tuple(s[2] for s in own), text, len(" ".join(html.unescape("".join(linked)).split()))))
            words, linked = [], []

    def close(at: int) -> None:
        nonlocal skip, links, in_article
        if any(not s[3] for s in stack[at:]):
            flush()
        for tag, n, _, _ in stack[at:]:
            skip -= n < 0
            links -= tag == "a"
            in_article -= tag in ("article", "main")
        del stack[at:]

    at = 0
    for m in _NODE.finditer(page):
        if skip and dropped is not None and open_drop in dropped:
            dropped[open_drop][1] += m.start() - at
        if m.start() > at and not skip:
            words.append(page[at : m.start()])
            if links:
                linked.append(words[-1])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["cdata"] and not skip:
                words.append(m["cdata"])
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr" and m["end"]:
            words.append(" ")
        elif m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and not stack[k][3]:
                    break
        else:
            ends = CLOSES.get(tag)
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in SCOPE and not (tag in ("td", "th", "tr") and stack[k][0] in ends):
                        break
            if tag in VOID:
                if tag not in INLINE:
                    flush()
                continue
            inline = tag in INLINE
            if not inline:
                flush()
            count += 1
            share = boilerplate(tag, m["attrs"] or "", bool(in_article))
            drop = share > 0 and count not in kept
            if drop and not skip:
                open_drop = count
                if dropped is not None and share <= 1:
                    dropped[count] = [share, 0]
            if drop and inline:
                words.append(" ")
            stack.append((tag, -count if drop else count, tag, inline))
            skip += drop
            links += tag == "a"
            in_article += tag in ("article", "main")
    if at < len(page) and not skip:
        words.append(page[at:])
    flush()
    return out


def smooth(x: np.ndarray) -> np.ndarray:
    """A short Gaussian over neighbouring blocks, weights renormalised at the ends."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    return np.convolve(x, kernel)[2:-2] / np.convolve(np.ones(len(x)), kernel)[2:-2]


def container(found: list[tuple], weight: np.ndarray) -> tuple[tuple, tuple]:
    """``(element numbers, path)`` of the deepest element around blocks that holds most of the weight.

    A block's own paragraph or heading is no container; inside an ``article`` or ``main`` the
    nearest of these is taken, so that no section of it is lost. Empty if there is none.
    """
    held: dict[int, float] = defaultdict(float)
    chain: dict[int, tuple] = {}
    for w, (elements, path, *_) in zip(weight, found, strict=True):
        n = len(elements) - (bool(path) and path[-1] in LEAVES)
        for d in range(n):
            held[elements[d]] += w
            chain[elements[d]] = elements[: d + 1], path[: d + 1]
    inside = [e for e, w in held.items() if w >= HELD * weight.sum()]
    if not inside:
        return (), ()
    elements, path = chain[max(inside, key=lambda e: len(chain[e][0]))]
    for name in ("article", "main"):
        if name in path:
            n = len(path) - path[::-1].index(name)
            return elements[:n], path[:n]
    return elements, path


def widened(found: list[tuple], elements: tuple, path: tuple, chosen: np.ndarray, menu: np.ndarray) -> tuple[int, int]:
    """The first block of the article and the one after its last.

    Around the container, from each element to the next outer one: all content blocks belong to it,
    the paragraphs right beside it, and headings before it if no menu stands between.
    """

    def span(d: int) -> tuple[int, int]:
        own = [k for k, b in enumerate(found) if len(b[0]) > d and b[0][d] == elements[d]]
        return own[0], own[-1] + 1

    if not elements:
        return 0, len(found)
    lo, hi = span(len(elements) - 1)
    if path[-1] in ("article", "main"):
        return lo, hi
    for d in range(len(elements) - 2, -1, -1):
        a, b = span(d)
        beside = (*path[: d + 1], "p")
        first, last, apart = lo, hi, False
        for k in range(lo - 1, a - 1, -1):
            apart |= bool(menu[k])
            own = found[k][1]
            if chosen[k] or not menu[k] and own == beside or not apart and own[-1] in HEADINGS:
                first = k
        for k in range(hi, b):
            if chosen[k] or not menu[k] and found[k][1] == beside and path[d] not in ("html", "body"):
                last = k + 1
        lo, hi = first, last
    return lo, hi


def scored(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Of each block, whether its path is a content path, and whether it is one of a menu."""
    by_path: dict[tuple, list[int]] = defaultdict(list)
    for k, b in enumerate(found):
        by_path[b[1]].append(k)
    size = np.array([len(b[2]) for b in found], float)
    punct = np.array([len(_PUNCT.findall(b[2])) for b in found], float)
    linked = np.array([b[3] for b in found], float)
    text_ratio, punct_ratio, link_share = np.zeros(len(found)), np.zeros(len(found)), np.zeros(len(found))
    for at in by_path.values():
        text_ratio[at] = size[at].sum() / len(at)
        punct_ratio[at] = punct[at].sum() / len(at)
        link_share[at] = linked[at].sum() / size[at].sum()
    score = smooth(text_ratio) * np.log1p(smooth(punct_ratio)) * (1 - link_share)
    path_score = np.zeros(len(found))
    for at in by_path.values():
        path_score[at] = score[at].mean()
    chosen = path_score >= SHARE * (path_score @ size) / size.sum()
    chosen &= link_share <= LINKS
    menu = (link_share > LINKS) & (punct_ratio < 1) & (linked > 0)
    return chosen, menu


def content(found: list[tuple]) -> list[str]:
    """The texts of the content blocks."""
    if not found:
        return []
    chosen, menu = scored(found)
    size = np.array([len(b[2]) for b in found], float)
    weight = np.where(chosen, size, 0.0)
    if not weight.any():
        weight = size
    elements, path = container(found, weight)
    lo, hi = widened(found, elements, path, chosen, menu)
    return [found[k][2] for k in range(lo, hi) if not menu[k] or path[-1:] == ("article",)]


def unwrapped(page: str) -> list[tuple]:
    """The blocks of a page, where no wrapper of most of its content text is left out.

    Only a marked element with more raw text than enough is tried, the largest first; then those in it.
    """
    kept: frozenset[int] = frozenset()
    while True:
        dropped: dict[int, list[float]] = {}
        found = blocks(page, kept, dropped)
        rest = sum(len(b[2]) - b[3] for b in found)
        for n, (share, raw) in sorted(dropped.items(), key=lambda x: -x[1][1]):
            if raw < share * (raw + rest) / 2 or not raw:
                continue
            inside: dict[int, list[float]] = {}
            tried = blocks(page, kept | {n}, inside)
            deeper = [x for x in inside if x not in dropped]
            if not tried:
                if deeper:
                    kept |= {n}
                    break
                continue
            chosen, _ = scored(tried)
            size = np.array([len(b[2]) for b in tried], float) * chosen
            own = np.array([n in b[0] for b in tried])
            hidden = sum(inside[x][1] for x in deeper)
            if size.any() and size @ own >= share * size.sum() or hidden >= share * (hidden + size.sum()):
                kept |= {n}
                break
        else:
            return found


def main_text(page: str) -> str:
    return "\n\n".join(content(unwrapped(page)))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars`` of each page, from its whole html.

    A null or empty html, or one without text, gives an empty text; plain text without tags is one
    block; null ids and urls stay null; repeated rows give repeated results; other columns are
    ignored; broken markup is closed as browsers close it; an empty table gives an empty table.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            found = list(map(main_text, b["html"]))
            yield {"page_id": b["page_id"], "url": b["url"], "text": found, "n_chars": list(map(len, found))}

    return map_rows(pages, run, _SCHEMA, "page_id long, url string, text string, n_chars long")
