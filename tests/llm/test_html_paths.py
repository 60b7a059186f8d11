"""Main text: fixed pages with known answers, and the generated pages against their article element."""

import html
import re

from trackspark.llm import html_paths

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h2>Site of things</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, and we tell you so, at length, in every page.</div>
<div id=main><h1>The &eacute;t&eacute;</h1><p>First   paragraph,\nwith <b>bold</b> words &amp; <a href=x>a link</a>.<p>Second one; it is
longer, and has more commas, stops. And so on.<script>var x = "<p>no</p>";</script></p><p>ok</p>
<form><input name=q><p>Search here, please.</p></form><div class="ad">Buy, buy, buy. Now, at once.</div>
<ul><li>item one, a</li><li>item two, b</li></ul><!-- <p>hidden</p> --><p>a&lt;b</p></div>
<aside><p>Side text, long enough, to count as text.</p></aside>
<section id="comments"><p>Great article, thanks, I liked it. Really, very, very much indeed.</p></section>
<footer>&copy; site, 2020. All rights, reserved.</footer></body></html>"""


def test_known_page():
    assert html_paths.main_text(PAGE).split("\n\n") == [
        "The été",
        "First paragraph, with bold words & a link.",
        "Second one; it is longer, and has more commas, stops. And so on.",
        "ok",
        "item one, a",
        "item two, b",
        "a<b",
    ]


LONG = "This is a long sentence, with commas, and more text. It goes on, as text does, for a while."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>More</a></li></ul>"


def test_pages_without_article():
    text = lambda p: html_paths.main_text(f"<html><body>{p}</body></html>").split("\n\n")
    body = f"<div class=text><p>{LONG * 4}</p><p>{LONG * 4}</p></div>"
    want = [LONG * 4] * 2
    assert text(f"{MENU}<div class=post><h1>T</h1><p>The lead.</p>{body}</div><div class=footer>x</div>") == ["T", "The lead.", *want]
    assert text(f"{MENU}<div class=post><p>The lead.</p>{body}<p>The end.</p></div>") == ["The lead.", *want, "The end."]
    assert text(f"<h1>T</h1><div>By me</div>{body}<div class=footer><p>All rights, reserved.</p></div>") == ["T", "By me", *want]
    assert text(f"<h2>Site</h2>{MENU}<div><h1>T</h1>{body}</div><div>{MENU}</div>") == ["T", *want]
    assert text(f"{MENU}<div class=page><div><p>{LONG * 8}</p></div><div><p>{LONG}</p></div></div>") == [LONG * 8, LONG]


def test_reference_lists():
    refs = "<ul><li><a href=1>Smith, J. A paper, 2020.</a></li><li><a href=2>Jones, K. A book.</a></li></ul>"
    for tag in ("article", "main", "div"):
        got = html_paths.main_text(f"<body>{MENU}<{tag}><p>{LONG * 5}</p>{refs}</{tag}></body>")
        assert got.split("\n\n") == [LONG * 5, "Smith, J. A paper, 2020.", "Jones, K. A book."]
    assert html_paths.main_text(f"<article><p>{LONG}</p><ul><li><a href=1>Smith 2020</a></li></ul></article>").endswith("Smith 2020")


def test_wrappers_with_marks():
    inner = f"<h1>T</h1><p>{LONG * 4}</p><p>{LONG * 2}</p>"
    want = ["T", LONG * 4, LONG * 2]
    side = f"<div class=sidebar><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>"
    for mark in ("class='content-with-sidebar'", "class=has-sidebar", "class='no-comments'", "class='post-share x'", "id=widget"):
        assert html_paths.main_text(f"<body>{MENU}<div {mark}>{inner}</div></body>").split("\n\n") == want, mark
    for mark in ("class='content-with-sidebar'", "class='post-share'"):
        assert html_paths.main_text(f"<body>{MENU}<div {mark}>{inner}{side}</div>{side}</body>").split("\n\n") == want, mark
    assert html_paths.main_text(f"<body><form action=x>{MENU}<div class=post-share>{inner}</div><input name=a>{side}</form></body>").split("\n\n") == want
    # Comments longer than the text, and an element that hides itself, are left out all the same.
    assert html_paths.main_text(f"<body><div>{inner}</div><div class=comments><p>{LONG * 9}</p></div></body>").split("\n\n") == want
    assert html_paths.main_text(f"<body><div>{inner}</div><div hidden><p>{LONG * 9}</p></div></body>").split("\n\n") == want


def test_broken_and_plain():
    assert html_paths.main_text("") == ""
    assert html_paths.main_text("just  text, no tags") == "just text, no tags"
    assert html_paths.main_text("<script>x") == ""
    assert html_paths.main_text("<article><p>one, two<p>three <b>four<br>five") == "one, two\n\nthree four five"
    assert html_paths.main_text("<p>a < b and <c") != ""
    assert html_paths.main_text('<a title="x>' * 2000) is not None


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_paths.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = re.sub(r"</?(?:p|h1)>", "\0", body).replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", "", p)).split()) for p in body.split("\0"))
        want = "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_awkward(awkward, empty):
    rename = {"doc_id": "page_id", "text": "html", "found": "url"}
    rows = html_paths.extract_text(awkward.withColumnsRenamed(rename).withColumn("text", awkward["n"])).collect()
    assert len(rows) == 11 and sum(r["text"] == "" for r in rows) == 3
    assert html_paths.extract_text(empty.withColumnsRenamed(rename)).count() == 0
