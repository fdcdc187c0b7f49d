"""Main text of pages."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

from lodestar.llm import common, page_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p><b>First  part.<br><p>Second&nbsp;one &lt;x&gt; a < b<aside>side</aside>
<ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><section class="comments"><p>reader says</p></section>
<form><p>subscribe</p><input></form></article><footer>&copy; host</footer></body></html>"""


def test_article():
    assert page_text.text_of_page(PAGE).split("\n") == ["Head & line", "First part.", "Second one <x> a < b", "one", "two", "1 2", "3"]


def test_odd_pages():
    assert page_text.text_of_page("") == ""
    assert page_text.text_of_page("just text &amp more") == "just text & more"
    assert page_text.text_of_page("<p>a<p>b") == "a\nb"
    assert page_text.text_of_page("<article>x<script>never closed <p>y") == "x"
    assert page_text.text_of_page("<p>x</div></span></p>y<!-- open") == "x\ny"
    assert page_text.text_of_page("<div>" * 20_000 + "deep") == "deep"
    assert page_text.text_of_page('<main><p>m</p></main><p>other</p>') == "m"
    assert page_text.text_of_page('<div class="sidebar">s</div><p hidden>h</p><p>t</p>') == "t"
    assert page_text.text_of_page("<p>&#0000000065;&#99999999999;&#x110000000;&#" + "9" * 9_000 + ";</p>") == "A" + "\ufffd" * 3
    assert page_text.text_of_page('<p title="open>x</p><p>y</p>') == "x\ny"
    assert page_text.text_of_page("a <b") == "a" and page_text.text_of_page("a < b <") == "a < b <"


N = 1 << 20


@pytest.mark.parametrize("unit,tail", [('<a x="', ""), ("<a ", ""), ("<i>", "</u>"), ("<u><div><i>", "</u>"), ("<script></script ", ""), ("<b 'x>y' ", ""), ("<p>", "</i>"), ("<", ""), ("&#9", ""), ("<!--", ""), ("<td><button><b>", "</b>")])
def test_malformed_pages_take_linear_time(unit, tail):
    n = N // (len(unit) + len(tail))
    start = time.process_time()
    page_text.text_of_page(unit * n + tail * n)
    assert time.process_time() - start < 8  # a second or two; quadratic time would be minutes


def pages(spark):
    rows = []
    for i in range(30):  # a site without article elements
        rows.append((i, f"https://Site.example/{i}", f"<body><div><p>Welcome to our site</p></div><p>Story number {i} tells of {i * 7}</p><p>All rights reserved</p></body>", "x"))
    for i in range(20):  # one article at many addresses, and its common paragraph
        rows.append((100 + i, f"http://mirror.example:80/a/{i}", "<article><p>Same story</p><div><p>in two parts</p></div></article>", "y"))
    rows += [(200, None, "<p>no host</p>", None), (201, "bad url", None, None), (202, "http://x.example/", "", None), (None, None, None, None)]
    rows += [(0, "https://Site.example/0", rows[0][2], "x")] * 2
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string"), rows


def test_templates_of_a_site(spark):
    table, rows = pages(spark)
    got = {(r["page_id"], r["main"]) for r in page_text.with_text(table, out="main").collect()}
    want = {(i, f"Story number {i} tells of {i * 7}") for i in range(30)} | {(100 + i, "Same story\nin two parts") for i in range(20)}
    assert got == want | {(200, "no host"), (201, ""), (202, ""), (None, "")}
    assert page_text.with_text(table, out="main").count() == len(rows)


def test_empty_table(spark):
    table, _ = pages(spark)
    assert page_text.with_text(table.limit(0), out="main").collect() == []


def brute_templates(rows, html):
    """Blocks of text (one a page element here) that many distinct pages of a host have."""
    seen, contents = defaultdict(set), defaultdict(set)
    for host, parts in rows:
        contents[host].add(html(parts))
        for part in parts:
            seen[host, part].add(html(parts))
    return {k for k, pages_ in seen.items() if (len(pages_) >= 10 and len(pages_) >= 0.02 * len(contents[k[0]])) or (len(pages_) >= 3 and len(pages_) >= 0.5 * len(contents[k[0]]))}


@pytest.mark.parametrize("broadcast", [8 << 20, -1])
def test_templates_are_what_a_brute_force_count_says(spark, monkeypatch, broadcast):
    """No names to go by: plain blocks, menus and notices that recur on some pages of a site."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(common, "HOST_ROWS", 20)
    chooser = random.Random(2)
    html = lambda parts: "<body>" + "".join(f"<div><p>{x}</p></div>" for x in parts) + "</body>"
    rows = []
    for host, n in (("big.example", 700), ("mid.example", 60), ("small.example", 7), ("tiny.example", 2)):
        for i in range(n):
            own = [f"{host} story {i} part {j}" for j in range(chooser.randint(1, 3))]
            shared = [f"menu {m}" for m in range(12) if chooser.random() < m / 12]  # on ever more pages
            rows.append((host, tuple(shared + own)))
        rows += rows[-2:]  # repeated pages count once
    known = brute_templates(rows, html)
    table = spark.createDataFrame([(i, f"https://{host}/{i}", html(parts)) for i, (host, parts) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.with_text(table).collect()}
    want = {i: "\n".join(p for p in parts if (host, p) not in known) for i, (host, parts) in enumerate(rows)}
    assert got == want
    without = sum(got[i] != "\n".join(parts) for i, (_, parts) in enumerate(rows))
    assert without > 500  # the templates alone decide on these pages


def test_templates_within_named_articles(spark):
    """Containers that recur within articles go; a passage that many articles quote stays."""
    quote = "A passage that very many articles of this site quote word for word"
    rows = [(i, f"https://a.example/{i}", f"<body><p>top</p><article><h1>Story {i}</h1><p>{quote}</p><div><p>Share this</p></div><p>Text {i * 3}</p></article></body>") for i in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.with_text(table).collect()}
    assert got == {i: f"Story {i}\n{quote}\nText {i * 3}" for i in range(40)}


def test_clashing_text_column(spark):
    table, rows = pages(spark)
    out = page_text.with_text(table)
    assert out.columns == table.columns and out.count() == len(rows)
