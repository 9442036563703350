"""Main text of pages."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tapeworks.llm.html_text import extract, main_text

P = "<p>This is a paragraph of the article, with enough words in it that it is as dense as others are.</p>"
T = "This is a paragraph of the article, with enough words in it that it is as dense as others are."

CASES = {
    "menus and asides": (
        f"<html><body><div id='header'><a href=/>Site</a></div><div class='menu'><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div>"
        f"<div id=content><h1>Title</h1>{P * 3}<ul><li>one<li>two</ul></div><div class='comments'><h3>Comments</h3><p>Nice post</p></div>"
        f"<div class=sidebar>{P}</div><form><input name=q>Search</form></body></html>", ["Title", T, T, T, "one", "two"]),
    "sections": (
        f"<body><div><section><h2>S1</h2>{P * 3}</section><section><h2>S2</h2>{P * 2}</section></div>"
        "<ul><li><a href=1>link one</a><li><a href=2>link two</a></ul><div>Copyright 2020</div></body>", ["S1", T, T, T, "S2", T, T]),
    "no markup": ("plain text &amp; no\n tags", ["plain text & no tags"]),
    "unclosed": ("<p><b>bold <i>both</b> rest<p>next", ["bold both rest", "next"]),
    "inline": (f"<article>{P}<p>x<b>y</p>z</article>", [T, "xy", "z"]),
    "table": (f"<table><tr><td>{P}<td>cell</table>", [T, "cell"]),
    "comments as articles": (f"<main><article>{P}</article><section id='comments'><article>{P}</article></section></main>", [T]),
    "hidden and notices": (
        f"<body><pre>  a\n  b </pre><blockquote>{P}</blockquote><script>if (a<b) x='</p>'</script>{P}<p hidden>no</p><!-- {P} -->"
        "<div class='cookie-notice'>We use cookies</div><div role=alert>alert</div><nav>n</nav><noscript>s</noscript>", ["a b", T, T]),
    "only links": ("<div><a href=x>only links</a></div>", []),
    "references": ("<p>&copy; &#8364;&#x41;&nbsp;b &unknown; &lt;p&gt;</p>", ["© €A b &unknown; <p>"]),
    "quotes in tags": ("<body><p title=don't x>it's <a href=\"a>b\">y</a> and some longer text here</p>", ["it's y and some longer text here"]),
    "nothing": ("", []),
    "no text": ("<p>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, blocks = CASES[name]
    assert extract(page) == "\n\n".join(blocks)


def test_odd_markup_is_linear():
    assert extract('<a "' * 200_000) == ""
    assert extract("<div>" * 100_000 + "x" + "</b>" * 100_000) == "x"
    assert extract("<" * 1000) == "<" * 1000
    assert extract("<p>" * 100_000 + "x") == "x"
    assert extract(None) == ""


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r for r in main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?p>|</?h1>", article)]
        assert rows[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text) and rows[r.page_id].url == r.url


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, f"<body>{P}"), (2, "v", ""), (3, "w", "<p>" + "long text " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("id", "text", "n_chars")})
    got = sorted(((r.page_id, r.url, r.text) for r in main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", ""), (1, "u", ""), (None, None, T), (2, "v", ""), (3, "w", ("long text " * 100_000).strip())], key=str)
    assert main_text(df.limit(0)).count() == 0
