"""Linked titles and reference lists that belong to the article."""

import pytest
from test_html import P, T

from tapeworks.llm.html_text import extract

LINKS = "<h2><a href=r>References</a></h2><ul><li><a href=1>First cited title</a><li><a href=2>Second cited title</a></ul>"
INSIDE = ["Title", T, T, T, "Read on", "References", "First cited title", "Second cited title", T]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_links_inside(tag):
    page = f"<body><nav><a href=n>Menu</a></nav><{tag}><h1><a href=t>Title</a></h1>{P * 3}<p><a href=x>Read on</a></p>{LINKS}{P}</{tag}></body>"
    assert extract(page) == "\n\n".join(INSIDE)


def test_linked_title_beside_the_path():
    assert extract(f"<body><h1><a href=t>Title</a></h1><div>{P * 3}</div><ul><li><a href=1>more</a></ul></body>") == "\n\n".join(["Title", T, T, T])
