"""Pages in forms, behind unclosed navigation, parted by adverts or with sections named like furniture; pages without an article element; sources of equal rows."""

import collections
import re

import pytest
from test_edges import slow_text

from tessera.llm import html_text, mixing

SF = "/root/testdata/sf0.001"
LONG = "This is a sentence of running text that goes on for a while and ends here. "
ARTICLE = f"<h1>Title</h1><p>{LONG * 5}</p><p>{LONG * 4}</p>"
TEXT = "\n\n".join(["Title", (LONG * 5).strip(), (LONG * 4).strip()])


@pytest.mark.parametrize(
    "page",
    [
        f"<form id=aspnetForm><div class=nav><a href=x>a</a></div><article>{ARTICLE}</article></form>",
        f"<form id=aspnetForm><main>{ARTICLE}</main></form>",
        f"<nav><ul><li><a href=x>Menu</a></li></ul><div class=content>{ARTICLE}</div>",
        f"<div class=siteNav><p>Site words here</p></div><article>{ARTICLE}<div class=commentList><p>{LONG * 3}</p></div></article><div class=copyrightNotice>Copyright of all</div>",
        f"<div class=left><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div><div class=content>{ARTICLE}</div>",
        f"<article>{ARTICLE}</article><form><p>Your name, please, and all else.</p></form>",
    ],
)
def test_the_article_alone(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == TEXT


def blocks(page):
    return html_text.main_text(f"<body>{page}</body>").split("\n\n")


def test_adverts_part_nothing():
    assert blocks(f"<div id=content><p>Lead.</p><div class=ad>Buy</div><p>{LONG * 5}</p><aside class=ad>Buy</aside><p>Short.</p><div class=ad>Buy</div><p>End.</p></div>") == ["Lead.", (LONG * 5).strip(), "Short.", "End."]


def test_sections_named_like_furniture():
    page = f"<article><p>{LONG * 3}</p><section class=hidden-gem><p>Gem</p></section><section class=search-rescue><p>Rescue</p></section><section id=menu><p>Soup. {LONG * 2}</p></section><ul id=menu><li><a href=x>Home</a></li></ul></article>"
    assert blocks(page) == [(LONG * 3).strip(), "Gem", "Rescue", f"Soup. {LONG * 2}".strip()]


def test_an_introduction_does_not_replace_the_article():
    assert (f"Art. {LONG * 2}").strip() in blocks(f"<div><p>Intro. {LONG * 5}</p></div><article><p>Art. {LONG * 2}</p></article>")


def test_a_paragraph_that_is_a_link():
    assert blocks(f"<article><p><a href=x>{LONG}</a></p></article>") == [LONG.strip()]


def test_nested_names_and_long_pages():
    deep = "".join(f"<div class=widget{'' if i % 2 else '-wrap'}>" for i in range(40))
    assert html_text.main_text(f"<body>{deep}{ARTICLE * 200}</body>") == "\n\n".join([TEXT] * 200)


@pytest.mark.parametrize("tag", ["article", "div", "section"])
@pytest.mark.parametrize("form", [False, True])
def test_pages_with_other_tags(spark, tag, form):
    """The given pages with their article under another tag and within a form, against patterns that read the page as it was."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if "<article" in (r.html or "") and "<form" not in r.html]
    assert len(pages) >= 20
    good = 0
    for page in pages:
        other = re.sub(r"<article([^>]*)>", rf"<{tag}\1>", page).replace("</article>", f"</{tag}>")
        if form:
            other = re.sub(r"(<body[^>]*>)", r"\1<form id=f>", other).replace("</body>", "</form></body>")
        good += html_text.main_text(other) == slow_text(page)
    assert good >= 0.95 * len(pages)


@pytest.mark.parametrize("ranges", [7, 4_000])
def test_equal_rows_are_taken_apart(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    rows = [(1, "a b c d", "s1")] * 1000 + [(i, "x " * (i % 7 + 1), "s0") for i in range(2, 1500)] + [(9000, "p q r", "s2")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    taken, target = collections.Counter(), {}
    for r in mixing.mix_sources(df).collect():
        taken[r.source] += r.copies * r.mix_size
        target[r.source] = r.target
        assert r.copies <= 3
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t, s
