"""Pages whose paragraphs are no p elements, and boilerplate that is."""

import re

import pytest

from strophe.llm import html_text

A = "The first paragraph says something at some length, and ends here."
B = "The second one goes on with more words about the same thing."
SIDE = "Read this other story of ours too"
NAV = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
FOOT = "<footer><p>© 2020 Somebody, all rights reserved.</p></footer>"


@pytest.fixture(scope="module")
def model():
    return html_text.learn()


@pytest.mark.parametrize(
    "page",
    [
        f"<article><div>{A}</div><div>{B}</div></article>",
        f"<div id=content><div class=text><div>{A}</div><div>{B}</div></div></div>",
        f"{NAV}<main><div>{A}</div><div>{B}</div></main>{FOOT}",
        f"{NAV}<article><section>{A}</section><section>{B}</section></article>{FOOT}",
        f"<article>{A}<br><br>{B}</article>{FOOT}",
        f"<body>{NAV}<div class=post><span>{A}</span><p>{B}</div>{FOOT}",
        f"<article><p>{A}</p><div>{B}</div></article>",
        f"<article><p>{A}</p><p>{B}</p><div class=sidebar data-x=/a/>{SIDE}</div></article>",
        f"<article><form><select><option>x</form><p>{A}</p><p>{B}</p></article>",
        f"<article><form><textarea>x y</form><p>{A}</p><p>{B}</p></article>",
        f'<div class="cookie-notice"><p>We keep cookies on your machine, do you agree?</p></div><article><div>{A}</div><div>{B}</div></article>',
        f"<article><div>{A}</div><div>{B}</div></article><section class=comments><p>A reader thinks that all of this is wrong.</p></section>",
    ],
)
def test_layouts(model, page):
    assert html_text.main_text(page, model) == f"{A} {B}"


def test_paragraphs_as_div_keep_the_text(model, spark):
    pages = [r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    kept = 0
    for page in pages:
        own, other = (html_text.main_text(x, model) for x in (page, re.sub(r"<(/?)p\b", r"<\1div", page)))
        kept += own == other
    assert kept >= 0.95 * len(pages)
