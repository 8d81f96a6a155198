import html
import re

import helpers
import numpy as np
import pytest
from furrow.llm import page_text

TREE = page_text.grow(np.array(page_text.LABELLED, float)[:, :-1], np.array(page_text.LABELLED, float)[:, -1])

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1><ul><li><a href=1>Home</a></li></ul></header>
<div id="cookie-notice"><p>We use cookies on this site to make it better for all readers who come by.</p></div>
<div class="sidebar"><p>Latest posts and other long things that a reader may want to see one day or other</p></div>
<main><article class="post"><header><h1>The title</h1></header><p>Hello <b>wor</b>ld &amp; all, here is a first   paragraph with some words.</p>
<p>Short.<aside>aside text</aside><p>Another <a href=x>link</a> text.<script>var a="<p>no</p>"</script><form><label>Name</label><input></form></article>
<section class="comments"><h2>Comments</h2><p>I do not agree with what this says about things at all, since it is wrong.</p></section></main>
<footer>&copy; 2020</footer></body></html>"""


def test_tree_knows_its_table():
    table = np.array(page_text.LABELLED, float)
    assert (page_text.classify(TREE, table[:, :-1]) == table[:, -1]).all()


def test_page_with_all_parts():
    assert page_text.main_text(PAGE, TREE).split("\n") == [
        "The title", "Hello world & all, here is a first paragraph with some words.", "Short.", "Another link text.",
    ]


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{helpers.SF}/pages.parquet").select("page_id", "html")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_text.extract(pages).collect()}
    for page_id, page in helpers.rows_of(pages):
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        text = "\n".join(b for b in blocks if b)
        assert got[page_id] == (text, len(text))


@pytest.mark.parametrize("page", ["", "<", "<p", "a<script>x", "<!-- x", "<p>" * 3000, '<div a="' * 2000, "< 3 and 4 > 2", "</p></div>"])
def test_broken_pages(page):
    assert isinstance(page_text.main_text(page, TREE), str)


def test_null_empty_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, PAGE, 7), (2, PAGE, 7)], "page_id long, html string, text int")
    got = page_text.extract(rows).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and len(got) == 4
    assert page_text.extract(rows.limit(0)).count() == 0
