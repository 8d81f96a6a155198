import time

import numpy as np
import pytest
from furrow.llm import page_text

TREE = page_text.grow(np.array(page_text.LABELLED, float)[:, :-1], np.array(page_text.LABELLED, float)[:, -1])
WORDS = "These are some words of a paragraph that tells of rivers and hills and more."


def test_head_without_its_end_tag():
    assert page_text.main_text(f"<html><head><title>t</title><meta charset=x><body><article><p>{WORDS}</p></article>", TREE) == WORDS
    assert page_text.main_text(f"<head><title>t</title><noscript><img src=x><body><article><p>{WORDS}</p></article>", TREE) == WORDS


@pytest.mark.parametrize("name", "svg object select canvas noscript button iframe template video".split())
def test_unclosed_element_ends_with_the_one_around_it(name):
    page = f"<article><p>{WORDS}</p><div><{name}></div><p>{WORDS}</p><p>Last words here.</p></article>"
    assert page_text.main_text(page, TREE).split("\n") == [WORDS, WORDS, "Last words here."]


@pytest.mark.parametrize("name", "svg select canvas noscript button iframe template video".split())
def test_closed_element_is_not_read(name):
    page = f"<article><p>{WORDS}</p><{name}><b>no</b> <i>not this</i></{name}><p>{WORDS}</p></article>"
    assert page_text.main_text(page, TREE).split("\n") == [WORDS, WORDS]


def test_math_and_object_are_text():
    page = "<article><p>The sum <math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow></math> is <object data=x>a figure</object> here.</p></article>"
    assert page_text.main_text(page, TREE) == "The sum a+b is a figure here."


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><article>{0}</article></div>", "<div class='sidebar-layout'><article>{0}</article></div>",
    "<form action=x><input type=hidden><article>{0}</article></form>", "<form><div>{0}</div></form>",
    "<main><div class='sidebar page'><article>{0}</article></div></main>", "<div class='search'><h1>A title</h1>{0}</div>",
])
def test_wrapped_page_is_read(page):
    assert WORDS in page_text.main_text(page.format(f"<p>{WORDS}</p><p>{WORDS}</p>"), TREE)


def test_parts_of_an_article_with_doubtful_names():
    page = (f"<article><h1>The title</h1><p>{WORDS}</p><h2 id='related-work'>Related work</h2><p>{WORDS}</p><h3 id='search-tags'>Search tags</h3>"
            f"<p>{WORDS}</p><section id='discussion'><h2>Discussion</h2><p>{WORDS}</p></section><div class='notice'><p>{WORDS}</p></div></article>")
    assert page_text.main_text(page, TREE).split("\n") == [
        "The title", WORDS, "Related work", WORDS, "Search tags", WORDS, "Discussion", WORDS, WORDS]


def test_other_things_stay_out():
    links = "<ul>" + "<li><a href=x>Another post</a></li>" * 4 + "</ul>"
    page = (f"<div class='sidebar'><article>{WORDS}</article></div><article><p>{WORDS} One.</p><div class='related'><h3>Related</h3>{links}</div>"
            f"<div class='newsletter'><p>{WORDS}</p></div></article><section class='comments'><article><p>{WORDS}</p></article></section>")
    assert page_text.main_text(page, TREE) == f"{WORDS} One."


def test_short_paragraphs_of_a_plain_page():
    page = "<h1>A title of it</h1>" + "".join(f"<p>{x}</p>" for x in [f"{WORDS} {WORDS} {WORDS}", "That was all.", WORDS * 5, "It ends here with only seven words."])
    assert page_text.main_text(page, TREE).split("\n")[2:] == ["That was all.", WORDS * 5, "It ends here with only seven words."]


def test_linked_parts_of_an_article_stay():
    page = "<article><h2>References</h2><ol><li><a>The first book of all</a></li><li><a>Second</a></li></ol><p><a>Read the full report</a></p></article>"
    assert page_text.main_text(page, TREE) == "References\nThe first book of all\nSecond\nRead the full report"


def test_names_in_one_word_mark_their_element():
    body = "<p>" + "words of the article itself " * 8 + "</p>"
    for name in ("adslot", "cookiebar", "sharebar", "relatedposts", "usercomments"):
        assert "junk" not in page_text.main_text(f"<article>{body}<div class='{name}'><p>junk of some kind</p></div></article>", TREE)


def test_many_end_tags_of_elements_that_are_not_open():
    start = time.time()
    assert page_text.main_text("<div>" * 20000 + "</nope>" * 20000 + "text", TREE) == "text"
    assert time.time() - start < 20
