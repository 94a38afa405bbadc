"""Main text: names are features, the cut helps, the parser's time grows with the length, and whole frames go through Spark."""

import re
import time

import numpy as np
import pytest

from tallyloom.llm import html

DIR = "/root/testdata/sf0.01"
PART = "<p>This is a long paragraph of the article, with words, and it goes on for a while.</p><p>Short one.</p><p>Another long paragraph follows here, with many more words in it.</p>"
TEXT = "This is a long paragraph of the article, with words, and it goes on for a while. Short one. Another long paragraph follows here, with many more words in it."


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").orderBy("page_id").collect()]


@pytest.mark.parametrize("wrap", [
    "<div class='with-sidebar content'>{}</div>", "<div class='post-related'>{}</div>", "<div class='share-price-report'>{}</div>", "<div class='has-sidebar'><article>{}</article></div>",
    "<form>{}</form>", "<div class=content-with-sidebar>{}</div>", "<article>{}</article><section class=comments><p>I liked it a lot, thanks for this article, it is very good.</p></section>", "<div class=story>{}</div><aside><p>Something else that one might read, or not.</p></aside>",
])
def test_wrappers_keep_the_article(wrap):
    assert html.main_text("<html><body><nav><a href=x>Home</a></nav>" + wrap.format(PART) + "<footer>c 2020</footer></body></html>") == TEXT


HEADS = ["", "<header><h1>The Daily</h1></header>", "<header class=masthead><h1><a href=/>The Daily</a></h1><p>News that is worth to be read, every day of the week.</p></header>"]


@pytest.mark.parametrize("head", HEADS)
@pytest.mark.parametrize("wrap", ["<div class='with-sidebar'>{}</div>", "<div class='share-price-report'>{}</div>", "<form>{}</form>", "<div class='has-comments'>{}</div>", "<div id=page class='no-footer'><div>{}</div></div>", "<main>{}</main>", "{}"])
def test_articles_stay_beside_the_name_of_the_site(head, wrap):
    page = f"<html><body>{head}<nav><a href=x>Home</a><a href=y>News</a></nav>{wrap.format(PART * 4)}<footer>c 2020 The Daily. All rights reserved.</footer></body></html>"
    assert html.main_text(page) == " ".join([TEXT] * 4)


@pytest.mark.parametrize("other", [
    "<div class='c-bar'>We use cookies to give you the best experience on our site. Please accept them.</div>", "<div><p>Sign up here, and never miss what we write for you again.</p></div>", "<div id=comments><p>I liked it a lot, and so did all of my friends, who have read it twice. Thank you. More of it, please.</p><p>No.</p></div>",
    "<div class='advert box'><p>Buy two of these fine things now, and pay for one of them only.</p></div>", "<aside><p>Another story that is told elsewhere, at some length, by somebody.</p></aside>",
])
@pytest.mark.parametrize("first", [True, False])
def test_other_parts_go(other, first):
    article = f"<div>{PART * 5}</div>"
    page = f"<html><body>{HEADS[1]}<nav><a href=x>Home</a></nav>{other + article if first else article + other}<footer>c 2020</footer></body></html>"
    assert html.main_text(page) == " ".join([TEXT] * 5)


@pytest.mark.parametrize("stripped, less", [(True, 0.1), (False, 0.5)])
def test_the_cut_mends_what_the_classifier_alone_gets_wrong(pages, stripped, less):
    """On held-out pages of the table, as they are and without landmark tags: errors of the classifier alone, and of the cut."""
    rows = [(html.described(b), y) for h in pages[:125] for b in html.read(h).found if (y := html.landmark(b)) is not None]
    weights = html.fitted(np.array([x for x, _ in rows]), np.array([y for _, y in rows]))
    alone = cut = n = changed = 0
    for h in pages[125:]:
        truth = [bool(b.at.content and max(b.at.tag_side, b.at.name_side) < 1) for b in html.read(h).found]
        found = html.read(re.sub(r"<(/?)(nav|article|aside|main|footer)\b", r"<\1div", h) if stripped else h).found
        odds = html.log_odds(found, weights)
        own = html.labels(found, odds)
        alone += sum((x > 0) != t for x, t in zip(odds, truth))
        cut += sum(y != t for y, t in zip(own, truth))
        changed += sum((x > 0) != y for x, y in zip(odds, own))
        n += len(truth)
    assert changed > 0 and cut <= less * alone and cut < 0.01 * n, (alone, cut, changed, n)


def test_ties_are_boilerplate():
    block = html.read("<p>x").found
    block[0].at.holder.pull = 0.0
    assert html.labels(block, [0.0]) == [False] and html.labels(block, [0.1]) == [True]


@pytest.mark.parametrize("page", ["<div>text" * 20_000, "<a " * 20_000, "<a href='" * 20_000, "<b>" * 20_000 + "<hr>x" * 9_000, "<p>some words here, and more." * 8_000, "<div>" * 9_000 + "<tr>x" * 9_000, "</p>" * 20_000, "<!--" * 20_000, "<div><li>x" * 9_000])
def test_time_grows_with_the_length(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 4


def test_few_rows_change_the_weights_by_degrees():
    x = np.array([html.PRIOR]) * 0 + np.array([[1, 3, 0, 1, 1, 0, 0]])
    far = [np.abs(np.array(html.fitted(np.repeat(x, n, 0), np.zeros(n, int))) - html.PRIOR).max() for n in (0, 1, 2, 49, 50, 51)]
    assert far[0] == 0 < far[1] < 1 and max(abs(far[5] - far[4]), abs(far[4] - far[3])) < 0.02


def test_extracted(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    big = "<body><nav><a href=a>x</a></nav><article>" + PART * 3000 + "</article></body>"
    rows = [(2**53 + 1, "u", f"<article>{PART}</article>"), (None, None, None), (3, "v", ""), (3, "v", ""), (4, "w", big)]
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html.extracted(spark.createDataFrame([(*r, 1, "x") for r in rows], schema)).collect()}
    assert got == {(2**53 + 1, "u", TEXT, len(TEXT)), (None, None, "", 0), (3, "v", "", 0), (4, "w", " ".join([TEXT] * 3000), len(TEXT) * 3000 + 2999)}
    assert html.extracted(spark.createDataFrame([], schema)).count() == 0
