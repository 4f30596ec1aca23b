import itertools
import random

import pytest

from variform.llm import webtext as W
from variform.llm.mincut import label

CHROME = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header"><h1>Site</h1><a href="/">home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this a better place for all readers.</div><!-- <p>hidden</p> -->%s
<aside><p>Other things that were read by many people this week.</p></aside><form><label>Mail</label><input name=q><button>Go</button></form>
<footer>&copy; 2020 Someone</footer></body></html>"""

ARTICLE = """<article><header><h1>A &lt;title&gt;</h1></header><p>First&nbsp; <b>bold</b> and
 <a href=x>linked</a> words.</p><div class="ad">Buy this now.</div><ul><li>point one</li><li>point two</li></ul><p>Caf&eacute; &#233;&amp
<section id="comments"><h2>Comments</h2><p>I like this article, it is a great thing to read and share.</p></section></article>"""


def test_article_without_the_rest():
    assert W.extract(CHROME % ARTICLE) == "A <title>\nFirst bold and linked words.\npoint one\npoint two\nCafé é&"


def test_pages_without_an_article_element():
    body = '<div class="story"><h2>Head</h2><p>Some text that goes on for a while, as stories do.</p><p>More of it.</p></div>'
    assert W.extract(CHROME % body) == "Head\nSome text that goes on for a while, as stories do.\nMore of it."
    plain = "<div><p>Some text that goes on for a while, as stories do in the end.</p><p>Short one.</p></div>"
    assert W.extract(CHROME % plain) == "Some text that goes on for a while, as stories do in the end.\nShort one."


@pytest.mark.parametrize("cut", [10, 60, 200, 400, 700, 900, 1100])
def test_cut_pages_do_not_fail(cut):
    assert isinstance(W.extract((CHROME % ARTICLE)[:cut]), str)


@pytest.mark.parametrize("page", ["", "text", "<", "</p>", "<p", "<!--", "<script>x", "<p>a</b></i></p>", "<a>" * 3000, "<div>" * 3000 + "x", "&#x110000;&bogus;"])
def test_broken_markup(page):
    assert isinstance(W.extract(page), str)


def test_minimum_cut_equals_trying_all_labels():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 8)
        costs = [rng.choice([-3, -1, -0.5, 0.5, 1, 2, 0]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.3, 1, 2])) for _ in range(rng.randint(0, 14))]

        def paid(labels):
            own = sum(abs(c) for c, l in zip(costs, labels) if c and (c > 0) != l)
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert paid(label(costs, edges)) == pytest.approx(min(map(paid, itertools.product([False, True], repeat=n))))


def test_smoothness_turns_a_doubtful_block():
    assert label([3.0, -0.2, 3.0], [(0, 1, 0.4), (1, 2, 0.4)]) == [True, True, True]
    assert label([3.0, -2.0, 3.0], [(0, 1, 0.4), (1, 2, 0.4)]) == [True, False, True]


def test_table_with_nulls_repeats_and_long_pages(spark):
    long = "<article>" + "<p>Words that fill a long page.</p>" * 20_000 + "</article>"
    rows = [(1, "u", CHROME % ARTICLE, 5, "t"), (2, None, None, None, None), (3, "u", "", 0, ""), (4, "u", long, 0, ""), (1, "u", CHROME % ARTICLE, 5, "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    got = W.report(df).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 5 and by[2]["text"] == "" and by[3]["n_chars"] == 0
    assert by[4]["text"].count("\n") == 19_999 and by[1]["n_chars"] == len(by[1]["text"])
    assert W.report(df.limit(0)).collect() == []
