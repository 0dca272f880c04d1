"""Pages written by hand in layouts that the training pages do not have, pages of 1 MB, and odd columns."""

import time

import pytest

from stemma.llm import html_crf

HAND = [
    # a blog with a theme's own class names
    ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Rust | Gardening notes</title><link rel=stylesheet href=a.css>
<script async src=x.js></script></head><body class="home single"><div id="masthead" class="site-header"><a href="/" rel=home>Gardening notes</a>
<nav id="site-navigation"><ul class=menu><li><a href=/about>About</a><li><a href=/archive>Archive</a></ul></nav></div>
<div id=content class="site-content"><main><article id="post-17" class="post hentry"><h1 class="entry-title">Dealing with rust on pear trees</h1>
<div class="entry-content"><p>Orange spots on the leaves are the first sign.</p><p>Remove affected leaves &mdash; and burn them.</p>
<h2>When to act</h2><ol><li>Early in May, before the rain.</li><li>Again in June.</li></ol><pre>spray: 2 g / l</pre></div></article>
<section id="comments" class="comments-area"><h3>2 thoughts</h3><ol class="comment-list"><li class="comment"><p>Worked for me, thank you.</p></li></ol></section></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href=/p1>Peat</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer">Proudly made in a shed</footer></body></html>""",
     ["Dealing with rust on pear trees", "Orange spots on the leaves are the first sign.", "Remove affected leaves — and burn them.", "When to act", "Early in May, before the rain.", "Again in June.", "spray: 2 g / l"]),
    # an article as bare divs, tables for layout outside
    ("""<html><body><table width=100%><tr><td><div class="navbar"><a href=1>News</a> | <a href=2>Sport</a></div></td></tr></table>
<div class="article-body"><h1>Bridge reopens</h1><div>The old bridge was opened again on Monday, after repairs that took two years.</div>
<div>Traffic was light, the mayor said.</div><blockquote>We are glad that it is done.</blockquote></div>
<div class="ads">Buy tyres now, at half the price!</div><div class="footer">Contact us by mail.</div></body></html>""",
     ["Bridge reopens", "The old bridge was opened again on Monday, after repairs that took two years.", "Traffic was light, the mayor said.", "We are glad that it is done."]),
    # mathematics and a figure within the text; a form and a notice before it
    ("""<body><div class="cookie-banner"><p>This site stores cookies on your device.</p><button>Accept</button></div><header><form role=search><input name=q><button>Go</button></form></header>
<main><h1>Squares</h1><p>Take a number <math><mi>x</mi></math> and its square.</p><figure><img src=a.png><figcaption>A square of side two.</figcaption></figure>
<p>An unclosed <object data=x>is no reason to stop.</p><p>The end of the proof.</p></main><footer><p>All rights reserved.</p></footer>""",
     ["Squares", "Take a number x and its square.", "A square of side two.", "An unclosed is no reason to stop.", "The end of the proof."]),
]


@pytest.mark.parametrize("k", range(len(HAND)))
def test_hand_written(k):
    page, want = HAND[k]
    got = html_crf.main_text(page, html_crf.trained_field()).split("\n")
    assert len(set(got) ^ set(want)) <= 1 and [x for x in got if x in want] == [x for x in want if x in got]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 200_000, "".join(f"<div class=c{i}>x" for i in range(40_000)), "<!x " * 200_000, "<p>" + "</span>" * 200_000, '<a "' * 200_000, "<p>x" * 200_000, "&amp;" * 200_000, "<p>" + "word " * 200_000])
def test_pages_of_1_mb(page):
    field, began = html_crf.trained_field(), time.time()
    html_crf.main_text(page, field)
    assert time.time() - began < 30


def test_other_columns(spark):
    rows = [(1, "<article><p>A short text, with one comma.</p></article>", "u", "clash", 5)]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id int, html string, url string, text string, n_chars int")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "A short text, with one comma.", 29)]


def test_nothing_cuts_an_article():
    for tag in ("svg", "math", "object", "video", "canvas", "noscript", "template"):
        found = html_crf.blocks(f"<p>one <{tag}>two<p>three")
        assert " ".join(b.text for b in found) == "one two three"
    assert [b.text for b in html_crf.blocks("<p>one<script>two<p>three")] == ["one"]
