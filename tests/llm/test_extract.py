"""Main texts of pages: messages against enumeration, written pages, held-out layouts, odd tables."""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from actaflow.llm import extract
from actaflow.llm.dom import parse
from actaflow.llm.layouts import labelled_pages
from actaflow.llm.queries import QUERIES

SENTENCE = "The river rose by a metre in one night, and nobody in the town had seen it coming."
OTHER = "Three bridges were closed until noon; the fourth had never been finished."


def text_of(page):
    return "\n\n".join(t for t, p in extract.main_texts([page], extract.built_in())[0] if p >= 0.5)


WRITTEN = {
    "semantic": (
        f"<header><a href=/>The Daily</a><p>News since 1901</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>World</a></ul></nav>"
        f"<main><article><h1>Flood &amp; after</h1><p>{SENTENCE}</p><aside><h3>Related</h3><a href=/c>Older floods</a></aside><p>{OTHER}</p>"
        f"<div class=ad>Buy boats now. Cheap boats for all.</div><p>It is over.</p></article>"
        f"<section id=comments><h3>2 comments</h3><p>Anna: I was there and it was worse than they say.</p><p>Bob: Me too, and my cellar still is full of mud.</p></section></main>"
        f"<footer><p>&copy; 2020 The Daily. All rights reserved.</p></footer>",
        ["Flood & after", SENTENCE, OTHER, "It is over."],
    ),
    "classes": (
        f'<div id="cookie-notice"><p>We use cookies to make this site better for you.</p><button>OK</button></div><div class="topnav"><a href=/a>Home</a> | <a href=/b>Shop</a></div>'
        f'<div class="wrapper"><div class="sidebar"><h3>About me</h3><p>I write about rivers and the towns beside them, mostly at night.</p></div>'
        f'<div class="post-content"><h2>High water</h2><p>{SENTENCE} {OTHER}</p><ul><li>One boat was lost.</li><li>Two were found.</li></ul><blockquote>{OTHER}</blockquote>'
        f'<div class="share-buttons"><a href=/s>Share</a> <a href=/t>Tweet</a></div></div>'
        f'<div class="comments-area"><div class="comment"><b>Eve</b><p>What a night that was, thank you for the pictures and the words.</p></div></div></div><div class="site-footer">Copyright by me, imprint</div>',
        ["High water", f"{SENTENCE} {OTHER}", "One boat was lost.", "Two were found.", OTHER],
    ),
    "table": (
        f'<table><tr><td class="menu"><a href=/a>Home</a><br><a href=/b>Links</a></td><td class="main"><h1>High water</h1><p>{SENTENCE}<p>{OTHER}<br>It was late.</td></tr></table>'
        f'<div class="footer">Copyright &copy; 1999</div>',
        ["High water", SENTENCE, f"{OTHER} It was late."],
    ),
    "form": (
        f'<div class="content"><h1>High water</h1><p>{SENTENCE}</p><p>{OTHER}</p></div><form class="newsletter-signup"><p>Get our best stories by mail every week.</p><label>Mail <input name=m></label><button>Send</button></form>'
        f'<form id="search"><label>Search <input></label></form>',
        ["High water", SENTENCE, OTHER],
    ),
    "soup": (
        f"<title>a</title><script>var t='<p>no</p>';</script><style>p{{}}</style><nav><a href=x>y</a></nav><article><h1>High <em>water</em></h1><p><b>{SENTENCE}<br><p>It\n is&nbsp;so.</p></div><p>{OTHER}<footer>by nobody",
        ["High water", SENTENCE, "It is so.", OTHER],
    ),
    "heading in a header": (f"<article><header><h1>High water</h1></header><p>{SENTENCE}</p><p>{OTHER}</p></article>", ["High water", SENTENCE, OTHER]),
    "plain": (f"<h1>High water</h1><p>{SENTENCE}</p><p>{OTHER}</p>", ["High water", SENTENCE, OTHER]),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_written_pages(name):
    page, blocks = WRITTEN[name]
    assert text_of(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>x</title></head><body>{page}</body></html>") == "\n\n".join(blocks)


def test_messages_are_exact_marginals():
    """Against all labelings of small pages, under random weights."""
    rng = np.random.default_rng(5)
    model = extract.Model(rng.normal(size=extract.FEATURES), rng.normal(size=(extract.EDGES, 2, 2)))
    for page in ("<p>a", "<div><p>a<p>b</div>", "<div class=ad>x<p>a</p></div><ul><li>b</ul>", "", "<nav><a>x</a></nav>y"):
        trees = extract.forest([parse(page), parse("<p>another page")])
        own = np.flatnonzero(trees.page == 0)
        unary = trees.features @ model.unary
        total, marked = 0.0, np.zeros(len(own))
        joint = np.zeros((len(own), 2, 2))
        for y in itertools.product((0, 1), repeat=len(own)):
            score = sum(unary[i] for i in own if y[i]) + sum(model.pair[trees.edge[i], y[trees.parent[i]], y[i]] for i in own if i)
            weight = np.exp(score)
            total += weight
            marked += weight * np.array(y)
            for i in own[1:]:
                joint[i, y[trees.parent[i]], y[i]] += weight
        content, found = extract.messages(trees, model)
        assert np.allclose(content[own], marked / total)
        assert np.allclose(found[own], joint / total)


def test_training_climbs_and_holds_on_other_layouts():
    held = labelled_pages(250, seed=99)
    trees = extract.forest(parse(p) for p in held)
    y = extract.labels(trees)
    text = np.array([bool(t) for t in trees.text])
    right = lambda model: ((extract.messages(trees, model)[0] >= 0.5) == y)[text].mean()
    assert right(extract.built_in()) > 0.975
    short = extract.train(labelled_pages(60, 3), steps=40)
    assert right(short) > 0.9
    no_edges = extract.built_in()._replace(pair=np.zeros((extract.EDGES, 2, 2)))
    assert right(no_edges) < right(extract.built_in())  # the edges carry something


def by_pattern(page):
    """The article of the given tables' pages, by patterns."""
    body = re.search(r"(?s)<article>(.*?)(</article>|$)", page or "")
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body[1] if body else "")]
    return "\n\n".join(x for x in blocks if x)


def test_given_pages(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op12_extract_text"](spark, sf_dir).collect()
    assert len(found) == len(pages) > 0
    for r in found:
        assert r.text == by_pattern(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_tables(spark):
    good = f"<article><h1>High water</h1><p>{SENTENCE}</p></article>"
    rows = [(None, None, good, "x"), (1, "u", None, "x"), (2, "u", "", "x"), (2, "u", good, "x"), (2, "u", good, "x"), (3, "u", "<p", "x"), (4, "u", "<<<>>> &#xD800; &#0; <a '", "x"), (5, "u", "<div>" * 3000 + "deep", "x"), (6, "u", "<article>" + f"<p>{SENTENCE}</p>" * 20_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract.extract_text(pages).collect()
    assert len(found) == len(rows)
    texts = {}
    for r in found:
        texts.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[None] == [f"High water\n\n{SENTENCE}"] and texts[1] == [""] and sorted(texts[2]) == ["", texts[None][0], texts[None][0]]
    assert texts[6] == ["\n\n".join([SENTENCE] * 20_000)]
    assert extract.extract_text(pages.limit(0)).collect() == []
    blocks = extract.block_marginals(pages.where("page_id is null")).collect()
    assert [(b.nth, b.text) for b in blocks] == [(1, "High water"), (2, SENTENCE)] and all(b.content >= 0.5 for b in blocks)


def test_a_page_alone_and_among_others_is_judged_alike():
    pages = labelled_pages(30, seed=7)
    together = extract.main_texts(pages, extract.built_in())
    for page, found in zip(pages, together):
        alone = extract.main_texts([page], extract.built_in())[0]
        assert [t for t, _ in alone] == [t for t, _ in found] and np.allclose([p for _, p in alone], [p for _, p in found])
