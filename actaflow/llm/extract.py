"""Main text of web pages by a tree-structured graphical model.

The block elements and the texts of a page are the nodes of a tree; each is content or
not.  A log-linear potential of a node reads its element, the words of its class and id,
and what is below it (links, words, punctuation, its share of the page); a potential of a
node and its parent says how likely the two differ.  Messages go up from the leaves to the
body and down again (sum-product), which gives each node's exact marginal; texts with a
marginal of at least 1/2 are the main text.  The weights are fitted by maximum likelihood
to labelled pages: the gradient is what the labels count less what the messages expect.

Trees of many pages are handled side by side: all nodes of one depth send their messages
in one step.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from actaflow.llm.dom import Node, parse
from actaflow.llm.layouts import NAMES, labelled_pages

#: Elements that have a weight of their own; the others share one.
TAGS = ["", "body", "article", "main", "nav", "menu", "header", "footer", "aside", "form", "fieldset", "p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "td", "table", "blockquote", "pre", "figure", "figcaption", "div", "section", "dialog", "address", "dd"]
_TAG = {t: i for i, t in enumerate(TAGS)} | {"h5": TAGS.index("h4"), "h6": TAGS.index("h4"), "th": TAGS.index("td"), "dt": TAGS.index("dd"), "legend": TAGS.index("fieldset")}
KINDS = list(NAMES)
_KIND = {}
for _bit, _names in enumerate(NAMES.values()):
    for _name in _names:
        _KIND[_name] = _KIND.get(_name, 0) | 1 << _bit
_CONTENT = 1 << KINDS.index("content")
_FORM, _HEADER = 1 << KINDS.index("form"), 1 << KINDS.index("header")
_BOILERPLATE_TAGS, _CONTENT_TAGS, _FORM_TAGS = ([TAGS.index(t) for t in names.split()] for names in ("nav menu header footer aside dialog", "article main", "form fieldset"))
#: What the nearest named element around a node (itself included) is named as: nothing, content, boilerplate, form.
AROUND = 4
#: Kinds of a node as its parent sees it: a text, an element without a name, one named as boilerplate, one named as content.
EDGES = 4
PAGES, SEED = 400, 12
#: Steps, step size and weight decay of the fit.
STEPS, RATE, DECAY = 150, 0.2, 2e-4
#: Code points of HTML whose trees are handled side by side.
BATCH_CHARS = 2 << 20


class Forest(NamedTuple):
    """Trees of pages, one behind the other; ``level`` has the nodes of each depth."""

    parent: np.ndarray
    level: list[np.ndarray]
    features: np.ndarray
    edge: np.ndarray
    mark: np.ndarray
    text: list[str]
    page: np.ndarray


class Model(NamedTuple):
    """Weights of a node's features for content, and [kind, parent, child] of the edges."""

    unary: np.ndarray
    pair: np.ndarray


def _kind_bits(words: tuple[str, ...]) -> int:
    bits = 0
    for word in words:
        bits |= _KIND.get(word) or _KIND.get(word.rstrip("s"), 0)
    return bits


def forest(pages: Iterable[list[Node]]) -> Forest:
    nodes, parent, page = [], [], []
    for k, tree in enumerate(pages):
        base = len(nodes)
        nodes += tree
        parent += [base + n.parent if n.parent >= 0 else -1 for n in tree]
        page += [k] * len(tree)
    n = len(nodes)
    parent, page = np.array(parent, np.int64), np.array(page, np.int64)
    depth = np.fromiter((x.depth for x in nodes), np.int64, n)
    tag = np.fromiter((_TAG.get(x.tag, len(TAGS)) for x in nodes), np.int64, n)
    bits = np.fromiter((_kind_bits(x.words) if x.words else 0 for x in nodes), np.int64, n)
    texts = [x.text for x in nodes]
    is_text = np.fromiter((bool(t) for t in texts), bool, n)
    # of the texts: words, code points, those in links, punctuation, signs of rights; summed up for the elements
    own = np.zeros((n, 6))
    for i in np.flatnonzero(is_text):
        t = texts[i]
        own[i] = 1 + t.count(" "), len(t), nodes[i].link_chars, t.count(".") + t.count(",") + t.count("?") + t.count("!"), "©" in t, 1
    order = np.argsort(depth, kind="stable")
    level = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    below = own.copy()
    for at in level[:0:-1]:
        np.add.at(below, parent[at], below[at])
    roots = np.flatnonzero(parent < 0)
    whole = below[roots][page] if n else below
    words, chars, links, marks, rights, leaves = below.T
    first = np.concatenate([[0], np.cumsum(own[:, 5])])[:-1] if n else np.empty(0)
    place = (first - first[roots][page]) / np.maximum(1, whole[:, 5]) if n else first
    link = links / np.maximum(1, chars)
    named = (bits & ~(_CONTENT | _FORM) > 0) | np.isin(tag, _BOILERPLATE_TAGS)
    content = (bits & _CONTENT > 0) | np.isin(tag, _CONTENT_TAGS)
    around = np.where(named, 2, np.where((bits & _FORM > 0) | np.isin(tag, _FORM_TAGS), 3, np.where(content, 1, 0)))
    edge = np.where(is_text, 0, np.where(around == 0, 1, np.where(around == 1, 3, 2)))
    within, head = content & ~named, (bits & _HEADER > 0) | (tag == TAGS.index("header"))
    for at in level[1:]:
        head[at] |= head[parent[at]]
        around[at] = np.where(around[at] == 0, around[parent[at]], around[at])
        within[at] |= within[parent[at]]
    columns = [
        np.ones(n), is_text, np.log1p(words), link, np.log1p(words) * (1 - link), np.minimum(0.3, marks / np.maximum(1, words)), marks > 0, rights > 0, words / np.maximum(1, whole[:, 0]),
        np.log1p(words / np.maximum(1, leaves)), np.log1p(leaves), place, place**2, place > 0.9, np.minimum(depth, 20) / 10, chars == 0, within, within & head,
    ]
    columns += [tag == t for t in range(len(TAGS) + 1)] + [bits >> k & 1 for k in range(len(KINDS))] + [around == k for k in range(AROUND)]
    mark = np.fromiter((x.mark for x in nodes), np.int64, n)
    return Forest(parent, level, np.stack(columns, 1).astype(np.float32), edge, mark, texts, page)


FEATURES = 18 + len(TAGS) + 1 + len(KINDS) + AROUND


def messages(trees: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The marginal of content of each node, and [node, parent's state, state] for its edge (roots: zero)."""
    n = len(trees.parent)
    inside = np.zeros((n, 2))
    inside[:, 1] = trees.features @ model.unary
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    pair = model.pair[trees.edge]
    for at in trees.level[:0:-1]:  # children are complete before their parents
        up[at] = np.logaddexp(pair[at, :, 0] + inside[at, 0, None], pair[at, :, 1] + inside[at, 1, None])
        np.add.at(inside, trees.parent[at], up[at])
    for at in trees.level[1:]:
        above = trees.parent[at]
        outside = inside[above] + down[above] - up[at]
        down[at] = np.logaddexp(pair[at, 0] + outside[:, 0, None], pair[at, 1] + outside[:, 1, None])
    both = inside + down
    content = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    joint = np.zeros((n, 2, 2))
    at = np.flatnonzero(trees.parent >= 0)
    if len(at):
        above = trees.parent[at]
        joint[at] = (inside[above] + down[above] - up[at])[:, :, None] + pair[at] + inside[at][:, None, :]
        joint[at] = np.exp(joint[at] - joint[at].max((1, 2), keepdims=True))
        joint[at] /= joint[at].sum((1, 2), keepdims=True)
    return content, joint


def labels(trees: Forest) -> np.ndarray:
    """Of labelled pages: a text as it is marked, an element as most of the code points below it."""
    chars = np.fromiter(map(len, trees.text), float, len(trees.text))
    weigh = np.stack([chars, chars * (trees.mark == 1)], 1)
    for at in trees.level[:0:-1]:
        np.add.at(weigh, trees.parent[at], weigh[at])
    return (2 * weigh[:, 1] > weigh[:, 0]).astype(np.int64)


def train(labelled: Iterable[str], steps: int = STEPS) -> Model:
    """Weights for labelled pages, by Adam's steps on the exact gradient."""
    trees = forest(parse(p) for p in labelled)
    y, n = labels(trees), len(trees.parent)
    child = np.flatnonzero(trees.parent >= 0)
    counted = np.zeros((EDGES, 2, 2))
    np.add.at(counted, (trees.edge[child], y[trees.parent[child]], y[child]), 1)
    weights = np.zeros(FEATURES + counted.size)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        content, joint = messages(trees, Model(weights[:FEATURES], weights[FEATURES:].reshape(counted.shape)))
        expected = np.zeros_like(counted)
        np.add.at(expected, trees.edge[child], joint[child])
        gradient = np.concatenate([(y - content) @ trees.features, (counted - expected).ravel()]) / n - DECAY * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model(weights[:FEATURES], weights[FEATURES:].reshape(counted.shape))


@functools.lru_cache(maxsize=2)
def built_in(pages: int = PAGES, seed: int = SEED) -> Model:
    """The model of the built-in layouts; fitted once in a process."""
    return train(labelled_pages(pages, seed))


def main_texts(pages: list[str | None], model: Model) -> list[list[tuple[str, float]]]:
    """Of each page its texts in their order with their marginals."""
    trees = forest(parse(p) for p in pages)
    content = messages(trees, model)[0]
    out: list[list[tuple[str, float]]] = [[] for _ in pages]
    for i in np.flatnonzero(np.fromiter((bool(t) for t in trees.text), bool, len(trees.text))):
        out[trees.page[i]].append((trees.text[i], float(content[i])))
    return out


SCHEMA = "page_id long, url string, text string, n_chars long"
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int64())


def extract_text(pages: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars: one row for each input row.

    ``text`` joins the content blocks by two line feeds, and is empty for a null or empty
    page and for one without content.  Each row is judged by its own page, whatever the
    others are: repeated rows get equal texts, null ids and addresses are passed through,
    an empty table gives no rows, other columns are not read.  A page is read as a whole;
    pages are handled side by side up to BATCH_CHARS code points.
    """
    fitted = model or built_in()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin, held, chars = 0, [], 0
            for i, page in enumerate(batch.column(2)):
                held.append(page.as_py())
                chars += len(held[-1] or "")
                if chars >= BATCH_CHARS or i + 1 == batch.num_rows:
                    texts = ["\n\n".join(t for t, p in found if p >= threshold) for found in main_texts(held, fitted)]
                    columns = (ids[begin : i + 1], urls[begin : i + 1], texts, list(map(len, texts)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=["page_id", "url", "text", "n_chars"])
                    begin, held, chars = i + 1, [], 0

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, SCHEMA)


def block_marginals(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, nth, text, content: every text of every page with its marginal."""
    fitted = model or built_in()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = main_texts([page.as_py()], fitted)[0]
                columns = ([page_id] * len(found), range(1, len(found) + 1), [t for t, _ in found], [p for _, p in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.float64()))], names=["page_id", "nth", "text", "content"])

    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(run, "page_id long, nth int, text string, content double")


#: For pages that hold their article in one <article> of paragraphs and headings, with no other
#: references than &amp; and &quot; in it.
EXTRACT_SQL = r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT r, unnest(regexp_split_to_array(body, '</?(p|h1)\b[^>]*>')) AS block, generate_subscripts(regexp_split_to_array(body, '</?(p|h1)\b[^>]*>'), 1) AS nth FROM a),
c AS (
  SELECT r, nth, trim(regexp_replace(replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(block, '<br\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&quot', '"'), '&amp;?', '&amp;', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM b
),
t AS (SELECT r, string_agg(block, chr(10) || chr(10) ORDER BY nth) AS text FROM c WHERE block <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM a LEFT JOIN t USING (r)
"""
