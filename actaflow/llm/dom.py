"""A forgiving reader of HTML into a small tree of block elements and their texts."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_NAMED = r"[a-zA-Z][^\s/>]*"
#: Comments, declarations, and tags with quoted attribute values.
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)({_NAMED})((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|[\"'][^>]*(?:>|\Z)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names of HTML, by what they do.
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp".split())
DROPPED = frozenset("head svg math template select datalist canvas button object audio video".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - frozenset("caption legend tbody td tfoot th thead tr".split()) | {"hr"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OF_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
#: What a start tag closes, and the elements beyond which it doesn't look.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
_CELL = frozenset(("td", "th", "caption"))
MARK = "data-keep"


class Node(NamedTuple):
    """An element, or (tag "") a block of text of it."""

    tag: str
    parent: int
    depth: int
    words: tuple[str, ...] = ()
    text: str = ""
    link_chars: int = 0
    mark: int = -1


def _words(tag: str, attributes: str) -> tuple[tuple[str, ...], str | None]:
    """Lower-case words of class, id, role and the like, and the mark of a labelled page."""
    found, mark = (_TOKEN.findall(tag) if "-" in tag else []), None
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found += _TOKEN.findall(value)
        elif name == MARK:
            mark = value
        elif name == "hidden":
            found.append("hidden")
    return tuple(x.lower() for x in found), mark


def parse(page: str | None) -> list[Node]:
    """The nodes of a page in its order, parents first; node 0 is the body.

    Missing end tags are implied, stray ones ignored, texts of scripts, styles, form fields
    and drawings left out.  Inline elements make no nodes.  A run of text between two
    borders of block elements is a node; references are decoded in it and its white space,
    a line break included, is one space.
    """
    page = page or ""
    nodes, stack = [Node("body", -1, 0)], [0]
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0  # code points of the pieces inside links
    in_link, at, end = False, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                nodes.append(Node("", top, nodes[top].depth + 1, (), text, min(linked, len(text)), nodes[top].mark))
            pieces.clear()
        linked = 0

    def close(until: int) -> None:
        """Take elements from the stack until it has ``until``."""
        flush()
        while len(stack) > until:
            open_tags[nodes[stack.pop()].tag] -= 1

    def find(tags: frozenset | set, limits: frozenset | set) -> int:
        """Place in the stack of the innermost of ``tags`` that isn't beyond ``limits``; 0 if there is none."""
        if not any(open_tags.get(x) for x in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                return k
            if tag in limits:
                return 0
        return 0

    while at < end:
        found = _MARKUP.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            piece = page[at:stop]
            pieces.append(html.unescape(piece) if "&" in piece else piece)
            if in_link:
                linked += len(pieces[-1])
        if not found:
            break
        at = found.end()
        closing, tag = found[1], found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                in_link = False
            elif tag in BLOCK or "-" in tag:
                k = find(_HEADINGS, _CELL) if tag in _HEADINGS else find({tag}, frozenset() if tag in _OF_TABLE else _CELL)
                if k:
                    close(k)
                    in_link = False
                else:
                    flush()
            continue
        if tag in RAW:
            rest = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = rest.end() if rest else end
        elif tag in DROPPED:
            at = _beyond(page, at, tag)
        elif tag == "a":
            in_link = True
        elif tag == "br":
            pieces.append("\n")
        elif tag in BLOCK or "-" in tag or tag == "hr":
            if tag in _CLOSES_P and (k := find({"p"}, _CELL)):
                close(k)
            if tag in _HEADINGS and (k := find(_HEADINGS, _CELL)):
                close(k)
            if tag in _SIBLINGS and (k := find(*_SIBLINGS[tag])):
                close(k)
            flush()
            if tag != "hr":
                words, mark = _words(tag, found[3]) if found[3] else ((), None)
                top = stack[-1]
                kept = nodes[top].mark if mark is None else int(mark)
                nodes.append(Node(tag, top, nodes[top].depth + 1, words, "", 0, kept))
                stack.append(len(nodes) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return nodes


_HEAD_ENDS = re.compile(r"</head\b[^>]*>?|(?=<(?:body|article|main|header|nav|div|p|h[1-6]|table|ul|ol|section|aside|footer|form)\b)", re.I)


def _beyond(page: str, at: int, tag: str) -> int:
    """The place behind the element ``tag`` whose start tag ends at ``at``; elements of its name nest.
    A head ends before the first element of a body, too; one without an end tag is its start tag alone."""
    if tag == "head":
        # texts of scripts and styles in the head may look like markup
        for found in re.compile(r"<(script|style|title|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|" + _HEAD_ENDS.pattern, re.I | re.S).finditer(page, at):
            if not found[1]:
                return found.end()
        return len(page)
    depth, start = 1, at
    for found in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if found[1] else 0 if found[0].endswith("/>") else 1
        if not depth:
            return found.end()
    return start
