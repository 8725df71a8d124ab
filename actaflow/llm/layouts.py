"""Labelled pages: layouts of many sites around invented texts.

Every page marks with ``data-keep`` which of its regions are the article (1) and which are
not (0); the reader of pages hands these marks to training and never to prediction.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be ca do en fi ga he in jo ka le mo no or pa qu re sa ti un ve wi xo ya zu ér öß ña ст ра ко".split()

# Names that sites give to their regions.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pagination pager topnav skip".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adslot commercial affiliate".split(),
    "footer": "footer foot copyright legal colophon imprint bottom credits".split(),
    "sidebar": "sidebar side aside rail widget widgets related recommended complementary popular trending secondary teaser".split(),
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription paywall toast disclaimer".split(),
    "comments": "comment comments commentlist reply replies respond disqus discussion reactions responses reader feedback".split(),
    "share": "share sharing social follow bookmark".split(),
    "header": "header masthead topbar logo branding brand head tagline".split(),
    "form": "form search searchbox login signin signup register contact".split(),
    "content": "article content post entry story text body main prose copy articlebody blogpost markdown news hentry maincontent".split(),
}
_TAGS = {"menu": ["nav", "menu"], "footer": ["footer"], "sidebar": ["aside"], "header": ["header"], "form": ["form"], "notice": ["aside", "dialog", "section"], "comments": ["section"], "advert": ["aside"], "share": ["section"]}


class Writer:
    """Writes one page after the numbers of a generator."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        """Prose; of one text in eight what else comes as a text: one word again and again,
        columns of words, shouting, numbers, no marks at all."""
        odd = self.rng.random()
        if odd < 0.12:
            words = [self.word() for _ in range(self.rng.randint(1, 40))]
            return (
                " ".join(words[:1] * len(words)) if odd < 0.03 else " | ".join(words) if odd < 0.06 else "!! ".join(words).upper() + "!!" if odd < 0.08
                else " ".join(str(self.rng.randint(0, 10**6)) for _ in words) if odd < 0.1 else " ".join(words)
            )
        out = []
        for _ in range(self.rng.randint(low, high)):
            words = [self.word() for _ in range(self.rng.randint(1, 22))]
            if len(words) > 8 and self.rng.random() < 0.6:
                words[len(words) // 2] += ","
            out.append(" ".join(words).capitalize() + self.rng.choice(".....?!"))
        return " ".join(out)

    def region(self, kind: str, inner: str, keep: int | None = None) -> str:
        """``inner`` in an element that is named for its kind by its tag, its class, both or, seldom, neither."""
        rng, name, at = self.rng, self.rng.choice(NAMES[kind]), ""
        tag, told = "div", rng.random()
        if told < 0.45 and kind in _TAGS:
            tag = rng.choice(_TAGS[kind])
            told = rng.random() * 2
        elif told > 0.93:
            tag, name = rng.choice(["div", "section", "div"]), f"c{rng.randint(1, 99)}"
        if tag == "section" or told < 0.96:
            extra = rng.choice(["", "", f" {rng.choice(['box', 'wrap', 'left', 'inner', 'block'])}", "-" + rng.choice(["wrap", "area", "block", "list"])])
            at = f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "site-", "js-", "page-"])}{name}{extra}"'
        return f'<{tag}{at} data-keep="{int(kind == "content") if keep is None else keep}">{inner}</{tag}>'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(1, self.rng.choice([2, 6]))}</a>' for _ in range(self.rng.randint(low, high))]
        shape = self.rng.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if shape < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def boilerplate(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            inner = self.links(1, 12)
        elif kind == "advert":
            inner = rng.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f'<a href="/x">{self.phrase(2, 9)}</a>', f"<h3>{self.phrase(2, 5)}</h3><p>{self.sentences(1, 4)}</p>"])
        elif kind == "footer":
            inner = f"{rng.choice(['&copy;', '©', 'Copyright', ''])} {self.word()}.example &middot; {self.sentences(1, 3)}" + (self.links(2, 8) if rng.random() < 0.5 else "")
            inner = inner if rng.random() < 0.5 else f"<p>{inner}</p><p>{self.sentences(1, 2)}</p>"
        elif kind == "sidebar":
            inner = "".join(f"<h3>{self.phrase(1, 3)}</h3>" + rng.choice([self.links(2, 8), f"<p>{self.sentences(1, 5)}</p>", f"<p>{self.phrase(3, 9)}</p>"]) for _ in range(rng.randint(1, 4)))
        elif kind == "notice":
            inner = f"<p>{self.sentences(1, 4)}</p>" + rng.choice(["", "<button>OK</button>", f'<a href="/p">{self.phrase(1, 2)}</a>'])
            inner = rng.choice([inner, self.sentences(1, 3), f"<h2>{self.phrase(1, 4)}</h2>{inner}"])
        elif kind == "comments":
            inner = f"<h{rng.randint(2, 4)}>{rng.randint(1, 90)} {self.phrase(1, 1)}</h{3}>" if rng.random() < 0.6 else ""
            shape = rng.random()
            for _ in range(rng.randint(1, 6)):
                one = f"<b>{self.word()}</b> {rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 25)}<p>{self.sentences(1, 6)}</p>"
                inner += f"<li>{one}</li>" if shape < 0.3 else f'<div class="{rng.choice(NAMES["comments"])}">{one}</div>' if shape < 0.7 else f"<p>{self.word()}: {self.sentences(1, 5)}</p>"
        elif kind == "share":
            inner = rng.choice([self.links(2, 5), f"<span>{self.phrase(1, 2)}</span> <a href='/s'>{self.word()}</a>"])
        elif kind == "header":
            inner = rng.choice([f"<h1>{self.phrase(1, 3)}</h1>", f"<p>{self.phrase(1, 3)}</p>", f'<a href="/">{self.phrase(1, 2)}</a>']) + rng.choice(["", f"<p>{self.phrase(3, 8)}</p>", self.links(2, 6)])
        else:
            inner = "".join(f"<label>{self.phrase(1, 3)} <input name=x></label>" + rng.choice(["", "<br>"]) for _ in range(rng.randint(1, 5))) + rng.choice(["<button>Go</button>", f"<p>{self.sentences(1, 2)}</p>", f"<select><option>{self.word()}</select>"])
        return self.region(kind, inner, 0)

    def article(self) -> str:
        """Blocks of an article, now and then with something between them that isn't of it."""
        rng, out = self.rng, []
        if rng.random() < 0.85:
            head = f"<h{rng.choice([1, 1, 1, 2])}>{self.phrase(1, 14)}{rng.choice(['', '.'])}</h1>"
            out.append(head if rng.random() < 0.85 else f"<header>{head}</header>")
        soup = rng.random() < 0.3
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            text = self.sentences(1, rng.choice([1, 1, 3, 9]))
            if kind < 0.6:
                out.append(f"<p><b>{text}<br>" if soup and rng.random() < 0.5 else f"<p>{text}</p>")
            elif kind < 0.66:
                out.append(f"<p>{self.phrase(1, 1)}.</p>")
            elif kind < 0.72:
                out.append(f"<h{rng.randint(2, 4)}>{self.phrase(1, 7)}</h2>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote>{rng.choice([text, f'<p>{text}</p>'])}</blockquote>")
            elif kind < 0.86:
                out.append("<table>" + "".join(f"<tr><th>{self.phrase(1, 2)}</th><td>{self.phrase(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.89:
                out.append(f"<pre>{self.phrase(2, 20)}</pre>")
            elif kind < 0.92:
                out.append(f"<figure><img src=a.png><figcaption>{self.sentences(1, 1)}</figcaption></figure>")
            elif kind < 0.95:
                out.append(f"<p>{self.phrase(1, 6)} <a href='/y'>{self.phrase(1, 6)}</a>, {text}</p>")
            else:
                out.append(f"<div>{text}</div>")
            if rng.random() < 0.07:
                out.append(self.boilerplate(rng.choice(["advert", "share", "sidebar", "notice", "form", "menu"])))
        if rng.random() < 0.15:
            out.append(self.boilerplate(rng.choice(["comments", "share", "sidebar"])))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        inner = self.article()
        shape = rng.random()
        if shape < 0.35:
            inner = f'<article data-keep="1">{inner}</article>'
        elif shape < 0.5:
            inner = f'<main data-keep="1">{inner}</main>'
        elif shape < 0.8:
            inner = self.region("content", inner)
        elif shape < 0.9:
            inner = f'<div data-keep="1">{inner}</div>'
        else:
            inner = f'<section data-keep="1"><div>{inner}</div></section>'
        before = [self.boilerplate(k) for k in ("notice", "header", "menu", "form", "advert", "sidebar") if rng.random() < 0.4]
        after = [self.boilerplate(k) for k in ("share", "advert", "sidebar", "comments", "form", "menu", "notice", "footer") if rng.random() < 0.4]
        rng.shuffle(before), rng.shuffle(after)
        if rng.random() < 0.2:
            inner = f"<table><tr><td>{''.join(before)}</td><td>{inner}</td><td>{''.join(after)}</td></tr></table>"
        else:
            if rng.random() < 0.35:
                side = self.boilerplate("sidebar")
                inner = rng.choice(["<div>{}{}</div>", "<main>{}{}</main>", '<div class="container row">{}{}</div>']).format(*(rng.sample([inner, side], 2)))
            inner = "".join(before) + inner + "".join(after)
        if rng.random() < 0.1:
            inner = f"<form method=post>{inner}</form>"
        return f'<!DOCTYPE html><html><head><title>{self.phrase(2, 9)}</title><style>p{{margin:0}}</style></head><body><div class="{rng.choice(["page", "wrapper", "site", "x", "content", "main"])}">{inner}</div>' + rng.choice(["", "</body></html>"])


def labelled_pages(n: int = 400, seed: int = 12) -> list[str]:
    """``n`` labelled pages; the same ones for the same numbers."""
    rng = random.Random(seed)
    return [Writer(rng).page() for _ in range(n)]
