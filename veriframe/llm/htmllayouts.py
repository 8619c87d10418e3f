"""Generated page layouts with the truth of each block, from which :func:`htmltext.fit` learns its weights.

A layout has an article among menus, headers, footers, sidebars, notices, adverts, forms and readers' comments, in
changing order and markup. A third of the layouts name their parts by elements, a third by classes, a third by neither.
Words are invented, so that weights can only learn from form.
"""

from __future__ import annotations

import random

from veriframe.llm import htmltext

#: Names of parts: the element, and classes of a div.
PARTS = {
    "menu": ("nav", ("nav", "menu", "topbar", "main-navigation")),
    "header": ("header", ("header", "masthead", "site-head")),
    "footer": ("footer", ("footer", "site-footer", "copyright")),
    "side": ("aside", ("sidebar", "related", "widget")),
    "notice": ("dialog", ("cookie-notice", "popup", "gdpr")),
    "advert": ("aside", ("ad", "advert", "sponsored")),
    "form": ("form", ("newsletter", "signup", "search")),
    "comments": ("section", ("comments", "replies")),
    "article": ("article", ("content", "post", "entry-body")),
}


class _Page:
    def __init__(self, r: random.Random) -> None:
        self.r, self.style, self.out, self.keep = r, r.randrange(3), [], []
        syllables = ["".join(r.choices("bdfgklmnprstvz", k=1)) + r.choice("aeiou") for _ in range(30)]
        self.words = ["".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(300)]

    def text(self, low: int, high: int, stop: bool = True) -> str:
        w = self.r.choices(self.words, k=self.r.randrange(low, high + 1))
        w[0] = w[0].capitalize()
        for i in range(self.r.randrange(8, 16), len(w) - 2, 12):
            w[i] += "."
            w[i + 1] = w[i + 1].capitalize()
        return " ".join(w) + ("." if stop else "")

    def block(self, tag: str, text: str, keep: bool, link: bool = False) -> None:
        if keep and self.r.random() < 0.25:  # links inside a sentence
            w = text.split()
            i = self.r.randrange(len(w))
            text = " ".join([*w[:i], "<a href=x>" + " ".join(w[i : i + 3]) + "</a>", *w[i + 3 :]])
        self.out.append(f"<{tag}>" + (f"<a href=x>{text}</a>" if link else text) + f"</{tag}>")
        self.keep.append(keep)

    def part(self, name: str, inside) -> None:
        element, classes = PARTS[name]
        r = self.r
        if self.style == 0 and not (name == "advert" and r.random() < 0.5):
            open_, close = f"<{element}>" if element != "section" else "<section id=comments>", f"</{element}>"
        elif self.style <= 1:
            open_, close = f'<div class="{r.choice(classes)}">', "</div>"
        else:
            open_, close = "<div>", "</div>"
        self.out.append(open_)
        inside()
        self.out.append(close)

    def links(self, low: int, high: int) -> None:
        tag = self.r.choice(("li", "li", "div", "p"))
        self.out.append("<ul>" if tag == "li" else "<div>")
        for _ in range(self.r.randrange(low, high)):
            self.block(tag, self.text(1, 4, False), False, link=True)
        self.out.append("</ul>" if tag == "li" else "</div>")

    def lines(self, low: int, high: int, short: int, long: int, keep: bool = False, tag: str = "p") -> None:
        for _ in range(self.r.randrange(low, high)):
            self.block(tag, self.text(short, long, self.r.random() < 0.8), keep)

    def article(self) -> None:
        r = self.r
        inner = self.style < 2 and r.random() < 0.3
        self.out.append("<header>" if inner else "")
        if r.random() < 0.85:
            self.block("h1", self.text(3, 14, False), True)
        self.out.append("</header>" if inner else "")
        brief = r.random() < 0.2  # a short article of short paragraphs
        for _ in range(r.randrange(1, 4) if brief else r.randrange(2, 14)):
            what = r.random()
            if brief:
                self.block("p", self.text(5, 20), True)
            elif what < 0.62:
                self.block("p", self.text(18, 110), True)
            elif what < 0.74:
                self.block("p", self.text(2, 14, r.random() < 0.8), True)
            elif what < 0.82:
                self.block("h2", self.text(2, 7, False), True)
            elif what < 0.88:
                self.out.append("<ul>")
                self.lines(2, 6, 3, 16, True, "li")
                self.out.append("</ul>")
            elif what < 0.92:
                self.out.append("<blockquote>")
                self.block("p", self.text(6, 40), True)
                self.out.append("</blockquote>")
            elif what < 0.96 and self.style < 2:
                self.part("advert", lambda: self.lines(1, 2, 3, 16))
            elif what < 0.98:
                self.out.append(f"<p {r.choice(('hidden', 'style=display:none'))}>{self.text(3, 40)}</p>")
                self.keep.append(False)
            else:
                self.out.append("<table><tr>")
                self.lines(2, 5, 1, 8, True, "td")
                self.out.append("</table>")

    def made(self) -> tuple[str, list[bool]]:
        r = self.r
        bare = r.random() < 0.15  # nothing but text
        some = lambda p, f: f() if r.random() < p and not bare else None
        some(0.7, lambda: self.part("header", lambda: (self.block("p", self.text(1, 4, False), False, r.random() < 0.7), some(0.5, lambda: self.block("p", self.text(4, 12), False)))))
        some(0.8, lambda: self.part("menu", lambda: self.links(3, 10)))
        some(0.3, lambda: self.part("notice", lambda: self.lines(1, 3, 6, 16)))
        some(0.6, lambda: self.part("advert", lambda: self.lines(1, 2, 3, 13, tag=r.choice(("p", "div")))) if r.random() < 0.5 else self.part("advert", lambda: (self.out.append(self.text(3, 13)), self.keep.append(False))))
        some(0.3, lambda: self.part("side", lambda: (self.block("h3", self.text(1, 3, False), False), self.links(2, 7))))
        if r.random() < 0.3:
            self.out.append("<div>")
        self.part("article", self.article)
        some(0.4, lambda: self.part("comments", lambda: (self.block("h3", self.text(1, 2, False), False), [(self.block("h4", self.text(1, 2, False), False, True), self.block("p", self.text(3, 30), False)) for _ in range(r.randrange(1, 5))])))
        some(0.4, lambda: self.part("side", lambda: (self.block("h3", self.text(1, 3, False), False), self.lines(1, 3, 6, 18), self.links(2, 7))))
        some(0.3, lambda: self.part("form", lambda: (self.block("p", self.text(4, 12), False), self.block(r.choice(("label", "div")), self.text(1, 2, False), False))))
        some(0.9, lambda: self.part("footer", lambda: (some(0.5, lambda: self.links(2, 8)), self.block("p", f"{'© 2024 ' if r.random() < 0.8 else ''}{self.text(1, 13, r.random() < 0.6)}", False))))
        return f"<html><body>{''.join(self.out)}</body></html>", self.keep


def pages(number: int, seed: int = 1) -> list[tuple[str, list[bool]]]:
    """(html, whether each block is content) of ``number`` layouts."""
    r = random.Random(seed)
    return [_Page(random.Random(r.random())).made() for _ in range(number)]


def labelled(number: int, seed: int = 1) -> list[tuple[list[htmltext.Block], list[bool]]]:
    """(blocks, truth) of ``number`` layouts."""
    return [(htmltext.blocks_of(h), t) for h, t in pages(number, seed)]
