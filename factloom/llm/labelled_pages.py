"""Labelled pages from which the main-text model is trained: varied layouts whose article is marked.

The pages are put together from the pieces below by a seeded choice. ``data-label="1"`` marks an element whose text is the
article's, down to an element marked ``"0"``; unmarked roots are not. The model never sees the attribute.
"""

from __future__ import annotations

import numpy as np

SEED = 11
PAGES = 240  # bound of the labelled sample

_SYLLABLES = "ba den ri tor lin ka mes ovi ul sta per no gra fi sol en ti ar qua lo".split()
_MENU = ("nav", 'nav class="menu"', 'div class="navbar"', 'div id="navigation"', 'ul class="nav menu"', 'div role="navigation"', 'div class="breadcrumbs"', "div")
_HEADER = ("header", 'header class="site-header"', 'div id="header"', 'div class="masthead"', 'div role="banner"')
_FOOTER = ("footer", 'footer class="site-footer"', 'div id="footer"', 'div class="footer copyright"', 'div role="contentinfo"')
_SIDE = ("aside", 'aside class="sidebar"', 'div id="sidebar"', 'div class="widget related"', 'section class="recommended"', 'div class="col side"')
_ADVERT = ('div class="ad"', 'div class="ads"', 'div id="ad-top"', 'div class="advert banner"', 'aside class="sponsored"', 'section class="promo"', 'p class="advertisement"')
_NOTICE = ('div class="cookie-notice"', 'div id="consent"', 'div class="alert notice"', 'section class="newsletter"', 'div class="popup modal"', 'p class="notice"', 'div role="dialog"', 'div class="disclaimer"')
_COMMENTS = ('section id="comments"', 'div class="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div id="disqus_thread"', 'section class="replies discussion"')
_ARTICLE = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry"', 'section class="story"', 'div id="main"', 'div class="article-text"', "td", 'div role="main"', "div")


class _Writer:
    def __init__(self, seed: int):
        self.pick = np.random.default_rng([SEED, seed])

    def one(self, options):
        return options[int(self.pick.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.pick.random() < p

    def words(self, low: int, high: int) -> str:
        made = ["".join(self.pick.choice(_SYLLABLES, int(self.pick.integers(1, 4)))) for _ in range(int(self.pick.integers(low, high + 1)))]
        return " ".join(made)

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(3, 14).capitalize() + self.one((".", ".", ".", "?")) for _ in range(sentences))

    def element(self, opening: str, inside: str, label: str = "") -> str:
        mark = f' data-label="{label}"' if label else ""
        return f"<{opening}{mark}>{inside}</{opening.split()[0]}>"

    def links(self, count: int, wrap: str = "li") -> str:
        return "".join(self.element(wrap, f'<a href="#">{self.words(1, 3)}</a>') for _ in range(count))

    def menu(self) -> str:
        return self.element(self.one(_MENU), f"<ul>{self.links(int(self.pick.integers(3, 8)))}</ul>")

    def header(self) -> str:
        return self.element(self.one(_HEADER), self.one(("", self.menu())) + self.element(self.one(("p", "div", "h2", "span")), self.words(2, 5)))

    def footer(self) -> str:
        return self.element(self.one(_FOOTER), f"&copy; {self.words(1, 3)} &middot; " + self.one((self.prose(1), self.links(4, "span"), self.element("p", self.prose(2)))))

    def side(self) -> str:
        inside = self.one((self.element("ul", self.links(5)), "".join(self.element("p", self.prose(1)) for _ in range(2)), self.element("div", f'<a href="#">{self.words(4, 9)}</a>')))
        return self.element(self.one(_SIDE), self.element("h3", self.words(1, 3)) + inside)

    def advert(self) -> str:
        return self.element(self.one(_ADVERT), self.one((self.prose(1), f'<a href="#">{self.words(3, 8)}</a>', self.element("p", self.prose(2)))), "0")

    def notice(self) -> str:
        return self.element(self.one(_NOTICE), self.one((self.prose(2), self.element("p", self.prose(2)) + "<button>OK</button>")), "0")

    def form(self) -> str:
        return self.element(self.one(("form", 'form class="search"', 'div class="login form"')), f"<label>{self.words(1, 3)}</label><input>{self.element('p', self.prose(1))}", "0")

    def comments(self) -> str:
        each = self.one(('div class="comment"', 'li class="comment"', "li", "div", 'article class="comment"'))
        entries = "".join(self.element(each, self.element("p", self.words(1, 2)) + self.element("p", self.prose(int(self.pick.integers(1, 5))))) for _ in range(int(self.pick.integers(1, 5))))
        return self.element(self.one(_COMMENTS), self.element("h3", self.words(1, 2)) + entries, "0")

    def body(self) -> str:
        blocks = []
        for _ in range(int(self.pick.integers(1, 9))):
            prose = self.prose(int(self.pick.integers(1, 9)))
            kind = self.pick.random()
            if kind < 0.70:
                prose = prose.replace(" ", f' <a href="#">{self.words(1, 2)}</a> ', 1) if self.chance(0.2) else prose
                blocks.append(self.element("p", f"<b>{prose}" if self.chance(0.1) else prose))
            elif kind < 0.78:
                blocks.append(self.element(self.one(("h2", "h3")), self.words(1, 6)))
            elif kind < 0.84:
                blocks.append(self.element(self.one(("ul", "ol")), "".join(self.element("li", self.one((self.prose(1), self.words(2, 6)))) for _ in range(4))))
            elif kind < 0.88:
                blocks.append(self.element("blockquote", self.one((prose, self.element("p", prose)))))
            elif kind < 0.91:
                blocks.append(self.element("pre", prose))
            elif kind < 0.94:
                blocks.append(self.element("table", self.element("tr", "".join(self.element("td", self.words(1, 4)) for _ in range(3)))))
            elif kind < 0.97:
                blocks.append(self.element("figure", "<img>" + self.element("figcaption", self.words(3, 8))))
            else:
                blocks.append(self.element(self.one(("div", "section")), self.one((prose, self.element("p", prose)))))
            if self.chance(0.06):
                blocks.append(self.one((self.advert, self.notice, self.form))())
        return "".join(blocks)

    def page(self) -> str:
        title = self.words(2, 9).capitalize()
        heading = self.one(("", self.element("h1", title), self.element("h1", title), self.element("header", self.element("h1", title))))
        article = self.element(self.one(_ARTICLE), heading + self.body() + (self.comments() if self.chance(0.12) else ""), "1")
        if article.startswith("<td"):
            article = self.element("table", self.element("tr", self.element("td", self.links(4, "div")) + article))
        for _ in range(int(self.pick.integers(0, 3))):
            article = self.element(self.one(("div", "div", 'div class="wrapper"', 'div class="container"', "main", "section")), article)
        before = [p() for p, often in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.7), (self.advert, 0.5), (self.form, 0.2), (self.side, 0.2)) if self.chance(often)]
        after = [p() for p, often in ((self.advert, 0.2), (self.side, 0.4), (self.comments, 0.4), (self.form, 0.2), (self.menu, 0.2), (self.footer, 0.8), (self.notice, 0.2)) if self.chance(often)]
        return f"<html><head><title>{title}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def labelled_pages(count: int = PAGES) -> list[str]:
    return [_Writer(k).page() for k in range(count)]
