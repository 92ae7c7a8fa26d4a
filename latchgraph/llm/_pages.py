"""Generated web pages whose main text is marked, to train extraction on."""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = "⁣"  # stands in every piece of main text; removed nowhere, as these pages are for training only
_SOUNDS = "ba ce di fo gu la me ni ro su ta ve xi jo ka lem nor pis tur and the of der les ver ion ment ing".split()
_GOOD = "article main content post entry story body text page-content post-body entry-content article-text".split()
_NEUTRAL = "wrapper container row col inner outer block section box grid layout app root left center".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SOUNDS) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(f"{self.words(4, 18).capitalize()}{self.r.choice('.....!?')}" for _ in range(self.r.randint(a, b)))

    def attribute(self, names: str, chance: float = 1.0) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names.split())
        if self.r.random() < 0.3:
            name += self.r.choice(("-wrapper", "-box", "_1", " clearfix", "-list", "-area", "-section"))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def any_attribute(self) -> str:
        return self.attribute(" ".join(_NEUTRAL), 0.4)

    def links(self, a: int, b: int) -> str:
        kind = self.r.choice(("ul", "div", "span"))
        one = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if kind == "ul" else f"<{kind}>" + " | ".join(one) + f"</{kind}>"

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        return f"<{tag}{self.attribute('nav menu navbar navigation breadcrumb topbar toc', 0 if tag == 'nav' and self.r.random() < 0.5 else 1)}>{self.links(2, 9)}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        return f"<{tag}{self.attribute('header masthead site-header branding top', 0.5 if tag == 'header' else 1)}><{self.r.choice(('div', 'p'))}>{self.words(1, 6)}</div>{self.menu() if self.r.random() < 0.6 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        text = self.r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}", f"<p>&copy; {self.words(2, 9)}</p>{self.links(2, 6)}", self.sentences(1, 3)))
        return f"<{tag}{self.attribute('footer site-footer bottom copyright colophon legal', 0.4 if tag == 'footer' else 1)}>{text}</{tag}>"

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        inside = "".join(self.r.choice((f"<h3>{self.words(1, 4)}</h3>{self.links(2, 7)}", f"<p>{self.sentences(1, 4)}</p>")) for _ in range(self.r.randint(1, 3)))
        return f"<{tag}{self.attribute('sidebar aside related widget recommended rail tags trending more', 0.5 if tag == 'aside' else 1)}>{inside}</{tag}>"

    def notice(self) -> str:
        return f"<{self.r.choice(('div', 'section', 'p'))}{self.attribute('notice cookie cookies consent alert banner warning popup modal newsletter paywall disclaimer')}>{self.sentences(1, 4)}{self.r.choice(('', '<button>' + self.words(1, 2) + '</button>'))}</div>"

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "section", "aside", "p", "ins"))
        return f"<{tag}{self.attribute('ad ads advert advertisement sponsored promo promotion adsense sponsor banner-ad')}>{self.r.choice((self.sentences(1, 4), self.words(2, 9), self.links(1, 2)))}</{tag}>"

    def form(self) -> str:
        return f"<form{self.attribute('search login subscribe signup contact newsletter form', 0.6)}><label>{self.words(1, 4)}</label><input name=q>{self.r.choice(('', '<p>' + self.sentences(1, 2) + '</p>'))}<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        one = "".join(f"<{self.r.choice(('div', 'li', 'article'))}{self.attribute('comment reply comment-body response', 0.8)}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 5)}</p></div>" for _ in range(self.r.randint(1, 5)))
        return f"<{self.r.choice(('section', 'div', 'ol'))}{self.attribute('comments comment-list discussion responses disqus reader-comments')}><h3>{self.words(1, 3)}</h3>{one}</section>"

    def share(self) -> str:
        return f"<div{self.attribute('share social sharing follow buttons meta')}>{self.links(2, 5)}</div>"

    def article(self) -> str:
        m = MARK
        parts = [f"<h1>{m}{self.words(3, 12)}</h1>"] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = self.r.random()
            text = f"{m}{self.sentences(1, 9)}"
            if kind < 0.62:
                parts.append(f"<p{self.any_attribute() if self.r.random() < 0.2 else ''}>{text}{self.r.choice(('</p>', '</p>', ''))}")
            elif kind < 0.72:
                parts.append(f"<p><b>{text}<br><p>{m}{self.sentences(1, 5)}</p>")
            elif kind < 0.8:
                parts.append(f"<h2>{m}{self.words(1, 8)}</h2><p>{text} <a href='#'>{m}{self.words(1, 3)}</a> {m}{self.sentences(1, 2)}</p>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{m}{self.sentences(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<table><tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 4)}</td></tr></table>")
            else:
                parts.append(f"<div>{text}</div>")
        for _ in range(self.r.choice((0, 0, 1, 2))):
            parts.insert(self.r.randint(0, len(parts)), self.r.choice((self.advert, self.share, self.notice, self.sidebar))())
        tag = self.r.choice(("article", "article", "main", "div", "section"))
        names = " ".join(_GOOD)
        return f"<{tag}{self.attribute(names, 0.35 if tag in ('article', 'main') else 0.85)}>{''.join(parts)}</{tag}>"

    def page(self) -> str:
        before = [self.r.choice((self.menu, self.header, self.advert, self.notice, self.form))() for _ in range(self.r.randint(0, 4))]
        after = [self.r.choice((self.footer, self.sidebar, self.comments, self.advert, self.share, self.form, self.notice))() for _ in range(self.r.randint(0, 4))]
        middle = self.article()
        if self.r.random() < 0.35:
            middle += self.r.choice((self.comments, self.sidebar))()
        if self.r.random() < 0.5:
            middle = f"<div{self.any_attribute()}>{middle}</div>"
        if self.r.random() < 0.7:
            after.append(self.footer())
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body><script>x('</p>')</script>{''.join(before)}<!-- {self.word()} -->{middle}{''.join(after)}</body></html>"
        return page if self.r.random() < 0.9 else page.removesuffix("</body></html>")


def labelled_pages(number: int, seed: int) -> Iterator[tuple[str, str]]:
    maker = _Maker(seed)
    for _ in range(number):
        yield maker.page(), MARK
