"""Labelled pages to train on: made pages of many layouts in which content blocks carry a mark."""

from __future__ import annotations

import numpy as np

#: Begins each block of text that is content; a private-use character that no other text has.
MARK = ""


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.commas, self.kinds, self.bare = 0.4, 1.0, False
        self.syllables = ["ta", "ren", "lo", "mi", "ver", "sa", "kon", "du", "pe", "ra", "el", "is", "no", "ti", "gra", "be", "und", "que", "the", "of", "in", "é", "ción"]

    def pick(self, *x):
        return x[int(self.rng.integers(len(x)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return "".join(self.pick(*self.syllables) for _ in range(int(self.rng.integers(1, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def sentence(self) -> str:
        text = self.words(1, self.pick(5, 16, 30))
        if self.chance(self.commas):
            text = text.replace(" ", ", ", int(self.rng.integers(1, 4)))
        return text.capitalize() + self.pick(".", ".", ".", "!", "?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(low, high + 1))))

    def inline(self, text: str) -> str:
        if self.chance(0.3):
            words = text.split(" ")
            k = int(self.rng.integers(len(words)))
            tag = self.pick("b", "em", "strong", "i", "a href='/x'", "span class='s'", "code")
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
            text = " ".join(words)
        return text.replace(". ", ".<br>", 1) if self.chance(0.08) else text

    def block(self) -> str:
        """A block of an article."""
        kind = self.rng.random() * self.kinds
        if kind < 0.64:
            text = self.prose(1, self.pick(2, 6, 14)) if self.chance(0.85) else self.words(1, 4).capitalize() + self.pick(".", ".", "")
            return self.pick("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p class='par'>{}</p>", "<p><b>{}<br>").format(MARK + self.inline(text))
        if kind < 0.76:
            return f"<h{(n := self.pick(2, 3, 4))}>{MARK}{self.words(1, 8).capitalize()}</h{n}>"
        if kind < 0.86:
            item = lambda: f"<li>{MARK}{self.inline(self.pick(self.words(1, 6), self.prose(1, 2)))}</li>"
            return f"<{(t := self.pick('ul', 'ol'))}>{''.join(item() for _ in range(int(self.rng.integers(2, 6))))}</{t}>"
        if kind < 0.91:
            return self.pick("<blockquote><p>{}</p></blockquote>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<div>{}</div>").format(MARK + self.prose(1, 3))
        if kind < 0.96:
            cell = lambda: f"<td>{MARK}{self.words(1, 3)}</td>"
            return f"<table><tr>{cell()}{cell()}</tr><tr>{cell()}{cell()}</tr></table>"
        if kind < 0.98:
            return f"<dl><dt>{MARK}{self.words(1, 3)}</dt><dd>{MARK}{self.prose(1, 2)}</dd></dl>"
        if kind >= 0.99:  # sources, which are links and content
            item = lambda: f"<li><a href='/{self.word()}'>{MARK}{self.words(1, 6)}</a></li>"
            return f"<h3>{MARK}{self.words(1, 3).capitalize()}</h3><{(t := self.pick('ul', 'ol'))}>{''.join(item() for _ in range(int(self.rng.integers(2, 6))))}</{t}>"
        return f"<figure><img src='/i'><figcaption>{MARK}{self.prose(1, 1)}</figcaption></figure>"

    def links(self, low: int = 3, high: int = 9) -> str:
        many = int(self.rng.integers(low, high + 1))
        if self.chance(0.7):
            return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(many)) + "</ul>"
        return self.pick(" | ", " ", " &middot; ").join(f'<a href="/{self.word()}">{self.words(1, 2)}</a>' for _ in range(many))

    def named(self, tags: tuple[str, ...], hints: tuple[str, ...], inner: str, bare: float = 0.4) -> str:
        """An element that its tag or its class or both name."""
        if self.bare:
            return f"<div>{inner}</div>"
        tag = self.pick(*tags)
        name = "" if tag != "div" and tag != "section" and tag != "ul" and tag != "ins" and self.chance(bare) else self.pick(*hints)
        key = self.pick("class", "class", "id")
        return f'<{tag} {key}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def nav(self) -> str:
        return self.named(("nav", "nav", "div"), ("nav", "menu", "navbar", "main-nav", "site-navigation", "breadcrumbs", "breadcrumb"), self.links())

    def header(self) -> str:
        inner = self.pick(f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1>", f"<div class='logo'>{self.words(1, 2)}</div><p>{self.prose(1, 1)}</p>", f"<p>{self.words(2, 6)}</p>")
        return self.named(("header", "header", "div"), ("header", "site-header", "masthead", "top", "page-header"), inner + (self.nav() if self.chance(0.5) else ""))

    def footer(self) -> str:
        parts = [f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}", f"<p>Copyright 2024 {self.words(1, 3)}. All rights reserved.</p>", f"<p>{self.prose(1, 3)}</p>", self.links(), f"<h3>{self.words(1, 2)}</h3>{self.links(2, 5)}"]
        inner = "".join(self.pick(*parts) for _ in range(int(self.rng.integers(1, 4))))
        return self.named(("footer", "footer", "div"), ("footer", "site-footer", "page-footer", "colophon", "copyright"), inner)

    def side(self) -> str:
        box = lambda: f"<div><h3>{self.words(1, 3)}</h3>{self.pick(self.links(2, 6), f'<p>{self.prose(1, 3)}</p>')}</div>"
        return self.named(("aside", "aside", "div", "section"), ("sidebar", "side", "related", "related-posts", "widget", "recommended", "popular", "right-rail"), self.pick(box() + box(), box(), f"<p>{self.prose(1, 4)}</p>", self.links()))

    def advert(self) -> str:
        return self.named(("div", "div", "aside", "ins", "section"), ("ad", "ads", "advert", "advertisement", "ad-box", "sponsored", "promo", "banner-ad", "adsbygoogle", "ad-slot"), self.pick(self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<a href='/ad'>{self.words(2, 6)}</a>"), 0.0)

    def notice(self) -> str:
        inner = self.pick(f"We use cookies. {self.prose(1, 2)}", f"<p>{self.prose(1, 3)}</p>", f"<p>This site uses cookies, {self.words(3, 8)}.</p><button>OK</button>", self.prose(1, 2))
        return self.named(("div", "div", "section", "aside"), ("cookie-notice", "cookie-banner", "consent", "notice", "alert", "notification", "popup", "gdpr", "modal", "site-notice"), inner, 0.0)

    def comments(self) -> str:
        one = lambda: self.pick("<div class='comment'><b>{}</b><p>{}</p></div>", "<li><cite>{}</cite> <p>{}</p></li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<li class='comment'>{}: {}</li>", "<p><b>{}</b> {}</p>").format(self.words(1, 2), self.prose(1, 4))
        inner = self.pick("", f"<h2>{self.words(1, 2)}</h2>", "<h3>Comments</h3>") + "".join(one() for _ in range(int(2 ** (self.rng.random() * 4.5)))) + (self.form() if self.chance(0.3) else "")
        return self.named(("section", "div", "div", "ol", "aside"), ("comments", "comment-list", "commentlist", "discussion", "reader-comments", "replies", "respond"), inner, 0.0)

    def form(self) -> str:
        inner = self.pick(f"<p>{self.prose(1, 2)}</p>", "", f"<label>{self.words(1, 3)}</label>", f"<h3>{self.words(1, 4)}</h3>") + self.pick("<input name='q'><button>Go</button>", "<label>Name</label><input><label>Mail</label><input>", "<select><option>a<option>b</select>", "<textarea>x</textarea>")
        form = f"<form action='/'{self.pick('', ' class=\"search-form\"', ' id=\"newsletter\"', ' class=\"login\"')}>{inner}</form>"
        return form if self.chance(0.7) else self.named(("div", "section"), ("newsletter", "subscribe", "search", "login-form", "signup"), form)

    def social(self) -> str:
        return self.named(("div", "ul"), ("share", "social", "share-buttons", "follow-us"), self.pick(self.links(2, 5), f"Share this: {self.links(2, 4)}"))

    def table_page(self) -> str:
        """A page laid out by a table, without names: links in one cell, the article in another."""
        inner = f"<h1>{MARK}{self.words(2, 8).capitalize()}</h1>" + "".join(self.block() for _ in range(int(self.rng.integers(3, 16))))
        top = self.pick("", f"<tr><td colspan=2>{self.pick(self.links(), f'<b>{self.words(1, 3)}</b>')}</td></tr>")
        low = self.pick("", f"<tr><td colspan=2>&copy; 2024 {self.words(1, 3)}</td></tr>")
        cells = [f"<td>{self.links()}</td>", f"<td>{inner}</td>"]
        return f"<html><head><title>{self.words(1, 6)}</title></head><body><table>{top}<tr>{''.join(cells if self.chance(0.7) else cells[::-1])}</tr>{low}</table></body></html>"

    def page(self) -> str:
        self.commas, self.kinds = self.rng.random(), self.pick(0.5, 0.7, 1.0)  # half have few kinds of blocks
        body = [self.block() for _ in range(int(2 ** (self.rng.random() * 5.5 * self.pick(0.3, 1, 1))))]
        if self.chance(0.04):
            return self.table_page()
        self.bare = self.chance(0.1)  # a page without any names, whose links and notices must tell
        headline = f"<h1>{MARK}{self.words(2, 10).capitalize()}</h1>"
        if self.bare:
            body = [self.block() for _ in range(int(self.rng.integers(3, 20)))]
            inner = "".join([headline, *body])
            parts = [self.pick(self.links(), f"<div>{self.links()}</div>"), f"<div>{inner}</div>", self.pick("", f"<div>{self.links()}</div>"), f"<div>Copyright 2024 {self.words(1, 3)}.</div>"]
            return f"<html><head><title>{self.words(1, 6)}</title></head><body>{''.join(f'<div>{x}</div>' if self.chance(0.3) else x for x in parts)}</body></html>"
        if self.chance(0.85):
            body.insert(0, self.pick(headline, headline, headline, f'<header{self.pick("", " class=\"entry-header\"", " class=\"post-header\"")}>{headline}</header>'))
            if "<header" in body[0]:
                body.append(self.pick("", f"<footer>{self.pick(self.links(1, 3), f'Tags: {self.links(1, 4)}')}</footer>"))
        for intrude, p in ((self.advert, 0.3), (self.side, 0.12), (self.social, 0.15), (self.form, 0.15), (self.notice, 0.12), (self.nav, 0.06)):
            if self.chance(p):
                body.insert(int(self.rng.integers(len(body) + 1)), intrude())
        inner = "".join(body)
        layout = 0.0 if "<header" in body[0] else self.rng.random()
        if layout < 0.45:
            main = f"<article{self.pick('', '', ' class=\"post\"', ' id=\"story\"')}>{inner}</article>"
        elif layout < 0.6:
            main = f"<main>{self.pick('<article>{}</article>', '<div class=\"content\">{}</div>', '{}', '<section>{}</section>').replace('{}', inner)}</main>"
        elif layout < 0.85:
            main = f'<div {self.pick("class", "id")}="{self.pick("content", "post", "entry-content", "article-body", "main", "story", "post-content", "main-content", "text")}">{inner}</div>'
        else:
            main = self.pick("<div>{}</div>", "<section>{}</section>", "<div><div>{}</div></div>", "{}").replace("{}", inner)
        before = [f() for f, p in ((self.header, 0.5), (self.nav, 0.6), (self.notice, 0.25), (self.advert, 0.35), (self.form, 0.1), (self.side, 0.15)) if self.chance(p)]
        after = [f() for f, p in ((self.social, 0.15), (self.comments, 0.4), (self.advert, 0.25), (self.side, 0.35), (self.form, 0.2), (self.footer, 0.8), (self.notice, 0.15)) if self.chance(p)]
        if self.chance(0.2):  # comments stand in the article too
            main = main[: main.rfind("</")] + self.comments() + main[main.rfind("</") :] if "</" in main else main
        whole = "".join(before) + main + "".join(after)
        for _ in range(int(self.rng.integers(0, 3))):
            whole = self.pick("<div>{}</div>", '<div class="wrapper">{}</div>', '<div id="page">{}</div>', '<div class="container">{}</div>').replace("{}", whole)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body>{whole}{self.pick('</body></html>', '')}"


def labelled_pages(many: int, seed: int = 7) -> list[str]:
    maker = _Maker(np.random.default_rng(seed))
    return [maker.page() for _ in range(many)]
