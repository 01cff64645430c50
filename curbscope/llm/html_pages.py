"""Labelled pages for training the extractor: pages of many layouts, drawn
from a seed, together with the texts that belong to the article."""

from __future__ import annotations

import random

# Layout vocabulary of public web pages: names by which sites mark what is
# and what is not the article.
ARTICLE = ["content", "post-body", "entry-content", "article-body", "story", "main-content", "post", "article", "text"]
MENU = ["menu", "nav", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs", "site-nav", "links"]
SIDE = ["sidebar", "side", "widget", "related", "popular", "trending", "recommended", "more-stories", "secondary"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sponsor", "adbox"]
NOTICE = ["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "privacy-banner", "modal", "popup"]
FORM = ["newsletter", "subscribe", "signup", "login", "search", "contact-form"]
COMMENT = ["comments", "comment-list", "comment", "discussion", "replies", "responses", "respond", "disqus"]
FOOT = ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"]
HEAD = ["header", "site-header", "masthead", "branding", "page-header"]
SHARE = ["share", "social", "sharing", "tags", "meta", "byline", "author", "pagination"]


class Page:
    """One drawn page: ``html`` and ``gold``, the article's block texts."""

    def __init__(self, rng: random.Random):
        self.rng, self.gold = rng, set()
        boxes = [self.menu, self.advert, self.notice, self.site_head, self.form, self.side, self.share]
        top = "".join(b() for b in rng.sample(boxes, rng.randint(1, 5)))
        low = "".join(b() for b in rng.sample([self.comments, self.side, self.form, self.advert, self.share, self.menu], rng.randint(0, 4)))
        body = top + self.article() + low + (self.foot() if rng.random() < 0.85 else "")
        if rng.random() < 0.25:
            body = f'<div class="{rng.choice(["wrapper", "container", "page", "layout"])}">{body}</div>'
        title = self.words(3, 9)
        self.html = (
            f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style>"
            f'<script>var t="</p>";</script></head><body>{body}' + rng.choice(["</body></html>", "</body></html>", ""])
        )

    def words(self, low: int, high: int, end: str = "") -> str:
        r = self.rng
        parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "ti", "es", "or", "st", "en", "la", "ba", "mo", "é", "ü"]
        found = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        out = " ".join(w + "," if r.random() < 0.05 else w for w in found)
        return out[:1].upper() + out[1:] + end

    def prose(self) -> str:
        return " ".join(self.words(4, 20, ".") for _ in range(self.rng.choice([1, 1, 2, 3, 5, 8])))

    def marked(self, names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag, name = self.rng.choice(tags), self.rng.choice(names)
        how = self.rng.choice(["class", "class", "id"])
        return f'<{tag} {how}="{name}">{inner}</{tag}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def menu(self) -> str:
        return f"<nav>{self.links()}</nav>" if self.rng.random() < 0.6 else self.marked(MENU, self.links(), ("div", "ul", "header"))

    def advert(self) -> str:
        inner = self.rng.choice([self.prose(), f"<p>{self.prose()}</p>", f'<a href="/x">{self.words(3, 8)}</a>', "Advertisement"])
        return self.marked(ADVERT, inner, ("div", "div", "aside", "section"))

    def notice(self) -> str:
        return self.marked(NOTICE, f"<p>{self.prose()}</p><button>{self.words(1, 2)}</button>")

    def site_head(self) -> str:
        inner = self.rng.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a><p>{self.words(3, 8)}</p>', f"<p>{self.prose()}</p>"])
        return f"<header>{inner}</header>" if self.rng.random() < 0.6 else self.marked(HEAD, inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><p>{self.prose()}</p><button>{self.words(1, 2)}</button>"
        return f"<form>{inner}</form>" if self.rng.random() < 0.6 else self.marked(FORM, f"<form>{inner}</form>")

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.rng.choice([self.links(), f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p><p>{self.prose()}</p>"])
        return f"<aside>{inner}</aside>" if self.rng.random() < 0.5 else self.marked(SIDE, inner, ("div", "aside", "section"))

    def share(self) -> str:
        return self.marked(SHARE, self.rng.choice([self.links(2, 5), f"<span>{self.words(2, 6)}</span>"]), ("div", "p", "ul"))

    def comments(self) -> str:
        one = lambda: f'<div class="{self.rng.choice(["comment", "reply", "comment-body"])}"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></div>'
        plain = "".join(f"<p>{self.prose()}</p>" for _ in range(self.rng.randint(1, 4)))
        inner = self.rng.choice([plain, "".join(one() for _ in range(self.rng.randint(1, 5)))])
        return self.marked(COMMENT, f"<h3>{self.words(1, 3)}</h3>{inner}", ("div", "section", "section", "ol"))

    def foot(self) -> str:
        inner = f"&copy; {self.words(1, 2)}.example.org &middot; {self.prose()}"
        return f"<footer>{inner}</footer>" if self.rng.random() < 0.6 else self.marked(FOOT, f"<p>{inner}</p>")

    def own(self, text: str) -> str:
        self.gold.add(" ".join(text.split()))
        return text

    def block(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.62:
            text = self.own(self.prose())
            if r.random() < 0.15 and " " in text:
                a, b = text.split(" ", 1)
                text = f"{a} <{r.choice(['b', 'em', 'i'])}>{b}"
            elif r.random() < 0.15 and " " in text:
                a, b = text.rsplit(" ", 1)
                text = f'{a} <a href="/y">{b}</a>'
            return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>", "<br>"])
        if kind < 0.72:
            return f"<{(h := r.choice(['h2', 'h3']))}>{self.own(self.words(1, 7))}</{h}>"
        if kind < 0.80:
            return "<ul>" + "".join(f"<li>{self.own(self.words(2, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote>{self.own(self.prose())}</blockquote>"
        if kind < 0.90:
            return f"<pre>{self.own(self.words(4, 20))}</pre>"
        if kind < 0.95:
            return f"<p>{self.own(self.words(1, 3, '.'))}</p>"
        return "<table><tr>" + "".join(f"<td>{self.own(self.words(1, 4))}</td>" for _ in range(r.randint(2, 4))) + "</tr></table>"

    def article(self) -> str:
        r = self.rng
        parts = [f"<h1>{self.own(self.words(3, 10))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(2, 12)):
            parts.append(self.block())
            if r.random() < 0.10:
                parts.append(r.choice([self.advert, self.side, self.form, self.share, self.notice])())
        if r.random() < 0.15:
            parts.append(self.comments())
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.5:
            return f"<article>{inner}</article>"
        if kind < 0.65:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return self.marked(ARTICLE, inner)
        return inner


def labelled(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """``n`` drawn pages: (html, texts of the article's blocks)."""
    rng = random.Random(seed)
    return [(p.html, p.gold) for p in (Page(rng) for _ in range(n))]
