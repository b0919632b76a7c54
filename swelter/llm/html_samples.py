"""Labelled pages for the block classifier: made-up pages whose main text is known.

Layouts, wrappers, names and noise are drawn at random, so that the classifier meets main
text with and without telling elements around it, and noise inside and outside of it.
"""

from __future__ import annotations

import random

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split()

WRAPPERS = (
    ("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "main-content"), ("div", "post"), ("div", "post-body"),
    ("div", "entry-content"), ("div", "article-body"), ("div", "story"), ("div", "text"), ("section", "article"), ("div", "page-content"),
    ("td", "content"), ("div", "container"), ("div", ""), ("section", ""), ("", ""),
)
NOISE = {
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "ad-slot", "adsense", "promotion"),
    "side": ("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "aside", "more-stories"),
    "notice": ("notice", "cookie", "cookie-notice", "consent", "gdpr", "alert", "message", "banner-notice", "disclaimer", "popup", "modal", "overlay"),
    "share": ("share", "social", "social-buttons", "share-links", "tools"),
    "comments": ("comments", "comment", "comment-list", "commentlist", "discussion", "replies", "reader-comments", "responses", "disqus"),
    "foot": ("footer", "foot", "site-footer", "copyright", "legal", "bottom"),
    "head": ("header", "site-header", "masthead", "top", "brand", "logo", "topbar"),
    "nav": ("nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "toc", "links", "pager", "pagination"),
    "form": ("form", "search", "newsletter", "subscribe", "signup", "login", "contact", "register"),
}


class PageMaker:
    """One page at a time; ``main`` collects the blocks of its main text in order."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        words = ["".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 16) + self.r.choice((".", ".", ".", "!", "?")) for _ in range(self.r.randint(low, high)))

    def named(self, kind: str) -> str:
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(NOISE[kind])}"'

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]

    def nav(self) -> str:
        items = self.links(3, 9)
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        if self.r.random() < 0.6:
            return f"<{tag}{self.named('nav') if tag != 'nav' or self.r.random() < 0.3 else ''}><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></{tag}>"
        return f"<{tag}{self.named('nav') if tag != 'nav' else ''}>{self.r.choice((' | ', ' ', ' &raquo; ')).join(items)}</{tag}>"

    def header(self) -> str:
        body = self.r.choice(("h1", "p", "div"))
        inner = f"<{body}>{self.words(1, 6)}</{body}>" + (f"<p>{self.words(3, 9)}</p>" if self.r.random() < 0.5 else "")
        return f"<header>{inner}</header>" if self.r.random() < 0.5 else f"<div{self.named('head')}>{inner}</div>"

    def footer(self) -> str:
        inner = f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}"
        if self.r.random() < 0.5:
            inner = f"<p>{inner}</p>" + "".join(f"<p>{x}</p>" for x in self.links(0, 3))
        return f"<footer>{inner}</footer>" if self.r.random() < 0.6 else f"<div{self.named('foot')}>{inner}</div>"

    def noise(self, kinds: tuple[str, ...]) -> str:
        kind = self.r.choice(kinds)
        text = self.r.choice((self.words(1, 6), self.sentences(1, 2), self.sentences(2, 5)))
        inner = text if self.r.random() < 0.5 else f"<p>{text}</p>"
        if kind == "form":
            inner = f'<p>{self.words(2, 8)}</p><label>{self.words(1, 2)}</label><input name="x"><button>{self.words(1, 2)}</button>'
            return f"<form>{inner}</form>" if self.r.random() < 0.6 else f"<div{self.named('form')}><form>{inner}</form></div>"
        if kind == "side":
            inner = f"<h3>{self.words(1, 4)}</h3>" + (f"<ul>{''.join(f'<li>{x}</li>' for x in self.links(2, 6))}</ul>" if self.r.random() < 0.6 else inner)
            return f"<aside>{inner}</aside>" if self.r.random() < 0.5 else f"<div{self.named('side')}>{inner}</div>"
        if kind == "share":
            inner = " ".join(self.links(2, 4)) if self.r.random() < 0.6 else "".join(f"<button>{self.words(1, 1)}</button>" for _ in range(3))
        if kind == "comments":
            each = self.r.choice(("li", "div", "article"))
            name = self.r.choice((' class="comment"', ' class="reply"', ""))
            said = "".join(f"<{each}{name}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></{each}>" for _ in range(self.r.randint(1, 5)))
            outer = self.r.choice(("section", "div", "ol"))
            return f"<{outer}{self.named('comments')}><h3>{self.words(1, 3)}</h3>{said}</{outer}>"
        tag = self.r.choice(("div", "div", "section"))
        return f"<{tag}{self.named(kind)}>{inner}</{tag}>"

    def paragraph(self) -> tuple[str, str]:
        """Markup and plain text of a block of the main text."""
        text = self.sentences(1, 1) if self.r.random() < 0.25 else self.sentences(2, 7)
        if self.r.random() < 0.12:
            text = self.words(1, 3)
        plain, kind = text, self.r.random()
        if kind < 0.15:
            parts = text.split(" ")
            k = self.r.randrange(len(parts))
            parts[k] = self.r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>')).format(parts[k])
            text = " ".join(parts)
        return text, plain

    def main_text(self) -> tuple[str, list[str]]:
        title = self.words(3, 9)
        parts, main = ([f"<h1>{title}</h1>"], [title]) if self.r.random() < 0.8 else ([], [])
        closing = "</p>" if self.r.random() < 0.8 else ""
        for _ in range(self.r.randint(1, 10)):
            text, plain = self.paragraph()
            kind = self.r.random()
            if kind < 0.08:
                items = [self.words(2, 9) for _ in range(self.r.randint(2, 5))]
                parts.append(f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>")
                main += items
                continue
            if kind < 0.16:
                head = self.words(1, 6)
                parts.append(f"<h2>{head}</h2>")
                main.append(head)
            tag = self.r.choice(("blockquote", "div", "pre")) if kind > 0.93 else "p"
            parts.append(f"<{tag}>{text}{closing if tag == 'p' else f'</{tag}>'}")
            main.append(plain)
            if self.r.random() < 0.1:
                parts.append(self.noise(("ad", "side", "share", "notice", "form")))
        return "".join(parts), main

    def page(self) -> tuple[str, list[str]]:
        """A page and the blocks of its main text."""
        body, main = self.main_text()
        tag, name = self.r.choice(WRAPPERS)
        if self.r.random() < 0.2:
            body += self.noise(("comments", "share", "side"))
        if tag:
            body = f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{body}</{tag}>"
        if self.r.random() < 0.3:
            body = f"<div{self.r.choice(('', ' class=' + chr(34) + 'wrapper' + chr(34), ' id=' + chr(34) + 'page' + chr(34)))}>{body}</div>"
        before = [self.nav() if self.r.random() < 0.8 else "", self.header() if self.r.random() < 0.5 else ""]
        before += [self.noise(("ad", "notice", "form")) for _ in range(self.r.randint(0, 2))]
        after = [self.noise(("comments", "side", "ad", "share", "form", "notice", "nav")) for _ in range(self.r.randint(0, 3))]
        self.r.shuffle(before)
        after.append(self.footer() if self.r.random() < 0.9 else "")
        end = "</body></html>" if self.r.random() < 0.9 else ""
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- x -->{body}{''.join(after)}{end}", main
