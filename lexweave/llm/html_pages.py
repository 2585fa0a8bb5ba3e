"""Labelled web pages to train the extractor on: written by rule, seeded, labelled as written.

Pages vary in how they name and nest things: semantic tags or plain ``div``s with
class or id names, notices before or after, adverts, forms, related links and
reader comments inside or outside the article, short and long paragraphs.  Texts
are drawn from made-up words, so that labels hang on structure and on the shape
of a text, never on its words.
"""

from __future__ import annotations

import random

MAIN, OTHER = 1, 0

#: Names that sites give to parts of a page.
NAMES = {
    "article": ["article", "content", "main-content", "post", "post-body", "entry-content", "article-body", "story", "story-body", "page-content", "text", "blog-post"],
    "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc-links"],
    "header": ["header", "site-header", "masthead", "top", "banner", "page-header", "logo"],
    "footer": ["footer", "site-footer", "bottom", "page-footer", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "right-column", "tags", "share", "social"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "alert", "gdpr", "newsletter", "subscribe", "popup", "modal", "paywall", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "sponsor"],
    "form": ["form", "search", "search-box", "login", "signup", "contact-form", "comment-form", "subscribe-form"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "responses", "reader-comments", "disqus"],
}
#: Names that say how a part looks, not what it is.
LOOKS = "flex grid block col row items-center justify-between gap-2 gap-4 px-4 py-2 py-8 mx-auto mt-4 mt-8 mb-2 w-full max-w-3xl h-full bg-white bg-gray-100 text-sm text-xs text-gray-500 text-center font-bold leading-7 border border-t rounded shadow container row-12 col-md-8 col-4 clearfix no-print dark".split()
TAGS = {"article": ["article", "main", "div", "section"], "nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "ad": ["div", "aside", "section"], "form": ["form"], "comments": ["section", "div", "ol"]}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.noise: list[str] = []
        self.looks = False
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvz") + self.r.choice("aeiouéäó") for _ in range(1)) + self.r.choice(["", "n", "r", "s", "t"]) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.noise:
            words = [(w.upper() if self.noise[0] == "!!" else w) + self.r.choice(self.noise) for w in words]
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def text(self, long: bool) -> str:
        n = self.r.choice([1, 1, 2, 3, 5, 8]) if long else 1
        return " ".join(self.sentence(*((1, 3) if self.r.random() < 0.25 else (4, 18)) if long else (1, 9)) for _ in range(n))

    def open(self, kind: str, bare: bool) -> tuple[str, str]:
        tag = self.r.choice(TAGS[kind])
        semantic = tag not in ("div", "section", "p", "ul", "ol", "ins")
        attr = ""
        if not (semantic and bare) and self.r.random() < (0.4 if semantic else 0.97):
            name = self.r.choice(NAMES[kind])
            if self.r.random() < 0.2:
                name = self.r.choice(["js-", "c-", "site-", "box "]) + name
            if self.looks:
                words = [*self.r.choices(LOOKS, k=self.r.randint(1, 6)), name]
                self.r.shuffle(words)
                name = " ".join(words)
            attr = f' {self.r.choice(["class", "class", "id"])}="{name}"'
        return f"<{tag}{attr}>", f"</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.sentence(1, 3)}</a>'

    def boiler(self, kind: str) -> list[tuple[str, str | None, int]]:
        """Pieces (markup, text or None, label) of a part that isn't the article."""
        r = self.r
        start, end = self.open(kind, r.random() < 0.5)
        out: list = [(start, None, OTHER)]
        if kind in ("aside", "comments", "notice", "footer", "ad") and r.random() < 0.35:
            out.append((r.choice(["<h2>", "<h3>", "<h3>", "<h4>"]), self.sentence(1, 4), OTHER))
        if kind == "nav" or (kind in ("aside", "footer", "header") and r.random() < 0.5):
            for _ in range(r.randint(2, 9)):
                out.append(("<li>", self.link(), OTHER))
        elif kind == "form":
            out.append(("<label>", self.sentence(1, 3), OTHER))
            out.append(("<button>", self.sentence(1, 2), OTHER))
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                out.append((r.choice(["<div>", "<li>", '<div class="comment">', '<article class="comment">', '<li id="comment-7">']), None, OTHER))
                out.append((r.choice(["<p>", "<div>"]), self.text(r.random() < 0.6), OTHER))
        elif kind == "footer":
            out.append((r.choice(["<p>", ""]), f"&copy; {self.word()}.example &middot; {self.text(False)}", OTHER))
        else:
            for _ in range(r.choice([1, 1, 2, 3])):
                out.append((r.choice(["<p>", "<div>", ""]), self.text(r.random() < 0.3) if r.random() < 0.7 else self.link(), OTHER))
        return [*out, (end, None, OTHER)]

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        """HTML and its blocks' (text as written, label)."""
        r = self.r
        # some pages carry signs on every word
        self.noise = r.choice([["!!"], ["%%%", "$$$", "***", "###", "&amp;&amp;&amp;"], [" |"], ["", "", "!!"]]) if r.random() < 0.15 else []
        self.looks = r.random() < 0.25
        parts: list = []
        for kind in ("notice", "header", "nav", "ad", "form", "aside"):
            if r.random() < (0.75 if kind in ("header", "nav") else 0.4):
                parts += self.boiler(kind)
        wrap = [self.open("article", r.random() < 0.6)]
        if r.random() < 0.3:
            wrap.insert(0, ("<div>", "</div>"))
        parts += [(a, None, OTHER) for a, _ in wrap]
        paragraph = r.choice(["<p>", "<p>", "<p>", "<p>", "<div>"])
        if r.random() < 0.8:
            parts.append((r.choice(["<h1>", "<h1>", "<h2>"]), self.sentence(2, 9), MAIN))
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.1:
                parts.append((r.choice(["<h2>", "<h3>"]), self.sentence(1, 6), MAIN))
            elif x < 0.17:
                parts.append((r.choice(["<ul>", "<ol>"]), None, MAIN))
                parts += [("<li>", self.text(r.random() < 0.5), MAIN) for _ in range(r.randint(2, 4))]
                parts.append(("</ul>", None, MAIN))
            elif x < 0.22:
                parts.append((r.choice(["<blockquote>", "<pre>", "<td>", "<figcaption>"]), self.text(r.random() < 0.5), MAIN))
                parts.append((r.choice(["</blockquote>", ""]), None, MAIN))
            elif x < 0.36:
                parts += self.boiler(r.choice(["ad", "ad", "notice", "aside", "form"]))
            else:
                parts.append((paragraph, self.text(True), MAIN))
        if r.random() < 0.25:
            parts += self.boiler("comments")
        parts += [(b, None, OTHER) for _, b in reversed(wrap)]
        for kind in ("comments", "aside", "ad", "form", "notice", "footer"):
            if r.random() < (0.8 if kind == "footer" else 0.3):
                parts += self.boiler(kind)
        close = {"<p>": "</p>", "<li>": "</li>"}
        html = "".join(m + (t or "") + (close.get(m, "") if r.random() < 0.8 and t else "") + (f"</{m[1:-1]}>" if t and m.startswith("<") and m not in close and m[1:-1].isalnum() and m not in ("<div>", "<blockquote>") else "") + ("</div>" if m == "<div>" and t else "") for m, t, _ in parts)
        # what a body is called says nothing about its parts
        body = f' class="{r.choice(["article-page", "single post", "page", "post-template", "has-sidebar", "no-comments", "home with-ads", "story menu-open"])}"' if r.random() < 0.3 else ""
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title></head><body{body}>{html}</body></html>", [(t, label) for _, t, label in parts if t]
