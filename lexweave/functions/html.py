"""Content of the first main element of a page, by a list of selectors."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import MAIN_SELECTORS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Selected(HTMLParser):
    """Text below every selector, of the body, and of all."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.first: dict[str, list[str]] = {}
        self.closed: set[str] = set()
        #: Open elements by selector and by tag; a page costs time in proportion to its length, however deep it is.
        self.active: Counter = Counter()
        self.open: Counter = Counter()
        self.skip = 0

    def matching(self, tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
        a = {k: v or "" for k, v in attrs}
        names = {tag, *("." + c for c in a.get("class", "").split())}
        if a.get("id"):
            names.add("#" + a["id"])
        if a.get("role"):
            names.add(f"[role={a['role']}]")
        return frozenset(n for n in [*MAIN_SELECTORS, "body"] if n in names and n not in self.closed)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        self.skip += tag in ("script", "style")
        names = self.matching(tag, attrs)
        self.stack.append((tag, names))
        self.open[tag] += 1
        self.active.update(names)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while True:
            t, names = self.stack.pop()
            self.open[t] -= 1
            self.active -= Counter(names)
            self.skip -= t in ("script", "style")
            self.closed |= {n for n in names if any(x.strip() for x in self.first.get(n, []))}
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for n in self.active:
                self.first.setdefault(n, []).append(data)

    def text(self) -> str:
        for n in [*MAIN_SELECTORS, "body"]:
            found = " ".join("".join(self.first.get(n, [])).split())
            if found:
                return found
        return ""


def content_of(html: str | None) -> str:
    p = Selected()
    p.feed(html or "")
    p.close()
    return p.text()


@F.pandas_udf(T.StringType())
def main_content(html: pd.Series) -> pd.Series:
    return html.map(content_of)
