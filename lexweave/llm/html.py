"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read once, as a browser would: comments, scripts, styles and the head
are passed over, a new paragraph ends an open one, an end tag closes what it
matches.  A leaf block is the text between two block-level tags.  Its features are
its ancestors' tags and the words in their class, id and role names, its own tag,
and the shape of its text (length, share of links, punctuation, signs).  The field
has two labels, main and other; weights are fitted on labelled pages by the exact
log-likelihood gradient (forward-backward); Viterbi decodes a page.

The default model is fitted on ``TRAINING_PAGES`` pages written by ``html_pages``,
on the driver, and is a few thousand weights.  Labelled pages of one's own can be
given instead.

Formulas (MathML) and the text of drawings (SVG) are text of the block around them.
Passed over before the field sees them are scripts, styles, the head, templates and form
controls, and what is markup of a formula or drawing and never shown as text (a formula's
annotations and phantoms, a drawing's descriptions and definitions).  What stands in for a
frame, object, canvas or script is text of a block of its own, for the field to judge.

Open elements are a chain that shares its parents, and each knows what it adds to their
features, so a page costs time and memory in proportion to its length, however
deep it is nested.

Null and empty pages have an empty text.  Any markup is read to its end, however
broken.  Repeated rows give equal rows; empty tables give empty results; only the
id, url and html columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_pages import MAIN, Writer

TRAINING_PAGES = 700

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style template head title select textarea annotation annotation-xml mphantom desc metadata defs symbol".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of formulas and drawings; they run inside a block, and end at once if they end in a slash.
FOREIGN = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics annotation annotation-xml svg g path rect circle ellipse line polyline polygon text tspan textpath use image marker mask pattern clippath lineargradient radialgradient stop filter switch animate animatetransform set desc metadata defs symbol".split())
#: Elements that run inside a block.
INLINE = FOREIGN | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br picture source".split())
#: A start tag of the first kind ends an open element of the second kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements inside which an ended paragraph or item is looked for, and no further.
WALLS = frozenset("ul ol dl table div section article main aside nav header footer form body html blockquote".split())

#: Elements that hold blocks.
HOLDERS = frozenset("article main section aside nav header footer form div body".split())


def names_in(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in NAMED.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and "none" in value):
            found.add("hidden")
        elif key != "style":
            found |= {x.lower() for x in PIECE.findall(value)}
    return tuple(sorted(found))


@lru_cache(maxsize=20_000)
def element(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, then the words of its names."""
    return (tag, *names_in(attributes))


class Open:
    """An element of a path: what it adds to its ancestors' features, and the chain above it."""

    __slots__ = ("above", "added", "element", "holder", "score")

    def __init__(self, above: Open | None, element: tuple[str, ...], added: tuple[str, ...]):
        self.above, self.element, self.added = above, element, added
        self.holder = element if element[0] in HOLDERS else above.holder if above else ("-",)
        #: Sum of the weights of the whole chain's features, once a model has been asked.
        self.score: float | None = None


class Path:
    """The open elements of a page, and where each tag stands among them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Open | None, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.active: dict[str, int] = {}

    def top(self) -> Open | None:
        return self.stack[-1][1] if self.stack else None

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def push(self, e: tuple[str, ...]) -> None:
        node, held = self.top(), ()
        if e[0] not in INLINE or len(e) > 1:
            held = ("in=" + e[0], *("name=" + x for x in e[1:]))
            node = Open(node, e, tuple(f for f in held if not self.active.get(f)))
            for f in held:
                self.active[f] = self.active.get(f, 0) + 1
        self.places.setdefault(e[0], []).append(len(self.stack))
        if e[0] in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((e[0], node, held))

    def close(self, k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(self.stack) > k:
            tag, _, held = self.stack.pop()
            self.places[tag].pop()
            if tag in WALLS:
                self.walls.pop()
            for f in held:
                self.active[f] -= 1


def blocks(html: str) -> list[tuple[str, Open | None, int]]:
    """(text, innermost element, letters in links) of every leaf block, in page order."""
    out: list[tuple[str, Open | None, int]] = []
    path = Path()
    texts: list[str] = []
    links, at, in_link = 0, 0, 0
    node: Open | None = None
    find = TAG.search
    endless: set[str] = set()

    def flush() -> None:
        nonlocal links
        if texts:
            text = " ".join(unescape("".join(texts)).split())
            if text:
                out.append((text, node, links))
            texts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links, node
        if not texts:
            node = path.top()
        texts.append(raw)
        if in_link:
            links += len(raw)

    n = len(html)
    while at < n:
        m = find(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, end = name.lower(), (m[1] or m[4]) == "/"
        if tag in SKIPPED and not end:
            if tag in FOREIGN and (m[3] or m[6] or "").endswith("/"):
                continue
            if tag not in FOREIGN and path.last("svg") < 0 and path.last("math") < 0:
                flush()
            # what has no end further on is not looked for again
            close = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>|<body\b" if tag == "head" else rf"</{tag}\b[^>]*>", re.I).search(html, at)
            if close is None:
                endless.add(tag)
            at = n if close is None and tag in ("script", "style") else at if close is None else close.start() if close[0][:2] != "</" else close.end()
            continue
        if tag == "br" or tag == "text":
            if texts:
                texts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if tag in VOID or (tag in FOREIGN and (m[3] or m[6] or "").endswith("/")):
            continue
        if end:
            if path.last(tag) >= 0:
                path.close(path.last(tag))
            if tag == "a":
                in_link = 0
            continue
        if not inline:
            ended = max(path.last(g) for g in (*ENDS.get(tag, ()), "p"))
            if ended > (path.walls[-1] if path.walls else -1):
                path.close(ended)
            in_link = 0
        if tag == "a":
            in_link = 1
        path.push(element(tag, m[3] or m[6] or ""))
    flush()
    return out


def near_features(node: Open | None) -> list[str]:
    """Features of the innermost elements: own tag, holder, names of the last two."""
    own = node.element[0] if node else "-"
    holder = node.holder if node else ("-",)
    out = {"own=" + own, "holder=" + holder[0], f"holder={holder[0]} own={own}"}
    if len(holder) == 1:
        out.add(f"bare holder={holder[0]}")
    for e in (node, node.above if node else None):
        if e:
            out |= {"near=" + x for x in e.element[1:]}
    return sorted(out)


def path_features(node: Open | None) -> list[str]:
    """All features of a block's path: tags and names of the whole chain, and those of its inner end."""
    out = near_features(node)
    while node:
        out += node.added
        node = node.above
    return out


def text_features(text: str, links: int) -> list[str]:
    n = len(text)
    share = links / n
    out = [f"long={min(9, int(math.log2(n + 1)))}", f"link={0 if share < 0.05 else 1 if share < 0.5 else 2}", f"end={text[-1] if text[-1] in '.!?:' else '-'}"]
    if "©" in text:
        out.append("sign=c")
    if "·" in text or "»" in text:
        out.append("sign=dot")
    dots = text.count(". ")
    out.append(f"dots={min(3, dots)}")
    return out


@dataclass(frozen=True)
class Model:
    """weight[f]: how much feature f speaks for main; move[a][b]: from label a to b; first: of a page's first block."""

    weight: dict[str, float]
    move: tuple[tuple[float, float], tuple[float, float]]
    first: tuple[float, float]

    def chain(self, node: Open | None) -> float:
        """Sum of the weights of the chain's features; each element is asked once."""
        todo = []
        while node and node.score is None:
            todo.append(node)
            node = node.above
        total = node.score if node else 0.0
        for x in reversed(todo):
            total += sum(self.weight.get(f, 0.0) for f in x.added)
            x.score = total
        return total

    def decoder(self):
        weight, (m0, m1), first = self.weight, self.move, self.first

        def decode(found: list[tuple[str, Open | None, int]]) -> list[bool]:
            """Viterbi: is the block main?"""
            back = []
            a = b = 0.0
            for k, (text, node, links) in enumerate(found):
                e = self.chain(node)
                for f in near_features(node):
                    e += weight.get(f, 0.0)
                for f in text_features(text, links):
                    e += weight.get(f, 0.0)
                if k == 0:
                    a, b = first[0], first[1] + e
                    continue
                x, y = b + m1[0] > a + m0[0], b + m1[1] > a + m0[1]
                back.append((x, y))
                a, b = (b + m1[0] if x else a + m0[0]), (b + m1[1] if y else a + m0[1]) + e
            if not found:
                return []
            label = b > a
            out = [label]
            for x, y in reversed(back):
                label = y if label else x
                out.append(label)
            return out[::-1]

        return decode


def fit(pages: Iterable[tuple[list[list[str]], list[int]]], steps: int = 250, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Maximum likelihood by Adam; pages: (features of each block, label of each block)."""
    pages = [p for p in pages if p[1]]
    names = {f: i for i, f in enumerate(sorted({f for blocks_, _ in pages for b in blocks_ for f in b}))}
    longest = max(len(y) for _, y in pages)
    n = len(pages)
    row, col, col_f = [], [], []
    y = np.zeros((n, longest), dtype=int)
    length = np.array([len(p[1]) for p in pages])
    for i, (found, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
        for t, fs in enumerate(found):
            row += [i] * len(fs)
            col += [t] * len(fs)
            col_f += [names[f] for f in fs]
    cell, f = np.array(row) * longest + np.array(col), np.array(col_f)
    real = np.arange(longest)[None, :] < length[:, None]
    w = np.zeros(len(names) + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pair = real[:, 1:]
    for t in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(cell, weights=w[f], minlength=n * longest).reshape(n, longest)
        move, first = w[-6:-2].reshape(2, 2), w[-2:]
        alpha, beta = np.full((n, longest, 2), -np.inf), np.zeros((n, longest, 2))
        alpha[:, 0] = first + e[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.logaddexp.reduce(alpha[:, k - 1, :, None] + move, axis=1) + e[:, k]
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(real[:, k + 1][:, None], step, 0.0)
        z = np.logaddexp.reduce(alpha[np.arange(n), length - 1], axis=1)
        main = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
        g = np.zeros_like(w)
        g[:-6] = np.bincount(f, weights=((y == 1) - main).reshape(-1)[cell], minlength=len(names))
        both = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        for a in (0, 1):
            for b in (0, 1):
                g[-6 + 2 * a + b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum()) - both[:, :, a, b][pair].sum()
        start = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None])
        g[-2:] = [(y[:, 0] == 0).sum() - start[:, 0].sum(), (y[:, 0] == 1).sum() - start[:, 1].sum()]
        g = g / n - decay * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({k: float(w[i]) for k, i in names.items()}, ((float(w[-6]), float(w[-5])), (float(w[-4]), float(w[-3]))), (float(w[-2]), float(w[-1])))


def labelled(seed: int, pages: int) -> list[tuple[str, list[list[str]], list[int]]]:
    """(html, features, labels) of written pages whose blocks match what was written."""
    out = []
    writer = Writer(seed)
    for _ in range(pages):
        html, written = writer.page()
        found = blocks(html)
        want = [(" ".join(unescape(re.sub(r"<[^>]*>", "", t)).split()), y) for t, y in written]
        if [t for t, _, _ in found] == [t for t, _ in want]:
            out.append((html, [path_features(p) + text_features(t, k) for t, p, k in found], [int(y == MAIN) for _, y in want]))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit([(f, y) for _, f, y in labelled(1, TRAINING_PAGES)])


def main_text(html: str | None, decode) -> str:
    found = blocks(html or "")
    return " ".join(b[0] for b, keep in zip(found, decode(found), strict=True) if keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """id_col, url_col, ``text`` and ``n_chars`` of every page."""
    model = model or default_model()
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand weights, whatever the input
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = shared.value.decoder()
        for big in batches:
            for start in range(0, big.num_rows, 512):
                batch = big.slice(start, 512)
                texts = [main_text(x.as_py(), decode) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return df.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
