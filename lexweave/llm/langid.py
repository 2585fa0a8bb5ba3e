"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary (the
byte strings of a rank file, all of them).  A word's probability is the sum, over all
ways to cut it into pieces, of the product of their probabilities; the forward
algorithm adds them up from left to right, scaled by word and language, so that words
of any length are summed whole.  A text's likelihood is the product over its words, its
score the posterior of the best language under equal priors.

Piece probabilities are learned by expectation maximisation: forward and backward
sums give each piece's expected count in a language's words.  The sample is
bounded by ``most_docs`` whole texts per language, least by a hash of the id; to learn
only, words of over ``PART`` bytes are cut into parts of that many.

The text is lower-cased.  A word is a run of ASCII letters and non-ASCII bytes, with a
space before it; runs of digits and of other signs are words too, so every byte but
white space is scored.  Words are scored once per distinct word and slice, as numpy columns.

``und``, with score 0, is given to null texts and texts without a letter, and to
all if no labelled row can be learned from.  Ties go to the language first in
order.  Repeated rows score alike; empty tables give empty results; only id and
text (and, to learn, lang) are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, read_ranks
from .common import Words, coefficients, cut, mix64, slices, table, text_buffers

#: Bytes of the parts in which words are learned from.
PART = 4096
MOST_DOCS = 600
#: Parts of a language's ids, of which each gives its least first.
PARTS = 16
ROUNDS = 4
#: Weight of the even distribution that smooths a language's expected counts.
SMOOTH = 200.0
CACHE = 300_000
#: Bytes of words whose pieces are looked up at a time.
CELLS = 250_000
#: Sums are scaled anew where they leave this range.
SMALL = 1e-120
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Hash table from the vocabulary's byte strings to piece numbers."""

    BITS = 22

    def __init__(self, path: str):
        self.pieces = sorted(read_ranks(path))
        self.longest = max(map(len, self.pieces))
        h = np.zeros(len(self.pieces), dtype=np.uint64)
        for i, p in enumerate(self.pieces):
            x = 0
            for byte in p:
                x = (x * int(BASE) + byte + 1) & (2**64 - 1)
            h[i] = x
        self.hash = mix64(h)
        shift = np.uint64(64 - self.BITS)
        self.first = np.full(1 << self.BITS, -1, dtype=np.int32)
        self.second = self.first.copy()
        order = np.arange(len(h), dtype=np.int32)
        self.first[self.hash >> shift] = order
        lost = order[self.first[self.hash >> shift] != order]
        at = (self.hash[lost] * BASE) >> shift
        self.second[at] = lost
        if np.any(self.second[at] != lost):
            raise ValueError("piece table is too small")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 for none."""
        h = mix64(h)
        shift = np.uint64(64 - self.BITS)
        out = self.first[h >> shift]
        miss = (out < 0) | (self.hash[out] != h)
        if miss.any():
            m = h[miss]
            other = self.second[(m * BASE) >> shift]
            other[(other >= 0) & (self.hash[other] != m)] = -1
            out[miss] = other
        return out


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def lattice(words: np.ndarray, size: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(end, starts, rows, piece numbers) of the pieces that end there, for every end, rising; rows rise too.

    words: bytes in columns, 0 beyond the end; size: their lengths.  Pieces are looked up for
    as many ends at a time as ``CELLS`` allows.
    """
    n, width = words.shape
    step = max(pieces.longest, CELLS // max(1, n))
    for low in range(0, width, step):
        high = min(width, low + step)  # ends in (low, high]
        left = max(0, low - pieces.longest + 1)
        value = words[:, left:high].astype(np.uint64) + np.uint64(1)
        h = value
        ends, starts, rows, found = [], [], [], []
        for k in range(1, min(pieces.longest, high - left) + 1):
            if k > 1:
                h = h[:, :-1] * BASE + value[:, k - 1 :]
            skip = max(0, low + 1 - k - left)  # starts whose end is in an earlier part
            got = pieces.find(h[:, skip:].reshape(-1)).reshape(n, -1)
            row, start = np.nonzero(got >= 0)
            piece = got[row, start]
            start = start + (left + skip)
            ok = start + k <= size[row]
            ends.append(start[ok] + k)
            starts.append(start[ok])
            rows.append(row[ok])
            found.append(piece[ok])
        end, start, row, piece = (np.concatenate(x) for x in (ends, starts, rows, found))
        order = np.argsort(end * n + row, kind="stable")
        end, start, row, piece = end[order], start[order], row[order], piece[order]
        cuts = np.searchsorted(end, np.arange(low + 1, high + 2))
        for e in range(low + 1, high + 1):
            u, v = cuts[e - low - 1], cuts[e - low]
            if u < v:
                yield e, start[u:v], row[u:v], piece[u:v]


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, rising, and the sum of each one's values."""
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values, first, axis=0)


def forward(words: np.ndarray, size: np.ndarray, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log probability of each word in each language; p: pieces by languages.

    Sums of the last ``longest`` ends stand in a ring, each as a mantissa and the logarithm of
    its scale; scales differ only in words where sums became small.
    """
    n, languages = len(words), p.shape[1]
    ring = pieces.longest + 1
    a, scale = np.zeros((ring, n, languages)), np.zeros((ring, n, languages))
    now = np.zeros((n, languages))
    a[0] = 1.0
    scaled = False
    out = np.zeros((n, languages))
    for end, start, rows, which in lattice(words, size, pieces):
        at = start % ring
        part = a[at, rows] * p[which]
        if scaled:
            part = part * np.exp(np.minimum(scale[at, rows] - now[rows], 600.0))
        row, total = summed(rows, part)
        low = total < SMALL
        if low.any():
            scaled = True
            change = np.where(low, np.log(total), 0.0)
            total = np.where(low, 1.0, total)
            now[row] += change
        a[end % ring] = 0.0
        a[end % ring, row] = total
        scale[end % ring, row] = now[row]
        done = size[row] == end
        out[row[done]] = np.log(total[done]) + now[row[done]]
    return out


def expected(words: np.ndarray, size: np.ndarray, weight: np.ndarray, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected count of every piece in weighted words of one language, by scaled forward and backward sums."""
    n, width = words.shape
    a, b = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    a_scale, b_scale = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    a[0] = 1.0
    b[size, np.arange(n)] = 1.0
    edges = list(lattice(words, size, pieces))
    now = np.zeros(n)
    for end, start, rows, which in edges:
        row, total = summed(rows, a[start, rows] * p[which] * np.exp(a_scale[start, rows] - now[rows]))
        low = total < SMALL
        now[row[low]] += np.log(total[low])
        total[low] = 1.0
        a[end, row], a_scale[end, row] = total, now[row]
    end = np.concatenate([np.full(len(x[1]), x[0]) for x in edges])
    start, rows, which = (np.concatenate([x[k] for x in edges]) for k in (1, 2, 3))
    order = np.argsort(-start * n + rows, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(start[order]) != 0)), len(order))
    now = np.zeros(n)
    for u, v in zip(cuts[:-1], cuts[1:], strict=True):
        i = order[u:v]
        row, total = summed(rows[i], b[end[i], rows[i]] * p[which[i]] * np.exp(b_scale[end[i], rows[i]] - now[rows[i]]))
        low = total < SMALL
        now[row[low]] += np.log(total[low])
        total[low] = 1.0
        b[start[i[0]], row], b_scale[start[i[0]], row] = total, now[row]
    every = np.arange(n)
    whole = np.log(a[size, every]) + a_scale[size, every]
    share = a[start, rows] * p[which] * b[end, rows] * np.exp(a_scale[start, rows] + b_scale[end, rows] - whole[rows])
    return np.bincount(which, weights=share * weight[rows], minlength=len(p))


def columns(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    width = int(size.max()) if len(words) else 0
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width), size


def grouped(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words of rising length, together as far as their columns hold some ``CELLS`` bytes."""
    low = 0
    for k in range(1, len(words) + 1):
        if k == len(words) or (k + 1 - low) * len(words[k]) > CELLS:
            yield words[low:k]
            low = k


def learn(counts: Counter, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its word counts."""
    p = np.full(len(pieces.pieces), 1.0 / len(pieces.pieces))
    parts: Counter = Counter()
    for word, n in counts.items():
        for low in range(0, len(word), PART):
            parts[word[low : low + PART]] += n
    counts = parts
    ordered = sorted(counts, key=lambda w: (len(w), w))
    for _ in range(rounds):
        total = np.zeros(len(p))
        for part in grouped(ordered):
            words, size = columns(part)
            total += expected(words, size, np.array([counts[w] for w in part], dtype=float), p, pieces)
        p = (total + SMOOTH / len(p)) / (total.sum() + SMOOTH)
    return p


def lowered(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.large_string())


#: Kind of each byte: white space, letters and bytes of other characters, digits, signs.
KIND = np.full(256, 3, dtype=np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[[*range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


class LetterWords(Words):
    """Runs of letters (ASCII ones and all non-ASCII bytes), of digits and of signs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        kind = KIND[data]
        first = kind > 0
        first[1:] &= kind[1:] != kind[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = kind[edge] > 0
        at = np.flatnonzero(kind)
        self.start = np.flatnonzero(first)
        part = np.cumsum(first)[at] - 1
        size = np.bincount(part, minlength=len(self.start))
        self.end = self.start + size
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.data = data
        cuts = np.cumsum(size) - size
        c = coefficients(int(size.max()) if len(size) else 0, 1)
        sums = np.add.reduceat(c[at - self.start[part]] * (data[at].astype(np.uint64) + np.uint64(1)), cuts) if len(at) else np.zeros(0, np.uint64)
        self.hash = [mix64(sums + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))]

    def matrix(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given words as columns of bytes, a space before each."""
        size = self.end[which] - self.start[which]
        width = int(size.max()) if len(which) else 0
        at = self.start[which][:, None] + np.arange(width)[None, :]
        out = np.where(np.arange(width)[None, :] < size[:, None], self.data[np.minimum(at, len(self.data) - 1)], 0).astype(np.uint8)
        return np.concatenate((np.full((len(which), 1), 32, np.uint8), out), axis=1), size + 1


@dataclass(frozen=True)
class Model:
    """languages in order; p: pieces of the vocabulary at ``path`` by languages."""

    path: str
    languages: tuple[str, ...]
    p: np.ndarray | None

    def scorer(self):
        pieces = pieces_of(self.path)
        known, logs = np.zeros(0, np.uint64), np.zeros((0, len(self.languages)))

        def score(texts: pa.Array) -> tuple[list[str], np.ndarray]:
            nonlocal known, logs
            names, best = [], np.zeros(len(texts))
            data, offsets = text_buffers(lowered(texts))
            w = LetterWords(data, offsets)
            values, first, inverse = np.unique(w.hash[0], return_index=True, return_inverse=True)
            at = np.searchsorted(known, values)
            old = known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)
            table_ = np.zeros((len(values), len(self.languages)))
            table_[old] = logs[at[old]]
            new = np.flatnonzero(~old)
            if len(new):
                size = (w.end - w.start)[first[new]]
                order = np.argsort(size, kind="stable")
                new, size, low = new[order], size[order], 0
                for k in range(1, len(new) + 1):
                    # words of like length together; many languages are summed few at a time
                    if k == len(new) or (k + 1 - low) * (size[k] + 1) > CELLS or k - low >= 4000:
                        part, low = new[low:k], k
                        words, lengths = w.matrix(first[part])
                        for g in range(0, len(self.languages), 8):
                            table_[part, g : g + 8] = forward(words, lengths, self.p[:, g : g + 8], pieces)
                if len(known) + len(new) > CACHE:
                    known, logs = values, table_
                else:
                    both = np.concatenate((known, values[new]))
                    order = np.argsort(both, kind="stable")
                    known, logs = both[order], np.concatenate((logs, table_[new]))[order]
            n = len(texts)
            total = np.stack([np.bincount(w.row, weights=table_[inverse, k], minlength=n) for k in range(len(self.languages))], axis=1)
            total -= total.max(axis=1, keepdims=True)
            post = np.exp(total)
            post /= post.sum(axis=1, keepdims=True)
            top = post.argmax(axis=1)
            for i, t in enumerate(texts.to_pylist()):
                ok = bool(t) and any(map(str.isalpha, t))
                names.append(self.languages[top[i]] if ok else "und")
                best[i] = post[i, top[i]] if ok else 0.0
            return names, best

        return score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", may_learn: Column | None = None, most_docs: int = MOST_DOCS, path: str | None = None) -> Model:
    """Fit one distribution per language on at most ``most_docs`` texts of each."""
    path = path or default_vocabulary()[0]
    may_learn = F.lit(True) if may_learn is None else may_learn
    order = [F.xxhash64(F.lit(3), F.col("id")), F.col("id")]
    ids = docs.where(may_learn).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null")
    # the least of each of some parts, then of all: the last task of a common language gets as many rows as PARTS allow, whatever the table
    for by in (["lang", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(PARTS))], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= most_docs).drop("n")
    ids = ids.distinct()
    sample = docs.where(may_learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("lang", "text").repartition(24)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            data, offsets = text_buffers(lowered(batch.column(1)))
            langs = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                w = LetterWords(data, offsets[i : j + 1])
                raw = w.data.tobytes()
                for row, start, end in zip(w.row.tolist(), w.start.tolist(), w.end.tolist(), strict=True):
                    seen.setdefault(langs[i + row], Counter())[b" " + raw[start:end]] += 1
        rows = [(g, word, n) for g, c in seen.items() for word, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    counts = cut(sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def fit(group: pa.Table) -> pa.Table:
        # the words of at most most_docs texts
        p = learn(Counter(dict(zip(group["word"].to_pylist(), group["n"].to_pylist(), strict=True))), pieces_of(path))
        return pa.table({"lang": group["lang"].slice(0, 1), "p": pa.array([p.tobytes()], pa.binary())})

    made = counts.groupBy("lang").applyInArrow(fit, "lang string, p binary").orderBy("lang").toArrow()  # a row per language
    languages = tuple(made["lang"].to_pylist())
    if not languages:
        return Model(path, (), None)
    order = sorted(range(len(languages)), key=languages.__getitem__)
    return Model(path, tuple(languages[i] for i in order), np.stack([np.frombuffer(made["p"][i].as_py()) for i in order], axis=1))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages: fixed by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = m.scorer() if m.languages else None
        for batch in batches:
            offsets = text_buffers(batch.column(1))[1]
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                names, best = score(part.column(1)) if score else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(best)], names=["id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """One fold of three, never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of two folds of three."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, may_learn=~held_out())
    return identify(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
