"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts P and unlabelled texts U train linear classifiers.  With
class prior q and logistic loss l, the risk of a classifier g is
``q * mean_P l(g) + max(0, mean_U l(-g) - q * mean_P l(-g))``: the second part
is what negatives alone would cost, and is kept from going below zero, against
overfitting (when it does, the step goes up that part instead).  Three
classifiers each see their own part of U; a text's score is the mean of their
probabilities.

A feature is a word (run of letters, lower case) or the first 4 to 7 letters of
a longer word; its value is its count over the fourth root of the number of words.
A feature is used if it occurs in more of P's texts than chance would have it, given
the share of all texts of the table that have it; none is cut off.  Prior and shares are
counted over all rows that may be learned from.

Only ids, texts and labels are read.  What the risk is computed on is a sample of labelled
rows, those least by a hash of the id, whole: P is at most ``most_positive`` confirmed
toxic ones; U is at most ``most_labelled`` of either label, whose labels are withheld,
so that they stand for texts without one.  All texts are scored, whole.

Null and empty texts score what no feature scores.  Repeated rows score alike.
Labels that are null don't count; an id with several labels is toxic if one
says so.  Without a confirmed example every score is 0.  Empty tables give
empty results.  Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WORDS = re.compile(r"[^\W\d_]+").findall
PREFIXES = (4, 5, 6, 7)
#: Counts are divided by this power of the number of words: long texts may say a bad word by chance.
POWER = 0.25
BAGS = 3
#: Bounds of the training sample, in labelled rows.
MOST_POSITIVE, MOST_LABELLED = 4_000, 12_000
LEAST_COUNT, LEAST_Z = 3, 4.0


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def text_counts(text: str | None) -> tuple[Counter, int]:
    words = WORDS((text or "").lower())
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for f in features(word):
            out[f] += n
    return out, len(words)


@dataclass(frozen=True)
class Model:
    """weights[f] has one weight per classifier; bias likewise. No weights: no examples."""

    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    prior: float

    def scorer(self) -> Callable[[str | None], float]:
        zero = (0.0,) * len(self.bias)
        cache: dict[str, tuple[float, ...] | None] = {}

        def of(word: str) -> tuple[float, ...] | None:
            found = [self.weights[f] for f in features(word) if f in self.weights]
            return tuple(map(sum, zip(*found, strict=True))) if found else None

        def score(text: str | None) -> float:
            if not self.bias:
                return 0.0
            words = WORDS((text or "").lower())
            if len(cache) > 200_000:
                cache.clear()
            sums = zero
            for word in words:
                try:
                    w = cache[word]
                except KeyError:
                    w = cache[word] = of(word)
                if w is not None:
                    sums = tuple(map(sum, zip(sums, w, strict=True)))
            root = max(1, len(words)) ** POWER
            return sum(1 / (1 + math.exp(-max(-30.0, min(30.0, b + s / root)))) for b, s in zip(self.bias, sums, strict=True)) / len(self.bias)

        return score


def nnpu(p: tuple[np.ndarray, np.ndarray, np.ndarray, int], u: tuple[np.ndarray, np.ndarray, np.ndarray, int], width: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4, start: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; p and u are (row, feature, value, rows)."""
    w = np.zeros(width + 1)
    w[-1] = start
    m, v = np.zeros_like(w), np.zeros_like(w)

    def margins(x):
        row, col, value, n = x
        return np.bincount(row, weights=value * w[col], minlength=n) + w[-1]

    def gradient(x, g):
        row, col, value, n = x
        out = np.zeros_like(w)
        out[:-1] = np.bincount(col, weights=value * g[row], minlength=width) / n
        out[-1] = g.sum() / n
        return out

    for t in range(1, steps + 1):
        gp, gu = margins(p), margins(u)
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative = gradient(u, su) - prior * gradient(p, sp)
        grad = prior * gradient(p, sp - 1) + d_negative if negative >= 0 else -d_negative
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn: Column | None = None, most_positive: int = MOST_POSITIVE, most_labelled: int = MOST_LABELLED) -> Model:
    """Fit on rows where ``may_learn`` (of the id column) holds; the sample is bounded as documented above."""
    may_learn = F.lit(True) if may_learn is None else may_learn
    order = F.xxhash64(F.lit(7), F.col("id"))
    given = labels.where(may_learn).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    given = cut(given)
    n, toxic = given.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)), F.lit(0))).first()
    if not toxic:
        return Model({}, (), 0.0)
    prior = min(0.9, toxic / n)
    chosen = given.where("y > 0").orderBy(order, "id").limit(most_positive).select("id", F.lit(1).alias("p"))
    others = given.orderBy(order, "id").limit(most_labelled).select("id", F.lit(0).alias("p"))
    # at most most_positive + most_labelled ids
    ids = F.broadcast(chosen.unionByName(others).groupBy("id").agg(F.max("p").alias("p"), F.min("p").alias("u")))
    learnable_docs = docs.where(may_learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = cut(learnable_docs.join(ids, "id").select("id", "text", "p", (F.col("u") == 0).alias("u")).repartition(24, "id"))
    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum(F.col("p").cast("long")), F.sum(F.col("u").cast("long"))).first())
    if not n_p or not n_u:
        return Model({}, (), 0.0)

    def in_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(text_counts(text.as_py())[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["f", "n"])

    # what at most most_positive texts hold
    often = sample.where("p = 1").select("text").mapInArrow(in_positives, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).orderBy("f").toArrow()
    names, np_ = often["f"].to_pylist(), often["n"].to_numpy()
    if not names:
        return Model({}, (), prior)
    in_all, total = document_frequencies(learnable_docs, names)
    mean = (np_ + in_all) / (n_p + total)
    z = (np_ / n_p - in_all / total) / np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / total) + 1e-12)
    names = [f for f, x in zip(names, z, strict=True) if x >= LEAST_Z]
    if not names:
        return Model({}, (), prior)
    place = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, values = [], []
            for text in batch.column(1):
                found, length = text_counts(text.as_py())
                hit = sorted((place[f], n / max(1, length) ** POWER) for f, n in found.items() if f in place)
                cols.append([i for i, _ in hit])
                values.append([x for _, x in hit])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["id", "p", "u", "col", "value"])

    id_type = sample.schema["id"].dataType.simpleString()
    data = sample.mapInArrow(rows, f"id {id_type}, p int, u boolean, col array<int>, value array<double>").orderBy(order, "id").drop("id").toArrow()

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        at = np.flatnonzero(mask)
        cols, values = (data[c].combine_chunks().take(pa.array(at)) for c in ("col", "value"))
        row = np.repeat(np.arange(len(at)), cols.value_lengths().to_numpy(zero_copy_only=False))
        return row, cols.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), len(at)

    is_p = data["p"].to_numpy() == 1
    is_u = data["u"].to_numpy().astype(bool)
    bag = np.cumsum(is_u) % BAGS
    made = []
    for b in range(BAGS):
        u = is_u & ((bag != b) if is_u.sum() >= 20 * BAGS else True)
        made.append(nnpu(part(is_p), part(u), len(names), prior, start=math.log(prior / (1 - prior))))
    weights = {f: tuple(float(w[i]) for w, _ in made) for f, i in place.items()}
    return Model(weights, tuple(b for _, b in made), prior)


def document_frequencies(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """How many of all texts have each of the features, and how many texts there are; docs: (id, text)."""
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # of a bounded sample of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        found, n = np.zeros(len(at), dtype=np.int64), 0
        of: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                hit: set[int] = set()
                for word in set(WORDS((text.as_py() or "").lower())):
                    which = of.get(word)
                    if which is None:
                        if len(of) > 200_000:
                            of.clear()
                        which = of[word] = tuple(at[f] for f in features(word) if f in at)
                    hit.update(which)
                found[list(hit)] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], names=["i", "n"])

    got = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(len(names), dtype=np.int64), 0
    for i, n in zip(got["i"].to_pylist(), got["n"].to_pylist(), strict=True):
        if i < 0:
            total = n
        else:
            out[i] = n
    return out, total


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` by id and text, with ``score`` and ``predicted``; columns id, text, score, predicted."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of what a bounded sample of texts holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for big in batches:
            for start in range(0, big.num_rows, 512):
                batch = big.slice(start, 512)
                s = np.array([of(x.as_py()) for x in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", may_learn: Column | None = None) -> DataFrame:
    """``docs`` without the rows that a model trained on them and ``labels`` predicts toxic."""
    model = train(docs, labels, id_col, text_col, may_learn=may_learn)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(x.as_py()) < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that labels may be learned from: four folds of five."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model of the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), may_learn=learnable())
    return score(docs, model).select(F.col("id").alias("doc_id"), (~learnable("id")).alias("held_out"), "score", "predicted")
