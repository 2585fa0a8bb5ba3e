"""Exact substring dedup by difference-cover anchors.

A window is ``length`` consecutive words.  With a difference cover D modulo P,
two equal windows at any two places share an offset below P at which both
places lie in D; the ``length - P + 1`` words there are an anchor.  So hashing
anchors only at cover positions (5 of 21) still meets every repeated window.

1. One scan emits the anchors of every text.  A repeated anchor is one that
   occurs at two places.
2. Texts with repeated anchors are extended: each repeated anchor stands in at
   most P windows, and only those windows are hashed in full (96 bits) and
   counted.  A window counted twice covers its words.
Rows with equal texts form one class that is hashed once; its words, if it has
a window and two rows or more, are all repeated.  Counting is by hash, so a
passage that a third of all rows share costs a row per place, never a pair.  A task
combines what it has before the shuffle: places whose repetition it sees itself are
known, are dealt out evenly, and leave one or two rows that speak for them, so
a hot anchor or window is at most two rows for each ``MOST_HELD`` of a task.

Null and empty texts have no words.  Rows that repeat are places of their own.
Null or repeated ids are fine: rows are told apart by id and text.  An empty
table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, cut, mix64, run_hash, slices, table, text_buffers

LENGTH = 35
#: Anchors or windows that a task holds to combine them.
MOST_HELD = 1 << 20
#: A perfect difference cover modulo 21: every difference occurs.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


def check_cover(length: int, period: int, cover: tuple[int, ...]) -> int:
    """The anchor length; raises if some shift has no aligned pair in the cover."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or length < period:
        raise ValueError("not a difference cover for windows of this length")
    return length - period + 1


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text (null: empty)."""
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("k2")]


def held_together(parts: Iterator[tuple[np.ndarray, ...]], most: int = MOST_HELD) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts' columns, strung together until there are ``most`` rows."""
    kept: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        kept.append(part)
        n += len(part[0])
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))
            kept, n = [], 0
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def combined(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, k, n) of a task's anchors: places of one text are one row, n of them.

    An anchor that the task has in several texts has a row of n = 0 for each, known to be
    repeated in another text, and rows of n = 2 for its least and greatest k, for other tasks.
    """
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new_h = np.ones(len(h), dtype=bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    h, k, new_h = h[at], k[at], new_h[at]
    first = np.flatnonzero(new_h)
    size = np.diff(np.append(first, len(h)))
    many = size > 1
    n[np.repeat(many, size)] = 0
    low, high = first[many], first[many] + size[many] - 1
    both = np.concatenate((low, high))
    return np.concatenate((h, h[both])), np.concatenate((k, k[both])), np.concatenate((n, np.full(len(both), 2)))


def anchors(texts: DataFrame, length: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(h, k, n) of the anchors of texts of at least ``length`` words, combined by task; texts: (k, text)."""
    size = check_cover(length, period, cover)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                w = Words(data, offsets[i : j + 1])
                at = at_cover(w, length, period, cover, size)
                yield run_hash(w.hash[0], at, size, 21).view(np.int64), keys[i:j][w.row[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in held_together(found(batches)):
            h, k, n = combined(*held)
            for low in range(0, len(h), 200_000):
                part = slice(low, low + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(k[part]), pa.array(n[part].astype(np.int32))], names=["h", "k", "n"])

    return texts.mapInArrow(run, "h long, k long, n int")


def squeezed(texts: DataFrame) -> DataFrame:
    """The texts, last column, as compressed binaries: what is shuffled and stored is less than half."""
    import zstandard

    names = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            small = [press(x.as_buffer().to_pybytes()) if x.is_valid else None for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(small, pa.binary())], names=[*names, "text"])

    return texts.mapInArrow(run, ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names) + ", text binary")


def unsqueezed(column: pa.Array) -> pa.Array:
    import zstandard

    full = zstandard.ZstdDecompressor().decompress
    return pa.array([full(x.as_buffer()) if x.is_valid else None for x in column], pa.large_binary())


def at_cover(w: Words, length: int, period: int, cover: tuple[int, ...], size: int) -> np.ndarray:
    """Indices of the words that start an anchor."""
    n = np.diff(w.begin)[w.row]
    pos = np.arange(len(w)) - w.begin[w.row]
    return np.flatnonzero(np.isin(np.arange(period), cover)[pos % period] & (n >= length) & (pos + size <= n))


def windows(texts: DataFrame, length: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(w1, w2, row, pos) of the windows that hold a repeated anchor, combined by task; texts: (row, text, anchors).

    Windows that the task has twice are known to be repeated: their places have a null w2 and a w1 of
    their own, and a row without a place stands for each of them twice in other tasks' eyes.
    """
    size = check_cover(length, period, cover)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in (big.slice(k, 512) for big in batches for k in range(0, big.num_rows, 512)):
            data, offsets = text_buffers(unsqueezed(batch.column(1)))
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                w = Words(data, offsets[i : j + 1], hashes=2)
                at = at_cover(w, length, period, cover, size)
                known = batch.column(2).slice(i, j - i)
                # an anchor of a row is told by its hash and row together; a chance hit only adds windows to judge
                salt = mix64(np.arange(1, j - i + 1, dtype=np.uint64))
                have = known.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ np.repeat(salt, known.value_lengths().to_numpy(zero_copy_only=False))
                at = at[np.isin(run_hash(w.hash[0], at, size, 21) ^ salt[w.row[at]], have)]
                first, n = w.begin[:-1][w.row[at]], np.diff(w.begin)[w.row[at]]
                low = np.maximum(at - (length - size), first)
                high = np.minimum(at, first + n - length) + 1
                ok = high > low
                step = np.zeros(len(w) + 1, dtype=np.int64)
                np.add.at(step, low[ok], 1)
                np.add.at(step, high[ok], -1)
                start = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                r = w.row[start]
                second = (run_hash(w.hash[1], start, length, 32) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield run_hash(w.hash[0], start, length, 31).view(np.int64), second, rows[i:j][r], (start - w.begin[r]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w1, w2, row, pos in held_together(found(batches)):
            order = np.lexsort((w2, w1))
            w1, w2, row, pos = w1[order], w2[order], row[order], pos[order]
            new = np.ones(len(w1), dtype=bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(w1)))
            again = np.repeat(times > 1, times)
            for part in np.array_split(np.arange(len(w1)), max(1, len(w1) // 200_000)):
                known = again[part]
                own = np.where(known, mix64(row[part].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos[part].astype(np.uint64)).view(np.int64), w1[part])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(w2[part], mask=known), pa.array(row[part]), pa.array(pos[part])], names=["w1", "w2", "row", "pos"])
            at = at[times > 1]
            none = np.ones(len(at), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(w1[at]), pa.array(w2[at]), pa.array(row[at], mask=none), pa.array(pos[at], mask=none)], names=["w1", "w2", "row", "pos"])

    return texts.mapInArrow(run, "w1 long, w2 int, row long, pos int")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> tuple[DataFrame, DataFrame]:
    """What repeats, by text: ``copies(k1, k2)``, texts of two rows or more that are repeated
    whole if they have a window, and ``starts(k1, k2, text, starts)``, other texts with the
    first words of their repeated windows.
    """
    rows = df.select(F.col(text_col).alias("text"), *text_key(F.col(text_col)), F.xxhash64(F.col(id_col)).alias("own"))
    # 40 bits deal out anchors; texts that share them only share candidates
    rows = rows.withColumn("k", F.shiftrightunsigned("k1", 24))
    classes = cut(rows.where("text <> ''").groupBy("k", "k1", "k2").agg(F.count("*").alias("n"), F.min("own").alias("rep")).where("n > 1"))
    # a known anchor is dealt by itself and its text, an anchor to count by itself alone
    hidden = F.when(F.col("n") == 0, F.col("h").bitwiseXOR(F.xxhash64("k"))).otherwise(F.col("h"))
    found = anchors(rows.select("k", "text"), length, period, cover).withColumn("g", hidden).select("g", "k", "n")
    by = Window.partitionBy("g")
    known = F.col("n") == 0
    count, low, high = (f(F.when(~known, F.col(c))).over(by) for f, c in ((F.sum, "n"), (F.min, "k"), (F.max, "k")))
    twice = found.withColumn("far", known | (low != high)).withColumn("c", F.coalesce(count, F.lit(0))).where(known | (F.col("c") > 1))
    twice = twice.select(F.when(F.col("n") == 0, F.col("g").bitwiseXOR(F.xxhash64("k"))).otherwise(F.col("g")).alias("h"), "k", "far")
    # far: in another text as well; near: only in one text or its copies
    places = twice.groupBy("k").agg(F.collect_set(F.when(F.col("far"), F.col("h"))).alias("far"), F.collect_set(F.when(~F.col("far"), F.col("h"))).alias("near"))
    places = cut(places.join(classes.groupBy("k").agg(F.collect_list(F.struct("k1", "k2", "rep")).alias("classes")), "k", "left"))
    mine = F.filter("classes", lambda c: (c["k1"] == F.col("k1")) & (c["k2"] == F.col("k2")))
    held = squeezed(rows.select("k", "k1", "k2", "own", "text")).join(places, "k").withColumn("class", F.try_element_at(mine, F.lit(1)))
    # one row stands for a class of copies; its windows matter to other texts only
    held = held.where("class is null or own = class.rep").withColumn("anchors", F.when(F.col("class").isNull(), F.concat("far", "near")).otherwise(F.col("far"))).where("size(anchors) > 0")
    held = held.select("k1", "k2", "text", "anchors", F.col("class").isNotNull().alias("many"), F.monotonically_increasing_id().alias("row"))
    texts = cut(held)
    judged = windows(texts.select("row", "text", "anchors"), length, period, cover)
    again = judged.withColumn("c", F.count("*").over(Window.partitionBy("w1", "w2"))).where("row is not null and (w2 is null or c > 1)")
    starts = again.groupBy("row").agg(F.collect_set("pos").alias("starts"))
    return classes.select("k1", "k2"), texts.where("not many").select("row", "k1", "k2", "text").join(starts, "row").select("k1", "k2", "text", "starts")


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step)[:-1] > 0


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id_col, n_words, n_removed, kept_sha256."""
    copies, changed = repeated(df, id_col, text_col, length)
    id_type = df.schema[id_col].dataType.simpleString()

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = [], []
            for text in batch.column(3):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n.append(len(words))
                sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sums, pa.string())], names=[id_col, "k1", "k2", "n_words", "whole"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = [], []
            for text, at in zip(unsqueezed(batch.column(2)), batch.column(3), strict=True):
                words = text.as_buffer().to_pybytes().split()
                gone = covered(at.values.to_numpy(zero_copy_only=False), len(words), length)
                n.append(int(gone.sum()))
                sums.append(hashlib.sha256(b" ".join(words[k] for k in np.flatnonzero(~gone))).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sums, pa.string())], names=["k1", "k2", "removed", "rest"])

    base = df.select(F.col(id_col), *text_key(F.col(text_col)), F.col(text_col).alias("text")).mapInArrow(plain, f"`{id_col}` {id_type}, k1 long, k2 long, n_words long, whole string")
    some = changed.mapInArrow(kept, "k1 long, k2 long, removed long, rest string")
    out = base.join(some, ["k1", "k2"], "left").join(copies.withColumn("many", F.lit(True)), ["k1", "k2"], "left")
    all_gone = F.col("many").isNotNull() & (F.col("n_words") >= length)
    return out.select(
        id_col,
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with repeated passages cut out of its texts; a text without any is left as it is, byte for byte.

    A cut takes the covered words and the white space before each.  Rows of
    repeated texts that hold a window keep an empty text.
    """
    copies, changed = repeated(df, id_col, text_col, length)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, at in zip(unsqueezed(batch.column(2)), batch.column(3), strict=True):
                raw = text.as_buffer()
                data = np.frombuffer(raw, dtype=np.uint8)
                w = Words(data, np.array([0, len(data)]))
                gone = covered(at.values.to_numpy(zero_copy_only=False), len(w), length)
                low = np.concatenate(([0], w.end[:-1]))
                step = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(step, low[gone], 1)
                np.add.at(step, w.end[gone], -1)
                texts.append(data[np.cumsum(step)[:-1] == 0].tobytes().decode().strip(" \t\n\v\f\r"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["k1", "k2", "rest"])

    some = changed.mapInArrow(kept, "k1 long, k2 long, rest string")
    names = df.columns
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"), *text_key(F.col(text_col)))
    out = given.join(some, ["k1", "k2"], "left").join(copies.withColumn("many", F.lit(True)), ["k1", "k2"], "left")
    long_enough = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= length
    text = F.when(F.col("many").isNotNull() & long_enough, F.lit("")).otherwise(F.coalesce("rest", "text"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names])


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows of 35 words cover."""
    return digests(table(spark, sf_dir, "documents"))


#: Every window of every text, counted.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, i, array_to_string(w[i:i+34], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM w)
), d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM p) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM d),
t AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT t.r, count(*) AS n, string_agg(x, ' ' ORDER BY t.i) AS s FROM t ANTI JOIN gone ON gone.r = t.r AND gone.i = t.i GROUP BY t.r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""
