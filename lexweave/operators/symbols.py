"""Identifier tokens, symbols, rejections and corpus context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as X
from ..session import cut

TOKEN = re.compile(fixed.TOKEN)
#: A declaring word that no letter precedes, and what it declares.
DECLARING = re.compile(r"(?<![^\W\d])(" + "|".join(fixed.DECLARED) + r")\s+(?=[A-Za-z_])", re.I)
KEY = ["library_id", "version"]
#: What a token's fate hangs on, besides its library.
SHAPE = ["name", "callable", "generic", "keyword"]


def split_name(name: str) -> tuple[str, str | None]:
    """(leaf, container) of a name, by its last separator."""
    for sep in ("::", "->", "."):
        left, found, right = name.rpartition(sep)
        if found:
            return right, left
    return name, None


def candidates(content: str | None) -> list[tuple]:
    """Distinct (name, leaf, container, callable, generic, declaring word) of a text, in order; one pass over it."""
    content = content or ""
    declared = {m.end(): m[1].lower() for m in DECLARING.finditer(content) if m[1].lower() in fixed.DECLARED}
    seen: dict[tuple, str | None] = {}
    for m in TOKEN.finditer(content):
        after = content[m.end() : m.end() + 1]
        keyword = declared.get(m.start())
        seen.setdefault((m[0], after == "(", after == "<", keyword is not None), keyword)
    return [(name, *split_name(name), call, generic, keyword) for (name, call, generic, _), keyword in seen.items()]


def tokens(chunks: DataFrame) -> DataFrame:
    """(library_id, version, id, pos, name, leaf, container, callable, generic, keyword) of every chunk's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, 256):
                batch = big.slice(low, 256)
                row, pos, found = [], [], []
                for i, text in enumerate(batch.column(3)):
                    got = candidates(text.as_py())
                    row += [i] * len(got)
                    pos += range(len(got))
                    found += got
                at = pa.array(row, pa.int32())
                flat = list(zip(*found, strict=True)) if found else [()] * 6
                kinds = [pa.string()] * 3 + [pa.bool_()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(pos, pa.int32()), *(pa.array(x, k) for x, k in zip(flat, kinds, strict=True))], names=["library_id", "version", "id", "pos", "name", "leaf", "container", "callable", "generic", "keyword"])

    return chunks.select(*KEY, "id", "content").mapInArrow(run, "library_id string, version string, id string, pos int, name string, leaf string, container string, callable boolean, generic boolean, keyword string")


def code_fence_symbols(chunks: DataFrame) -> DataFrame:
    """Distinct identifiers, and parts of dotted ones, inside fenced or pre-formatted code."""
    fence = F.regexp_extract_all("content", F.lit(r"(?s)```[^\r\n]*\r?\n(.*?)```"), F.lit(1))
    pre = F.regexp_extract_all("content", F.lit(r"(?is)<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>"), F.lit(1))
    block = chunks.select("library_id", "version", F.explode(F.concat(fence, pre)).alias("block"))
    ids = block.select("library_id", "version", F.explode(F.filter(F.regexp_extract_all("block", F.lit(fixed.IDENTIFIER), F.lit(0)), lambda x: F.length(x) >= 2)).alias("id"))
    parts = F.filter(F.split("id", r"\.|::|->"), lambda x: F.length(x) >= 2)
    return ids.select("library_id", "version", F.explode(F.array_distinct(F.concat(F.array("id"), parts))).alias("name")).distinct()


def prose_mentions(chunks: DataFrame) -> DataFrame:
    """(name, mentions) of capitalised words outside code."""
    words = F.regexp_extract_all(X.strip_fences(F.col("content")), F.lit(fixed.MENTION), F.lit(0))
    return chunks.select("library_id", "version", F.explode(words).alias("name")).where(F.length("name") >= 2).groupBy("library_id", "version", "name").agg(F.count("*").alias("mentions"))


def dotted_identifiers(chunks: DataFrame) -> DataFrame:
    """Distinct dotted identifiers and every neighbouring pair in them."""
    path = chunks.select("library_id", "version", F.explode(F.regexp_extract_all("content", F.lit(fixed.DOTTED), F.lit(0))).alias("path")).distinct()
    seg = F.split("path", r"\.")
    pairs = F.transform(F.sequence(F.lit(0), F.size(seg) - 2), lambda i: F.concat_ws(".", F.get(seg, i), F.get(seg, i + 1)))
    return path.select("library_id", "version", F.explode(F.array_union(F.array("path"), pairs)).alias("name")).distinct()


def decided(shapes: DataFrame, profiles: DataFrame | None = None, fences: DataFrame | None = None, mentions: DataFrame | None = None, threshold: int = 3) -> DataFrame:
    """Reason (null if kept) and kind of each distinct token of a library version; context is joined by name and by leaf."""
    rows = shapes
    if profiles is None:
        none = F.array().cast("array<string>")
        rows = rows.withColumns({"likely_symbols": none, "stoplist": none, "types": F.lit(""), "methods": F.lit("")})
    else:
        rows = rows.join(profiles.select(*KEY, "likely_symbols", F.transform("stoplist", F.lower).alias("stoplist"), "types", "methods"), KEY, "left")
    fenced: Column = F.lit(False)
    mention_name = mention_leaf = F.lit(0)
    if fences is not None:
        for c in ("name", "leaf"):
            rows = rows.join(fences.select(*KEY, F.col("name").alias(c), F.lit(True).alias(f"fence_{c}")), [*KEY, c], "left")
        fenced = F.coalesce("fence_name", "fence_leaf", F.lit(False))
    if mentions is not None:
        for c in ("name", "leaf"):
            rows = rows.join(mentions.select(*KEY, F.col("name").alias(c), F.col("mentions").alias(f"mention_{c}")), [*KEY, c], "left")
        mention_name, mention_leaf = F.col("mention_name"), F.col("mention_leaf")
    likely = F.coalesce(F.array_contains("likely_symbols", F.col("name")) | F.array_contains("likely_symbols", F.col("leaf")), F.lit(False))
    reason = X.rejection_reason(F.col("name"), F.col("leaf"), F.col("container"), F.col("keyword").isNotNull(), F.col("callable"), F.col("generic"), likely, fenced, mention_name, mention_leaf, F.col("stoplist"), threshold)
    kind = X.symbol_kind(F.col("keyword"), F.col("callable"), F.col("generic"), F.col("container"), likely, F.col("leaf"), F.col("types"), F.col("methods"))
    return rows.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNull(), kind)).select(*KEY, *SHAPE, "reason", "kind")


def extract(chunks: DataFrame, profiles: DataFrame | None = None, fences: DataFrame | None = None, mentions: DataFrame | None = None, threshold: int = 3) -> DataFrame:
    """One row per chunk and token: id, pos, the token, reason (null if kept) and kind.

    profiles: (library_id, version, likely_symbols, stoplist, types, methods).  Context is
    looked up once for each distinct token of a library version, not at each of its places.
    """
    rows = cut(tokens(chunks))
    shapes = rows.groupBy(*KEY, *SHAPE).agg(F.first("leaf").alias("leaf"), F.first("container").alias("container"))
    known = cut(decided(shapes, profiles, fences, mentions, threshold))
    same = lambda c: F.coalesce(F.col(c), F.lit(""))  # noqa: E731  a token without a declaring word
    out = rows.withColumn("k", same("keyword")).join(known.withColumn("k", same("keyword")).drop("keyword"), [*KEY, "name", "callable", "generic", "k"])
    return out.select("library_id", "version", "id", "pos", "name", "leaf", "container", "reason", "kind")


def per_chunk(tokens: DataFrame) -> DataFrame:
    """Symbols (first of each name, in order) and primary name of every chunk with a kept token."""
    first = tokens.where("reason is null").groupBy("library_id", "version", "id", "name").agg(F.min(F.struct("pos", "kind", "container")).alias("s"))
    ordered = first.groupBy("library_id", "version", "id").agg(F.array_sort(F.collect_list(F.struct("s.pos", "name", "s.kind", "s.container"))).alias("s"))
    out = ordered.withColumn("symbols", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["container"].alias("container")))).drop("s")
    return out.withColumn("primary_name", X.primary_name(F.col("symbols")))


def sample_window(content: str, token: str, side: int = 100, most: int = 200) -> str | None:
    """Words around a token's first place, at most ``most`` characters; None if it has none."""
    at = content.find(token)
    if at < 0:
        return None
    low, high = max(0, at - side), min(len(content), at + len(token) + side)
    while low > 0 and not content[low - 1].isspace():
        low -= 1
    while high < len(content) and not content[high].isspace():
        high += 1
    text = " ".join(content[low:high].split())
    if len(text) <= most:
        return text
    at = text.find(token)
    room = most - len(token)
    after = min(len(text) - at - len(token), room - min(at, room // 2))
    before = min(at, room - after)
    return text[at - before : at + len(token) + after].strip()


@F.pandas_udf(T.StringType())
def sample_windows(contents: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or not t else sample_window(c, t) for c, t in zip(contents, tokens, strict=True)], dtype=object)


def numbered(chunks: DataFrame) -> DataFrame:
    """(library_id, version, id, ix): chunks numbered from 0 by id within a library version.

    Ids alone are range partitioned, so a large version is numbered by many tasks: a number is the
    place within a part plus the version's rows in the parts before.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(chunks.select(*KEY, "id").repartitionByRange(n, *KEY, "id").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy(*KEY, "part").agg(F.count("*").alias("n"))  # a row per version and part it touches
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*KEY, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*KEY, "part").orderBy("id")) - 1
    return parts.withColumn("place", place).join(offsets, [*KEY, "part"]).select(*KEY, "id", (F.col("place") + F.col("before")).alias("ix"))


def excluded(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rejected names with first reason, number of chunks, and a sample from each third of the chunks.

    Chunks are numbered by id within a library version; the thirds come from that number.
    """
    total = chunks.groupBy(*KEY).agg(F.count("*").alias("total"))
    rejected = tokens.where("reason is not null").groupBy(*KEY, "id", "name").agg(F.min(F.struct("pos", "reason")).alias("r"))
    rows = rejected.join(numbered(chunks), [*KEY, "id"]).join(total, KEY)
    bucket = F.least(F.floor(F.col("ix") / F.greatest(F.floor(F.col("total") / 3), F.lit(1))), F.lit(2)).cast("int")
    rows = cut(rows.select(*KEY, "name", "id", "ix", "r.reason", bucket.alias("bucket")))
    facts = rows.groupBy(*KEY, "name").agg(F.min_by("reason", "ix").alias("reason"), F.count("*").alias("chunk_count"))
    firsts = rows.groupBy(*KEY, "name", "bucket").agg(F.min_by("id", "ix").alias("id"))
    samples = firsts.join(chunks.select(*KEY, "id", "content"), [*KEY, "id"]).withColumn("sample", sample_windows("content", "name"))
    samples = samples.groupBy(*KEY, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "sample"))), lambda x: x["sample"]).alias("sample_sentences"))
    return facts.join(samples, [*KEY, "name"], "left")
