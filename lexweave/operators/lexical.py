"""Inverted index and BM25: postings, lengths, statistics, scores, and an index stored by shard."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import fnv_shard, query_terms, terms

PROSE, IDENTIFIER = re.compile(fixed.PROSE), re.compile(fixed.IDENTIFIER)


def term_counts(text: str | None) -> Counter:
    """Index terms of a text: prose tokens in lower case and identifiers of two characters or more."""
    out: Counter = Counter()
    for word, n in Counter(PROSE.findall(text or "")).items():
        out[word.lower()] += n
    for word, n in Counter(IDENTIFIER.findall(text or "")).items():
        if len(word) >= 2:
            out[word] += n
    return out


def postings(chunks: DataFrame) -> DataFrame:
    """(library_id, version, chunk_id, term, term_frequency).

    A chunk is one row, so its terms are counted where it is read, without a shuffle.  A
    term that is both a prose token and an identifier counts once for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, 256):
                batch = big.slice(low, 256)
                row, term, n = [], [], []
                for i, text in enumerate(batch.column(3)):
                    found = term_counts(text.as_py())
                    row += [i] * len(found)
                    term += found
                    n += found.values()
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(term, pa.string()), pa.array(n, pa.int64())], names=["library_id", "version", "chunk_id", "term", "term_frequency"])

    return chunks.select("library_id", "version", "id", "content").mapInArrow(run, "library_id string, version string, chunk_id string, term string, term_frequency long")


def doc_lengths(posted: DataFrame) -> DataFrame:
    return posted.groupBy("library_id", "version", "chunk_id").agg(F.sum("term_frequency").alias("doc_length"))


def lengths_of(chunks: DataFrame) -> DataFrame:
    """``doc_lengths`` straight from the texts, without a shuffle; chunks without terms are left out."""
    return chunks.select("library_id", "version", F.col("id").alias("chunk_id"), F.size(terms(F.col("content"))).cast("long").alias("doc_length")).where("doc_length > 0")


def stats(lengths: DataFrame, shards: int = fixed.SHARDS) -> DataFrame:
    return lengths.agg(F.count("*").alias("document_count"), F.avg("doc_length").alias("average_doc_length")).withColumn("shard_count", F.lit(shards))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def sharded(posted: DataFrame, shards: int = fixed.SHARDS) -> DataFrame:
    return posted.withColumn("shard_index", fnv_shard(F.col("term"), shards))


def shard_sizes(posted: DataFrame, shards: int = fixed.SHARDS) -> DataFrame:
    per_term = posted.groupBy("term").agg(F.count("*").alias("n"))
    return sharded(per_term, shards).groupBy("shard_index").agg(F.count("*").alias("terms"), F.sum("n").alias("postings"))


def posting_bytes(posted: DataFrame) -> DataFrame:
    """Stored size of each term's list, and whether it is past a megabyte."""
    return posted.groupBy("term").agg(F.sum(F.length("chunk_id") + 12).alias("bytes")).withColumn("spills", F.col("bytes") > (1 << 20))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


class Index:
    """An inverted index below a path: postings by shard and term, lengths, and one row of statistics.

    A shard's files are sorted by term, so a search reads the shards of its terms and, by the
    least and greatest term of each part of a file, little else.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, chunks: DataFrame, shards: int = fixed.SHARDS) -> Index:
        """Write the index of these chunks, in place of any other at this path."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        posted = sharded(postings(chunks), shards)
        # a shard is dealt by chunk, so that a very common term is spread as well
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, parts // shards)))
        posted = posted.repartition(parts, "shard_index", part).sortWithinPartitions("shard_index", "term", "chunk_id")
        posted.write.mode("overwrite").partitionBy("shard_index").parquet(f"{self.path}/postings")
        lengths_of(chunks).write.mode("overwrite").parquet(f"{self.path}/lengths")
        stats(self.lengths(), shards).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def postings(self, asked: list[str] | None = None) -> DataFrame:
        """All postings, or those of some terms."""
        rows = self.spark.read.parquet(f"{self.path}/postings")
        if asked is None:
            return rows
        at = {int(r.s) for r in self.spark.createDataFrame([(t,) for t in asked], "t string").select(fnv_shard(F.col("t")).alias("s")).distinct().collect()}
        return rows.where(F.col("shard_index").isin(sorted(at)) & F.col("term").isin(asked))

    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lengths")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def score(self, queries: DataFrame) -> DataFrame:
        """``score`` of queries (query_id, query) from the stored tables."""
        return score(self.postings(), self.lengths(), queries, known=self.stats())

    def score_text(self, text: str) -> DataFrame:
        """(chunk_id, bm25) of one text, from the shards of its terms."""
        asked = sorted(term_counts(text))
        query = self.spark.createDataFrame([("q", text)], "query_id string, query string")
        return score(self.postings(asked), self.lengths(), query, known=self.stats()).drop("query_id")


def score(posted: DataFrame, lengths: DataFrame, queries: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, known: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, bm25) of every chunk with a query term; queries: (query_id, query), known: stored ``stats``.

    The query's terms cut the postings down before anything is counted.  A chunk without a
    length takes the average, rounded down.
    """
    asked = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    hit = posted.join(asked.select("term").distinct(), "term", "left_semi").select("chunk_id", "term", "term_frequency")
    df = document_frequency(hit)
    known = stats(lengths) if known is None else known
    s = F.broadcast(known.select(F.col("document_count").alias("n"), F.col("average_doc_length").alias("avg")))  # one row
    rows = hit.join(df, "term").join(lengths.select("chunk_id", "doc_length"), "chunk_id", "left").join(s)
    length = F.coalesce(F.col("doc_length"), F.floor("avg"))
    tf = F.col("term_frequency")
    part = idf(F.col("n"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avg")))
    return rows.select("chunk_id", "term", part.alias("part")).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("bm25"))


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """Best n by score, then id."""
    return scored.where("bm25 > 0").orderBy(F.desc("bm25"), "chunk_id").limit(n)
