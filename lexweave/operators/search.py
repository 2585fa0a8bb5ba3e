"""Vector, lexical and hybrid search; re-ranking; look-ups by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import parse_score, query_shape, score_word
from ..session import cut
from . import lexical


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for unequal lengths, zero or null vectors."""
    mul = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(mul(a, a)) * F.sqrt(mul(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), mul(a, b) / norm).otherwise(0.0)


def parsed_category(text: str | None) -> str | None:
    """The category that a text names in any case; none: no filter."""
    return next((c for c in fixed.CATEGORIES if text and c.lower() == text.lower()), None)


def vector_scores(chunks: DataFrame, query: Sequence[float] | DataFrame, category: str | None = None) -> DataFrame:
    """Chunks that have a vector, with their cosine to the query; query: values or a one-row frame (q)."""
    rows = chunks.where("embedding is not null")
    known = parsed_category(category)
    if known:
        rows = rows.where(F.col("category") == known)
    if isinstance(query, DataFrame):
        rows = rows.join(F.broadcast(query.limit(1)))  # one row
    else:
        rows = rows.withColumn("q", F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("vector_score", cosine(F.col("embedding"), F.col("q"))).drop("q")


def vector_topk(chunks: DataFrame, query: Sequence[float] | DataFrame, k: int = 5, category: str | None = None) -> DataFrame:
    return vector_scores(chunks, query, category).orderBy(F.desc("vector_score"), "id").limit(k)


def blend(hits: DataFrame, bm25: DataFrame) -> DataFrame:
    """Adds bm25_score (share of the best of all) and relevance_score; hits without one have 0."""
    best = F.broadcast(bm25.agg(F.max("bm25").alias("best")))  # one row
    out = hits.join(bm25.select(F.col("chunk_id").alias("id"), "bm25"), "id", "left").join(best)
    out = out.withColumn("bm25_score", F.when(F.col("best") > 0, F.coalesce("bm25", F.lit(0.0)) / F.col("best")).otherwise(0.0)).drop("bm25", "best")
    return out.withColumn("relevance_score", fixed.VECTOR_WEIGHT * F.col("vector_score") + fixed.BM25_WEIGHT * F.col("bm25_score"))


def search(chunks: DataFrame, index: lexical.Index, text: str, vector: Sequence[float] | DataFrame, k: int = 5, category: str | None = None) -> DataFrame:
    """Hybrid search: the best 2k by cosine, blended with BM25 over all chunks from the stored index, best k."""
    hits = vector_topk(chunks, vector, fixed.CANDIDATES * k, category)
    return blend(hits, cut(index.score_text(text))).orderBy(F.desc("relevance_score"), "id").limit(k)


def reranks(strategy: Column, query: Column, candidates: Column) -> Column:
    """Does the re-ranker run? Only the LLM's, on prose, from six candidates on."""
    return (strategy == "Llm") & ~query_shape(query) & (candidates >= fixed.RERANK_LEAST)


def rerank_blend(rerank: Column, hybrid: Column) -> Column:
    return fixed.RERANK_WEIGHT * rerank + (1 - fixed.RERANK_WEIGHT) * hybrid


def keep_order(hits: DataFrame, by: str = "relevance_score") -> DataFrame:
    """The re-ranker that changes nothing: 1, 0.99, 0.98 and so on, over the few hits of a query."""
    w = Window.orderBy(F.desc(by), "id")
    return hits.withColumn("rerank_score", 1 - 0.01 * (F.row_number().over(w) - 1))


def lexical_rerank(hits: DataFrame, query: str) -> DataFrame:
    """A model-free scorer behind the same interface: share of the query's words that the content has."""
    words = F.array_distinct(F.split(F.lower(F.lit(query)), r"\W+"))
    own = F.split(F.lower("content"), r"\W+")
    return hits.withColumn("rerank_score", F.size(F.array_intersect(words, own)) / F.greatest(F.size(words), F.lit(1)))


def rerank(hits: DataFrame, strategy: str, replies: DataFrame | None = None) -> DataFrame:
    """Adds ``rerank_score`` by strategy: Off keeps the order, Llm reads a word of the scale, CrossEncoder a number.

    replies: (id, reply), what the model said of each hit; a missing or unreadable one scores 0.
    """
    if strategy == "Off":
        return keep_order(hits)
    if strategy not in ("Llm", "CrossEncoder"):
        raise ValueError(f"no such strategy: {strategy}")
    score = score_word(F.col("reply")) if strategy == "Llm" else parse_score(F.col("reply"))
    return hits.join(replies.select("id", "reply"), "id", "left").withColumn("rerank_score", F.coalesce(score, F.lit(0.0))).drop("reply")


def class_reference(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks of that qualified name; in libraries without one, those whose name matches it as a pattern in any case."""
    exact = chunks.where(F.col("qualified_name") == name)
    fuzzy = chunks.where(F.col("qualified_name").rlike("(?i)" + name)).join(exact.select("library_id").distinct(), "library_id", "left_anti")
    return exact.unionByName(fuzzy.select(*exact.columns))


def overview(chunks: DataFrame, query: Sequence[float] | DataFrame, k: int = 5) -> DataFrame:
    """Best k of category Overview; of any, if there is none."""
    scored = vector_scores(chunks, query)
    some = scored.where("category = 'Overview'").limit(1).select(F.lit(1).alias("one")).groupBy().agg(F.count("*").alias("n"))
    return scored.join(F.broadcast(some)).where("n = 0 or category = 'Overview'").drop("n").orderBy(F.desc("vector_score"), "id").limit(k)


def ndcg(ranked: DataFrame, gains: DataFrame, k: int = 5) -> DataFrame:
    """nDCG@k per query; ranked: (query_id, id, score); gains: (id, gain) that hold for every query, or (query_id, id, gain)."""
    key = ["query_id"] if "query_id" in gains.columns else []
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    part = F.sum(F.col("gain") / F.log2(F.col("r") + 1))
    dcg = top.join(gains, [*key, "id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0))).groupBy("query_id").agg(part.alias("dcg"))
    if key:
        best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "id")
        ideal = gains.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(part.alias("ideal"))
        both = dcg.join(ideal, "query_id")
    else:
        # the k best gains of all, once
        best = gains.orderBy(F.desc("gain"), "id").limit(k).agg(F.sort_array(F.collect_list("gain"), asc=False).alias("g"))
        both = dcg.join(F.broadcast(best.select(F.aggregate(F.transform("g", lambda x, i: x / F.log2(i + F.lit(2))), F.lit(0.0), lambda s, x: s + x).alias("ideal"))))  # one row
    return both.select("query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))
