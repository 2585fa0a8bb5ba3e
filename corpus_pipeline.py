"""Corpus pipeline: five stages from raw documents to token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  A runner writes a stage's
result as Parquet and rereads it as the next one's ``docs``; ``run`` does so in the
shared folder of the session, where only what the last stage reads stays.  All stages but the last return the columns of
``documents``.  What a stage does with nulls, empty texts, ties and repeated rows
is what its operator says; no stage looks at other columns than it names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm import bpe, minhash, mixing, substring, toxicity
from lexweave.llm.common import table
from lexweave.session import drop_folder, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on them and the labels, doesn't predict toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), may_learn=toxicity.learnable())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id.

    Shingles of five words, similarity 0.8 or more.  A document is an id and a text here, so rows
    that repeat an id go only if their texts are near copies; of rows with equal id and text
    the least by the other columns stays.  Rows without an id are documents like others, the least.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null")
    if again.isEmpty():
        # every id is a document: no need to tell texts of one id apart, so documents are dealt once, by id
        kept = minhash.near_duplicates(docs, words=5).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    kept = minhash.near_duplicates(rows, "key", "text", words=5).where("kept").select("key").distinct()
    held = rows.select("key", "row").join(kept, "key", "left_semi")
    order = Window.partitionBy("key").orderBy("key", *[F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    return held.withColumn("n", F.row_number().over(order)).where("n = 1").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that also stand elsewhere; others unchanged."""
    out = substring.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    out = bpe.encode(docs, keep=("lang", "source"))
    return out.drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier and the draws of the mix have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
