"""Incremental ingest: the batch operators on micro-batches of pages.

Reading is bounded per trigger, which is the back-pressure; texts are cut and indexed
without state; a sink commits every micro-batch under its number, so a replayed one
replaces itself.  The state machine of host limits runs as keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lexical
from ..operators.chunking import chunk_pages
from ..operators.crawl import Limiter
from ..operators.store import Catalog, VectorIndex
from ..schema import schema
from ..session import cut, drop_folder

STATE = "now int, streak int, until double"


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 50) -> DataFrame:
    return spark.readStream.schema(schema("pages")).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(pages: DataFrame, out: str, checkpoint: str, classify: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Classify, chunk and index pages as they come; results are written by batch number.

    Pages that fail to chunk go to ``errors``; counters of a batch to ``progress``.
    """

    def commit(batch: DataFrame, number: int) -> None:
        batch = classify(batch) if classify else batch
        path = lambda name: f"{out}/{name}/batch={number}"
        chunk_pages(batch).write.mode("overwrite").parquet(path("raw"))
        rows = batch.sparkSession.read.parquet(path("raw"))
        good = rows.where("error is null").drop("error")
        good.write.mode("overwrite").parquet(path("chunks"))
        rows.where("error is not null").write.mode("overwrite").parquet(path("errors"))
        lexical.postings(good).write.mode("overwrite").parquet(path("postings"))
        rows.agg(F.countDistinct("page_url").alias("pages"), F.count_if(F.col("error").isNull()).alias("chunks"), F.count_if(F.col("error").isNotNull()).alias("errors")).write.mode("overwrite").parquet(path("progress"))

    return pages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vector_batches(chunks: DataFrame, index: VectorIndex, pending: Catalog, checkpoint: str, least: int = 100) -> StreamingQuery:
    """Index chunks with vectors as they come: when ``least`` or more are pending they are added to the index; ``flush`` adds the rest.

    A batch waits under its number, so a replayed one replaces itself, and adding a chunk again changes nothing.
    """

    def commit(batch: DataFrame, number: int) -> None:
        pending.replace("pending", batch.withColumn("version_of", F.col("version")).withColumn("library_of", F.col("library_id")).withColumns({"library_id": F.lit("batch"), "version": F.lit(str(number))}))
        if pending.read("pending").count() >= least:
            flush(index, pending)

    return chunks.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(index: VectorIndex, pending: Catalog) -> int:
    """Add all pending chunks to the index and clear them; how many there were."""
    waiting = cut(pending.read("pending").withColumns({"library_id": F.col("library_of"), "version": F.col("version_of")}).drop("library_of", "version_of"))
    n = waiting.count()
    if n:
        index.add(waiting)
        drop_folder(pending.spark, f"{pending.path}/pending")
    return n


def table(spark: SparkSession, out: str, name: str, number: bool = False) -> DataFrame:
    """All committed batches of a result; with ``number`` also each row's batch."""
    rows = spark.read.parquet(f"{out}/{name}")
    return rows if number else rows.drop("batch")


def host_limits(log: DataFrame, grow: int = 25) -> DataFrame:
    """Streaming form of the host limiter: (host, seq, concurrency, until) after each answer.

    log: (host string, seq int, at double, status int, retry_after double).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Limiter(grow=grow)
        if state.exists:
            machine.now, machine.streak, machine.until = state.get
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [machine.step(int(r.status), float(r.at), r.retry_after) for r in rows.itertuples(index=False)]
        state.update((machine.now, machine.streak, machine.until))
        yield pd.DataFrame({"host": key[0], "seq": rows["seq"].to_numpy(), "concurrency": [x for x, _ in out], "until": [y for _, y in out]})

    return log.groupBy("host").applyInPandasWithState(step, "host string, seq int, concurrency int, until double", STATE, "append", GroupStateTimeout.NoTimeout)
