"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas.  A
change is an insert (+1 document, +tokens), a delete (-1, -tokens) or a revision
(0, new - old).  A batch of changes is rolled up first, then committed under its id:
one folder of the store per batch, written whole, and valid once its ``_SUCCESS``
mark stands.  A batch that was committed is not applied again; one that broke off
leaves no mark, is not read, and is overwritten by its next try.

``compact`` folds committed batches into a generation: a folder of totals and a table
of the ids that are in them, valid once its ``_COMMITTED`` mark stands, which is made
last.  Readers take the latest valid generation and those batches whose ids it does
not hold, so a driver lost at any step, also between the mark and the deletes, leaves
the totals as they were; the next ``compact`` sweeps up what was left.  One writer
at a time is assumed.

The store lies below the session's shared folder or a path of one's own; it holds
a row per source, language and version for each batch, however many documents a batch
changes, and a hot source is combined map-side.  The driver lists folders; ids
and totals stay in tables.

``counted`` adds the number of tokens of a text under each of several rank files that
share one pre-token pattern: texts are cut once, whole, and a pre-token is encoded once.

Null source, language or version is a group of its own.  A null or empty text has 0
tokens and still counts as a document.  A change with an unknown or null kind raises
when the batch is applied.  Repeated rows count as often as they stand.  An
empty batch commits nothing but its id.  Only the named columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_folder, shared_folder
from .bpe import CACHE, codec
from .common import WORD, cut, table

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
MARK = "_COMMITTED"


def changes(df: DataFrame, kind: str, tokenizer: str, tokens: Column, old: Column | None = None, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Rows (kind, source, lang, tokenizer, tokens, old_tokens), one per row of ``df``."""
    old = F.lit(None) if old is None else old
    return df.select(F.lit(kind).alias("kind"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"), F.coalesce(old, F.lit(0)).cast("long").alias("old_tokens"))


def deltas(rows: DataFrame) -> DataFrame:
    """Signed sums of a batch of changes by source, language and version."""
    kind = F.col("kind")
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(kind == "insert", F.col("tokens")).when(kind == "delete", -F.col("tokens")).otherwise(F.col("tokens") - F.col("old_tokens"))
    return rows.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """A store of committed batches; see the module's description."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/batch-{batch}"

    def _has(self, file: str) -> bool:
        return self._fs.exists(self._path(file))

    def _names(self) -> list[str]:
        root = self._path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def generation(self) -> str | None:
        """Folder of the latest valid generation."""
        found = [n for n in self._names() if n.startswith("compact-") and self._has(f"{self.path}/{n}/{MARK}")]
        return f"{self.path}/{found[-1]}" if found else None

    def _folded(self, batches: list[str]) -> set[str]:
        """Which of the batches the latest generation holds; as many ids as are asked for, at most."""
        now = self.generation()
        if not now or not batches:
            return set()
        return {r.batch for r in self.spark.read.schema("batch string").parquet(f"{now}/ids").where(F.col("batch").isin(batches)).distinct().collect()}

    def folders(self) -> list[str]:
        """Folders of committed batches that no generation holds, by name."""
        found = [n.removeprefix("batch-") for n in self._names() if n.startswith("batch-") and self._has(f"{self.path}/{n}/_SUCCESS")]
        gone = self._folded(found)
        return [self._folder(b) for b in found if b not in gone]

    def apply(self, batch: str, rows: DataFrame) -> bool:
        """Commit a batch of changes; False if its id was committed before."""
        folder = self._folder(batch)
        if self._has(f"{folder}/_SUCCESS") or self._folded([batch]):
            return False
        deltas(rows).write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        """The additive totals: one row per key with any document or token."""
        now, found = self.generation(), self.folders()
        parts = [f"{now}/totals"] * bool(now) + found
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new generation, then delete what it holds."""
        before, found = self.generation(), self.folders()
        if found:
            new = f"{self.path}/compact-{int(before.rpartition('-')[2]) + 1 if before else 0:012d}"
            self._fs.delete(self._path(new), True)
            self.totals().write.parquet(f"{new}/totals")
            ids = self.spark.createDataFrame([(f.rpartition("/batch-")[2],) for f in found], "batch string")
            if before:
                ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{before}/ids"))
            ids.write.parquet(f"{new}/ids")
            self._fs.create(self._path(f"{new}/{MARK}"), True).close()
        self.sweep()

    def sweep(self) -> None:
        """Delete batches that the latest generation holds, and older or broken generations."""
        now, live = self.generation(), {f.rpartition("/")[2] for f in self.folders()}
        for n in self._names():
            done = n.startswith("batch-") and n not in live and self._has(f"{self.path}/{n}/_SUCCESS")
            if done or (now and n.startswith("compact-") and n != now.rpartition("/")[2]):
                self._fs.delete(self._path(f"{self.path}/{n}"), True)

    def drop(self) -> None:
        """Delete the store."""
        drop_folder(self.spark, self.path)


def counted(df: DataFrame, versions: dict[str, tuple[str, str]], text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, and for each version (name: rank file, pattern) a column of that name with a text's tokens."""
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{v}` long" for v in versions])
    if len({p for _, p in versions.values()}) != 1:
        raise ValueError("versions are counted together if they share a pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [codec(path, pattern) for path, pattern in versions.values()]
        find = codecs[0].find
        known: dict[str, tuple[int, ...]] = {}
        for big in batches:
            for start in range(0, big.num_rows, 512):
                batch = big.slice(start, 512)
                sums: list[list[int]] = [[] for _ in codecs]
                for text in batch.column(len(keep)):
                    now = [0] * len(codecs)
                    for token, times in Counter(find(text.as_py() or "")).items():
                        each = known.get(token)
                        if each is None:
                            each = tuple(len(c.pre_token(token)) for c in codecs)
                            if len(known) >= CACHE:
                                known.clear()
                            if len(token) <= 64:
                                known[token] = each
                        for k, n in enumerate(each):
                            now[k] += n * times
                    for k, n in enumerate(now):
                        sums[k].append(n)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, pa.int64()) for x in sums)], names=[*keep, *versions])

    return df.select(*keep, text_col).mapInArrow(run, schema)


def query_versions() -> dict[str, tuple[str, str]]:
    """The query's tokenizer versions: two public byte-level rank files with one pattern."""
    import public_tokenizers

    return {name: (public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after inserts, a revision, deletes and replays.

    1 and 2: every document under two tokenizer versions, the second by its number of words, as
    a first estimate.  3: the second is revised to its real count.  4: further copies of a
    text leave the first version.  5: the batches are folded.  6: batches 2 and 4 come again and change nothing.
    """
    one, two = versions = query_versions()
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    given = docs.select("doc_id", "source", "lang", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("words"), "text")
    rows = cut(counted(given, versions, keep=("doc_id", "source", "lang", "h1", "h2", "words")))
    # copies are few rows or many of one text: their first id comes back by a join that may split a hot text
    first = cut(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
    again = rows.join(first, ["h1", "h2"]).where("doc_id > first")
    store = Rollup(spark)
    store.apply("0001", changes(rows, "insert", one, F.col(one)))
    second = changes(rows, "insert", two, F.col("words"))
    store.apply("0002", second)
    store.apply("0003", changes(rows, "revise", two, F.col(two), F.col("words")))
    gone = changes(again, "delete", one, F.col(one))
    store.apply("0004", gone)
    store.compact()
    store.apply("0002", second)
    store.apply("0004", gone)
    totals = cut(store.totals())
    store.drop()
    return totals
