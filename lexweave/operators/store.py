"""Keyed tables: upserts, deletes and replacements as functions from frames to frames, and a Parquet catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, drop_folder


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` replace those of equal key; among incoming ones the last by ``order`` stands."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        incoming = incoming.withColumn("lexweave_n", F.row_number().over(w)).where("lexweave_n = 1").drop("lexweave_n", order)
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def delete(existing: DataFrame, keys: DataFrame) -> DataFrame:
    return existing.join(keys.distinct(), keys.columns, "left_anti").select(*existing.columns)


def replace_set(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the incoming keys go, then the incoming ones come in."""
    return delete(existing, incoming.select(*keys)).unionByName(incoming.select(*existing.columns))


class Catalog:
    """Tables as Parquet below a path, by library and version; writes replace whole partitions.

    What a write is made from is materialised in the shared folder first, so a table may be
    written from itself, and a job that breaks off leaves the old partitions.
    """

    BY = ("library_id", "version")

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), dict(schemas or {})

    def read(self, table: str) -> DataFrame:
        """The table, empty before its first write if its schema is known."""
        known = self.schemas.get(table)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if known is not None and not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], known)
        # with a schema a version such as 2.10 stays a text
        reader = self.spark.read if known is None else self.spark.read.schema(known)
        return reader.parquet(f"{self.path}/{table}")

    def append(self, table: str, rows: DataFrame) -> None:
        self.schemas.setdefault(table, rows.schema)
        rows.write.partitionBy(*self.BY).mode("append").parquet(f"{self.path}/{table}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Overwrite just the partitions that ``rows`` has."""
        self.schemas.setdefault(table, rows.schema)
        rows.write.partitionBy(*self.BY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{table}")

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: str | None = None) -> None:
        """Rows replace those of equal key in their partitions; other partitions aren't read."""
        touched = rows.select(*self.BY).distinct()
        old = self.read(table).join(touched, list(self.BY), "left_semi")
        self.replace(table, cut(upsert(old, rows, keys, order)))

    def delete(self, table: str, keys: DataFrame) -> int:
        """Delete the partitions of (library_id, version); how many rows went."""
        gone = self.read(table).join(keys.select(*self.BY).distinct(), list(self.BY), "left_semi").groupBy(*self.BY).agg(F.count("*").alias("n")).collect()  # a row per partition
        for r in gone:
            escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            drop_folder(self.spark, f"{self.path}/{table}/" + "/".join(f"{c}={escape(r[c])}" for c in self.BY))
        return sum(r.n for r in gone)


class VectorIndex:
    """Vectors of chunks by library and version, as unit vectors; a version is loaded, replaced or added to whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = Catalog(spark, path, {"vectors": T.StructType.fromDDL("id string, category string, unit array<double>, library_id string, version string")})

    @staticmethod
    def vectors(chunks: DataFrame) -> DataFrame:
        """Rows to store: chunks with a vector that isn't zero."""
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return chunks.where("embedding is not null").withColumn("norm", norm).where("norm > 0").select("id", "category", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias("unit"), "library_id", "version")

    def load(self, chunks: DataFrame) -> None:
        """Index these chunks in place of what their library versions had."""
        self.tables.replace("vectors", self.vectors(chunks))

    def add(self, chunks: DataFrame) -> None:
        """Index further chunks beside those of their library versions."""
        self.tables.upsert("vectors", self.vectors(chunks), ["id"])

    def reload(self, chunks: DataFrame, libraries: DataFrame) -> None:
        """Index the current version of every library, and nothing else."""
        current = libraries.select(F.col("id").alias("library_id"), F.col("current_version").alias("version"))
        drop_folder(self.tables.spark, f"{self.tables.path}/vectors")
        self.load(chunks.join(current, ["library_id", "version"], "left_semi"))

    def read(self) -> DataFrame:
        return self.tables.read("vectors")
