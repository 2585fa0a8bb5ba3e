"""Versions of libraries: register, compare, rename, delete, and edits of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import upsert


def register(libraries: DataFrame, library: str, version: str) -> DataFrame:
    """The version becomes current and is appended to the list unless it is there."""
    mine = F.col("id") == library
    old = libraries.withColumn("current_version", F.when(mine, F.lit(version)).otherwise(F.col("current_version"))).withColumn("all_versions", F.when(mine, F.array_union("all_versions", F.array(F.lit(version)))).otherwise(F.col("all_versions")))
    new = libraries.sparkSession.createDataFrame([(library, library, "", version, [version])], libraries.schema)
    return old.unionByName(new.join(libraries.select("id"), "id", "left_anti"))


def diff(pages: DataFrame, old: str, new: str) -> DataFrame:
    """(library_id, url, change): added, removed, changed or unchanged between two versions."""
    a = pages.where(F.col("version") == old).select("library_id", "url", F.col("content_hash").alias("a"))
    b = pages.where(F.col("version") == new).select("library_id", "url", F.col("content_hash").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, ["library_id", "url"], "full").select("library_id", "url", change.alias("change"))


def previous_version(libraries: DataFrame, version: str) -> DataFrame:
    at = F.array_position("all_versions", F.lit(version))
    return libraries.select("id", F.when(at > 1, F.get("all_versions", (at - 2).cast("int"))).alias("previous"))


def delete_version(tables: dict[str, DataFrame], library: str, version: str) -> dict[str, DataFrame]:
    """All tables without the library's version; the current one is the newest scraped of what remains.

    A library without versions goes too.
    """
    mine = (F.col("library_id") == library) & (F.col("version") == version)
    out = {n: t.where(~mine) for n, t in tables.items() if n != "libraries"}
    left = out["library_versions"].groupBy(F.col("library_id").alias("id")).agg(F.max_by("version", F.struct("scraped_at", "version")).alias("newest"))
    libs = tables["libraries"].join(left, "id", "left").where((F.col("id") != library) | F.col("newest").isNotNull())
    hit = (F.col("id") == library) & (F.col("current_version") == version)
    out["libraries"] = libs.withColumn("current_version", F.when(hit, F.col("newest")).otherwise(F.col("current_version"))).drop("newest")
    return out


def delete_library(tables: dict[str, DataFrame], library: str) -> dict[str, DataFrame]:
    return {n: t.where(F.col("id" if n == "libraries" else "library_id") != library) for n, t in tables.items()}


def rename_outcome(libraries: DataFrame, old: str, new: str) -> DataFrame:
    c = libraries.agg(F.count_if(F.col("id") == old).alias("a"), F.count_if(F.col("id") == new).alias("b"))
    return c.select(F.when(F.col("a") == 0, "NotFound").when(F.col("b") > 0, "Collision").otherwise("Renamed").alias("outcome"))


def rename(table: DataFrame, old: str, new: str) -> DataFrame:
    """The library under its new name, in its own column and at the front of composite ids."""
    out = table
    if "library_id" in table.columns:
        out = out.withColumn("library_id", F.when(F.col("library_id") == old, F.lit(new)).otherwise(F.col("library_id")))
    whole = F.col("id") == old
    return out.withColumn("id", F.when(whole, F.lit(new)).when(F.col("id").startswith(old + "/"), F.concat(F.lit(new), F.substr(F.col("id"), F.lit(len(old) + 1)))).otherwise(F.col("id"))) if "id" in table.columns else out


def update_category(chunks: DataFrame, page_url: str, category: str) -> DataFrame:
    return chunks.withColumn("category", F.when(F.col("page_url") == page_url, F.lit(category)).otherwise(F.col("category")))


def set_suspect(versions: DataFrame, library: str, version: str, suspect: bool) -> DataFrame:
    return versions.withColumn("suspect", F.when((F.col("library_id") == library) & (F.col("version") == version), F.lit(suspect)).otherwise(F.col("suspect")))


def add_to_likely(profiles: DataFrame, names: list[str]) -> DataFrame:
    """New names at the end of the likely list; in any case they leave the stop list."""
    low = F.array(*[F.lit(n.lower()) for n in names])
    return profiles.withColumn("likely_symbols", F.array_union("likely_symbols", F.array(*[F.lit(n) for n in names]))).withColumn("stoplist", F.filter("stoplist", lambda x: ~F.array_contains(low, F.lower(x))))


def add_to_stoplist(profiles: DataFrame, names: list[str]) -> DataFrame:
    """The mirror image: both lists by any case."""
    low = F.array(*[F.lit(n.lower()) for n in names])
    have = F.transform("stoplist", F.lower)
    new = F.filter(F.array(*[F.lit(n) for n in names]), lambda x: ~F.array_contains(have, F.lower(x)))
    return profiles.withColumn("stoplist", F.concat("stoplist", new)).withColumn("likely_symbols", F.filter("likely_symbols", lambda x: ~F.array_contains(low, F.lower(x))))


def without_names(excluded: DataFrame, names: list[str]) -> DataFrame:
    return excluded.where(~F.lower("name").isin([n.lower() for n in names]))


def carry_stoplist(profiles: DataFrame) -> DataFrame:
    """An empty stop list takes the newest non-empty one of the library's other versions."""
    w = Window.partitionBy("library_id")
    newest = F.max_by("stoplist", F.when(F.size("stoplist") > 0, F.struct("created_utc", "version"))).over(w)
    none = F.array().cast("array<string>")
    return profiles.withColumn("stoplist", F.when(F.size("stoplist") > 0, F.col("stoplist")).otherwise(F.coalesce(newest, none)))


def save_profile(profiles: DataFrame, incoming: DataFrame) -> DataFrame:
    """Checked, stop lists carried forward, and put in place by library and version."""
    bad = (F.col("library_id") == "") | (F.col("version") == "") | ~F.col("confidence").between(0, 1)
    checked = incoming.withColumn("library_id", F.when(bad, F.raise_error(F.lit("profile is not valid"))).otherwise(F.col("library_id")))
    return carry_stoplist(upsert(profiles, checked, ["library_id", "version"]))


def reclassify(pages: DataFrame, predictions: DataFrame, everything: bool = False) -> DataFrame:
    """Pages with new categories: of unclassified ones (or all), where a prediction says something else for sure."""
    out = pages.join(predictions.select("url", F.col("category").alias("new"), "confidence"), "url", "left")
    ok = (F.col("new") != "Unclassified") & (F.col("confidence") > 0) & (F.col("new") != F.col("category"))
    if not everything:
        ok = ok & (F.col("category") == "Unclassified")
    return out.withColumn("category", F.when(F.coalesce(ok, F.lit(False)), F.col("new")).otherwise(F.col("category"))).drop("new", "confidence")
