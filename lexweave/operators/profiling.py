"""Aggregates over libraries, versions, chunks and jobs; flags and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import url as U
from ..functions.text import boundary_hint, parse_profile

KEY = ["library_id", "version"]


def counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count("*").alias(name))


def language_mix(chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy(*KEY, F.coalesce("code_language", F.lit("unfenced")).alias("language")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*KEY))).drop("n")


def hosts(rows: DataFrame, url: str) -> DataFrame:
    return rows.groupBy(F.coalesce(U.host(F.col(url)), F.lit("(unknown)")).alias("host")).agg(F.count("*").alias("n"))


def top_hosts(rows: DataFrame, url: str, n: int = 20) -> DataFrame:
    return hosts(rows, url).orderBy(F.desc("n"), "host").limit(n)


def boundary_pct(issues: Column, chunks: Column) -> Column:
    return 100.0 * issues / F.greatest(chunks, F.lit(1))


def rescrub_hint(excluded: Column, kept: Column) -> Column:
    """Twenty or more rejected names, and a twentieth of all."""
    return (excluded >= 20) & (excluded / F.greatest(excluded + kept, F.lit(1)) >= 0.05)


def stale(jobs: DataFrame, now: Column) -> Column:
    """Running, without progress for four hours."""
    return (F.col("status") == "Running") & (F.coalesce("last_progress_at", "created_at") < now - F.expr(f"interval {fixed.STALE_HOURS} hours"))


def active_job(jobs: DataFrame, now: Column) -> DataFrame:
    """Newest queued or running job of each library version that isn't stale."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), "id")
    return jobs.where(F.col("status").isin("Queued", "Running") & ~stale(jobs, now)).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def recent(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id").limit(n)


def merged_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The n newest and all running ones, each once."""
    return recent(jobs, n).unionByName(jobs.where("status = 'Running'")).dropDuplicates(["id"])


def dashboard(libraries: DataFrame, versions: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """One row: counts and what to do first."""
    a = libraries.agg(F.count("*").alias("libraries"))
    b = versions.agg(F.count("*").alias("versions"), F.least(F.count_if("suspect"), F.lit(20)).alias("suspects"))
    c = jobs.agg(F.count_if(stale(jobs, now)).alias("stale_jobs"))
    out = a.join(b).join(c)  # one row each
    act = F.when(F.col("libraries") == 0, "ingest a library").when(F.col("suspects") > 0, "review suspect libraries").when(F.col("stale_jobs") > 0, "cancel stale jobs").otherwise("healthy")
    return out.withColumn("suggested_action", act)


def health(versions: DataFrame, chunks: DataFrame, url: str = "page_url") -> DataFrame:
    """Version rows with language mix, host count and hint."""
    mix = language_mix(chunks).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "language", F.format_number("share", 3)))), ";").alias("languages"))
    host = chunks.groupBy(*KEY).agg(F.countDistinct(F.coalesce(U.host(F.col(url)), F.lit("(unknown)"))).alias("hosts"))
    return versions.join(mix, KEY, "left").join(host, KEY, "left").withColumn("hint", boundary_hint(F.col("boundary_issue_pct")))


def suspect_reasons(facts: DataFrame, least_links: int = 10) -> DataFrame:
    """facts: (pages, links, hosts, declared array, mix map, root_url, sample_titles); adds ``reasons``."""
    declared = F.size("declared")
    matched = F.exists("declared", lambda x: F.coalesce(F.element_at("mix", x), F.lit(0.0)) >= 0.3)
    readme = F.col("root_url").rlike(r"(?i)^https?://(www\.)?github\.com") & (F.size("sample_titles") > 0) & F.forall("sample_titles", lambda t: F.lower(t).contains("readme"))
    one = [F.when(F.col("pages") <= 3, "OnePager"), F.when(F.col("links") < least_links, "SparseLinkGraph"), F.when((F.col("hosts") == 1) & (declared > 1), "SingleHost"), F.when((declared > 0) & ~matched, "LanguageMismatch"), F.when(readme, "ReadmeOnly")]
    return facts.withColumn("reasons", F.array_compact(F.array(*one)))


def ingest_status(running: Column, suspect: Column, profile: Column, chunks: Column, is_stale: Column, force: Column) -> Column:
    return F.when(running, "InProgress").when(suspect, "UrlSuspect").when(~profile, "ReconNeeded").when(chunks == 0, "ReadyToScrape").when(is_stale, "Stale").when(force, "ReadyToScrape").otherwise("Ready")


def cancel_outcome(status: Column, live: Column) -> Column:
    return F.when(status.isNull(), "NotFound").when(~status.isin("Queued", "Running"), "AlreadyTerminal").when(live, "Signalled").otherwise("OrphanCleanedUp")


def reclassifies(asked: Column, profile_hash: Column, manifest_hash: Column, classifier: Column, manifest_classifier: Column) -> Column:
    """Explicit choice, else a changed profile or classifier; without a manifest no."""
    return F.coalesce(asked, F.when(manifest_hash.isNull(), False).otherwise((profile_hash != manifest_hash) | (classifier != manifest_classifier)))


def admitted(jobs: DataFrame, now: Column) -> DataFrame:
    """The next job of each library version: its oldest queued one, if none is running; a stale one doesn't count as running."""
    queued = jobs.where("status = 'Queued'")
    busy = jobs.where(F.col("status") == "Running").where(~stale(jobs, now)).select(*KEY).distinct()
    return queued.join(busy, KEY, "left_anti").groupBy(*KEY).agg(F.min(F.struct("created_at", "id"))["id"].alias("id"))


def recon(libraries: DataFrame, replies: DataFrame) -> DataFrame:
    """Profiles from a model's saved replies (library_id, body); a library without a reply that can be read has an empty profile of confidence 0."""
    p = parse_profile(F.col("body"))
    readable = F.from_json("body", "confidence double, languages array<string>, source string")
    rows = libraries.select(F.col("id").alias("library_id"), F.col("current_version").alias("version")).join(replies, "library_id", "left")
    ok = F.coalesce(readable["languages"].isNotNull() | readable["confidence"].isNotNull(), F.lit(False))
    rows = rows.select(*KEY, F.when(ok, p).alias("p"))
    none = F.array().cast("array<string>")
    return rows.select(*KEY, *[F.coalesce(F.col(f"p.{c}"), none).alias(c) for c in ("languages", "likely_symbols", "stoplist", "separators", "callable_shapes")], *[F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c) for c in ("types", "methods")], F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"))
