"""Link graphs: scopes, depths, gates, limits, and a breadth-first crawl of stored links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import url as U
from ..session import cut


def resolved_links(links: DataFrame) -> DataFrame:
    """Adds ``link``: the absolute address of ``href`` on the page ``src``."""
    base = F.regexp_extract("src", "^[a-z]+://[^/?#]+", 0)
    return links.withColumn("link", F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(base, "href")))


def gated(fetches: DataFrame) -> DataFrame:
    """Fetches without those that come after a 403 out of scope on the same host and first segment."""
    f = fetches.withColumn("segment", U.first_segment(F.col("url")))
    gates = f.where("status = 403 and not in_scope").groupBy("host", "segment").agg(F.min("seq").alias("gate"))
    out = f.join(gates, ["host", "segment"], "left")
    return out.where("gate is null or in_scope or seq <= gate").drop("gate", "segment")


def outcome(status):
    """limited, forbidden or ok, by status code."""
    return F.when(status.isin(429, 503), "limited").when(status == 403, "forbidden").otherwise("ok")


def child_entries(entries: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Depths of the pages that entries (url, in_depth, same_depth, off_depth) link to; links: (src, link)."""
    r = F.lit(root)
    rows = entries.join(links, F.lower("url") == F.lower("src"))
    inside, same = U.in_scope(F.col("link"), r), U.same_host(F.col("link"), r)
    i, s, o = F.col("in_depth"), F.col("same_depth"), F.col("off_depth")
    return rows.select(
        F.col("link").alias("url"),
        F.when(inside, "in").when(same, "same").otherwise("off").alias("scope"),
        F.when(inside, i + 1).otherwise(i).alias("in_depth"),
        F.when(inside, 0).when(same, s + 1).otherwise(s).alias("same_depth"),
        F.when(inside, 0).when(same, o).otherwise(o + 1).alias("off_depth"),
    )


def crawl(links: DataFrame, root: str, excluded: list[str] | None = None, visited: DataFrame | None = None) -> DataFrame:
    """Pages reached from ``root`` over (src, link), breadth first, each once with its first depths.

    In-scope pages of a level come first where two ways lead to a page.  ``visited``
    (url) was stored before: it is walked through, not returned.  Every round is one join
    and one anti-join, cut by a checkpoint; it ends when a level is empty, which the
    depth limits and the pages seen bring about, however long the paths are.
    """
    spark = links.sparkSession
    links = cut(links.select("src", "link").distinct())
    level = spark.createDataFrame([(root, "in", 0, 0, 0)], "url string, scope string, in_depth int, same_depth int, off_depth int")
    seen = level
    order = Window.partitionBy(F.lower("url")).orderBy(F.when(F.col("scope") == "in", 0).when(F.col("scope") == "same", 1).otherwise(2), "in_depth", "same_depth", "off_depth", "url")
    while True:
        new = child_entries(level, links, root).where(~U.depth_reached(F.col("scope"), F.col("in_depth") - 1, F.col("same_depth") - 1, F.col("off_depth") - 1))
        new = new.where(U.url_allowed(F.col("url"), [], fixed.EXCLUDED_URLS if excluded is None else excluded))
        new = new.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        new = cut(new.join(seen.select(F.lower("url").alias("k")), F.lower("url") == F.col("k"), "left_anti"))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        level = new
    if visited is not None:
        seen = seen.join(visited.select(F.lower("url").alias("k")).distinct(), F.lower("url") == F.col("k"), "left_anti")
    return seen


def fetch_order(pages: DataFrame) -> DataFrame:
    """Adds ``place``: level by level, pages in scope before others, then by address; of a crawl's pages.

    Addresses are range partitioned, so no task sees them all: a place is that within a part plus the parts before.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.when(F.col("scope") == "in", 0).when(F.col("scope") == "same", 1).otherwise(2)
    # a page out of scope hangs below one in scope of the same depth
    keys = [F.col("in_depth") * 2 + F.col("same_depth") + F.col("off_depth"), rank, F.lower("url")]
    rows = pages.select("*", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    parts = cut(rows.repartitionByRange(n, "k0", "k1", "k2").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row per part
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("k0", "k1", "k2"))
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select(*pages.columns, (F.col("place") + F.col("before")).alias("place"))


def report(links: DataFrame, pages: DataFrame, excluded: list[str] | None = None, first: int = 50, pending: int = 30) -> DataFrame:
    """A dry run as rows (part, name, n): pages in and out of scope, by depth and by host; the first pages; links
    that are not allowed, and links beyond the depth limits with the first of them; repositories.

    links: (src, link) of the site, pages: what ``crawl`` made of them.  Links count by address in any case.
    """
    total = lambda part, rows: rows.agg(F.lit(part).alias("part"), F.lit("").alias("name"), F.count("*").alias("n"))
    each = lambda part, rows, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    one = lambda part, rows: rows.select(F.lit(part).alias("part"), "name", F.lit(1).cast("long").alias("n"))
    pages = cut(pages.withColumn("name", F.lower("url")))
    inside = F.col("scope") == "in"
    known = pages.select("name")
    to = links.join(known, F.lower("src") == F.col("name"), "left_semi").select("link", F.lower("link").alias("name")).dropDuplicates(["name"])
    allowed = U.url_allowed(F.col("link"), [], fixed.EXCLUDED_URLS if excluded is None else excluded)
    beyond = to.where(allowed).join(known, "name", "left_anti")
    repo = U.github_repo(F.col("url"))
    parts = [
        total("in scope", pages.where(inside)), total("out of scope", pages.where(~inside)),
        each("depth", pages, F.greatest("in_depth", "same_depth", "off_depth").cast("string")), each("host", pages, F.coalesce(U.host(F.col("url")), F.lit("(unknown)"))),
        one("page", pages.orderBy(F.when(inside, 0).otherwise(1), F.greatest("in_depth", "same_depth", "off_depth"), "name").limit(first)),
        total("not allowed", to.where(~allowed)), total("beyond depth", beyond), one("pending", beyond.orderBy("name").limit(pending)),
        one("repository", pages.where(repo.isNotNull()).select(F.concat_ws("/", repo["owner"], repo["name"]).alias("name")).where("name <> ''").distinct()),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


class Limiter:
    """Additive increase, multiplicative decrease of a host's concurrency."""

    def __init__(self, now: int = 4, least: int = 1, most: int = 16, grow: int = 25, penalty: float = 30.0):
        self.now, self.least, self.most, self.grow, self.penalty = now, least, most, grow, penalty
        self.streak, self.until = 0, 0.0

    def step(self, status: int, at: float, retry_after: float | None = None) -> tuple[int, float]:
        """Concurrency and end of the penalty after one answer."""
        if status in (429, 503):
            self.streak, self.now = 0, max(self.least, self.now // 2)
            self.until = max(self.until, at + (self.penalty if retry_after is None or pd.isna(retry_after) else retry_after))
        elif status >= 500:
            self.streak = 0
        else:
            self.streak += 1
            if self.streak >= self.grow and self.now < self.most:
                self.now, self.streak = self.now + 1, 0
        return self.now, self.until


def limit_hosts(log: DataFrame, grow: int = 25) -> DataFrame:
    """Concurrency after every answer of a log (host, seq, at double, status, retry_after double).

    An ordered fold per host: a host's answers are sorted by Spark and streamed, batch by
    batch, so no host's log has to fit in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, Limiter(grow=grow)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.host != host:
                    host, state = r.host, Limiter(grow=grow)
                out.append(state.step(int(r.status), float(r.at), r.retry_after))
            yield b[["host", "seq"]].assign(concurrency=[x for x, _ in out], until=[y for _, y in out])

    return log.repartition("host").sortWithinPartitions("host", "seq").mapInPandas(run, "host string, seq int, concurrency int, until double")


def retry_plan(attempts: DataFrame) -> DataFrame:
    """Next step of each attempt (url, in_scope, status, attempt): retry with a delay, drop, or done.

    Only a 403 in scope is tried again, twice; 429 and 503 are not.
    """
    from ..functions.text import retry_delay_ms

    again = (F.col("status") == 403) & F.col("in_scope")
    return attempts.withColumn("step", F.when(again & (F.col("attempt") < 2), "retry").when(again, "dropped").when(F.col("status") >= 400, "failed").otherwise("done")).withColumn("delay_ms", F.when(again & (F.col("attempt") < 2), retry_delay_ms(F.col("attempt"))))
