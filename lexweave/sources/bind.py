"""The driver's tables as tables of the engine, by rules that SQL can repeat.

Each function returns a DataFrame; ``SQL`` has the same rules as common table
expressions for the oracle (names end in ``_t``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import url_key
from ..operators.lexical import Index
from ..session import shared_folder, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


INDEXES: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the chunks: built in the shared folder when a session first asks for it, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in INDEXES:
        INDEXES[key] = Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}").build(chunks(spark, sf_dir))
    return INDEXES[key]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document; the library is its source."""
    d = read(spark, sf_dir, "documents")
    category = F.element_at(F.array(*[F.lit(c) for c in fixed.CATEGORIES]), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select(F.col("source").alias("library_id"), F.lit("2.0").alias("version"), F.concat(F.lit("doc://"), "source", F.lit("/"), "doc_id").alias("url"), F.substring_index("text", "\n", 1).alias("title"), category.alias("category"), F.col("text").alias("raw_content"), F.sha2("text", 256).alias("content_hash"), "doc_id", "lang")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One chunk per page; with ``vectors`` also its embedding (null for pages without one)."""
    p = pages(spark, sf_dir)
    d = F.col("doc_id")
    name = F.regexp_extract("raw_content", "([A-Za-z]+)", 1)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Type", "Enum", "Function", "Property")]), (d % 4 + 1).cast("int"))
    out = p.select(
        F.concat("library_id", F.lit("/"), "version", F.lit("/"), url_key(F.col("url")), F.lit("/0")).alias("id"), "library_id", "version", F.col("url").alias("page_url"), F.col("title").alias("page_title"), "category", F.col("raw_content").alias("content"),
        F.when(d % 5 == 0, F.concat(F.lit("Doc"), d)).alias("qualified_name"), F.when(F.col("lang") != "en", F.col("lang")).alias("code_language"),
        F.array(F.struct(name.alias("name"), kind.alias("kind"), F.lit(None).cast("string").alias("container"))).alias("symbols"), F.when(d % 5 == 0, 1).otherwise(2).alias("parser_version"), "doc_id",
    )
    if vectors:
        e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        out = out.join(e, "doc_id", "left")
    return out


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(F.col("library_id").alias("id")).agg(F.lit("2.0").alias("current_version")).select("id", F.col("id").alias("name"), F.concat(F.lit("docs of "), "id").alias("hint"), "current_version", F.array(F.lit("1.0"), F.lit("2.0")).alias("all_versions"))


def page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the pages: some only in one, some changed."""
    p = pages(spark, sf_dir)
    old = p.where("category <> 'Overview'").withColumn("version", F.lit("1.0"))
    new = p.where("category <> 'HowTo'").withColumn("raw_content", F.when(F.col("category") == "Sample", F.concat("raw_content", F.lit(" changed"))).otherwise(F.col("raw_content"))).withColumn("content_hash", F.sha2("raw_content", 256))
    return old.unionByName(new)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_versions(spark, sf_dir).groupBy("library_id", "version").agg(F.count("*").alias("page_count"), F.sum(F.ceil(F.length("raw_content") / 2400)).alias("chunk_count"))
    when = F.when(F.col("version") == "1.0", F.lit("2024-01-01 00:00:00")).otherwise("2024-02-01 00:00:00").cast("timestamp")
    number = F.regexp_extract("library_id", r"(\d+)", 1).cast("int")
    return p.select(F.concat("library_id", F.lit("/"), "version").alias("id"), "library_id", "version", when.alias("scraped_at"), "page_count", F.col("chunk_count").cast("long").alias("chunk_count"), F.when(number % 4 == 0, 12.5).when(number % 4 == 1, 6.0).otherwise(0.5).alias("boundary_issue_pct"), (number % 3 == 0).alias("suspect"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in (("view", "Queued"), ("click", "Running"), ("purchase", "Completed"), ("error", "Failed"), ("signup", "Cancelled")) for x in kv])
    return e.select(F.concat(F.lit("job-"), "event_id").alias("id"), F.concat(F.lit("lib"), F.col("user_id") % 20).alias("library_id"), F.lit("2.0").alias("version"), F.coalesce(F.element_at(status, F.col("event_type")), F.lit("Queued")).alias("status"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp") + F.expr("interval 30 minutes")).alias("last_progress_at"), (F.col("event_id") % 4).alias("error_count"), "event_id")


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, href) of every link of the html pages."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut every 800 characters, numbered within their page."""
    c = chunks(spark, sf_dir)
    cut_ = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / 800).cast("int")), lambda i: F.substring("content", i * 800 + 1, F.lit(800))))
    return c.select("id", "library_id", "version", "page_url", cut_.alias("i", "piece")).select(F.concat(F.regexp_replace("id", "[^/]*$", ""), "i").alias("id"), "library_id", "version", "page_url", F.col("piece").alias("content"), "i")


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of a project, one per document: some are libraries here, some are left out by prefix."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id") % 7
    name = F.when(n == 0, F.concat(F.lit("System."), "source")).when(n == 1, F.concat(F.lit("eslint-"), "source")).when(n == 2, F.concat(F.lit("pytest-"), "lang")).when(n == 3, F.upper("source")).when(n == 4, F.col("source")).otherwise(F.concat(F.lit("pkg"), F.col("doc_id") % 40))
    eco = F.when((n == 0) | (n == 3), "nuget").when(n == 1, "npm").when(n == 2, "pip").otherwise(F.element_at(F.array(F.lit("nuget"), F.lit("npm"), F.lit("pip")), (F.col("doc_id") % 3 + 1).cast("int")))
    version = F.concat(F.element_at(F.array(F.lit(""), F.lit("^"), F.lit("~"), F.lit(">=")), (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id") % 3, F.lit(".0"))
    return d.select(name.alias("package_id"), version.alias("version"), eco.alias("ecosystem_id"))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of fetches, one per event."""
    e = read(spark, sf_dir, "events")
    host = F.concat(F.lit("h"), F.col("user_id") % 12, F.lit(".com"))
    status = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "signup", 429).when(F.col("event_id") % 50 == 0, 503).otherwise(200)
    return e.select(host.alias("host"), F.col("event_id").cast("int").alias("seq"), F.concat(F.lit("https://"), host, F.lit("/p"), F.col("event_id") % 5, F.lit("/x"), "event_id").alias("url"), status.alias("status"), (F.col("user_id") % 3 == 0).alias("in_scope"), (F.col("event_id") % 4).cast("int").alias("attempt"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of the chunks that could be a name, and made-up ones of several shapes."""
    word = F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    w = chunks(spark, sf_dir).select(word.alias("w")).distinct()
    shaped = F.array("w", F.upper(F.substring("w", 1, 4)), F.concat("w", F.lit("_"), "w"), F.concat("w", F.lit("."), "w"), F.concat("w", F.initcap("w")))
    return w.select(F.explode(shaped).alias("name")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, link) of the html pages' links, made absolute."""
    base = F.regexp_extract("src", "^[a-z]+://[^/?#]+", 0)
    return html_links(spark, sf_dir).select(F.col("src").alias("url"), F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(base, "href")).alias("link")).distinct()


SQL = {
    "pages_t": "SELECT source AS library_id, '2.0' AS version, 'doc://' || source || '/' || doc_id AS url, split_part(text, chr(10), 1) AS title, list_extract(['Overview','HowTo','Sample','Code','ApiReference','ChangeLog','Unclassified'], CAST(doc_id % 7 + 1 AS BIGINT)) AS category, text AS raw_content, sha256(text) AS content_hash, doc_id, lang FROM documents",
    "chunks_t": "SELECT library_id || '/' || version || '/' || substr(sha256(url), 1, 12) || '/0' AS id, library_id, version, url AS page_url, title AS page_title, category, raw_content AS content, CASE WHEN doc_id % 5 = 0 THEN 'Doc' || doc_id END AS qualified_name, CASE WHEN lang <> 'en' THEN lang END AS code_language, regexp_extract(raw_content, '([A-Za-z]+)', 1) AS sym_name, list_extract(['Type','Enum','Function','Property'], CAST(doc_id % 4 + 1 AS BIGINT)) AS sym_kind, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS parser_version, doc_id FROM pages_t",
    "libraries_t": "SELECT DISTINCT library_id AS id, library_id AS name, 'docs of ' || library_id AS hint, '2.0' AS current_version, ['1.0', '2.0'] AS all_versions FROM pages_t",
    "page_versions_t": "SELECT library_id, '1.0' AS version, url, title, category, raw_content, content_hash, doc_id, lang FROM pages_t WHERE category <> 'Overview' UNION ALL SELECT library_id, version, url, title, category, raw, sha256(raw), doc_id, lang FROM (SELECT *, CASE WHEN category = 'Sample' THEN raw_content || ' changed' ELSE raw_content END AS raw FROM pages_t WHERE category <> 'HowTo')",
    "versions_t": "SELECT library_id || '/' || version AS id, library_id, version, CASE WHEN version = '1.0' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS scraped_at, page_count, chunk_count, CASE WHEN n % 4 = 0 THEN 12.5::DOUBLE WHEN n % 4 = 1 THEN 6.0::DOUBLE ELSE 0.5::DOUBLE END AS boundary_issue_pct, n % 3 = 0 AS suspect FROM (SELECT library_id, version, count(*) AS page_count, CAST(sum(ceil(length(raw_content) / 2400.0)) AS BIGINT) AS chunk_count, CAST(regexp_extract(library_id, '(\\d+)', 1) AS INT) AS n FROM page_versions_t GROUP BY library_id, version)",
    "jobs_t": "SELECT 'job-' || event_id AS id, 'lib' || (user_id % 20) AS library_id, '2.0' AS version, CASE event_type WHEN 'view' THEN 'Queued' WHEN 'click' THEN 'Running' WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Cancelled' ELSE 'Queued' END AS status, CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL 30 MINUTE END AS last_progress_at, event_id % 4 AS error_count, event_id FROM events",
    "links_t": """SELECT page_id, url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
    "postings_t": "SELECT library_id, version, id AS chunk_id, term, count(*) AS term_frequency FROM (SELECT library_id, version, id, lower(unnest(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9]+'))) AS term FROM chunks_t UNION ALL SELECT library_id, version, id, term FROM (SELECT library_id, version, id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*(?:(?:\\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*')) AS term FROM chunks_t) WHERE length(term) >= 2) GROUP BY ALL",
    "lengths_t": "SELECT library_id, version, chunk_id, CAST(sum(term_frequency) AS BIGINT) AS doc_length FROM postings_t GROUP BY ALL",
    "stats_t": "SELECT count(*) AS document_count, avg(doc_length) AS average_doc_length FROM lengths_t",
    "pieces_t": "SELECT regexp_replace(id, '[^/]*$', '') || i AS id, library_id, version, page_url, substr(content, i * 800 + 1, 800) AS content, i FROM (SELECT *, unnest(range(CAST(floor((greatest(length(content), 1) - 1) / 800) AS BIGINT) + 1)) AS i FROM chunks_t)",
    "deps_t": "SELECT CASE n WHEN 0 THEN 'System.' || source WHEN 1 THEN 'eslint-' || source WHEN 2 THEN 'pytest-' || lang WHEN 3 THEN upper(source) WHEN 4 THEN source ELSE 'pkg' || (doc_id % 40) END AS package_id, list_extract(['', '^', '~', '>='], CAST(doc_id % 4 + 1 AS BIGINT)) || (doc_id % 3) || '.0' AS version, CASE WHEN n IN (0, 3) THEN 'nuget' WHEN n = 1 THEN 'npm' WHEN n = 2 THEN 'pip' ELSE list_extract(['nuget', 'npm', 'pip'], CAST(doc_id % 3 + 1 AS BIGINT)) END AS ecosystem_id FROM (SELECT *, doc_id % 7 AS n FROM documents)",
    "fetches_t": "SELECT 'h' || (user_id % 12) || '.com' AS host, CAST(event_id AS INTEGER) AS seq, 'https://h' || (user_id % 12) || '.com/p' || (event_id % 5) || '/x' || event_id AS url, '/p' || (event_id % 5) || '/' AS segment, CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'signup' THEN 429 WHEN event_id % 50 = 0 THEN 503 ELSE 200 END AS status, user_id % 3 = 0 AS in_scope, CAST(event_id % 4 AS INTEGER) AS attempt FROM events",
    "names_t": "SELECT DISTINCT unnest([w, upper(substr(w, 1, 4)), w || '_' || w, w || '.' || w, w || upper(substr(w, 1, 1)) || lower(substr(w, 2))]) AS name FROM (SELECT DISTINCT unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM chunks_t)",
    "hrefs_t": "SELECT DISTINCT src AS url, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE regexp_extract(src, '^[a-z]+://[^/?#]+') || href END AS link FROM links_t",
    "profiles_t": "SELECT library_id, version, CASE WHEN version = '1.0' THEN ['One', library_id] ELSE [] END AS likely_symbols, CASE WHEN version = '1.0' THEN ['stop', library_id] WHEN CAST(regexp_extract(library_id, '(\\d+)', 1) AS INT) % 2 = 0 THEN [] ELSE ['later', 'KEEP'] END AS stoplist FROM versions_t",
    "site_t": "SELECT page AS src, name AS link FROM (SELECT DISTINCT 'https://site.com/page/' || page_id AS page, 'https://site.com' || regexp_replace(href, '^https?://[^/]*|[?#].*$', '', 'g') AS name FROM links_t) UNION ALL SELECT name, page FROM (SELECT DISTINCT 'https://site.com/page/' || page_id AS page, 'https://site.com' || regexp_replace(href, '^https?://[^/]*|[?#].*$', '', 'g') AS name FROM links_t)",
    "barred_t": "SELECT DISTINCT 'https://site.com/' || (page_id % 40) || list_extract(['/f.pdf', '/login/x', '/cart/1'], CAST(page_id % 3 + 1 AS BIGINT)) AS link FROM pages",
    "marked_t": "SELECT library_id, version, id, doc_id, content || chr(10) || 'class Big' || w || ' ' || w || 'Set(' || w || '.' || w || '_' || (doc_id % 5) || ') std::' || w || '<int> RPM x->' || w || ' enum  Kind' || (doc_id % 5) || ' the CPU' AS content FROM (SELECT *, regexp_extract(content, '([A-Za-z]+)', 1) AS w FROM chunks_t)",
    "dotp_t": "SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
}
NEEDS = {"chunks_t": ["pages_t"], "libraries_t": ["pages_t"], "page_versions_t": ["pages_t"], "versions_t": ["page_versions_t"], "postings_t": ["chunks_t"], "pieces_t": ["chunks_t"], "marked_t": ["chunks_t"], "site_t": ["links_t"], "profiles_t": ["versions_t"], "names_t": ["chunks_t"], "hrefs_t": ["links_t"], "lengths_t": ["postings_t"], "stats_t": ["lengths_t"]}


def with_tables(sql: str) -> str:
    """``sql`` with the expressions that it names in front; it may start with ``WITH``."""
    found: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in found:
            found.append(name)

    for name in SQL:
        if name in sql:
            add(name)
    if not found:
        return sql
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in found)
    sql = sql.strip()
    recursive = sql.upper().startswith("WITH RECURSIVE")
    rest = sql[len("WITH RECURSIVE") :] if recursive else sql[len("WITH") :] if sql.upper().startswith("WITH ") else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (f", {rest.lstrip()}" if rest is not None else f" {sql}")
