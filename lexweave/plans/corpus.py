"""Queries of aggregates, joins, search, symbols, versions and decisions (A, J, O, C, V, T, P)."""

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions import url as U
from ..operators import chunking, crawl, deps, lexical, profiling, search, store, versions
from ..operators import symbols as Y
from ..session import cut, drop_folder, shared_folder
from ..sources import bind
from . import fixtures as G
from .catalog import query
from .scalars import ASKED, SAID, SHARD, asked, reply
from .tables import ISSUES, KEEP, MANIFESTS, NOW, PACKAGES, now, packages, profiles


def posted(s, d):
    """All postings of the stored index."""
    return bind.index(s, d).postings()


@query("a1_counts", "SELECT p.library_id, p.pages, c.chunks FROM (SELECT library_id, count(*) AS pages FROM pages_t GROUP BY ALL) p JOIN (SELECT library_id, count(*) AS chunks FROM chunks_t GROUP BY ALL) c USING (library_id)")
def a1(s, d):
    return profiling.counts(bind.pages(s, d), "pages").join(profiling.counts(bind.chunks(s, d), "chunks"), ["library_id", "version"]).drop("version")


@query("a2_language_mix", "SELECT library_id, language, n / sum(n) OVER (PARTITION BY library_id) AS share FROM (SELECT library_id, coalesce(code_language, 'unfenced') AS language, count(*) AS n FROM chunks_t GROUP BY ALL)")
def a2(s, d):
    return profiling.language_mix(bind.chunks(s, d)).drop("version")


HOST = "lower(regexp_extract(url, '://([^/:?#]+)', 1))"


@query("a3_host_distribution", f"SELECT coalesce(nullif({HOST}, ''), '(unknown)') AS host, count(*) AS n FROM pages GROUP BY ALL")
def a3(s, d):
    return profiling.hosts(bind.read(s, d, "pages"), "url")


@query("a4_top_hosts", f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY ALL ORDER BY n DESC, host LIMIT 20")
def a4(s, d):
    return profiling.top_hosts(bind.read(s, d, "pages"), "url")


@query("a5_bm25_term_freq", "SELECT chunk_id, term, term_frequency FROM postings_t")
def a5(s, d):
    return lexical.postings(bind.chunks(s, d)).select("chunk_id", "term", "term_frequency")


@query("a6_bm25_doc_length", "SELECT chunk_id, doc_length FROM lengths_t")
def a6(s, d):
    return lexical.lengths_of(bind.chunks(s, d)).select("chunk_id", "doc_length")


@query("a7_bm25_stats", "SELECT document_count, average_doc_length, 64 AS shard_count FROM stats_t")
def a7(s, d):
    return lexical.stats(lexical.lengths_of(bind.chunks(s, d)))


@query("a8_bm25_df", "SELECT term, count(*) AS df FROM postings_t GROUP BY term")
def a8(s, d):
    return lexical.document_frequency(posted(s, d))


SCORE = """
WITH q AS (SELECT item_id AS query_id, term FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]+'))) AS term FROM benchmark UNION SELECT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:(?:\\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*')) AS term FROM benchmark) WHERE length(term) >= 2)),
f AS (SELECT term, count(*) AS df FROM postings_t GROUP BY term),
sc AS (SELECT q.query_id, p.chunk_id, sum(ln((s.document_count - f.df + 0.5) / (f.df + 0.5) + 1) * p.term_frequency * 2.5 / (p.term_frequency + 1.5 * (1 - 0.75 + 0.75 * l.doc_length / s.average_doc_length))) AS bm25
  FROM q JOIN postings_t p USING (term) JOIN f USING (term) JOIN lengths_t l USING (chunk_id), stats_t s GROUP BY ALL)
"""


def scored(s, d):
    q = bind.read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bind.index(s, d).score(q)


@query("a9_bm25_score", SCORE + "SELECT query_id, chunk_id, round(bm25, 5) AS bm25 FROM sc")
def a9(s, d):
    return scored(s, d).withColumn("bm25", F.round("bm25", 5))


@query("a10_bm25_shard_sizes", f"SELECT {SHARD} AS shard_index, count(*) AS terms, CAST(sum(n) AS BIGINT) AS postings FROM (SELECT term, count(*) AS n FROM postings_t GROUP BY term) GROUP BY 1")
def a10(s, d):
    return lexical.shard_sizes(posted(s, d).drop("shard_index"))


MENTIONS = "SELECT library_id, w AS name, count(*) AS mentions FROM (SELECT library_id, unnest(regexp_split_to_array(content, '[^\\p{L}\\p{M}\\p{N}_]+')) AS w FROM chunks_t) WHERE regexp_full_match(w, '[A-Z][A-Za-z0-9_]+') GROUP BY ALL"


@query("a11_prose_mention_counts", MENTIONS)
def a11(s, d):
    return Y.prose_mentions(bind.chunks(s, d)).drop("version")


def marked(s, d):
    """Chunks with some code at their end: a declaration, calls, generics and dotted names of their first word."""
    c = bind.chunks(s, d)
    w, n = F.regexp_extract("content", "([A-Za-z]+)", 1), F.col("doc_id") % 5
    code = F.concat(F.lit("\nclass Big"), w, F.lit(" "), w, F.lit("Set("), w, F.lit("."), w, F.lit("_"), n, F.lit(") std::"), w, F.lit("<int> RPM x->"), w, F.lit(" enum  Kind"), n, F.lit(" the CPU"))
    return c.withColumn("content", F.concat("content", code))


def tokens(s, d):
    c = marked(s, d)
    return Y.extract(c, mentions=Y.prose_mentions(c))


#: Tokens with their place, mark behind, and the declaring word before; distinct in a chunk.
TOKEN_LISTS = f"SELECT library_id, id, unnest(regexp_extract_all(content, '({fixed.TOKEN})([(<]?)', 1)) AS name, unnest(regexp_extract_all(content, '({fixed.TOKEN})([(<]?)', 2)) AS mark, unnest(range(len(regexp_extract_all(content, '{fixed.TOKEN}')))) AS place FROM marked_t"
TOKENS = f"SELECT library_id, id, min(place) AS place, name, regexp_extract(name, '[A-Za-z0-9_-]*$') AS leaf, CASE WHEN regexp_matches(name, '[.:>]') THEN regexp_replace(name, '(\\.|::|->)[A-Za-z0-9_-]*$', '') END AS container, mark = '(' AS callable, mark = '<' AS generic, arg_min(keyword, place) AS keyword FROM (SELECT *, CASE WHEN list_contains(['class', 'interface', 'struct', 'enum', 'record', 'type', 'def', 'function'], lower(before)) THEN lower(before) END AS keyword FROM (SELECT *, lag(name) OVER (PARTITION BY id ORDER BY place) AS before FROM ({TOKEN_LISTS}))) GROUP BY library_id, id, name, mark, keyword IS NOT NULL"
MENTIONS_OF = MENTIONS.replace("chunks_t", "{0}").replace("{L}", "{{L}}").replace("{M}", "{{M}}").replace("{N}", "{{N}}")
STOPPED = "lower({0}) IN (" + ", ".join(G.literal(w) for w in sorted(fixed.STOPLIST)) + ")"
UNIT = "({0} IN (" + ", ".join(G.literal(w) for w in fixed.UNITS) + ") OR (length({0}) <= 4 AND lower({0}) IN (" + ", ".join(G.literal(w) for w in fixed.UNITS_ANY_CASE) + ")))"
SHORT = "regexp_full_match({0}, '[A-Z0-9]{{1,4}}')"
#: Each distinct token of a chunk with its reason and kind, given mention counts m; there are no profiles and no fences.
JUDGED = f"""SELECT *, CASE WHEN {STOPPED.format('name')} OR {STOPPED.format('leaf')} THEN 'GlobalStoplist' WHEN {UNIT.format('name')} OR {UNIT.format('leaf')} THEN 'Unit' WHEN length(name) < 2 THEN 'BelowMinLength' WHEN NOT ok AND blocked THEN 'LikelyAbbreviation' WHEN NOT ok THEN 'NoStructureSignal' END AS reason,
 CASE WHEN keyword = 'enum' THEN 'Enum' WHEN keyword IN ('def', 'function') THEN 'Function' WHEN keyword IS NOT NULL THEN 'Type' WHEN callable THEN 'Function' WHEN generic THEN 'Type' WHEN container IS NOT NULL THEN 'Property' ELSE 'Unknown' END AS kind
 FROM (SELECT *, (on_name AND {SHORT.format('name')}) OR (on_leaf AND {SHORT.format('leaf')}) AS blocked, keyword IS NOT NULL OR container IS NOT NULL OR regexp_matches(name, '[_.]|::|->|[a-z][A-Z]|[A-Z]{{2}}[a-z]{{2}}') OR callable OR generic OR (on_name AND NOT {SHORT.format('name')}) OR (on_leaf AND NOT {SHORT.format('leaf')}) AS ok
 FROM (SELECT x.*, coalesce(a.mentions, 0) >= 3 AS on_name, coalesce(b.mentions, 0) >= 3 AS on_leaf FROM ({TOKENS}) x LEFT JOIN m a ON a.library_id = x.library_id AND a.name = x.name LEFT JOIN m b ON b.library_id = x.library_id AND b.name = x.leaf))"""


@query("a12_excluded_symbols", f"WITH m AS ({MENTIONS_OF.format('marked_t')}), t AS ({JUDGED}), c AS (SELECT library_id, id, name, min(struct_pack(place := place, reason := reason)).reason AS reason FROM t WHERE reason IS NOT NULL GROUP BY ALL) SELECT library_id, name, arg_min(reason, id) AS reason, count(*) AS chunk_count, least(count(DISTINCT CAST(least(ix // greatest(total // 3, 1), 2) AS INT)), 3) AS samples FROM c JOIN (SELECT id, row_number() OVER (PARTITION BY library_id ORDER BY id) - 1 AS ix, count(*) OVER (PARTITION BY library_id) AS total FROM chunks_t) USING (id) GROUP BY ALL")
def a12(s, d):
    """Rejected names with their first reason, number of chunks, and the number of sample sentences, one for each third they occur in."""
    return Y.excluded(tokens(s, d), marked(s, d)).select("library_id", "name", "reason", "chunk_count", F.size("sample_sentences").alias("samples"))


STATUS = f"""(SELECT package_id, CASE WHEN NOT ({KEEP}) THEN 'Filtered' WHEN l.id IS NULL THEN 'Unresolved' WHEN list_contains(l.all_versions, version) THEN 'Cached' ELSE 'CachedDifferentVersion' END AS status FROM {PACKAGES} x LEFT JOIN libraries_t l ON lower(l.id) = lower(x.package_id))"""


@query("a13_dependency_report", f"SELECT count(*) AS total, count_if(status = 'Filtered') AS filtered, count_if(status = 'Cached') AS cached, count_if(status = 'CachedDifferentVersion') AS different, count_if(status = 'Unresolved') AS unresolved FROM {STATUS}")
def a13(s, d):
    return deps.dependency_report(deps.with_status(packages(s, d), bind.libraries(s, d)))


@query("a14_dashboard", f"SELECT (SELECT count(*) FROM libraries_t) AS libraries, (SELECT count(*) FROM versions_t) AS versions, (SELECT least(count_if(suspect), 20) FROM versions_t) AS suspects, (SELECT count_if(status = 'Running' AND coalesce(last_progress_at, created_at) < {NOW} - INTERVAL 4 HOUR) FROM jobs_t) AS stale_jobs, 'review suspect libraries' AS suggested_action")
def a14(s, d):
    j = now(bind.jobs(s, d))
    return profiling.dashboard(bind.libraries(s, d), bind.versions(s, d), j, F.col("now"))


@query("a15_library_health", "SELECT v.id, v.page_count, CASE WHEN boundary_issue_pct >= 10 THEN 'rechunk recommended' WHEN boundary_issue_pct >= 5 THEN 'rechunk may help' END AS hint, m.languages, h.hosts FROM versions_t v LEFT JOIN (SELECT library_id, string_agg(language || '=' || printf('%.3f', share), ';' ORDER BY language || '=' || printf('%.3f', share)) AS languages FROM (SELECT library_id, language, n / sum(n) OVER (PARTITION BY library_id) AS share FROM (SELECT library_id, coalesce(code_language, 'unfenced') AS language, count(*) AS n FROM chunks_t GROUP BY ALL)) GROUP BY library_id) m ON m.library_id = v.library_id AND v.version = '2.0' LEFT JOIN (SELECT library_id, count(DISTINCT CASE WHEN doc_id % 9 = 0 THEN '(unknown)' ELSE 'h' || (doc_id % 4) || '.example.com' END) AS hosts FROM chunks_t GROUP BY ALL) h ON h.library_id = v.library_id AND v.version = '2.0'")
def a15(s, d):
    """Chunks stand on pages of several hosts, some of none."""
    url = F.when(F.col("doc_id") % 9 == 0, F.lit("no address")).otherwise(F.concat(F.lit("https://H"), F.col("doc_id") % 4, F.lit(".example.com/x/"), "doc_id"))
    return profiling.health(bind.versions(s, d), bind.chunks(s, d).withColumn("page_url", url)).select("id", "page_count", "hint", "languages", "hosts")


@query("a16_boundary_pct", f"SELECT p.library_id, 100.0 * count(i.next_chunk_id) / greatest(p.chunks, 1) AS pct FROM (SELECT library_id, count(*) AS chunks FROM pieces_t GROUP BY ALL) p LEFT JOIN ({ISSUES}) i ON i.library_id = p.library_id GROUP BY p.library_id, p.chunks")
def a16(s, d):
    """Share of cuts that the audit finds, by library."""
    c = bind.pieces(s, d).drop("i")
    issues = chunking.boundary_issues(c).groupBy("library_id").agg(F.count("*").alias("issues"))
    n = c.groupBy("library_id").agg(F.count("*").alias("chunks")).join(issues, "library_id", "left")
    return n.select("library_id", profiling.boundary_pct(F.coalesce("issues", F.lit(0)), F.col("chunks")).alias("pct"))


GRAPH = [("https://a.com/g/", "https://a.com/g/1"), ("https://a.com/g/", "https://a.com/other"), ("https://a.com/g/1", "https://a.com/g/2"), ("https://a.com/g/2", "https://a.com/g/"), ("https://a.com/other", "https://a.com/deep"), ("https://a.com/deep", "https://a.com/deeper"), ("https://a.com/g/2", "https://b.org/x"), ("https://b.org/x", "https://c.org/y"), ("https://a.com/g/1", "https://a.com/g/file.pdf"), ("https://a.com/g/1", "https://A.com/g/2"), ("https://a.com/g/1", "https://a.com/login/x")]


def graph(s):
    return s.createDataFrame(GRAPH, "src string, link string")


#: A walk that leaves its scope and comes back, as far as the depth limits reach and further.
WALK = [f"https://l.com/{'in/' if i % 2 == 0 else ''}{i:02}" for i in range(26)]


def walk(s):
    return s.createDataFrame(list(zip(WALK, WALK[1:], strict=False)), "src string, link string")


ROOT = "https://site.com/page/0"


def site(s, d):
    """One site of the html pages: a page links to the names that its links have, a name to all pages that link to it."""
    p = bind.html_links(s, d).select(F.concat(F.lit("https://site.com/page/"), "page_id").alias("page"), F.concat(F.lit("https://site.com"), F.regexp_replace("href", r"^https?://[^/]*|[?#].*$", "")).alias("name")).distinct()
    return p.select(F.col("page").alias("src"), F.col("name").alias("link")).unionByName(p.select(F.col("name").alias("src"), F.col("page").alias("link")))


def barred(s, d):
    """Links that a job leaves out: files and addresses of excluded kinds."""
    p = bind.read(s, d, "pages").select("page_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("/f.pdf", "/login/x", "/cart/1")]), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select(F.lit(ROOT).alias("src"), F.concat(F.lit("https://site.com/"), F.col("page_id") % 40, kind).alias("link")).distinct()


SITE = """WITH RECURSIVE e AS (SELECT DISTINCT lower(src) AS a, lower(link) AS b FROM site_t), b AS (SELECT 'https://site.com/page/0' AS url, 0 AS step UNION SELECT e.b, b.step + 1 FROM b JOIN e ON e.a = b.url WHERE b.step < 20), r AS (SELECT url, CAST(min(step) AS INTEGER) AS step FROM b GROUP BY url)"""
REACHED = "(VALUES ('https://a.com/g/', 'in', 0, 0, 0), ('https://a.com/g/1', 'in', 1, 0, 0), ('https://a.com/other', 'same', 0, 1, 0), ('https://A.com/g/2', 'in', 2, 0, 0), ('https://a.com/deep', 'same', 0, 2, 0), ('https://b.org/x', 'off', 2, 0, 1))"


@query("a17_dry_run_report", SITE + " SELECT * FROM (SELECT 'in scope' AS part, '' AS name, count(*) AS n FROM r WHERE step % 2 = 0 UNION ALL SELECT 'out of scope', '', count(*) FROM r WHERE step % 2 = 1 UNION ALL SELECT 'depth', CAST(CASE WHEN step % 2 = 0 THEN step // 2 ELSE greatest(step // 2, 1) END AS VARCHAR), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'host', 'site.com', count(*) FROM r UNION ALL SELECT * FROM (SELECT 'page', url, 1 FROM r ORDER BY step % 2, CASE WHEN step % 2 = 0 THEN step // 2 ELSE greatest(step // 2, 1) END, url LIMIT 50) UNION ALL SELECT 'not allowed', '', count(*) FROM (SELECT DISTINCT lower(link) FROM barred_t) UNION ALL SELECT 'beyond depth', '', 0)")
def a17(s, d):
    """Of a site made of the pages' links, with some links that the job leaves out."""
    g = site(s, d).unionByName(barred(s, d))
    return crawl.report(g, crawl.crawl(g, ROOT))


@query("a18_errors_by_kind", "SELECT event_type, id, n FROM (SELECT event_type, event_id AS id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 5")
def a18(s, d):
    from pyspark.sql import Window

    e = bind.read(s, d, "events").select("event_type", F.col("event_id").alias("id"))
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("id")
    return e.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r").join(n, "event_type")


@query("a19_status_by_version", "SELECT library_id, version, page_count, chunk_count FROM versions_t WHERE library_id = 'src1'")
def a19(s, d):
    return bind.versions(s, d).where("library_id = 'src1'").select("library_id", "version", "page_count", "chunk_count")


@query("a20_rescrub_hint", "WITH w AS (SELECT DISTINCT library_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM chunks_t), k AS (SELECT library_id, count_if(length(name) < 4) AS excluded, count_if(length(name) >= 4) AS kept FROM w GROUP BY ALL) SELECT library_id, excluded >= 20 AND excluded / greatest(excluded + kept, 1) >= 0.05 AS hint FROM k")
def a20(s, d):
    """Distinct names of a library, short ones rejected."""
    w = bind.chunks(s, d).select("library_id", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name")).distinct()
    k = w.groupBy("library_id").agg(F.count_if(F.length("name") < 4).alias("excluded"), F.count_if(F.length("name") >= 4).alias("kept"))
    return k.select("library_id", profiling.rescrub_hint(F.col("excluded"), F.col("kept")).alias("hint"))


@query("a21_posting_bytes", "SELECT term, CAST(sum(length(chunk_id) + 12) AS BIGINT) AS bytes, sum(length(chunk_id) + 12) > 1048576 AS spills FROM postings_t GROUP BY term")
def a21(s, d):
    return lexical.posting_bytes(posted(s, d))


@query("j1_postings_doc_lengths", "SELECT p.chunk_id, p.term, l.doc_length FROM postings_t p LEFT JOIN lengths_t l USING (chunk_id)")
def j1(s, d):
    i = bind.index(s, d)
    return i.postings().join(i.lengths().select("chunk_id", "doc_length"), "chunk_id", "left").select("chunk_id", "term", "doc_length")


@query("j2_query_terms_postings", "WITH q AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]+'))) AS term FROM benchmark) SELECT chunk_id, term, term_frequency FROM postings_t SEMI JOIN q USING (term)")
def j2(s, d):
    q = bind.read(s, d, "benchmark").select(F.explode(X.prose_tokens(F.col("text"))).alias("term")).distinct()
    return posted(s, d).join(q, "term", "left_semi").select("chunk_id", "term", "term_frequency")


COS = "list_cosine_similarity(e.v, q.v)"
QV = "SELECT v FROM dotp_t WHERE doc_id = 0"
TEXT = "thing of the ing and ereating idiot"


def query_vector(s, d):
    return bind.read(s, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def hybrid(s, d, k=5):
    return search.search(bind.chunks(s, d, vectors=True), bind.index(s, d), TEXT, query_vector(s, d), k)


ONE = f"""
WITH q0 AS ({QV}), qt AS (SELECT DISTINCT unnest(regexp_extract_all('{TEXT}', '[a-z]+')) AS term),
f AS (SELECT term, count(*) AS df FROM postings_t SEMI JOIN qt USING (term) GROUP BY term),
bm AS (SELECT p.chunk_id, sum(ln((s.document_count - f.df + 0.5) / (f.df + 0.5) + 1) * p.term_frequency * 2.5 / (p.term_frequency + 1.5 * (1 - 0.75 + 0.75 * l.doc_length / s.average_doc_length))) AS bm25 FROM postings_t p JOIN f USING (term) JOIN lengths_t l USING (chunk_id), stats_t s GROUP BY ALL),
hits AS (SELECT c.id, c.category, c.library_id, list_cosine_similarity(e.v, q0.v) AS vector_score FROM chunks_t c JOIN dotp_t e USING (doc_id), q0),
top AS (SELECT * FROM hits ORDER BY vector_score DESC, id LIMIT 10),
mix AS (SELECT t.id, t.category, vector_score, coalesce(bm25, 0) / (SELECT max(bm25) FROM bm) AS bm25_score FROM top t LEFT JOIN bm ON bm.chunk_id = t.id)
"""


@query("j3_vector_bm25", ONE + "SELECT id, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score FROM mix")
def j3(s, d):
    c = bind.chunks(s, d, vectors=True)
    hits = search.vector_topk(c, query_vector(s, d), 10)
    return search.blend(hits, bind.index(s, d).score_text(TEXT)).select("id", F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"))


@query("j4_rerank_hybrid", ONE + ", r AS (SELECT id, .6 * vector_score + .4 * bm25_score AS h FROM mix ORDER BY h DESC, id LIMIT 5), n AS (SELECT id, h, 1 - 0.01 * (row_number() OVER (ORDER BY h DESC, id) - 1) AS rr FROM r) SELECT id, round(.6 * rr + .4 * h, 6) AS relevance FROM n")
def j4(s, d):
    return search.keep_order(hybrid(s, d)).select("id", F.round(search.rerank_blend(F.col("rerank_score"), F.col("relevance_score")), 6).alias("relevance"))


@query("j5_libraries_chunks", "SELECT l.id, count(*) AS n FROM libraries_t l JOIN chunks_t c ON c.library_id = l.id AND c.version = l.current_version GROUP BY l.id")
def j5(s, d):
    libs = bind.libraries(s, d).select(F.col("id").alias("library_id"), F.col("current_version").alias("version"))
    return bind.chunks(s, d).join(libs, ["library_id", "version"]).groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias("n"))


@query("j6_dependencies_libraries", f"SELECT package_id, status FROM {STATUS}")
def j6(s, d):
    return deps.with_status(packages(s, d), bind.libraries(s, d)).select("package_id", "status")


CLIENTS = G.Given("ecosystem string, client string", [("NuGet", "nuget-client"), ("npm", "npm-client"), ("PIP", "pip-client")])


@query("j7_dependency_clients", f"SELECT package_id, version, client FROM {PACKAGES} x JOIN {CLIENTS.sql} c ON lower(c.ecosystem) = lower(x.ecosystem_id)")
def j7(s, d):
    c = F.broadcast(CLIENTS.frame(s))  # one row per ecosystem
    return packages(s, d).join(c, F.lower("ecosystem") == F.lower("ecosystem_id")).select("package_id", "version", "client")


@query("j8_token_context", f"WITH m AS ({MENTIONS}) SELECT library_id, sym_name AS name, max(mentions) AS mentions FROM chunks_t c LEFT JOIN m USING (library_id) WHERE m.name = c.sym_name GROUP BY ALL")
def j8(s, d):
    c = bind.chunks(s, d)
    return c.select("library_id", F.inline("symbols")).select("library_id", "name").distinct().join(Y.prose_mentions(c).drop("version"), ["library_id", "name"])


@query("j9_library_versions", "SELECT l.id AS library, x.v AS version, v.page_count FROM libraries_t l, unnest(l.all_versions) AS x(v) JOIN versions_t v ON v.library_id = l.id AND v.version = x.v")
def j9(s, d):
    e = bind.libraries(s, d).select(F.col("id").alias("library"), F.explode("all_versions").alias("version"))
    v = bind.versions(s, d).select(F.col("library_id").alias("library"), "version", "page_count")
    return e.join(v, ["library", "version"])


@query("j10_query_chunks", f"WITH q AS ({QV}) SELECT c.id, round({COS}, 6) AS score FROM chunks_t c JOIN dotp_t e USING (doc_id), q")
def j10(s, d):
    return search.vector_scores(bind.chunks(s, d, vectors=True), query_vector(s, d)).select("id", F.round("vector_score", 6).alias("score"))


DIFF = "SELECT coalesce(a.library_id, b.library_id) AS library_id, coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM (SELECT * FROM page_versions_t WHERE version = '1.0') a FULL JOIN (SELECT * FROM page_versions_t WHERE version = '2.0') b ON a.library_id = b.library_id AND a.url = b.url"


@query("j11_pages_full_join", f"SELECT library_id, count(*) AS n FROM ({DIFF}) GROUP BY library_id")
def j11(s, d):
    return versions.diff(bind.page_versions(s, d), "1.0", "2.0").groupBy("library_id").agg(F.count("*").alias("n"))


@query("v2_version_diff", DIFF)
def v2(s, d):
    return versions.diff(bind.page_versions(s, d), "1.0", "2.0")


@query("o1_vector_topk", f"WITH q AS ({QV}) SELECT c.id, round({COS}, 6) AS score FROM chunks_t c JOIN dotp_t e USING (doc_id), q WHERE c.category = 'HowTo' ORDER BY {COS} DESC, c.id LIMIT 5")
def o1(s, d):
    return search.vector_topk(bind.chunks(s, d, vectors=True), query_vector(s, d), 5, "howto").select("id", F.round("vector_score", 6).alias("score"))


@query("o2_bm25_topn", SCORE + "SELECT query_id, chunk_id, round(bm25, 5) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS r FROM sc) WHERE r <= 10")
def o2(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "chunk_id")
    return scored(s, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("query_id", "chunk_id", F.round("bm25", 5).alias("bm25"))


@query("o3_hybrid_topk", ONE + "SELECT id, round(.6 * vector_score + .4 * bm25_score, 6) AS score FROM mix ORDER BY .6 * vector_score + .4 * bm25_score DESC, id LIMIT 5")
def o3(s, d):
    return hybrid(s, d).select("id", F.round("relevance_score", 6).alias("score"))


@query("c1_search_docs", ONE + "SELECT id, category, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, round(.6 * vector_score + .4 * bm25_score, 6) AS relevance_score FROM mix ORDER BY .6 * vector_score + .4 * bm25_score DESC, id LIMIT 5")
def c1(s, d):
    r = lambda c: F.round(c, 6).alias(c)
    return hybrid(s, d).select("id", "category", r("vector_score"), r("bm25_score"), r("relevance_score"))


@query("c2_get_class_reference", "WITH x AS (SELECT id, library_id, qualified_name FROM chunks_t WHERE qualified_name = 'Doc25') SELECT id FROM x UNION ALL SELECT id FROM chunks_t WHERE regexp_matches(qualified_name, '(?i)Doc25') AND library_id NOT IN (SELECT library_id FROM x)")
def c2(s, d):
    return search.class_reference(bind.chunks(s, d), "Doc25").select("id")


@query("c3_get_library_overview", f"WITH q AS ({QV}), h AS (SELECT c.id, c.category, {COS} AS s FROM chunks_t c JOIN dotp_t e USING (doc_id), q WHERE c.library_id = 'src3') SELECT id FROM h WHERE category = 'Overview' OR (SELECT count(*) FROM h WHERE category = 'Overview') = 0 ORDER BY s DESC, id LIMIT 5")
def c3(s, d):
    return search.overview(bind.chunks(s, d, vectors=True).where("library_id = 'src3'"), query_vector(s, d)).select("id")


@query("c4_rerank_gate", "SELECT id, NOT (" + " OR ".join(f"regexp_matches(q, {G.literal(p)})" for p in fixed.SHAPES) + f") AND n >= 6 AS on_llm, FALSE AS on_off FROM (SELECT id, q, id % 12 AS n FROM ({ASKED}) UNION ALL SELECT -1 - id, q, id FROM {G.QUERIES.sql})")
def c4(s, d):
    g = lambda name: search.reranks(F.lit(name), F.col("q"), F.col("n"))
    q = bind.read(s, d, "benchmark").select(F.col("item_id").alias("id"), asked(F.col("item_id"), F.col("text")).alias("q"), (F.col("item_id") % 12).alias("n"))
    q = q.unionByName(G.QUERIES.frame(s).select((-1 - F.col("id")).cast("long").alias("id"), "q", F.col("id").cast("long").alias("n")))
    return q.select("id", g("Llm").alias("on_llm"), g("Off").alias("on_off"))


@query("c5_rerank_blend", f"SELECT id, round(.6 * least(coalesce(try_cast(regexp_extract(reply, '(\\d*\\.\\d+|\\d+)', 1) AS DOUBLE), 0), 1) + .4 * h, 6) AS score FROM (SELECT id, reply, (id % 11) / 10.0::DOUBLE AS h FROM ({SAID}) UNION ALL SELECT -1 - id, reply, 0.5 FROM {G.SCORES.sql})")
def c5(s, d):
    rows = bind.read(s, d, "events").select(F.col("event_id").alias("id"), reply().alias("reply"), (F.col("event_id") % 11 / 10).alias("h"))
    rows = rows.unionByName(G.SCORES.frame(s).select((-1 - F.col("id")).cast("long").alias("id"), "reply", F.lit(0.5).alias("h")))
    return rows.select("id", F.round(search.rerank_blend(X.parse_score(F.col("reply")), F.col("h")), 6).alias("score"))


@query("c6_rerankers", ONE + """, t AS (SELECT id, .6 * vector_score + .4 * bm25_score AS h FROM mix ORDER BY h DESC, id LIMIT 5), k AS (SELECT t.id, h, c.doc_id, row_number() OVER (ORDER BY h DESC, t.id) AS r FROM t JOIN chunks_t c ON c.id = t.id)
SELECT id, 'Off' AS strategy, round(1 - 0.01 * (r - 1), 6) AS rerank_score FROM k UNION ALL
SELECT id, 'Llm', list_extract([1.0, 0.8, 0.5, 0.2, 0.0], CAST(doc_id % 5 + 1 AS BIGINT))::DOUBLE FROM k UNION ALL
SELECT id, 'CrossEncoder', round((doc_id % 100) / 100.0, 6)::DOUBLE FROM k""")
def c6(s, d):
    """The best five, re-ranked by every strategy; the models' replies are saved ones, a word and a number for each chunk."""
    hits = cut(hybrid(s, d))
    n = F.col("doc_id")
    word = F.element_at(F.array(*[F.lit(w) for w in ("PERFECT", "high", " Medium", "LOW", "none")]), (n % 5 + 1).cast("int"))
    number = F.concat(F.lit("Relevance: 0."), F.lpad((n % 100).cast("string"), 2, "0"))
    said = bind.chunks(s, d).join(F.broadcast(hits.select("id")), "id")
    out = [search.rerank(hits, k, None if r is None else said.select("id", r.alias("reply"))).select("id", F.lit(k).alias("strategy"), F.round("rerank_score", 6).alias("rerank_score")) for k, r in (("Off", None), ("Llm", word), ("CrossEncoder", number))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("p10_tokenize_identifiers", f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS INTEGER) AS pos, name, leaf, container, callable, generic, keyword FROM ({TOKENS})")
def p10(s, d):
    return Y.tokens(marked(s, d)).drop("library_id", "version")


@query("c7_extract_symbols", f"WITH m AS ({MENTIONS_OF.format('marked_t')}), t AS ({JUDGED}), k AS (SELECT id, name, min(struct_pack(place := place, kind := kind)) AS first FROM t WHERE reason IS NULL GROUP BY ALL) SELECT id, count(*) AS n, min(struct_pack(r := CASE first.kind WHEN 'Type' THEN 0 WHEN 'Enum' THEN 1 WHEN 'Function' THEN 2 WHEN 'Property' THEN 3 ELSE 6 END, place := first.place, name := name)).name AS primary_name FROM k GROUP BY id")
def c7(s, d):
    return Y.per_chunk(tokens(s, d)).select("id", F.size("symbols").alias("n"), "primary_name")


@query("p19_sample_window")
def p19(s, d):
    return bind.chunks(s, d).select("id", Y.sample_windows("content", F.col("symbols")[0]["name"]).alias("sample"))


@query("p34_extract_main_content")
def p34(s, d):
    from ..functions.html import main_content

    return bind.read(s, d, "pages").select("page_id", main_content("html").alias("content"))


@query("c8_rescrub")
def c8(s, d):
    """Chunks whose symbols, primary name or parser version change when read again."""
    c = bind.chunks(s, d)
    new = Y.per_chunk(Y.extract(c, fences=Y.code_fence_symbols(c), mentions=Y.prose_mentions(c))).select("id", F.size("symbols").alias("new_count"), "primary_name")
    out = c.select("id", "qualified_name", "parser_version", F.size("symbols").alias("old_count")).join(new, "id", "left")
    return out.where((F.col("parser_version") < 2) | ~F.col("old_count").eqNullSafe(F.col("new_count")) | ~F.col("qualified_name").eqNullSafe(F.col("primary_name")))


CHOICES = G.Given("id int, asked boolean, hash string, old string", [(0, True, "a", "a"), (1, None, "a", "b"), (2, None, "a", "a"), (3, None, "a", None), (4, False, "a", "b")])


@query("c9_auto_reclassify", f"SELECT CAST(id AS VARCHAR) AS id, coalesce(asked, coalesce(hash <> old, FALSE)) AS again FROM {CHOICES.sql} UNION ALL SELECT url, CASE doc_id % 10 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE doc_id % 4 = 0 OR doc_id % 6 = 0 END FROM pages_t")
def c9(s, d):
    """Pages that are to be classified again: by choice, or as the profile or the classifier has changed; some have no manifest."""
    n = F.col("doc_id")
    old = F.when(n % 10 == 2, F.lit(None)).when(n % 4 == 0, F.lit("other")).otherwise(F.col("content_hash"))
    p = bind.pages(s, d).select(F.col("url").alias("id"), F.when(n % 10 == 0, True).when(n % 10 == 1, False).alias("asked"), F.col("content_hash").alias("hash"), old.alias("old"), F.lit("c1").alias("c"), F.when(n % 6 == 0, "c0").otherwise("c1").alias("old_c"))
    rows = CHOICES.frame(s).select(F.col("id").cast("string").alias("id"), "asked", "hash", "old", F.lit("c1").alias("c"), F.lit("c1").alias("old_c")).unionByName(p)
    return rows.select("id", profiling.reclassifies(*[F.col(x) for x in ("asked", "hash", "old", "c", "old_c")]).alias("again"))


@query("t1_chunk_pages")
def t1(s, d):
    return chunking.chunk_pages(bind.pages(s, d)).select("id", "category", F.length("content").alias("n"))


@query("c10_rechunk")
def c10(s, d):
    """Boundary issues before and after cutting the pages again, by library."""
    before = chunking.boundary_issues(bind.chunks(s, d)).groupBy("library_id").agg(F.count("*").alias("before"))
    new = chunking.chunk_pages(bind.pages(s, d))
    after = chunking.boundary_issues(new).groupBy("library_id").agg(F.count("*").alias("after"))
    n = new.groupBy("library_id").agg(F.count("*").alias("chunks"))
    return n.join(before, "library_id", "left").join(after, "library_id", "left").select("library_id", "chunks", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@query("t5_split_to_char_limit", "SELECT page_url, sum(length(regexp_replace(content, '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{85}\\x{1c}-\\x{1f}\\x{0b}]+', '', 'g')))::BIGINT AS letters, TRUE AS within, CAST(greatest(1, ceil(length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) / 2400.0)) AS BIGINT) <= 1 AS whole FROM chunks_t WHERE category <> 'ChangeLog' GROUP BY page_url, content")
def t5(s, d):
    """By page: what is left of its letters when white space is taken out, whether each piece keeps the limit, and whether a page within it stays whole."""
    c = chunking.chunk_pages(bind.pages(s, d).where("category <> 'ChangeLog'"))
    bare = F.regexp_replace("content", r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{1c}-\x{1f}\x{0b}]+", "")
    return c.groupBy("page_url").agg(F.sum(F.length(bare)).alias("letters"), (F.max(F.length("content")) <= 2400).alias("within"), (F.count("*") == 1).alias("whole"))


@query("t6_explode_symbols", "SELECT id, sym_name AS name, sym_kind AS kind FROM chunks_t")
def t6(s, d):
    return bind.chunks(s, d).select("id", F.inline("symbols")).drop("container")


@query("c11_suspect_reasons", "WITH l AS (SELECT page_id % 20 AS k, page_id, url, regexp_extract(lower(url), '://([^/:?#]+)', 1) AS host FROM pages), x AS (SELECT k, count(*) AS pages, count(DISTINCT host) AS hosts FROM l GROUP BY k), y AS (SELECT page_id % 20 AS k, count(DISTINCT href) AS links FROM links_t GROUP BY 1), m AS (SELECT library_id, max(c / t) AS best, count(*) AS n FROM (SELECT library_id, lang, c, sum(c) OVER (PARTITION BY library_id) AS t FROM (SELECT library_id, lang, count(*) AS c FROM pages_t GROUP BY ALL)) GROUP BY library_id) SELECT m.library_id, concat_ws(',', CASE WHEN pages <= 3 THEN 'OnePager' END, CASE WHEN coalesce(links, 0) < 10 THEN 'SparseLinkGraph' END, CASE WHEN hosts = 1 AND n > 1 THEN 'SingleHost' END, CASE WHEN best < 0.3 THEN 'LanguageMismatch' END, CASE WHEN x.k % 5 = 0 THEN 'ReadmeOnly' END) AS reasons FROM m JOIN x ON m.library_id = 'src' || x.k LEFT JOIN y ON y.k = x.k")
def c11(s, d):
    """A library's site is a twentieth of the html pages: their number, hosts and links; its languages are those of its documents."""
    h = bind.read(s, d, "pages").select((F.col("page_id") % 20).alias("k"), U.host(F.col("url")).alias("host")).groupBy("k").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))
    links = bind.html_links(s, d).groupBy((F.col("page_id") % 20).alias("k")).agg(F.countDistinct("href").alias("links"))
    m = bind.pages(s, d).groupBy("library_id", "lang").agg(F.count("*").alias("c"))
    m = m.groupBy("library_id").agg(F.sum("c").alias("t"), F.collect_set("lang").alias("declared"), F.map_from_entries(F.collect_list(F.struct("lang", F.col("c").cast("double")))).alias("m"))
    f = m.withColumn("mix", F.transform_values("m", lambda k, v: v / F.col("t"))).join(h.join(links, "k", "left").withColumn("library_id", F.concat(F.lit("src"), "k")), "library_id")
    hub = F.col("k") % 5 == 0
    f = f.withColumns({"links": F.coalesce("links", F.lit(0)), "root_url": F.when(hub, "https://github.com/o/r").otherwise("https://docs.example.com"), "sample_titles": F.when(hub, F.array(F.lit("README"), F.lit("Readme.md"))).otherwise(F.array(F.lit("Intro")))})
    return profiling.suspect_reasons(f).select("library_id", F.array_join("reasons", ",").alias("reasons"))


@query("c12_ingest_status", f"SELECT id, CASE WHEN running THEN 'InProgress' WHEN suspect THEN 'UrlSuspect' WHEN NOT profile THEN 'ReconNeeded' WHEN chunks = 0 THEN 'ReadyToScrape' WHEN stale THEN 'Stale' WHEN force THEN 'ReadyToScrape' ELSE 'Ready' END AS status FROM (SELECT id, page_count % 7 = 0 AS running, suspect, page_count % 5 <> 0 AS profile, CASE WHEN page_count % 11 = 0 THEN 0 ELSE chunk_count END AS chunks, version = '1.0' AS stale, page_count % 3 = 0 AS force FROM versions_t UNION ALL SELECT CAST(id AS VARCHAR), running, suspect, profile, chunks, stale, force FROM {G.STATES.sql})")
def c12(s, d):
    n = F.col("page_count")
    v = bind.versions(s, d).select("id", (n % 7 == 0).alias("running"), "suspect", (n % 5 != 0).alias("profile"), F.when(n % 11 == 0, 0).otherwise(F.col("chunk_count")).alias("chunks"), (F.col("version") == "1.0").alias("stale"), (n % 3 == 0).alias("force"))
    rows = v.unionByName(G.STATES.frame(s).withColumn("id", F.col("id").cast("string")))
    return rows.select("id", profiling.ingest_status(*[F.col(x) for x in ("running", "suspect", "profile", "chunks", "stale", "force")]).alias("status"))


@query("c13_build_bm25_index", f"SELECT {SHARD} AS shard_index, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(term_frequency) AS BIGINT) AS tokens FROM postings_t GROUP BY 1")
def c13(s, d):
    """The written shards: postings, terms and tokens of each."""
    return posted(s, d).groupBy("shard_index").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum("term_frequency").alias("tokens"))


RESOLVED = "(VALUES ('Serilog', 'https://serilog.net', 'Medium'), ('doc', 'https://doc.dev/docs', 'High'), ('gh', 'https://github.com/a/gh', 'Medium'), ('react', 'https://react.dev', 'High'), ('left', 'https://github.com/x/left', 'Medium'), ('requests', 'https://requests.readthedocs.io', 'High'), ('plain', 'https://plain.org', 'Medium'), ('none', 'https://none.readthedocs.io', 'Low'))"


def registered(s, d):
    """Registry rows and reachable addresses made of the documents' ids."""
    i, k = F.col("doc_id"), F.col("doc_id") % 6
    name = F.concat(F.lit("pkg"), i)
    none = F.lit(None).cast("string")
    eco = F.when(k < 2, "nuget").when(k < 4, "npm").otherwise("pip")
    project = F.when(k == 0, F.concat(F.lit("https://"), name, F.lit(".net"))).when(k == 2, F.concat(F.lit("https://"), name, F.lit(".org"))).when(k == 3, F.concat(F.lit("https://github.com/x/"), name))
    docs = F.when(k == 1, F.concat(F.lit("https://"), name, F.lit(".dev/docs"))).when(k == 4, F.concat(F.lit("https://docs.org/"), name))
    r = bind.read(s, d, "documents")
    rows = r.select(name.alias("package_id"), eco.alias("ecosystem_id"), F.coalesce(project, none).alias("project_url"), F.when(k == 3, F.concat(F.lit("git://github.com/x/"), name, F.lit(".git"))).alias("repository_url"), F.coalesce(docs, none).alias("documentation_url"))
    known = r.select(F.when(k == 0, F.concat(F.lit("https://"), name, F.lit(".net"))).when(i % 12 == 5, F.concat(F.lit("https://"), name, F.lit(".readthedocs.io"))).alias("url")).where("url is not null")
    return rows, known


@query("c15_resolve_doc_url", "SELECT 'pkg' || doc_id AS package_id, CASE k WHEN 0 THEN 'https://pkg' || doc_id || '.net' WHEN 1 THEN 'https://pkg' || doc_id || '.dev/docs' WHEN 2 THEN 'https://pkg' || doc_id || '.org' WHEN 3 THEN 'https://github.com/x/pkg' || doc_id WHEN 4 THEN 'https://docs.org/pkg' || doc_id WHEN 5 THEN CASE WHEN doc_id % 12 = 5 THEN 'https://pkg' || doc_id || '.readthedocs.io' END END AS doc_url, CASE k WHEN 0 THEN 'Medium' WHEN 3 THEN 'Medium' WHEN 5 THEN CASE WHEN doc_id % 12 = 5 THEN 'Low' END ELSE 'High' END AS confidence FROM (SELECT doc_id, doc_id % 6 AS k FROM documents) UNION ALL " + f"SELECT * FROM {RESOLVED} AS t(package_id, doc_url, confidence)")
def c15(s, d):
    """A package for each document, of every ecosystem and with every kind of metadata, and the small list."""
    own, known = registered(s, d)
    return deps.resolve_doc_url(own.unionByName(G.REGISTRY.frame(s)), known.unionByName(G.REACHABLE.frame(s))).drop("ecosystem_id")


@query("c14_index_dependencies", "SELECT * FROM (VALUES ('Serilog', 'Queued'), ('X', 'Unresolved'), ('NoVer', 'Unresolved'), ('react', 'Queued'), ('jest', 'Filtered'), ('requests', 'Queued'), ('flask', 'Unresolved'), ('plain', 'Queued'), ('numpy', 'Unresolved'), ('pandas', 'Unresolved')) AS t(package_id, status)")
def c14(s, d):
    f = s.createDataFrame(MANIFESTS, "path string, content string")
    return deps.index_dependencies(f, bind.libraries(s, d), G.REGISTRY.frame(s), G.REACHABLE.frame(s)).select("package_id", "status")


@query("c16_create_job", "SELECT id AS library_id, 'https://' || id || '.example.com/' AS root_url, id || '.example.com' AS host, 8 AS excluded, 10 AS in_scope_depth, 2 AS same_host_depth, 1 AS off_site_depth FROM libraries_t")
def c16(s, d):
    u = bind.libraries(s, d).select(F.col("id").alias("library_id"), F.col("current_version").alias("version"), F.concat(F.lit("https://"), "id", F.lit(".example.com/")).alias("url"))
    return deps.jobs_for(u).select("library_id", "root_url", F.col("allowed")[0].alias("host"), F.size("excluded").alias("excluded"), "in_scope_depth", "same_host_depth", "off_site_depth")


@query(
    "c17_retrieval_bench",
    SCORE + """, g AS (SELECT c.id AS chunk_id, l.quality AS gain FROM chunks_t c JOIN labels l USING (doc_id)),
i AS (SELECT sum(gain / log2(r + 1)) AS ideal FROM (SELECT gain, row_number() OVER (ORDER BY gain DESC, chunk_id) AS r FROM g) WHERE r <= 5),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS r FROM sc),
dcg AS (SELECT r.query_id, sum(coalesce(gain, 0) / log2(r + 1)) AS x FROM r LEFT JOIN g USING (chunk_id) WHERE r <= 5 GROUP BY ALL)
SELECT query_id, CASE WHEN ideal > 0 THEN round(x / ideal, 6) ELSE 0 END AS ndcg FROM dcg, i""",
)
def c17(s, d):
    """A label holds for every query of the set."""
    gains = bind.chunks(s, d).join(bind.read(s, d, "labels"), "doc_id").select("id", F.col("quality").alias("gain"))
    ranked = scored(s, d).select("query_id", F.col("chunk_id").alias("id"), F.round("bm25", 9).alias("score"))
    return search.ndcg(ranked, gains).withColumn("ndcg", F.round("ndcg", 6))


@query("c19_ingest_single_page", "SELECT 'chunks' AS part, count(*) + 2 AS n FROM chunks_t WHERE library_id = 'src1' UNION ALL SELECT 'pages', count(*) + 1 FROM pages_t WHERE library_id = 'src1' UNION ALL SELECT 'postings', count(*) + 4 FROM postings_t WHERE library_id = 'src1' UNION ALL SELECT 'found', 1")
def c19(s, d):
    """One page cut, upserted beside the stored ones twice, and the index built again: rows of each table, and the page found by a word of its own."""
    page = s.createDataFrame([("src1", "2.0", "doc://src1/new", "New", "HowTo", "# One\nAxis.Move(1)\n# Two\nmore")], "library_id string, version string, url string, title string, category string, raw_content string")
    folder = f"{shared_folder(s)}/single-{uuid.uuid4().hex}"
    catalog, index = store.Catalog(s, folder), lexical.Index(s, f"{folder}/index")
    key = ["library_id", "version", "id", "content"]
    catalog.append("pages", bind.pages(s, d).select(*page.columns))
    catalog.append("chunks", bind.chunks(s, d).select(*key))
    for _ in range(2):
        catalog.upsert("pages", page, ["url"])
        catalog.upsert("chunks", chunking.chunk_pages(page).select(*key), ["id"])
    index.build(catalog.read("chunks"))
    n = lambda part, rows: rows.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    mine = "library_id = 'src1'"
    out = n("chunks", catalog.read("chunks").where(mine)).unionByName(n("pages", catalog.read("pages").where(mine))).unionByName(n("postings", index.postings().where(mine))).unionByName(n("found", index.score_text("Axis.Move")))
    out = cut(out)
    drop_folder(s, folder)
    return out


@query("v1_register_version", "SELECT id, CASE WHEN id = 'src1' THEN '3.0' ELSE '2.0' END AS current_version, CASE WHEN id = 'src1' THEN '1.0,2.0,3.0' ELSE '1.0,2.0' END AS versions FROM libraries_t UNION ALL SELECT 'fresh', '1.0', '1.0'")
def v1(s, d):
    out = versions.register(versions.register(bind.libraries(s, d), "src1", "3.0"), "fresh", "1.0")
    return out.select("id", "current_version", F.array_join("all_versions", ",").alias("versions"))


def all_tables(s, d):
    return {"libraries": bind.libraries(s, d), "library_versions": bind.versions(s, d), "pages": bind.page_versions(s, d), "chunks": bind.chunks(s, d)}


@query("v3_delete_version", "SELECT id, CASE WHEN id = 'src1' THEN '1.0' ELSE '2.0' END AS current_version, (SELECT count(*) FROM page_versions_t p WHERE p.library_id = l.id AND NOT (l.id = 'src1' AND p.version = '2.0')) AS pages FROM libraries_t l")
def v3(s, d):
    t = versions.delete_version(all_tables(s, d), "src1", "2.0")
    n = t["pages"].groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias("pages"))
    return t["libraries"].join(n, "id", "left").select("id", "current_version", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("v4_delete_library", "SELECT id FROM libraries_t WHERE id <> 'src1' UNION ALL SELECT id FROM versions_t WHERE library_id <> 'src1'")
def v4(s, d):
    t = versions.delete_library(all_tables(s, d), "src1")
    return t["libraries"].select("id").unionByName(t["library_versions"].select("id"))


@query("v5_rename_library", "SELECT replace(id, 'src1/', 'axis/') AS id, CASE WHEN library_id = 'src1' THEN 'axis' ELSE library_id END AS library_id FROM versions_t")
def v5(s, d):
    return versions.rename(bind.versions(s, d), "src1", "axis").select("id", "library_id")


@query("v6_update_category", "SELECT id, CASE WHEN page_url = 'doc://src1/1' THEN 'Code' ELSE category END AS category FROM chunks_t")
def v6(s, d):
    return versions.update_category(bind.chunks(s, d), "doc://src1/1", "Code").select("id", "category")


@query("v7_set_suspect", "SELECT id, CASE WHEN id = 'src1/2.0' THEN TRUE WHEN id = 'src0/2.0' THEN FALSE ELSE suspect END AS suspect FROM versions_t")
def v7(s, d):
    v = versions.set_suspect(bind.versions(s, d), "src1", "2.0", True)
    return versions.set_suspect(v, "src0", "2.0", False).select("id", "suspect")


@query("v8_add_to_likely", "SELECT library_id, version, array_to_string(list_append(likely_symbols, 'KEEP'), ',') AS likely, array_to_string(list_filter(stoplist, lambda x: lower(x) <> 'keep'), ',') AS stops FROM profiles_t UNION ALL SELECT * FROM (VALUES ('l', '1.0', 'One,KEEP', 'stop'), ('l', '2.0', 'Two,KEEP', 'later'), ('l', '3.0', 'KEEP', ''), ('m', '1.0', 'KEEP', '')) AS t(library_id, version, likely, stops)")
def v8(s, d):
    return versions.add_to_likely(profiles(s, d), ["KEEP"]).select("library_id", "version", F.array_join("likely_symbols", ",").alias("likely"), F.array_join("stoplist", ",").alias("stops"))


@query("v9_add_to_stoplist", "SELECT library_id, version, array_to_string(list_filter(likely_symbols, lambda x: lower(x) <> 'one'), ',') AS likely, array_to_string(list_concat(stoplist, CASE WHEN list_contains(stoplist, 'stop') THEN ['ONE'] ELSE ['STOP', 'ONE'] END), ',') AS stops FROM profiles_t UNION ALL SELECT * FROM (VALUES ('l', '1.0', '', 'stop,ONE'), ('l', '2.0', 'Two', 'later,Keep,STOP,ONE'), ('l', '3.0', '', 'STOP,ONE'), ('m', '1.0', '', 'STOP,ONE')) AS t(library_id, version, likely, stops)")
def v9(s, d):
    p = versions.add_to_stoplist(profiles(s, d), ["STOP", "ONE"])
    return p.select("library_id", "version", F.array_join("likely_symbols", ",").alias("likely"), F.array_join("stoplist", ",").alias("stops"))


@query("v10_save_profile", "SELECT library_id, version, CASE WHEN version = '1.0' THEN 'mine' WHEN len(stoplist) = 0 THEN 'mine' ELSE array_to_string(stoplist, ',') END AS stoplist FROM profiles_t UNION ALL SELECT * FROM (VALUES ('l', '1.0', 'mine'), ('l', '2.0', 'later,Keep'), ('l', '3.0', 'later,Keep'), ('m', '1.0', 'mine'), ('m', '2.0', 'mine')) AS t(library_id, version, stoplist)")
def v10(s, d):
    """Every first version is saved anew with a stop list of its own; a new one without takes its library's newest."""
    p = profiles(s, d)
    new = p.where("version = '1.0'").withColumn("stoplist", F.array(F.lit("mine"))).unionByName(p.where("library_id = 'm'").withColumn("version", F.lit("2.0")))
    return versions.save_profile(p, new).select("library_id", "version", F.array_join("stoplist", ",").alias("stoplist"))


@query("v11_url_correction", "SELECT id FROM chunks_t WHERE library_id <> 'src1' UNION ALL SELECT 'job:https://new.example.com/'")
def v11(s, d):
    """Chunks of a corrected library go, and a clean job for its new address is queued."""
    t = versions.delete_library({"chunks": bind.chunks(s, d)}, "src1")
    u = s.createDataFrame([("src1", "2.0", "https://new.example.com/")], "library_id string, version string, url string")
    return t["chunks"].select("id").unionByName(deps.jobs_for(u).select(F.concat(F.lit("job:"), "root_url").alias("id")))


@query("v12_reclassify", "SELECT url, CASE WHEN category = 'Unclassified' AND lang = 'fr' THEN 'HowTo' ELSE category END AS category FROM pages_t")
def v12(s, d):
    p = bind.pages(s, d)
    guess = p.select("url", F.when(F.col("lang") == "fr", "HowTo").otherwise("Unclassified").alias("category"), F.lit(0.9).alias("confidence"))
    return versions.reclassify(p, guess).select("url", "category")


@query("w6_host_limiter")
def w6(s, d):
    e = bind.read(s, d, "events")
    log = e.select(F.concat(F.lit("h"), F.col("user_id") % 50).alias("host"), F.col("event_id").cast("int").alias("seq"), F.unix_timestamp("ts").cast("double").alias("at"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), F.lit(None).cast("double").alias("retry_after"))
    return crawl.limit_hosts(log)


@query("w8_bfs_child_depth", SITE + " SELECT url, CASE WHEN step % 2 = 0 THEN 'in' ELSE 'same' END AS scope, step // 2 AS in_depth, step % 2 AS same_depth, 0 AS off_depth FROM r UNION ALL " + f"SELECT lower(url), scope, in_depth, same_depth, off_depth FROM {REACHED} AS t(url, scope, in_depth, same_depth, off_depth) UNION ALL SELECT 'https://l.com/' || CASE i % 2 WHEN 0 THEN 'in/' ELSE '' END || lpad(CAST(i AS VARCHAR), 2, '0'), CASE i % 2 WHEN 0 THEN 'in' ELSE 'same' END, i // 2, i % 2, 0 FROM range(22) t(i)")
def w8(s, d):
    """Three sites: the pages' links, the small graph, and a walk of 22 pages that leaves its scope at every other step."""
    a, b = crawl.crawl(site(s, d), ROOT), crawl.crawl(graph(s), "https://a.com/g/")
    return a.unionByName(b).unionByName(crawl.crawl(walk(s), "https://l.com/in/00")).withColumn("url", F.lower("url"))


@query("w7_priority_frontier", SITE + " SELECT url, row_number() OVER (ORDER BY step, url) AS place FROM r")
def w7(s, d):
    """Pages in the order in which they are fetched: by level, in-scope ones first."""
    return crawl.fetch_order(crawl.crawl(site(s, d), ROOT)).select(F.lower("url").alias("url"), "place")


@query("w10_resume", SITE + " SELECT url FROM r WHERE step % 2 = 1 OR step = 4")
def w10(s, d):
    """Some pages are stored already; they are walked through and not fetched again."""
    every = crawl.crawl(site(s, d), ROOT)
    seen = every.where("scope = 'in' and in_depth <> 2").select(F.upper("url").alias("url"))
    return crawl.crawl(site(s, d), ROOT, visited=seen).select(F.lower("url").alias("url"))


ATTEMPTS = G.Given("id int, in_scope boolean, status int, attempt int", [(0, True, 403, 0), (1, True, 403, 1), (2, True, 403, 2), (3, False, 403, 0), (4, True, 429, 0), (5, True, 200, 0)])


@query("w9_retry", "SELECT seq AS id, CASE WHEN status = 403 AND in_scope THEN CASE WHEN attempt < 2 THEN 'retry' ELSE 'dropped' END WHEN status >= 400 THEN 'failed' ELSE 'done' END AS step, CASE WHEN status = 403 AND in_scope AND attempt < 2 THEN CAST(1000 * pow(2, attempt) AS INTEGER) END AS delay_ms FROM fetches_t UNION ALL SELECT * FROM (VALUES (-1, 'retry', 1000), (-2, 'retry', 2000), (-3, 'dropped', NULL), (-4, 'failed', NULL), (-5, 'failed', NULL), (-6, 'done', NULL)) AS t(id, step, delay_ms)")
def w9(s, d):
    rows = bind.fetches(s, d).select(F.col("seq").alias("id"), "in_scope", "status", "attempt").unionByName(ATTEMPTS.frame(s).withColumn("id", -1 - F.col("id")))
    return crawl.retry_plan(rows).select("id", "step", "delay_ms")


@query("w12_cancel", "SELECT id, CASE WHEN status NOT IN ('Queued', 'Running') THEN 'AlreadyTerminal' WHEN last_progress_at IS NOT NULL THEN 'Signalled' ELSE 'OrphanCleanedUp' END AS outcome FROM jobs_t")
def w12(s, d):
    return bind.jobs(s, d).select("id", profiling.cancel_outcome(F.col("status"), F.col("last_progress_at").isNotNull()).alias("outcome"))
