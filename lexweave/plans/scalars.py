"""Queries of the scalar functions (P), on documents or on given rows."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions import url as U
from ..operators.search import cosine
from ..sources import bind
from . import fixtures as G
from .catalog import query

IN = lambda words: "(" + ", ".join(G.literal(w) for w in words) + ")"
MID = "regexp_matches({0}, '[a-z][A-Z]|[A-Z][A-Z][a-z][a-z]')"
#: Names of the table and of the small list.
NAMES = f"(SELECT name FROM names_t UNION SELECT name FROM {G.NAMES.sql})"
#: A query of every third item is an identifier of its first word.
ASKED = "SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN regexp_extract(text, '[A-Za-z]+') || '.Move' WHEN 1 THEN text ELSE regexp_extract(text, '[A-Za-z]+') || '(x)' END AS q FROM benchmark"
#: Every chunk with its second line's worth of text inside a fence or a pre element.
FENCED = "SELECT id, CASE doc_id % 2 WHEN 0 THEN 'a ```cs' || chr(10) || content || chr(10) || '``` b' ELSE 'a <pre class=\"c\"><code>' || content || '</code></pre> b' END AS content FROM chunks_t"
FOLDERS, FILE_NAMES = ["/", "/docs/", "/samples/", "/src/", "/doc/"], ["README.md", ".md", "-changelog.md", ".py", "/history.txt", ".rst", "/readme"]
PATHS = f"SELECT source || list_extract({G.literal(FOLDERS)}, CAST(doc_id % {len(FOLDERS)} + 1 AS BIGINT)) || lang || list_extract({G.literal(FILE_NAMES)}, CAST(doc_id % {len(FILE_NAMES)} + 1 AS BIGINT)) AS path FROM documents"
SAID = "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Score: ' || (event_id % 200) || '.5' WHEN 1 THEN '.' || (event_id % 97) WHEN 2 THEN event_type ELSE '0.' || (event_id % 100) || ' of 1' END AS reply FROM events"


def named(s, d):
    return bind.names(s, d).unionByName(G.NAMES.frame(s).select("name")).distinct()


def asked(item, text):
    word = F.regexp_extract(text, "[A-Za-z]+", 0)
    return F.when(item % 3 == 0, F.concat(word, F.lit(".Move"))).when(item % 3 == 1, text).otherwise(F.concat(word, F.lit("(x)")))


def fenced(s, d):
    """Chunks whose text stands in a fence or a pre element."""
    c = bind.chunks(s, d)
    fence = F.concat(F.lit("a ```cs\n"), "content", F.lit("\n``` b"))
    return c.withColumn("content", F.when(F.col("doc_id") % 2 == 0, fence).otherwise(F.concat(F.lit('a <pre class="c"><code>'), "content", F.lit("</code></pre> b"))))


def reply():
    """What a model might say of an event: a number after words, a bare fraction, no number, a number before words."""
    i, n = F.col("event_id") % 4, F.col("event_id")
    return F.when(i == 0, F.concat(F.lit("Score: "), n % 200, F.lit(".5"))).when(i == 1, F.concat(F.lit("."), n % 97)).when(i == 2, F.col("event_type")).otherwise(F.concat(F.lit("0."), n % 100, F.lit(" of 1")))


def profile_replies(s, d):
    """A saved profile of each library: its languages, one likely symbol, and a confidence that may be too high."""
    g = bind.read(s, d, "documents").groupBy(F.col("source").alias("library_id")).agg(F.array_sort(F.collect_set("lang")).alias("l"))
    casing = F.struct(F.lit("PascalCase").alias("types"), F.lit("snake_case").alias("methods"))
    body = F.to_json(F.struct(F.col("l").alias("languages"), F.array(F.lit("Axis")).alias("likelySymbols"), casing.alias("casing"), (F.size("l") / 2.0).alias("confidence")))
    return g.select("library_id", body.alias("body"))


@query("p1_sha256_hex", "SELECT doc_id, sha256(raw_content) AS hash, substr(sha256(url), 1, 12) AS key FROM pages_t")
def p1(s, d):
    return bind.pages(s, d).select("doc_id", X.sha256_hex(F.col("raw_content")).alias("hash"), X.url_key(F.col("url")).alias("key"))


NORMAL = "lower(split_part(url, '://', 1)) || '://' || lower(regexp_extract(url, '://([^/:?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '(?i)\\.(html|htm|aspx)$', '') || CASE WHEN contains(regexp_replace(url, '#.*', ''), '?') THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END"


@query("p2_normalize_url", f"SELECT page_id AS id, {NORMAL} AS normal FROM pages UNION ALL SELECT id, {NORMAL} FROM {G.URLS.sql}")
def p2(s, d):
    rows = bind.read(s, d, "pages").select(F.col("page_id").alias("id"), "url").unionByName(G.URLS.frame(s).select(F.col("id").cast("long").alias("id"), "url"))
    return rows.select("id", U.normalize_url(F.col("url")).alias("normal"))


SEGMENT = "CASE WHEN regexp_extract(url, '://[^/?#]*(/[^/?#]+)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*(/[^/?#]+)', 1) || '/' END"


@query("p3_first_path_segment", f"SELECT DISTINCT url, {SEGMENT} AS segment FROM (SELECT link AS url FROM hrefs_t UNION SELECT url FROM pages)")
def p3(s, d):
    u = bind.links(s, d).select(F.col("link").alias("url")).unionByName(bind.read(s, d, "pages").select("url")).distinct()
    return u.select("url", U.first_segment(F.col("url")).alias("segment"))


@query("p4_cosine", "WITH q AS (SELECT v FROM dotp_t WHERE doc_id = 0) SELECT e.doc_id AS vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM dotp_t e, q")
def p4(s, d):
    e = bind.read(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q.limit(1))).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


#: Shard of a term: multiply and xor over its characters, in 32 bits.
SHARD = "CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(term, ''), lambda c: ord(c)::UBIGINT)), lambda h, c: xor((h * 16777619::UBIGINT) & 4294967295::UBIGINT, c)) % 64 AS INTEGER)"


@query("p5_fnv_shard", f"SELECT term, {SHARD} AS shard FROM (SELECT DISTINCT term FROM postings_t)")
def p5(s, d):
    return bind.index(s, d).postings().select("term").distinct().select("term", X.fnv_shard(F.col("term")).alias("shard"))


@query("p6_prose_tokens", "SELECT doc_id, list_transform(regexp_extract_all(raw_content, '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x)) AS tokens FROM pages_t")
def p6(s, d):
    return bind.pages(s, d).select("doc_id", X.prose_tokens(F.col("raw_content")).alias("tokens"))


IDENT = r"[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*"


@query("p7_identifier_tokens", f"SELECT doc_id, list_filter(regexp_extract_all(raw_content, '{IDENT}'), lambda x: length(x) >= 2) AS tokens FROM pages_t")
def p7(s, d):
    return bind.pages(s, d).select("doc_id", X.identifier_tokens(F.col("raw_content")).alias("tokens"))


@query("p8_query_terms", f"SELECT item_id, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x)), list_filter(regexp_extract_all(text, '{IDENT}'), lambda x: length(x) >= 2)))) AS terms FROM benchmark")
def p8(s, d):
    return bind.read(s, d, "benchmark").select("item_id", F.array_sort(X.query_terms(F.col("text"))).alias("terms"))


@query("p9_query_shape", "SELECT id, " + " OR ".join(f"regexp_matches(q, {G.literal(p)})" for p in fixed.SHAPES) + f" AS identifier FROM ({ASKED} UNION ALL SELECT id, q FROM {G.QUERIES.sql})")
def p9(s, d):
    q = bind.read(s, d, "benchmark").select(F.col("item_id").alias("id"), asked(F.col("item_id"), F.col("text")).alias("q"))
    return q.unionByName(G.QUERIES.frame(s).select(F.col("id").cast("long").alias("id"), "q")).select("id", X.query_shape(F.col("q")).alias("identifier"))


@query("p11_is_unit", f"SELECT name, name IN {IN(fixed.UNITS)} OR (length(name) <= 4 AND lower(name) IN {IN(fixed.UNITS_ANY_CASE)}) AS unit FROM {NAMES}")
def p11(s, d):
    return named(s, d).select("name", X.is_unit(F.col("name")).alias("unit"))


@query("p12_stoplist_match", f"SELECT name, CASE WHEN lower(name) IN {IN(sorted(fixed.STOPLIST))} THEN 'Global' WHEN lower(name) IN ('easytune', 'ram', 'der', 'und') THEN 'Library' ELSE 'None' END AS stop FROM {NAMES}")
def p12(s, d):
    own = F.array(*[F.lit(w) for w in ("easytune", "ram", "der", "und")])
    return named(s, d).select("name", X.stoplist_match(F.col("name"), own).alias("stop"))


@query("p13_mid_word_capital", f"SELECT name, {MID.format('name')} AS hump FROM {NAMES}")
def p13(s, d):
    return named(s, d).select("name", X.mid_word_capital(F.col("name")).alias("hump"))


@query("p14_internal_structure", f"SELECT name, contains(name, '_') OR contains(name, '.') OR contains(name, '::') OR contains(name, '->') OR {MID.format('name')} AS inside FROM {NAMES}")
def p14(s, d):
    return named(s, d).select("name", X.internal_structure(F.col("name")).alias("inside"))


@query("p15_likely_abbreviation", f"SELECT name, regexp_full_match(name, '[A-Z0-9]{{1,4}}') AS short FROM {NAMES}")
def p15(s, d):
    return named(s, d).select("name", X.likely_abbreviation(F.col("name")).alias("short"))


STRUCT = f"(contains(name, '_') OR contains(name, '.') OR contains(name, '::') OR contains(name, '->') OR {MID.format('name')})"


@query(
    "p16_rejection_reason",
    f"SELECT name, CASE WHEN lower(name) IN {IN(sorted(fixed.STOPLIST))} THEN 'GlobalStoplist' WHEN name IN {IN(fixed.UNITS)} OR (length(name) <= 4 AND lower(name) IN {IN(fixed.UNITS_ANY_CASE)}) THEN 'Unit' WHEN length(name) < 2 THEN 'BelowMinLength' WHEN {STRUCT} OR (length(name) % 2 = 0 AND NOT regexp_full_match(name, '[A-Z0-9]{{1,4}}')) THEN NULL WHEN length(name) % 2 = 0 THEN 'LikelyAbbreviation' ELSE 'NoStructureSignal' END AS reason FROM {NAMES}",
)
def p16(s, d):
    """Names of even length are mentioned often."""
    n, no = F.col("name"), F.lit(False)
    mentions = F.when(F.length("name") % 2 == 0, 5).otherwise(0)
    return named(s, d).select("name", X.rejection_reason(n, n, F.lit(None).cast("string"), no, no, no, no, no, mentions, mentions).alias("reason"))


@query("p17_symbol_kind", f"SELECT name, CASE WHEN length(name) % 5 = 0 THEN 'Enum' WHEN length(name) % 5 = 1 THEN 'Function' WHEN regexp_matches(name, '^[A-Z]') AND {MID.format('name')} AND NOT contains(name, '_') THEN 'Type' WHEN contains(name, '_') AND regexp_full_match(name, '[a-z0-9_]+') THEN 'Function' ELSE 'Unknown' END AS kind FROM {NAMES}")
def p17(s, d):
    """A name's length says how it is written: declared as an enum, called, or plain."""
    i = F.length("name") % 5
    return named(s, d).select("name", X.symbol_kind(F.when(i == 0, "enum"), i == 1, F.lit(False), F.lit(None).cast("string"), F.lit(False), F.col("name"), F.lit("PascalCase"), F.lit("snake_case")).alias("kind"))


@query("p18_primary_name", "SELECT id, sym_name AS name FROM chunks_t")
def p18(s, d):
    worse = F.struct(F.lit("zzz").alias("name"), F.lit("Namespace").alias("kind"), F.lit(None).cast("string").alias("container"))
    return bind.chunks(s, d).select("id", X.primary_name(F.concat(F.array(worse), F.col("symbols"))).alias("name"))


@query("p20_strip_fences", f"SELECT id, regexp_replace(regexp_replace(content, '(?s)```.*?```', ' ', 'g'), '(?is)<pre[^>]*>.*?</pre>', ' ', 'g') AS bare FROM ({FENCED} UNION ALL SELECT CAST(id AS VARCHAR), content FROM {G.MARKDOWN.sql})")
def p20(s, d):
    m = fenced(s, d).select("id", "content").unionByName(G.MARKDOWN.frame(s).select(F.col("id").cast("string").alias("id"), "content"))
    return m.select("id", X.strip_fences(F.col("content")).alias("bare"))


FILES = "CASE WHEN regexp_matches(n, '^(changelog|changes|history|releases)') OR n IN ('release-notes.md', 'release_notes.md') THEN 'ChangeLog' WHEN starts_with(n, 'readme') THEN 'Overview' WHEN regexp_matches(p, '/(samples?|examples?|demos?)/') THEN 'Sample' WHEN regexp_matches(p, '^docs?/|/docs?/') THEN 'HowTo' WHEN regexp_matches(n, '\\.(md|markdown|rst|adoc)$') THEN 'Overview' ELSE 'Code' END"


@query("p21_github_file_category", f"SELECT path, {FILES} AS category FROM (SELECT path, lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS n FROM ({PATHS} UNION SELECT path FROM {G.PATHS.sql}))")
def p21(s, d):
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in FILE_NAMES]), (F.col("doc_id") % len(FILE_NAMES) + 1).cast("int"))
    p = bind.read(s, d, "documents").select(F.concat("source", folder, "lang", name).alias("path")).unionByName(G.PATHS.frame(s).select("path")).distinct()
    return p.select("path", X.file_category(F.col("path")).alias("category"))


@query("p22_embed_text", "SELECT doc_id, sha256(substr('[' || category || '] [' || library_id || '] [' || title || ']' || chr(10) || raw_content, 1, 6000)) AS digest FROM pages_t")
def p22(s, d):
    return bind.pages(s, d).select("doc_id", F.sha2(X.embed_text(F.col("category"), F.col("library_id"), F.col("title"), F.col("raw_content")), 256).alias("digest"))


@query("p23_parse_score", f"SELECT id, coalesce(least(greatest(try_cast(regexp_extract(reply, '(\\d*\\.\\d+|\\d+(?:\\.\\d+)?)', 1) AS DOUBLE), 0), 1), 0) AS score FROM ({SAID} UNION ALL SELECT -1 - id, reply FROM {G.SCORES.sql})")
def p23(s, d):
    said = bind.read(s, d, "events").select(F.col("event_id").alias("id"), reply().alias("reply")).unionByName(G.SCORES.frame(s).select((-1 - F.col("id")).cast("long").alias("id"), "reply"))
    return said.select("id", X.parse_score(F.col("reply")).alias("score"))


WORDS = G.Given("id int, word string", list(enumerate(["PERFECT", "high", " Medium ", "LOW", "none", "other"])))


@query("p24_score_word", f"SELECT id, CASE upper(trim(word)) WHEN 'PERFECT' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.8::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE WHEN 'LOW' THEN 0.2::DOUBLE WHEN 'NONE' THEN 0.0::DOUBLE END AS score FROM (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'perfect' WHEN 'click' THEN ' High ' WHEN 'error' THEN 'MEDIUM' WHEN 'signup' THEN 'low' ELSE event_type END AS word FROM events UNION ALL SELECT -1 - id, word FROM {WORDS.sql})")
def p24(s, d):
    kind = F.col("event_type")
    word = F.when(kind == "view", "perfect").when(kind == "click", " High ").when(kind == "error", "MEDIUM").when(kind == "signup", "low").otherwise(kind)
    rows = bind.read(s, d, "events").select(F.col("event_id").alias("id"), word.alias("word")).unionByName(WORDS.frame(s).select((-1 - F.col("id")).cast("long").alias("id"), "word"))
    return rows.select("id", X.score_word(F.col("word")).alias("score"))


@query("p25_retry_delay_ms", "SELECT seq, CAST(least(1000 * pow(2, attempt), 5000) AS INTEGER) AS delay FROM fetches_t")
def p25(s, d):
    return bind.fetches(s, d).select("seq", X.retry_delay_ms(F.col("attempt")).alias("delay"))


NOW = "2026-01-01 00:00:00"


@query("p26_retry_after", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN nullif(CAST(event_id % 90 AS BIGINT), 0) WHEN 1 THEN CASE WHEN date_trunc('second', ts) > TIMESTAMP '2024-01-05' THEN date_diff('second', TIMESTAMP '2024-01-05', date_trunc('second', ts)) END END AS seconds FROM events UNION ALL SELECT * FROM (VALUES (-1, 120), (-2, NULL), (-3, NULL), (-4, date_diff('second', TIMESTAMP '2024-01-05', TIMESTAMP '2026-10-21 07:28:00')), (-5, date_diff('second', TIMESTAMP '2024-01-05', TIMESTAMP '2015-10-21 07:28:00') * NULL), (-6, NULL), (-7, NULL)) AS t(id, seconds)")
def p26(s, d):
    """Headers with a number of seconds, with an HTTP date, or neither; the clock stands in the middle of the log."""
    i = F.col("event_id") % 3
    value = F.when(i == 0, (F.col("event_id") % 90).cast("string")).when(i == 1, F.date_format(F.col("ts").cast("timestamp"), "E, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.col("event_type"))
    rows = bind.read(s, d, "events").select(F.col("event_id").alias("id"), value.alias("value")).unionByName(G.RETRIES.frame(s).select((-1 - F.col("id")).cast("long").alias("id"), "value"))
    return rows.select("id", X.retry_after_seconds(F.col("value"), F.lit("2024-01-05 00:00:00").cast("timestamp")).alias("seconds"))


@query("p27_clean_npm_version", "SELECT package_id, regexp_replace(version, '^[\\^~>=<]+', '') AS version FROM deps_t")
def p27(s, d):
    return bind.dependencies(s, d).select("package_id", X.clean_npm_version(F.col("version")).alias("version"))


@query("p28_normalize_git_url", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://github.com/' || source || '/r' WHEN 1 THEN 'https://github.com/' || source WHEN 2 THEN 'https://' || source || '.example.org/x' ELSE 'git@github.com:' || source END AS url FROM documents")
def p28(s, d):
    i = F.col("doc_id") % 4
    url = F.when(i == 0, F.concat(F.lit("git+https://github.com/"), "source", F.lit("/r.git"))).when(i == 1, F.concat(F.lit("git://github.com/"), "source", F.lit(".git"))).when(i == 2, F.concat(F.lit("https://"), "source", F.lit(".example.org/x"))).otherwise(F.concat(F.lit("git@github.com:"), "source", F.lit(".git")))
    return bind.read(s, d, "documents").select("doc_id", X.normalize_git_url(url).alias("url"))


@query("p29_profile_hash", "SELECT source AS library_id, upper(sha256(string_agg(lang, chr(31) ORDER BY lang) || chr(30) || 'Axis' || chr(31) || 'Zed' || chr(30) || chr(30) || chr(30) || 'PascalCase' || chr(30) || 'snake_case')) AS hash FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def p29(s, d):
    none = F.array().cast("array<string>")
    p = bind.read(s, d, "documents").groupBy(F.col("source").alias("library_id")).agg(F.collect_set("lang").alias("languages"))
    return p.select("library_id", X.profile_hash(F.col("languages"), F.array(F.lit("Zed"), F.lit("Axis")), none, none, F.lit("PascalCase"), F.lit("snake_case")).alias("hash"))


@query("p30_boundary_hint", "SELECT id, CASE WHEN boundary_issue_pct >= 10 THEN 'rechunk recommended' WHEN boundary_issue_pct >= 5 THEN 'rechunk may help' END AS hint FROM versions_t")
def p30(s, d):
    return bind.versions(s, d).select("id", X.boundary_hint(F.col("boundary_issue_pct")).alias("hint"))


@query("p31_estimate_tokens", "SELECT doc_id, CAST(length(raw_content) // 4 AS INTEGER) AS tokens FROM pages_t")
def p31(s, d):
    return bind.pages(s, d).select("doc_id", X.estimate_tokens(F.col("raw_content")).alias("tokens"))


IDS = G.Given("id string", [("l/v/h/2",), ("l/v/h/10",), ("l/v/h/3-1",), ("l/v/h/x",), ("7-2",), ("l/v/h/4-y",)])


@query("p32_chunk_order", f"SELECT id, CAST(i AS INTEGER) AS main, CAST(i % 3 AS INTEGER) AS sub FROM (SELECT id || CASE i % 3 WHEN 0 THEN '' ELSE '-' || (i % 3) END AS id, i FROM pieces_t) UNION ALL SELECT id, coalesce(try_cast(split_part(t, '-', 1) AS INTEGER), 0) AS main, coalesce(try_cast(split_part(t, '-', 2) AS INTEGER), 0) AS sub FROM (SELECT id, regexp_extract(id, '[^/]*$') AS t FROM {IDS.sql})")
def p32(s, d):
    main, sub = X.chunk_order(F.col("id"))
    part = F.when(F.col("i") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.col("i") % 3))
    rows = bind.pieces(s, d).select(F.concat("id", part).alias("id")).unionByName(IDS.frame(s))
    return rows.select("id", main.alias("main"), sub.alias("sub"))


@query("p33_frame_score", "SELECT page_id, round(least(n / 1000.0, 5) + (n - l) / n::DOUBLE * 5 + CASE WHEN regexp_matches(lower(url), 'content|main|topic|body|detail|article') THEN 3 ELSE 0 END, 6) AS score FROM (SELECT page_id, url, length(html) AS n, len(regexp_extract_all(html, '<a ')) * 10 AS l FROM pages)")
def p33(s, d):
    p = bind.read(s, d, "pages").select("page_id", "url", F.length("html").alias("n"), (F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))) * 10).alias("l"))
    return p.select("page_id", F.round(X.frame_score(F.col("n"), F.col("l"), F.lit(""), F.col("url")), 6).alias("score"))


@query("p35_extract_links", "SELECT DISTINCT page_id, lower(CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE regexp_extract(src, '^[a-z]+://[^/?#]+') || href END) AS link FROM links_t")
def p35(s, d):
    from ..operators.crawl import resolved_links

    return resolved_links(bind.html_links(s, d)).select("page_id", F.lower("link").alias("link")).distinct()


@query("p36_parse_classification", "SELECT url AS id, category, CASE WHEN doc_id % 3 = 2 THEN CASE WHEN category = 'Unclassified' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END ELSE (doc_id % 10) / 10.0::DOUBLE END AS confidence FROM pages_t UNION ALL SELECT * FROM (VALUES ('0', 'HowTo', 0.9::DOUBLE), ('1', 'ApiReference', 0.4::DOUBLE), ('2', 'Sample', 0.5::DOUBLE), ('3', 'Unclassified', 0.0::DOUBLE), ('4', 'Unclassified', 0.0::DOUBLE), ('5', 'Code', 0.0::DOUBLE)) AS t(id, category, confidence)")
def p36(s, d):
    """A saved reply for each page: JSON, fenced JSON, or a sentence that names a category; 'Unclassified' is no category to name."""
    number = (F.col("doc_id") % 10 / 10).cast("string")
    body = F.concat(F.lit('{"category": "'), "category", F.lit('", "confidence": '), number, F.lit("}"))
    i = F.col("doc_id") % 3
    plain = F.when(F.col("category") == "Unclassified", "I can't tell").otherwise(F.concat(F.lit("This is "), F.lower("category"), F.lit(".")))
    said = F.when(i == 0, body).when(i == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(plain)
    rows = bind.pages(s, d).select(F.col("url").alias("id"), said.alias("reply")).unionByName(G.REPLIES.frame(s).select(F.col("id").cast("string").alias("id"), "reply"))
    return rows.select("id", X.parse_classification(F.col("reply")).alias("c")).select("id", "c.*")


@query("p37_parse_profile_json", "SELECT library_id AS id, string_agg(lang, ',' ORDER BY lang) AS languages, 'Axis' AS likely, 'PascalCase' AS types, least(count(*) / 2.0, 1)::DOUBLE AS confidence FROM (SELECT DISTINCT source AS library_id, lang FROM documents) GROUP BY library_id UNION ALL SELECT * FROM (VALUES ('0', 'C#', 'Axis', 'PascalCase', 1.0::DOUBLE), ('1', '', '', '', 0.0::DOUBLE), ('2', '', '', '', 0.85::DOUBLE)) AS t(id, languages, likely, types, confidence)")
def p37(s, d):
    rows = profile_replies(s, d).select(F.col("library_id").alias("id"), "body").unionByName(G.PROFILES.frame(s).select(F.col("id").cast("string").alias("id"), "body"))
    p = rows.select("id", X.parse_profile(F.col("body")).alias("p"))
    return p.select("id", F.array_join("p.languages", ",").alias("languages"), F.array_join("p.likely_symbols", ",").alias("likely"), "p.types", "p.confidence")


@query("p38_kind_label", "SELECT id, CASE sym_kind WHEN 'Type' THEN 'class' ELSE lower(sym_kind) END AS label FROM chunks_t")
def p38(s, d):
    return bind.chunks(s, d).select("id", X.kind_label(F.col("symbols")[0]["kind"]).alias("label"))
