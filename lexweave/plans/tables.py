"""Queries of scans, sinks, filters, distincts and orders (S, F, D, O)."""

import uuid

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import chunking, crawl, deps, profiling, search, store, versions
from ..operators import symbols as Y
from ..session import cut, drop_folder, shared_folder
from ..sources import bind, readers
from . import fixtures as G
from .catalog import query
from .scalars import fenced

LIB, VER = "src1", "2.0"
NOW = "(SELECT max(created_at) FROM jobs_t)"


def now(jobs):
    """The newest job's time, as a column joined to every row."""
    return jobs.join(F.broadcast(jobs.agg(F.max("created_at").alias("now"))))


HOST_OF = "lower(regexp_extract({0}, '://([^/:?#]+)', 1))"
#: Links of the pages, and the small list of addresses under one root.
LINKED = f"(SELECT url, link FROM hrefs_t UNION ALL SELECT 'https://docs.example.com/guide/index.html', url FROM {G.URLS.sql})"
#: Packages of the projects and the small list.
PACKAGES = f"(SELECT package_id, version, ecosystem_id FROM deps_t UNION ALL SELECT package_id, version, ecosystem_id FROM {G.DEPENDENCIES.sql})"
KEEP = "NOT ((ecosystem_id = 'nuget' AND lower(package_id) LIKE 'system.%') OR (ecosystem_id = 'npm' AND (lower(package_id) LIKE 'eslint%' OR lower(package_id) LIKE '@types/%')) OR (ecosystem_id = 'pip' AND lower(package_id) LIKE 'pytest%'))"
#: Dotted names and each neighbouring pair in them.
DOTTED = "SELECT DISTINCT library_id, unnest(list_concat([p], list_transform(range(1, len(string_split(p, '.'))), lambda i: list_extract(string_split(p, '.'), i) || '.' || list_extract(string_split(p, '.'), i + 1)))) AS name FROM (SELECT library_id, unnest(regexp_extract_all(w, '\\b[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+\\b')) AS p FROM (SELECT library_id, unnest(regexp_split_to_array(content, '[^A-Za-z0-9_.]+')) AS w FROM {0}))".replace("{0}", "chunks_t")
ISSUES = "WITH n AS (SELECT *, lead(id) OVER w AS next_id, lead(content) OVER w AS next_content, row_number() OVER w AS place FROM pieces_t WINDOW w AS (PARTITION BY page_url ORDER BY i)), d AS (" + DOTTED.replace("chunks_t", "pieces_t") + "), c AS (SELECT *, regexp_extract(content, '([\\p{L}\\p{M}\\p{N}_]*)\\.\\s*$', 1) AS a, regexp_extract(next_content, '^\\s*([\\p{L}\\p{M}\\p{N}_]*)', 1) AS b FROM n WHERE next_id IS NOT NULL) SELECT c.library_id, id AS prev_chunk_id, next_id AS next_chunk_id, a || '.' || b AS joined_identifier FROM c JOIN d ON d.library_id = c.library_id AND d.name = a || '.' || b WHERE regexp_matches(a, '^\\p{L}') AND regexp_matches(b, '^\\p{L}') UNION ALL SELECT library_id, '(none)', id, '(leading-dot)' FROM n WHERE place > 1 AND regexp_matches(content, '^\\s*\\.')"


def in_catalog(s, run):
    """What ``run`` reads of a catalog that it has written; the catalog goes afterwards."""
    folder = f"{shared_folder(s)}/catalog-{uuid.uuid4().hex}"
    out = cut(run(store.Catalog(s, folder)))
    drop_folder(s, folder)
    return out


def in_vectors(s, run):
    """The same for a vector index."""
    folder = f"{shared_folder(s)}/vectors-{uuid.uuid4().hex}"
    out = cut(run(store.VectorIndex(s, folder)))
    drop_folder(s, folder)
    return out


def linked(s, d):
    root = F.lit("https://docs.example.com/guide/index.html")
    return bind.links(s, d).unionByName(G.URLS.frame(s).select(root.alias("url"), F.col("url").alias("link")))


def packages(s, d):
    return bind.dependencies(s, d).unionByName(G.DEPENDENCIES.frame(s).select("package_id", "version", "ecosystem_id"))


@query("s1_scan_chunks", "SELECT id, category FROM chunks_t WHERE library_id = 'src1' AND version = '2.0'")
def s1(s, d):
    return readers.scan(bind.chunks(s, d), LIB, VER).select("id", "category")


@query("s2_scan_pages", "SELECT url, title, content_hash FROM pages_t WHERE library_id = 'src1' AND version = '2.0'")
def s2(s, d):
    return readers.scan(bind.pages(s, d), LIB, VER).select("url", "title", "content_hash")


@query("s3_page_by_url", "SELECT url, title FROM pages_t WHERE url = 'doc://src1/21'")
def s3(s, d):
    return readers.point(bind.pages(s, d), url="doc://src1/21").select("url", "title")


@query("s4_scan_libraries", "SELECT id, name, hint, current_version FROM libraries_t")
def s4(s, d):
    return bind.libraries(s, d).drop("all_versions")


@query("s5_point_lookups", "SELECT id, page_count FROM versions_t WHERE id = 'src1/2.0'")
def s5(s, d):
    return readers.point(bind.versions(s, d), id="src1/2.0").select("id", "page_count")


@query("s6_shard_scan", "SELECT library_id, term, chunk_id, term_frequency FROM postings_t WHERE term IN ('idiot', 'the', 'Hereth')")
def s6(s, d):
    return bind.index(s, d).postings(["idiot", "the", "Hereth"]).select("library_id", "term", "chunk_id", "term_frequency")


@query("s10_registry_source", "SELECT source || doc_id AS package_id, 'https://' || source || '.dev' AS project_url, 'https://github.com/' || source || '/' || doc_id AS repository_url, CASE WHEN doc_id % 2 = 1 THEN 'https://' || source || '.readthedocs.io' END AS documentation_url FROM documents UNION ALL SELECT * FROM (VALUES ('react', 'https://react.dev', 'https://github.com/facebook/react', NULL), ('requests', 'https://psf.io', 'https://github.com/psf/requests', 'https://requests.readthedocs.io')) AS t(package_id, project_url, repository_url, documentation_url)")
def s10(s, d):
    """A saved reply of two registries for each document, and the small list."""
    rows = [("npm", "react", '{"homepage": "https://react.dev", "repository": {"url": "git+https://github.com/facebook/react.git"}}'), ("pip", "requests", '{"info": {"home_page": "https://psf.io", "project_urls": {"Source": "https://github.com/psf/requests", "Documentation": "https://requests.readthedocs.io"}}}')]
    small = s.createDataFrame(rows, "ecosystem_id string, package_id string, body string")
    odd, home = F.col("doc_id") % 2 == 1, F.concat(F.lit("https://"), "source", F.lit(".dev"))
    hub = F.concat(F.lit("https://github.com/"), "source", F.lit("/"), "doc_id")
    urls = F.create_map(F.lit("Source"), hub, F.lit("Documentation"), F.concat(F.lit("https://"), "source", F.lit(".readthedocs.io")))
    pip = F.to_json(F.struct(F.struct(home.alias("home_page"), urls.alias("project_urls")).alias("info")))
    npm = F.to_json(F.struct(home.alias("homepage"), F.struct(F.concat(F.lit("git+"), hub, F.lit(".git")).alias("url")).alias("repository")))
    saved = bind.read(s, d, "documents").select(F.when(odd, "pip").otherwise("npm").alias("ecosystem_id"), F.concat("source", "doc_id").alias("package_id"), F.when(odd, pip).otherwise(npm).alias("body"))
    return deps.registry_metadata(saved.unionByName(small)).drop("ecosystem_id", "description")


MANIFESTS = [
    ("a/App.csproj", '<Project><ItemGroup><PackageReference Include="Serilog" Version="2.0" /><PackageReference Include="X"><Version>1.1</Version></PackageReference><PackageReference Include="NoVer" /></ItemGroup></Project>'),
    ("a/All.sln", 'Project("{1-2}") = "App", "App.csproj", "{3}"\nEndProject'),
    ("a/All.slnx", '<Solution><Project Path="App.csproj" /></Solution>'),
    ("package.json", '{"name": "n", "dependencies": {"react": "^18.2.0"}, "devDependencies": {"jest": "29"}}'),
    ("requirements.txt", "# c\nrequests==2.31\n-r other.txt\n\nflask >= 2.0 \nplain"),
    ("pyproject.toml", '[build-system]\nrequires = ["x"]\n[project]\nname = "p"\ndependencies = [\n  "numpy>=1.2",\n  "pandas",\n]\n[tool.x]\ndependencies = [\n "no",\n]\n'),
]


@query("s9_manifest_parsers", "SELECT 'p' || doc_id || CASE doc_id % 4 WHEN 0 THEN '/App.csproj' WHEN 1 THEN '/package.json' WHEN 2 THEN '/requirements.txt' ELSE '/pyproject.toml' END AS path, unnest(CASE WHEN doc_id % 4 = 1 THEN [source, 'dev-' || lang] ELSE [source, lang] END) AS package_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['1.' || doc_id, 'unknown'] WHEN 1 THEN ['^1.' || doc_id, '2'] WHEN 2 THEN ['1.' || doc_id, ''] ELSE ['1.' || doc_id, ''] END) AS version, CASE doc_id % 4 WHEN 0 THEN 'nuget' WHEN 1 THEN 'npm' ELSE 'pip' END AS ecosystem_id FROM documents UNION ALL SELECT * FROM (VALUES ('a/App.csproj', 'Serilog', '2.0', 'nuget'), ('a/App.csproj', 'X', '1.1', 'nuget'), ('a/App.csproj', 'NoVer', 'unknown', 'nuget'), ('a/All.sln', 'Serilog', '2.0', 'nuget'), ('a/All.sln', 'X', '1.1', 'nuget'), ('a/All.sln', 'NoVer', 'unknown', 'nuget'), ('a/All.slnx', 'Serilog', '2.0', 'nuget'), ('a/All.slnx', 'X', '1.1', 'nuget'), ('a/All.slnx', 'NoVer', 'unknown', 'nuget'), ('package.json', 'react', '^18.2.0', 'npm'), ('package.json', 'jest', '29', 'npm'), ('requirements.txt', 'requests', '2.31', 'pip'), ('requirements.txt', 'flask', '2.0', 'pip'), ('requirements.txt', 'plain', '', 'pip'), ('pyproject.toml', 'numpy', '1.2', 'pip'), ('pyproject.toml', 'pandas', '', 'pip')) AS t(path, package_id, version, ecosystem_id)")
def s9(s, d):
    """A manifest for each document, of four kinds, and the small list."""
    k, i = F.col("doc_id") % 4, F.col("doc_id")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    source, lang = F.col("source"), F.col("lang")
    content = (
        F.when(k == 0, say('<Project><ItemGroup><PackageReference Include="', source, '" Version="1.', i, '" /><PackageReference Include="', lang, '" /></ItemGroup></Project>'))
        .when(k == 1, say('{"dependencies": {"', source, '": "^1.', i, '"}, "devDependencies": {"dev-', lang, '": "2"}}'))
        .when(k == 2, say("# made\n", source, "==1.", i, "\n-r more.txt\n", lang, "\n"))
        .otherwise(say('[project]\nname = "x"\ndependencies = [\n  "', source, ">=1.", i, '",\n  "', lang, '",\n]\n'))
    )
    path = say("p", i, F.element_at(F.array(*[F.lit(x) for x in ("/App.csproj", "/package.json", "/requirements.txt", "/pyproject.toml")]), (k + 1).cast("int")))
    files = bind.read(s, d, "documents").select(path.alias("path"), content.alias("content"))
    return deps.parse_manifests(files.unionByName(s.createDataFrame(MANIFESTS, "path string, content string")))


@query("s12_log_tail", "SELECT event_id AS number, event_type || ' ' || props AS line FROM events WHERE contains(lower(event_type), 'err') ORDER BY event_id DESC LIMIT 50")
def s12(s, d):
    e = bind.read(s, d, "events")
    return readers.log_tail(e.select(F.col("event_id").alias("number"), F.concat("event_type", F.lit(" "), "props").alias("line"), "event_type").where(F.contains(F.lower("event_type"), F.lit("err"))).drop("event_type"))


@query("s13_upsert", "SELECT url, CASE WHEN lang = 'fr' THEN 'new' ELSE title END AS title FROM pages_t UNION ALL SELECT 'doc://new/1', 'new'")
def s13(s, d):
    """Pages written to a catalog, then changed and added to there; of two changes of a key the later stands."""
    p = bind.pages(s, d).select("library_id", "version", "url", "title", "lang")
    new = p.where("lang = 'fr'").select("library_id", "version", "url", F.lit("new").alias("title"), F.lit(2).alias("seq"))
    older = new.withColumn("title", F.lit("older")).withColumn("seq", F.lit(1))
    more = s.createDataFrame([("src1", "2.0", "doc://new/1", "new", 1)], new.schema)

    def run(catalog):
        catalog.append("pages", p.drop("lang"))
        catalog.upsert("pages", older.unionByName(new).unionByName(more), ["url"], "seq")
        return catalog.read("pages").select("url", "title")

    return in_catalog(s, run)


@query("s14_delete_by_key", "SELECT id, (SELECT count(*) FROM chunks_t WHERE library_id IN ('src1', 'src2')) AS deleted FROM chunks_t WHERE library_id NOT IN ('src1', 'src2')")
def s14(s, d):
    """Two library versions deleted from a written table, and how many rows went."""
    gone = s.createDataFrame([("src1", "2.0"), ("src2", "2.0"), ("src3", "9.9")], "library_id string, version string")

    def run(catalog):
        catalog.append("chunks", bind.chunks(s, d).select("id", "library_id", "version"))
        n = catalog.delete("chunks", gone)
        return catalog.read("chunks").select("id", F.lit(n).cast("long").alias("deleted"))

    return in_catalog(s, run)


@query("s15_replace_set", "SELECT library_id, url FROM pages_t WHERE library_id <> 'src1' OR category = 'HowTo'")
def s15(s, d):
    p = bind.pages(s, d).select("library_id", "version", "url", "category")

    def run(catalog):
        catalog.append("pages", p)
        catalog.replace("pages", p.where("library_id = 'src1' and category = 'HowTo'"))
        return catalog.read("pages").select("library_id", "url")

    return in_catalog(s, run)


@query("s16_insert", "SELECT url FROM pages_t UNION ALL SELECT url FROM pages_t WHERE lang = 'de'")
def s16(s, d):
    p = bind.pages(s, d).select("library_id", "version", "url", "lang")

    def run(catalog):
        catalog.append("pages", p)
        catalog.append("pages", p.where("lang = 'de'"))
        return catalog.read("pages").select("url")

    return in_catalog(s, run)


@query("s17_vector_index_load", "SELECT c.id, round(list_cosine_similarity(e.v, (SELECT v FROM dotp_t WHERE doc_id = 0)), 6) AS score FROM chunks_t c JOIN dotp_t e USING (doc_id)")
def s17(s, d):
    """Vectors loaded twice into the stored index, which replaces them, and searched there."""
    c = bind.chunks(s, d, vectors=True)

    def run(index):
        index.load(c)
        index.load(c)
        q = index.read().where(F.col("id") == c.where("doc_id = 0").select("id").first()[0]).select(F.col("unit").alias("q"))
        dot = F.aggregate(F.zip_with("unit", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return index.read().join(F.broadcast(q.limit(1))).select("id", F.round(dot, 6).alias("score"))

    return in_vectors(s, run)


@query("s18_index_reload", "SELECT c.id FROM libraries_t l JOIN chunks_t c ON c.library_id = l.id AND c.version = l.current_version JOIN embeddings e ON e.vec_id = c.doc_id")
def s18(s, d):
    """An index that held an old version holds the current ones after a reload."""
    c = bind.chunks(s, d, vectors=True)

    def run(index):
        index.load(c.withColumn("version", F.lit("1.0")))
        index.reload(c, bind.libraries(s, d))
        return index.read().select("id")

    return in_vectors(s, run)


@query("s19_json_sink", """SELECT '{"id":"' || id || '","page_count":' || page_count || '}' AS json FROM versions_t""")
def s19(s, d):
    return readers.as_json(bind.versions(s, d).select("id", "page_count"))


@query("f1_filter_category", "SELECT id FROM chunks_t WHERE category = 'HowTo'")
def f1(s, d):
    return bind.chunks(s, d).where(F.col("category") == search.parsed_category("howto")).select("id")


@query("f2_filter_name_contains", "SELECT id, sym_name FROM chunks_t WHERE contains(lower(sym_name), 'th')")
def f2(s, d):
    return bind.chunks(s, d).select("id", F.col("symbols")[0]["name"].alias("sym_name")).where(F.contains(F.lower("sym_name"), F.lit("th")))


@query("f3_stale_chunks", "SELECT library_id, bool_or(parser_version < 2) AS stale FROM chunks_t GROUP BY library_id")
def f3(s, d):
    return bind.chunks(s, d).groupBy("library_id").agg(F.bool_or(F.col("parser_version") < 2).alias("stale"))


ASKED = G.Given("library string, version string", [("src1", None), ("src2", "1.0"), ("nope", None)])


@query("f4_version_resolution", f"SELECT a.library, coalesce(a.version, l.current_version) AS version FROM {ASKED.sql} a LEFT JOIN libraries_t l ON l.id = a.library")
def f4(s, d):
    return ASKED.frame(s).join(bind.libraries(s, d), F.col("library") == F.col("id"), "left").select("library", F.coalesce("version", "current_version").alias("version"))


@query("f5_url_allowed", f"SELECT DISTINCT link, NOT regexp_matches(lower(link), '\\.(pdf|zip|png)(\\?|$)') AND regexp_matches(link, '(?i)example\\.(com|org)') AND NOT regexp_matches(link, '(?i)/the|/la/') AS ok FROM {LINKED}")
def f5(s, d):
    return linked(s, d).select("link", U.url_allowed(F.col("link"), [r"example\.(com|org)"], ["/the", "/la/"]).alias("ok")).distinct()


@query("f6_url_in_scope", f"SELECT url, link, {HOST_OF.format('link')} = {HOST_OF.format('url')} AND starts_with(lower(regexp_extract(link, '://[^/?#]*([^?#]*)', 1)), lower(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^(.*/)?', 0))) AS ok FROM {LINKED}")
def f6(s, d):
    """Is a link below the folder of the page that it stands on?"""
    return linked(s, d).select("url", "link", U.in_scope(F.col("link"), F.col("url")).alias("ok"))


@query("f7_url_same_host", f"SELECT url, link, {HOST_OF.format('link')} = {HOST_OF.format('url')} AS ok FROM {LINKED}")
def f7(s, d):
    return linked(s, d).select("url", "link", U.same_host(F.col("link"), F.col("url")).alias("ok"))


@query("f8_depth_limit", f"SELECT id, CASE scope WHEN 'in' THEN in_depth >= 10 WHEN 'same' THEN same_depth >= 2 ELSE off_depth >= 1 END AS reached FROM (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'same' ELSE 'off' END AS scope, user_id % 13 AS in_depth, user_id % 4 AS same_depth, user_id % 3 AS off_depth FROM events UNION ALL SELECT -1 - id, scope, in_depth, same_depth, off_depth FROM {G.CRAWL.sql})")
def f8(s, d):
    i, u = F.col("event_id") % 3, F.col("user_id")
    scope = F.when(i == 0, "in").when(i == 1, "same").otherwise("off")
    rows = bind.read(s, d, "events").select(F.col("event_id").alias("id"), scope.alias("scope"), (u % 13).cast("int").alias("in_depth"), (u % 4).cast("int").alias("same_depth"), (u % 3).cast("int").alias("off_depth"))
    rows = rows.unionByName(G.CRAWL.frame(s).withColumn("id", (-1 - F.col("id")).cast("long")))
    return rows.select("id", U.depth_reached(F.col("scope"), F.col("in_depth"), F.col("same_depth"), F.col("off_depth")).alias("reached"))


@query("f9_gated_prefix", "SELECT f.host, f.seq FROM fetches_t f LEFT JOIN (SELECT host, segment, min(seq) AS gate FROM fetches_t WHERE status = 403 AND NOT in_scope GROUP BY ALL) g USING (host, segment) WHERE g.gate IS NULL OR f.in_scope OR f.seq <= g.gate")
def f9(s, d):
    return crawl.gated(bind.fetches(s, d)).select("host", "seq")


@query("f10_package_filter", f"SELECT package_id, ecosystem_id, version FROM {PACKAGES} WHERE {KEEP}")
def f10(s, d):
    return packages(s, d).where(~deps.skipped(F.col("package_id"), F.col("ecosystem_id"))).select("package_id", "ecosystem_id", "version")


@query("f11_github_repo_url", f"SELECT url, nullif(regexp_extract(url, '(?i)^https?://(?:www\\.)?github\\.com/([^/]+)/([^/#?]+)', 1), '') AS owner, nullif(replace(regexp_extract(url, '(?i)^https?://(?:www\\.)?github\\.com/([^/]+)/([^/#?]+)', 2), '.git', ''), '') AS repo FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'https://GitHub.com/o' || page_id || '/r.git' WHEN 1 THEN 'http://www.github.com/o/r' || page_id || '/tree/main' ELSE url END AS url FROM pages UNION ALL SELECT url FROM {G.URLS.sql})")
def f11(s, d):
    i, n = F.col("page_id") % 3, F.col("page_id")
    url = F.when(i == 0, F.concat(F.lit("https://GitHub.com/o"), n, F.lit("/r.git"))).when(i == 1, F.concat(F.lit("http://www.github.com/o/r"), n, F.lit("/tree/main"))).otherwise(F.col("url"))
    u = bind.read(s, d, "pages").select(url.alias("url")).unionByName(G.URLS.frame(s).select("url"))
    r = U.github_repo(F.col("url"))
    return u.select("url", r["owner"].alias("owner"), r["name"].alias("repo"))


STALE = f"status = 'Running' AND coalesce(last_progress_at, created_at) < {NOW} - INTERVAL 4 HOUR"


@query("f12_stale_running_job", f"SELECT id FROM jobs_t WHERE {STALE}")
def f12(s, d):
    j = now(bind.jobs(s, d))
    return j.where(profiling.stale(j, F.col("now"))).select("id")


@query("f13_active_job", f"SELECT library_id, id FROM (SELECT *, row_number() OVER (PARTITION BY library_id, version ORDER BY created_at DESC, id) AS n FROM jobs_t WHERE status IN ('Queued', 'Running') AND NOT ({STALE})) WHERE n = 1")
def f13(s, d):
    j = now(bind.jobs(s, d))
    return profiling.active_job(j, F.col("now")).select("library_id", "id")


VECTORS = G.Given("id int, a array<double>, b array<double>", [(0, [1.0, 0.0], [1.0, 1.0]), (1, [1.0], [1.0, 2.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [3.0, 4.0], [3.0, 4.0])])


@query("f14_embedding_guard", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN round(list_cosine_similarity(v, list_reverse(v)), 6) ELSE 0.0::DOUBLE END AS score FROM dotp_t UNION ALL SELECT * FROM (VALUES (-1, 0.707107::DOUBLE), (-2, 0.0::DOUBLE), (-3, 0.0::DOUBLE), (-4, 1.0::DOUBLE)) AS t(id, score)")
def f14(s, d):
    """Each vector with itself backwards, with a shorter one, or with zeros."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    i = F.col("vec_id") % 3
    b = F.when(i == 0, F.reverse(v)).when(i == 1, F.slice(v, 1, 3)).otherwise(F.transform(v, lambda x: F.lit(0.0)))
    rows = bind.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("a"), b.alias("b")).unionByName(VECTORS.frame(s).withColumn("id", (-1 - F.col("id")).cast("long")))
    return rows.select("id", F.round(search.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query("f15_fetch_outcome", "SELECT host, seq, CASE WHEN status IN (429, 503) THEN 'limited' WHEN status = 403 THEN 'forbidden' ELSE 'ok' END AS outcome FROM fetches_t")
def f15(s, d):
    return bind.fetches(s, d).select("host", "seq", crawl.outcome(F.col("status")).alias("outcome"))


@query("d1_qualified_names", "SELECT DISTINCT name FROM (SELECT sym_name AS name FROM chunks_t WHERE parser_version >= 2 AND sym_kind = 'Type' UNION ALL SELECT qualified_name FROM chunks_t WHERE parser_version < 2) WHERE name IS NOT NULL AND contains(lower(name), 'o')")
def d1(s, d):
    c = bind.chunks(s, d)
    a = c.where("parser_version >= 2").select(F.inline("symbols")).where("kind = 'Type'").select("name")
    b = c.where("parser_version < 2").select(F.col("qualified_name").alias("name"))
    return a.unionByName(b).where(F.col("name").isNotNull() & F.contains(F.lower("name"), F.lit("o"))).distinct().orderBy("name")


@query("d2_symbols_by_kind", "SELECT DISTINCT sym_name AS name FROM chunks_t WHERE parser_version >= 2 AND sym_kind = 'Function'")
def d2(s, d):
    return bind.chunks(s, d).where("parser_version >= 2").select(F.inline("symbols")).where("kind = 'Function'").select("name").distinct().orderBy("name")


@query("d3_all_symbols", "SELECT DISTINCT sym_name AS name, sym_kind AS kind FROM chunks_t")
def d3(s, d):
    return bind.chunks(s, d).select(F.inline("symbols")).select("name", "kind").dropDuplicates(["name", "kind"])


@query("d4_sample_titles", "SELECT DISTINCT page_title FROM (SELECT page_title FROM chunks_t ORDER BY id LIMIT 10)")
def d4(s, d):
    return bind.chunks(s, d).orderBy("id").limit(10).select("page_title").distinct()


@query("d5_dedup_dependencies", f"SELECT package_id, version, ecosystem_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(package_id), ecosystem_id ORDER BY package_id, version) AS n FROM {PACKAGES}) WHERE n = 1")
def d5(s, d):
    return deps.distinct_packages(packages(s, d))


@query("d6_union_statuses", f"SELECT package_id, 'processed' AS state FROM {PACKAGES} WHERE {KEEP} UNION ALL SELECT package_id, 'filtered' FROM {PACKAGES} WHERE NOT {KEEP}")
def d6(s, d):
    f = packages(s, d)
    skip = deps.skipped(F.col("package_id"), F.col("ecosystem_id"))
    return f.where(~skip).select("package_id", F.lit("processed").alias("state")).unionByName(f.where(skip).select("package_id", F.lit("filtered").alias("state")))


@query("d7_jobs_merge", "SELECT id FROM jobs_t WHERE status = 'Running' UNION SELECT id FROM (SELECT id FROM jobs_t ORDER BY created_at DESC, id LIMIT 5)")
def d7(s, d):
    return profiling.merged_jobs(bind.jobs(s, d)).select("id")


LINK = "lower(CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE regexp_extract(src, '^[a-z]+://[^/?#]+') || href END)"


@query("d8_visited_minus", f"SELECT DISTINCT {LINK} AS link FROM links_t WHERE {LINK} NOT IN (SELECT lower(url) FROM pages) AND NOT regexp_matches({LINK}, '/search|#')")
def d8(s, d):
    links = crawl.resolved_links(bind.html_links(s, d)).select(F.lower("link").alias("link")).distinct()
    seen = bind.read(s, d, "pages").select(F.lower("url").alias("link"))
    return links.join(seen, "link", "left_anti").where(U.url_allowed(F.col("link"), [], ["/search", "#"]))


@query("d9_links_distinct", f"SELECT page_id, count(DISTINCT {LINK}) AS links FROM links_t GROUP BY page_id")
def d9(s, d):
    return crawl.resolved_links(bind.html_links(s, d)).select("page_id", F.lower("link").alias("link")).dropDuplicates(["page_id", "link"]).groupBy("page_id").agg(F.count("*").alias("links"))


@query("d10_filtered_packages", f"SELECT DISTINCT package_id, ecosystem_id FROM {PACKAGES} WHERE NOT {KEEP}")
def d10(s, d):
    f = packages(s, d)
    kept = f.where(~deps.skipped(F.col("package_id"), F.col("ecosystem_id")))
    return store.delete(f, kept.select("package_id", "ecosystem_id")).select("package_id", "ecosystem_id").distinct()


@query("o4_recent_jobs", "SELECT id FROM jobs_t ORDER BY created_at DESC, id LIMIT 20")
def o4(s, d):
    return profiling.recent(bind.jobs(s, d)).select("id")


@query("o5_running_jobs", "SELECT id, error_count FROM jobs_t WHERE status = 'Running'")
def o5(s, d):
    return bind.jobs(s, d).where("status = 'Running'").orderBy(F.desc("created_at"), "id").select("id", "error_count")


@query("o6_excluded_top", "SELECT name, chunk_count FROM (SELECT name, count(DISTINCT id) AS chunk_count FROM (SELECT id, unnest(regexp_extract_all(content, '[A-Za-z]+')) AS name FROM chunks_t) WHERE length(name) = 2 GROUP BY name) ORDER BY chunk_count DESC, name LIMIT 50")
def o6(s, d):
    c = bind.chunks(s, d).select("id", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z]+"), F.lit(0))).alias("name")).where("length(name) = 2")
    return c.distinct().groupBy("name").agg(F.count("*").alias("chunk_count")).orderBy(F.desc("chunk_count"), "name").limit(50)


@query("o7_list_pages", "SELECT url, title FROM pages_t WHERE library_id = 'src1'")
def o7(s, d):
    return readers.scan(bind.pages(s, d), LIB, VER).orderBy(F.upper("url")).select("url", "title")


BOUNDARY = [("l/1/h/0", "p", "Set Axis.Move now. Call Axis."), ("l/1/h/1", "p", "Move again."), ("l/1/h/2", "p", "  .Dot leads"), ("l/1/h/10", "p", "last one"), ("l/1/g/0", "q", "See Foo."), ("l/1/g/0-1", "q", "Bar is not known."), ("l/1/g/1", "q", "end")]


def boundary_chunks(s):
    return s.createDataFrame([("l", "1", *r) for r in BOUNDARY], "library_id string, version string, id string, page_url string, content string")


@query("o8_boundary_pairs", "SELECT id, lead(id) OVER (PARTITION BY page_url ORDER BY i) AS next_id FROM pieces_t UNION ALL SELECT * FROM (VALUES ('l/1/h/0', 'l/1/h/1'), ('l/1/h/1', 'l/1/h/2'), ('l/1/h/2', 'l/1/h/10'), ('l/1/h/10', NULL), ('l/1/g/0', 'l/1/g/0-1'), ('l/1/g/0-1', 'l/1/g/1'), ('l/1/g/1', NULL)) AS t(id, next_id)")
def o8(s, d):
    return chunking.neighbours(bind.pieces(s, d).drop("i").unionByName(boundary_chunks(s))).select("id", "next_id")


@query("o9_boundary_issues", f"SELECT prev_chunk_id, next_chunk_id, joined_identifier FROM ({ISSUES}) UNION ALL SELECT * FROM (VALUES ('l/1/h/0', 'l/1/h/1', 'Axis.Move'), ('(none)', 'l/1/h/2', '(leading-dot)')) AS t(prev_chunk_id, next_chunk_id, joined_identifier)")
def o9(s, d):
    return chunking.boundary_issues(bind.pieces(s, d).drop("i").unionByName(boundary_chunks(s))).select("prev_chunk_id", "next_chunk_id", "joined_identifier")


@query("o10_previous_version", "SELECT id, '1.0' AS previous FROM libraries_t")
def o10(s, d):
    return versions.previous_version(bind.libraries(s, d), "2.0")


@query("o11_repoint_current", "SELECT library_id, version FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY scraped_at DESC, version DESC) AS n FROM versions_t WHERE version <> '2.0') WHERE n = 1")
def o11(s, d):
    return bind.versions(s, d).where("version <> '2.0'").groupBy("library_id").agg(F.max_by("version", F.struct("scraped_at", "version")).alias("version"))


def profiles(s, d):
    """Two profiles of each library, the second without likely symbols, and the small list."""
    p = bind.versions(s, d).select("library_id", "version", F.col("scraped_at").alias("created_utc"))
    first = F.col("version") == "1.0"
    none = F.array().cast("array<string>")
    number = F.regexp_extract("library_id", r"(\d+)", 1).cast("int")
    stops = F.when(first, F.array(F.lit("stop"), F.col("library_id"))).when(number % 2 == 0, none).otherwise(F.array(F.lit("later"), F.lit("KEEP")))
    rows = p.select("library_id", "version", F.when(first, F.array(F.lit("One"), F.col("library_id"))).otherwise(none).alias("likely_symbols"), stops.alias("stoplist"), "created_utc", F.lit(0.9).alias("confidence"))
    return rows.unionByName(profile_rows(s))


def profile_rows(s):
    rows = [("l", "1.0", ["One"], ["stop"], 1), ("l", "2.0", ["Two"], ["later", "Keep"], 2), ("l", "3.0", [], [], 3), ("m", "1.0", [], [], 1)]
    f = s.createDataFrame(rows, "library_id string, version string, likely_symbols array<string>, stoplist array<string>, n int")
    return f.withColumn("created_utc", F.timestamp_seconds("n")).withColumn("confidence", F.lit(0.9)).drop("n")


@query("o12_carry_forward_stoplist", "SELECT library_id, version, CASE WHEN len(stoplist) = 0 THEN 'stop,' || library_id ELSE array_to_string(stoplist, ',') END AS stoplist FROM profiles_t UNION ALL SELECT * FROM (VALUES ('l', '1.0', 'stop'), ('l', '2.0', 'later,Keep'), ('l', '3.0', 'later,Keep'), ('m', '1.0', '')) AS t(library_id, version, stoplist)")
def o12(s, d):
    return versions.carry_stoplist(profiles(s, d)).select("library_id", "version", F.array_join("stoplist", ",").alias("stoplist"))


@query("o13_primary_symbol", "SELECT library_id, min(sym_name) AS name FROM (SELECT library_id, sym_name, rank() OVER (PARTITION BY library_id ORDER BY CASE sym_kind WHEN 'Type' THEN 0 WHEN 'Enum' THEN 1 WHEN 'Function' THEN 2 ELSE 3 END) AS r FROM chunks_t) WHERE r = 1 GROUP BY library_id")
def o13(s, d):
    rank = F.when(F.col("kind") == "Type", 0).when(F.col("kind") == "Enum", 1).when(F.col("kind") == "Function", 2).otherwise(3)
    return bind.chunks(s, d).select("library_id", F.inline("symbols")).groupBy("library_id").agg(F.min(F.struct(rank, "name"))["name"].alias("name"))


@query("o14_previous_job", "SELECT library_id, id FROM (SELECT *, row_number() OVER (PARTITION BY library_id, version ORDER BY created_at DESC, id) AS n FROM (SELECT * FROM jobs_t ORDER BY created_at DESC, id LIMIT 100)) WHERE n = 1")
def o14(s, d):
    top = profiling.recent(bind.jobs(s, d), 100)
    return top.groupBy("library_id", "version").agg(F.max_by("created_at", "created_at").alias("at")).join(top, ["library_id", "version"]).where("created_at = at").groupBy("library_id").agg(F.min("id").alias("id"))


@query("o15_last_n", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 25")
def o15(s, d):
    e = bind.read(s, d, "events").select(F.col("event_id").alias("number"), F.col("event_type").alias("line"))
    return readers.log_tail(e, 25).select(F.col("number").alias("event_id"))


@query("t7_code_fence_symbols", "SELECT DISTINCT library_id, name FROM (SELECT library_id, unnest(list_concat([id], string_split_regex(id, '\\.|::|->'))) AS name FROM (SELECT library_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*(?:(?:\\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*')) AS id FROM chunks_t) WHERE length(id) >= 2) WHERE length(name) >= 2 UNION ALL SELECT 'l', unnest(['var', 'Axis.Move', 'Axis', 'Move', 'std::vector', 'std', 'vector', 'int', 'foo->bar', 'foo', 'bar', 'baz_q'])")
def t7(s, d):
    m = G.MARKDOWN.frame(s).withColumns({"library_id": F.lit("l"), "version": F.lit("1")})
    return Y.code_fence_symbols(fenced(s, d).select("content", "library_id", "version").unionByName(m.drop("id"))).select("library_id", "name")


@query("t8_dotted_identifiers", f"SELECT library_id, name FROM ({DOTTED}) UNION ALL SELECT 'l', unnest(['a.b.c', 'a.b', 'b.c'])")
def t8(s, d):
    c = s.createDataFrame([("l", "1", "use a.b.c and a.b or x")], "library_id string, version string, content string")
    return Y.dotted_identifiers(bind.chunks(s, d).select("library_id", "version", "content").unionByName(c)).select("library_id", "name")
