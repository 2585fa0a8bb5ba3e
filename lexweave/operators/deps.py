"""Project dependencies: manifests, filters, look-ups, documentation addresses, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import url as U
from ..functions.text import clean_npm_version, normalize_git_url

REQUIREMENT = r"^([a-zA-Z0-9_.-]+)\s*(?:[=!<>~]+\s*(.+))?$"


def _spec(line: Column) -> Column:
    return F.struct(F.regexp_extract(line, REQUIREMENT, 1).alias("package_id"), F.trim(F.regexp_extract(line, REQUIREMENT, 2)).alias("version"))


def parse_manifests(files: DataFrame) -> DataFrame:
    """(path, package_id, version, ecosystem_id) of manifest files (path, content).

    Project files and solutions (whose projects are looked up by path), package.json,
    requirements.txt and pyproject.toml; anything else, and what can't be read, has no rows.
    """
    name = F.lower(F.substring_index("path", "/", -1))
    projects = _projects(files.where(name.endswith(".csproj")))
    # a solution names its projects relative to its own folder
    sln = F.regexp_extract_all("content", F.lit(r'(?i)Project\("\{[^}]+\}"\)\s*=\s*"[^"]*",\s*"([^"]*\.csproj)"'), F.lit(1))
    slnx = F.regexp_extract_all("content", F.lit(r'(?i)<Project\b[^>]*\bPath="([^"]*\.csproj)"'), F.lit(1))
    folder = F.regexp_extract("path", r"^(.*/)?", 0)
    refs = files.where(name.endswith(".sln") | name.endswith(".slnx")).select(F.col("path").alias("solution"), F.explode(F.transform(F.when(name.endswith(".slnx"), slnx).otherwise(sln), lambda p: F.concat(folder, F.replace(p, F.lit("\\"), F.lit("/"))))).alias("path"))
    by_solution = refs.join(projects, "path").select(F.col("solution").alias("path"), "package_id", "version", "ecosystem_id")
    return projects.unionByName(by_solution).unionByName(_npm(files.where(name == "package.json"))).unionByName(_pip(files, name))


def _projects(files: DataFrame) -> DataFrame:
    tag = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(<PackageReference\b(?:[^>]*/>|.*?</PackageReference>|[^>]*>))"), F.lit(1)))
    t = files.select("path", tag.alias("t"))
    inner = F.regexp_extract("t", r"(?s)<Version>\s*([^<]*?)\s*</Version>", 1)
    own = F.regexp_extract("t", r'^<PackageReference\b[^>]*?\bVersion\s*=\s*"([^"]*)"', 1)
    version = F.when(own != "", own).when(inner != "", inner).otherwise("unknown")
    out = t.select("path", F.regexp_extract("t", r'^<PackageReference\b[^>]*?\bInclude\s*=\s*"([^"]*)"', 1).alias("package_id"), version.alias("version"), F.lit("nuget").alias("ecosystem_id"))
    return out.where(F.trim("package_id") != "")


def _npm(files: DataFrame) -> DataFrame:
    read = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.create_map().cast("map<string,string>")
    both = F.concat(F.map_entries(F.coalesce(read["dependencies"], none)), F.map_entries(F.coalesce(read["devDependencies"], none)))
    return files.select("path", F.explode(both).alias("e")).select("path", F.col("e.key").alias("package_id"), F.coalesce("e.value", F.lit("")).alias("version"), F.lit("npm").alias("ecosystem_id"))


def _pip(files: DataFrame, name: Column) -> DataFrame:
    lines = lambda c: F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x))
    plain = files.where(name == "requirements.txt").select("path", F.explode(lines(F.col("content"))).alias("line")).where(~F.col("line").rlike("^[#-]") & (F.col("line") != ""))
    # the dependencies array of the [project] table, to its closing line
    section = F.regexp_extract("content", r"(?is)(?:^|\n)\s*\[project\]\s*\r?\n(.*?)(?=\n\s*\[[a-z]|\z)", 1)
    body = F.regexp_extract(section, r"(?is)(?:^|\n)\s*dependencies[^\n]*\n(.*?)(?:\n\s*\]|\z)", 1)
    toml = files.where(name == "pyproject.toml").select("path", F.explode(lines(body)).alias("line")).select("path", F.regexp_extract("line", '"([^"]+)"', 1).alias("line"))
    rows = plain.unionByName(toml).where(F.col("line").rlike(REQUIREMENT)).select("path", _spec(F.col("line")).alias("s"))
    return rows.select("path", "s.package_id", "s.version", F.lit("pip").alias("ecosystem_id"))


def skipped(package: Column, ecosystem: Column) -> Column:
    """Does the id start, in any case, with a prefix that its ecosystem leaves out?"""
    out = F.lit(False)
    for eco, prefixes in fixed.SKIPPED_PACKAGES.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.lower(package).startswith(p.lower())
        out = out | ((ecosystem == eco) & hit)
    return out


def distinct_packages(deps: DataFrame) -> DataFrame:
    """One row per id in any case and ecosystem: the least by id as written, then version."""
    w = Window.partitionBy(F.lower("package_id"), "ecosystem_id").orderBy("package_id", "version")
    return deps.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def with_status(deps: DataFrame, libraries: DataFrame) -> DataFrame:
    """Cached at this version, cached at another one, or unresolved; left-out packages are Filtered."""
    libs = libraries.select(F.lower("id").alias("k"), "all_versions", "current_version")
    rows = deps.join(libs, F.lower("package_id") == F.col("k"), "left")
    status = F.when(skipped(F.col("package_id"), F.col("ecosystem_id")), "Filtered").when(F.col("k").isNull(), "Unresolved").when(F.array_contains("all_versions", F.col("version")), "Cached").otherwise("CachedDifferentVersion")
    return rows.select("package_id", "version", "ecosystem_id", status.alias("status"), F.col("current_version").alias("cached_version"))


def dependency_report(status: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count("*").alias("total"), n("Filtered").alias("filtered"), n("Cached").alias("cached"), n("CachedDifferentVersion").alias("different"), n("Unresolved").alias("unresolved"))


def patterns(package: Column) -> Column:
    n = F.lower(package)
    return F.array(F.concat(F.lit("https://"), n, F.lit(".readthedocs.io")), F.concat(F.lit("https://docs."), n, F.lit(".com")), F.concat(F.lit("https://"), n, F.lit(".github.io")), F.concat(F.lit("https://"), n, F.lit(".dev")))


def resolve_doc_url(registry: DataFrame, reachable: DataFrame) -> DataFrame:
    """Documentation address and confidence of every package; reachable: (url).

    The guessed addresses are joined as rows, so the table of reachable ones may be of any size.
    """
    hub = lambda c: F.coalesce(c.rlike(r"(?i)github\.com"), F.lit(False))
    project, docs = F.col("project_url"), F.col("documentation_url")
    repo = F.when(hub(F.col("repository_url")), normalize_git_url(F.col("repository_url")))
    guess = registry.select("package_id", "ecosystem_id", F.posexplode(patterns(F.col("package_id"))).alias("pos", "url")).join(reachable.distinct(), "url")
    guess = guess.groupBy("package_id", "ecosystem_id").agg(F.min_by("url", "pos").alias("guess"))
    ok = reachable.select(F.col("url").alias("project_url"), F.lit(True).alias("ok")).distinct()
    r = registry.join(guess, ["package_id", "ecosystem_id"], "left").join(ok, "project_url", "left")
    own = project.isNotNull() & ~hub(project)
    eco = F.col("ecosystem_id")
    github = F.coalesce(F.when(hub(project), project), repo)
    found = (
        F.when((eco != "npm") & docs.isNotNull() & ((eco == "pip") | ~hub(docs)), F.struct(docs.alias("url"), F.lit("High").alias("confidence")))
        .when((eco == "npm") & own, F.struct(project.alias("url"), F.lit("High").alias("confidence")))
        .when((eco == "pip") & own, F.struct(project.alias("url"), F.lit("Medium").alias("confidence")))
        .when((eco == "nuget") & own & F.col("ok"), F.struct(project.alias("url"), F.lit("Medium").alias("confidence")))
        .when(github.isNotNull(), F.struct(github.alias("url"), F.lit("Medium").alias("confidence")))
        .when(F.col("guess").isNotNull(), F.struct(F.col("guess").alias("url"), F.lit("Low").alias("confidence")))
    )
    return r.select("package_id", "ecosystem_id", found["url"].alias("doc_url"), found["confidence"].alias("confidence"))


def registry_metadata(saved: DataFrame) -> DataFrame:
    """Addresses from saved registry replies (ecosystem_id, package_id, body json)."""
    b = F.from_json("body", "homepage string, description string, repository struct<url:string>, info struct<home_page:string,docs_url:string,summary:string,project_urls:map<string,string>>, projectUrl string, projectSourceRepository string")
    urls = b["info"]["project_urls"]
    return saved.select("package_id", "ecosystem_id", F.coalesce(b["homepage"], b["projectUrl"], b["info"]["home_page"], F.try_element_at(urls, F.lit("Homepage"))).alias("project_url"), F.coalesce(normalize_git_url(b["repository"]["url"]), b["projectSourceRepository"], F.try_element_at(urls, F.lit("Source"))).alias("repository_url"), F.coalesce(b["info"]["docs_url"], F.try_element_at(urls, F.lit("Documentation"))).alias("documentation_url"), F.coalesce(b["description"], b["info"]["summary"]).alias("description"))


def jobs_for(urls: DataFrame) -> DataFrame:
    """A scrape job with default limits for every (library_id, version, url)."""
    return urls.select(
        "library_id", "version", F.col("url").alias("root_url"), F.col("library_id").alias("hint"), F.array(U.host(F.col("url"))).alias("allowed"), F.array(*[F.lit(x) for x in fixed.EXCLUDED_URLS]).alias("excluded"), F.lit(0).alias("max_pages"), F.lit(fixed.FETCH_DELAY_MS).alias("fetch_delay_ms"), *[F.lit(v).alias(k) for k, v in fixed.JOB_DEPTHS.items()],
    )


def index_dependencies(files: DataFrame, libraries: DataFrame, registry: DataFrame, reachable: DataFrame) -> DataFrame:
    """Manifests to packages, their state, and for unresolved ones an address to scrape."""
    deps = parse_manifests(files).select("package_id", F.when(F.col("ecosystem_id") == "npm", clean_npm_version(F.col("version"))).otherwise(F.col("version")).alias("version"), "ecosystem_id")
    status = with_status(distinct_packages(deps), libraries)
    found = resolve_doc_url(registry, reachable).select(F.lower("package_id").alias("k"), F.col("ecosystem_id").alias("e"), "doc_url")
    out = status.join(found, (F.lower("package_id") == F.col("k")) & (F.col("ecosystem_id") == F.col("e")), "left").drop("k", "e")
    last = F.when((F.col("status") == "Unresolved") & F.col("doc_url").isNotNull(), "Queued").otherwise(F.col("status"))
    return out.withColumn("status", last)
