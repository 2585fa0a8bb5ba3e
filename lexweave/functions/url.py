"""Functions of addresses, as columns. A host is lower-cased; an invalid address is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    p = F.try_parse_url(url, F.lit("PATH"))
    return F.when(p == "", "/").otherwise(p)


def normalize_url(url: Column, keep_extension: bool = False) -> Column:
    """scheme://host/path?query without fragment, port, last slash and page extension."""
    p = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    if not keep_extension:
        p = F.regexp_replace(p, r"(?i)\.(html|htm|aspx)$", "")
    q = F.try_parse_url(url, F.lit("QUERY"))
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), host(url), p, F.when(q.isNotNull(), F.concat(F.lit("?"), q)).otherwise(""))


def first_segment(url: Column) -> Column:
    seg = F.regexp_extract(path(url), "^/[^/]+", 0)
    return F.when(seg == "", "/").otherwise(F.concat(seg, F.lit("/")))


def is_binary(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(" + "|".join(fixed.BINARY_EXTENSIONS) + r")(\?|$)")


def url_allowed(url: Column, allowed: list[str], excluded: list[str]) -> Column:
    """No binary, some allowed pattern and no excluded one, in any case; no allowed patterns: all."""
    ok = ~is_binary(url)
    if allowed:
        ok = ok & url.rlike("(?i)" + "|".join(f"(?:{p})" for p in allowed))
    if excluded:
        ok = ok & ~url.rlike("(?i)" + "|".join(f"(?:{p})" for p in excluded))
    return ok


def in_scope(url: Column, root: Column) -> Column:
    """Same host, and below the directory of the root's path."""
    folder = F.regexp_replace(path(root), "[^/]*$", "")
    return F.coalesce((host(url) == host(root)) & F.lower(path(url)).startswith(F.lower(folder)), F.lit(False))


def same_host(url: Column, root: Column) -> Column:
    return F.coalesce(host(url) == host(root), F.lit(False))


def depth_reached(scope: Column, in_depth: Column, same_depth: Column, off_depth: Column, limits: dict[str, int] = fixed.JOB_DEPTHS) -> Column:
    """Is an entry too deep for its kind of address (in, same, off)?"""
    top = limits["in_scope_depth"]
    inside = (F.lit(top > 0)) & (in_depth >= top)
    return F.when(scope == "in", inside).when(scope == "same", same_depth >= limits["same_host_depth"]).otherwise(off_depth >= limits["off_site_depth"])


def github_repo(url: Column) -> Column:
    """(owner, name) of a repository's address, or null."""
    pattern = r"(?i)^https?://(?:www\.)?github\.com/([^/]+)/([^/#?]+)"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.replace(F.regexp_extract(url, pattern, 2), F.lit(".git"), F.lit("")).alias("name")))
