"""Scalar text functions: every one takes and returns columns, inside code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def url_key(url: Column) -> Column:
    """The first 12 digits of the address's hash."""
    return F.substring(F.sha2(url, 256), 1, 12)


def prose_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(fixed.PROSE), F.lit(0)), F.lower)


def identifier_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(fixed.IDENTIFIER), F.lit(0)), lambda t: F.length(t) >= 2)


def terms(c: Column) -> Column:
    """Index terms of a text with repeats: prose tokens, then identifiers."""
    return F.concat(prose_tokens(c), identifier_tokens(c))


def query_terms(c: Column) -> Column:
    return F.array_distinct(terms(c))


def query_shape(c: Column) -> Column:
    """Does the query look like an identifier?"""
    out = F.lit(False)
    for p in fixed.SHAPES:
        out = out | c.rlike("(?U)" + p)
    return out


def fnv_shard(term: Column, shards: int = fixed.SHARDS) -> Column:
    """Shard of a term: a 32-bit multiply-and-xor hash over its characters, modulo."""
    h = F.aggregate(F.split(term, ""), F.lit(2166136261).cast("long"), lambda h, ch: (h * 16777619).bitwiseAND(4294967295).bitwiseXOR(F.ascii(ch).cast("long")))
    return (F.when(F.length(term) > 0, h).otherwise(F.lit(2166136261)) % shards).cast("int")


def is_unit(c: Column) -> Column:
    return c.isin(fixed.UNITS) | ((F.length(c) <= 4) & F.lower(c).isin(fixed.UNITS_ANY_CASE))


def stoplist_match(c: Column, library: Column | None = None, stoplist: Iterable[str] = fixed.STOPLIST) -> Column:
    """Global, Library or None; library: array of lower-cased words."""
    hit = F.lower(c).isin(sorted(stoplist))
    own = F.lit(False) if library is None else F.coalesce(F.array_contains(library, F.lower(c)), F.lit(False))
    return F.when(hit, "Global").when(own, "Library").otherwise("None")


def mid_word_capital(c: Column) -> Column:
    return c.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]{2}")


def internal_structure(c: Column) -> Column:
    return c.rlike(r"[_.]|::|->|[a-z][A-Z]|[A-Z]{2}[a-z]{2}")


def likely_abbreviation(c: Column) -> Column:
    return c.rlike("^[A-Z0-9]{1,4}$")


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", " "), r"(?is)<pre[^>]*>.*?</pre>", " ")


def embed_text(category: Column, library: Column, title: Column, content: Column) -> Column:
    return F.substring(F.concat(F.lit("["), category, F.lit("] ["), library, F.lit("] ["), title, F.lit("]\n"), content), 1, fixed.EMBED_CHARS)


def parse_score(c: Column) -> Column:
    """First number of a reply, held to [0, 1]; none: 0."""
    found = F.regexp_extract(c, r"(\d*\.\d+|\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.least(F.greatest(found.try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def score_word(c: Column) -> Column:
    out = None
    for word, value in fixed.SCORE_WORDS.items():
        hit = F.upper(F.trim(c)) == word
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def retry_delay_ms(attempt: Column) -> Column:
    return F.least(F.lit(1000) * F.pow(F.lit(2), attempt), F.lit(5000)).cast("int")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Positive seconds, else seconds until an HTTP date that is still to come, else null."""
    seconds = value.try_cast("int")
    date = F.try_to_timestamp(F.regexp_extract(value, r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.unix_seconds(date) - F.unix_seconds(now)
    return F.when(seconds > 0, seconds.cast("long")).when(seconds.isNull() & (wait > 0), wait)


def clean_npm_version(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\^~>=<]+", "")


def normalize_git_url(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"^git\+https://", "https://"), "^git://", "https://")
    return F.regexp_replace(c, r"\.git$", "")


def boundary_hint(pct: Column) -> Column:
    return F.when(pct >= 10, "rechunk recommended").when(pct >= 5, "rechunk may help")


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / fixed.CHARS_PER_TOKEN).cast("int")


def chunk_order(id_: Column) -> tuple[Column, Column]:
    """Main and sub number at the end of a chunk id; 0 where there is none."""
    tail = F.substring_index(id_, "/", -1)
    part = lambda n: F.coalesce(F.split_part(tail, F.lit("-"), F.lit(n)).try_cast("int"), F.lit(0))
    return part(1), part(2)


def kind_label(kind: Column) -> Column:
    return F.when(kind == "Type", "class").otherwise(F.lower(kind))


def file_category(path: Column) -> Column:
    """Category of a repository's file by its path."""
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    sample = p.rlike("/(samples?|examples?|demos?)/")
    return (
        F.when(name.rlike(r"^(changelog|changes|history|releases)") | name.isin("release-notes.md", "release_notes.md"), "ChangeLog")
        .when(name.startswith("readme"), "Overview")
        .when(sample, "Sample")
        .when(p.rlike(r"^docs?/|/docs?/"), "HowTo")
        .when(name.rlike(r"\.(md|markdown|rst|adoc)$"), "Overview")
        .otherwise("Code")
    )


def rejection_reason(name: Column, leaf: Column, container: Column, declared: Column, callable_: Column, generic: Column, likely: Column, fenced: Column, mentions_name: Column, mentions_leaf: Column, library_stops: Column | None = None, threshold: int = 3) -> Column:
    """Why a token is no symbol, or null if it is one.

    likely, fenced: is the name or leaf known so; mentions: how often prose mentions each.
    """
    stop_n, stop_l = stoplist_match(name, library_stops), stoplist_match(leaf, library_stops)
    often_n, often_l = F.coalesce(mentions_name, F.lit(0)) >= threshold, F.coalesce(mentions_leaf, F.lit(0)) >= threshold
    short_n, short_l = likely_abbreviation(name), likely_abbreviation(leaf)
    frequent = (often_n & ~short_n) | (often_l & ~short_l)
    blocked = (often_n & short_n) | (often_l & short_l)
    admissible = declared | likely | fenced | (F.coalesce(container, F.lit("")) != "") | internal_structure(name) | callable_ | generic | frequent
    return (
        F.when((stop_n == "Global") | (stop_l == "Global"), "GlobalStoplist")
        .when((stop_n == "Library") | (stop_l == "Library"), "LibraryStoplist")
        .when(is_unit(name) | is_unit(leaf), "Unit")
        .when(F.length(name) < 2, "BelowMinLength")
        .when(~admissible & blocked, "LikelyAbbreviation")
        .when(~admissible, "NoStructureSignal")
    )


def symbol_kind(keyword: Column, callable_: Column, generic: Column, container: Column, likely: Column, leaf: Column, types_casing: Column, methods_casing: Column) -> Column:
    """Kind of a kept token: by declaring word, shape, then casing."""
    out = None
    for word, kind in fixed.DECLARED.items():
        hit = F.lower(keyword) == word
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    pascal = leaf.rlike("^[A-Z]") & mid_word_capital(leaf) & ~leaf.contains("_")
    snake = leaf.contains("_") & leaf.rlike("^[a-z0-9_]+$")
    return (
        out.when(callable_, "Function")
        .when(generic, "Type")
        .when(F.coalesce(container, F.lit("")) != "", "Property")
        .when(likely, "Type")
        .when(pascal & (F.lower(types_casing) == "pascalcase"), "Type")
        .when(snake & (F.lower(methods_casing) == "snake_case"), "Function")
        .otherwise("Unknown")
    )


def primary_name(symbols: Column) -> Column:
    """Name of the first symbol by kind, then place; symbols: array of (name, kind, ...)."""
    rank = lambda kind: F.coalesce(F.element_at(F.create_map(*[x for k, v in fixed.KIND_RANK.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(6))
    ranked = F.transform(symbols, lambda s, i: F.struct(rank(s["kind"]).alias("rank"), i.alias("i"), s["name"].alias("name")))
    return F.array_min(ranked)["name"]


def parse_classification(c: Column) -> Column:
    """(category, confidence) of a model's reply: JSON, fenced or not, else the first category it names."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^```\w*\s*$", ""))
    read = F.from_json(bare, "category string, confidence double", {"mode": "PERMISSIVE"})
    known = None
    named = None
    for cat in fixed.CATEGORIES:
        hit = F.lower(read["category"]) == cat.lower()
        known = F.when(hit, cat) if known is None else known.when(hit, cat)
        inside = F.lower(c).contains(cat.lower())
        named = F.when(inside, cat) if named is None else named.when(inside, cat)
    return F.struct(
        F.when(read["category"].isNotNull(), F.coalesce(known, F.lit("Unclassified"))).otherwise(F.coalesce(named, F.lit("Unclassified"))).alias("category"),
        F.when(read["category"].isNotNull(), F.coalesce(read["confidence"], F.lit(0.0))).when(named.isNotNull(), 0.5).otherwise(0.0).alias("confidence"),
    )


def parse_profile(c: Column) -> Column:
    """Typed profile of a JSON text; confidence 0.85 by default, held to [0, 1]."""
    p = F.from_json(c, "languages array<string>, likelySymbols array<string>, stoplist array<string>, separators array<string>, callableShapes array<string>, casing struct<types:string,methods:string>, confidence double, source string")
    none = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(p[k], none).alias(a) for k, a in (("languages", "languages"), ("likelySymbols", "likely_symbols"), ("stoplist", "stoplist"), ("separators", "separators"), ("callableShapes", "callable_shapes"))], F.coalesce(p["casing"]["types"], F.lit("")).alias("types"), F.coalesce(p["casing"]["methods"], F.lit("")).alias("methods"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p["confidence"], F.lit(0.85)))).alias("confidence"))


def profile_hash(languages: Column, likely: Column, separators: Column, callable_shapes: Column, types: Column, methods: Column) -> Column:
    """Order-free hash of what a profile says; its stoplist, confidence and source don't count."""
    j = lambda a: F.array_join(F.array_sort(a), "\x1f")
    return F.upper(F.sha2(F.concat_ws("\x1e", j(languages), j(likely), j(separators), j(callable_shapes), types, methods), 256))


def frame_score(length: Column, links: Column, name: Column, url: Column) -> Column:
    """How likely a frame holds the content: text, share outside links, hints in name or address."""
    hint = (F.lower(name).rlike("|".join(fixed.FRAME_HINTS))) | (F.lower(url).rlike("|".join(fixed.FRAME_HINTS)))
    ratio = F.when(length > 0, (length - links) / length).otherwise(0.0)
    return F.least(length / 1000, F.lit(5.0)) + ratio * 5 + F.when(hint, 3.0).otherwise(0.0)
