"""Column types of the engine's tables and the closed domains of its text columns."""

from pyspark.sql import types as T

from .functions.fixed import CATEGORIES, KIND_RANK

TABLES = {
    "libraries": "id string, name string, hint string, current_version string, all_versions array<string>",
    "library_versions": "id string, library_id string, version string, scraped_at timestamp, page_count long, chunk_count long, embedding_provider_id string, embedding_model_name string, embedding_dimensions int, previous_version string, boundary_issue_pct double, suspect boolean, suspect_reasons array<string>, last_suspect_evaluated_at timestamp",
    "pages": "library_id string, version string, url string, title string, category string, raw_content string, content_hash string",
    "chunks": "id string, library_id string, version string, page_url string, page_title string, category string, content string, embedding array<float>, section_path string, qualified_name string, code_language string, symbols array<struct<name:string,kind:string,container:string>>, parser_version int",
    "postings": "library_id string, version string, shard_index int, term string, chunk_id string, term_frequency long",
    "doc_lengths": "library_id string, version string, chunk_id string, doc_length long",
    "profiles": "library_id string, version string, languages array<string>, likely_symbols array<string>, stoplist array<string>, separators array<string>, callable_shapes array<string>, types string, methods string, confidence double, created_utc timestamp",
    "excluded_symbols": "library_id string, version string, name string, reason string, sample_sentences array<string>, chunk_count long",
    "jobs": "id string, library_id string, version string, status string, created_at timestamp, last_progress_at timestamp, error_count long",
    "dependencies": "package_id string, version string, ecosystem_id string",
    "registry": "package_id string, ecosystem_id string, project_url string, repository_url string, documentation_url string, description string",
}
CATEGORY, SYMBOL_KIND = tuple(CATEGORIES), ("Unknown", *KIND_RANK)
REJECTION = ("GlobalStoplist", "LibraryStoplist", "Unit", "BelowMinLength", "LikelyAbbreviation", "NoStructureSignal")
JOB_STATUS = ("Queued", "Running", "Completed", "Failed", "Cancelled")
INGEST_STATUS = ("ReconNeeded", "ReadyToScrape", "Partial", "Stale", "VersionDrift", "Ready", "UrlSuspect", "InProgress")


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
