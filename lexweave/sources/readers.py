"""Files as tables: repositories, manifests, logs, saved registry replies; JSON out."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import file_category
from ..functions.url import url_allowed

#: Files of an archive that is written, at most.
ARCHIVE_FILES = 256


def scan(table: DataFrame, library: str, version: str) -> DataFrame:
    """Rows of one library version; the filter reaches the files."""
    return table.where((F.col("library_id") == library) & (F.col("version") == version))


def point(table: DataFrame, **key: str) -> DataFrame:
    """The row of a key, or none."""
    for k, v in key.items():
        table = table.where(F.col(k) == v)
    return table.limit(1)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content binary) of all files below a folder that aren't empty; path is relative."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    return f.select(F.regexp_replace("path", rf"^(?:[a-z0-9]+:)?/*\Q{base}\E/", "").alias("path"), "length", "content")


def packed(path: str, text: str) -> str:
    """A text file as a tar archive holds it: header, bytes, zeros up to a whole block."""
    body = text.encode()
    info = tarfile.TarInfo(path)
    info.size = len(body)
    return info.tobuf(tarfile.PAX_FORMAT, "utf-8").decode() + text + "\0" * (-len(body) % tarfile.BLOCKSIZE)


def write_archives(found: DataFrame, root: str, most: int = ARCHIVE_FILES) -> None:
    """Text files (path, value) as tar archives of at most ``most`` files, in any file system that Spark knows.

    The writer ends each row by a separator; here it is the entry of the folder ``./``.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                yield pa.RecordBatch.from_arrays([pa.array(map(packed, part["path"].to_pylist(), part["value"].to_pylist()), pa.string())], ["value"])

    here = tarfile.TarInfo("./")
    here.type = tarfile.DIRTYPE
    rows = found.select("path", F.coalesce("value", F.lit("")).alias("value")).mapInArrow(members, "value string")
    rows.write.option("maxRecordsPerFile", most).option("lineSep", here.tobuf().decode()).text(root)


def archived(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content binary) of the files in the tar archives below a folder, without empty ones as in ``files``; path is that in the archive."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:") as archive:
                    found = [(m.name, m.size, archive.extractfile(m).read()) for m in archive if m.isreg() and m.size]
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "length", "content"), x, strict=True)) for x in found], pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())]))

    return files(spark, root).select("content").mapInArrow(members, "path string, length long, content binary")


def repository(spark: SparkSession, root: str, owner: str, name: str, archives: bool = False) -> DataFrame:
    """Pages of a repository, checked out or in archives: text files up to the size limit, outside skipped folders."""
    f = archived(spark, root) if archives else files(spark, root)
    ext = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    skip = F.exists(F.split("path", "/"), lambda p: F.lower(p).isin([x.lower() for x in fixed.SKIPPED_DIRECTORIES]))
    f = f.where((F.col("length") <= fixed.MAX_FILE_BYTES) & ext.isin(fixed.TEXT_EXTENSIONS) & ~skip)
    text = F.decode("content", "UTF-8")
    return f.select(F.lit(name).alias("library_id"), F.lit("HEAD").alias("version"), F.concat(F.lit(f"https://github.com/{owner}/{name}/blob/HEAD/"), "path").alias("url"), F.col("path").alias("title"), file_category(F.col("path")).alias("category"), text.alias("raw_content"), F.sha2(text, 256).alias("content_hash"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the manifests below a folder."""
    f = files(spark, root)
    skip = F.exists(F.split("path", "/"), lambda p: p.isin(fixed.MANIFEST_SKIPS))
    return f.where(F.lower("path").rlike(r"(\.csproj|\.slnx?|(^|/)package\.json|(^|/)requirements\.txt|(^|/)pyproject\.toml)$") & ~skip).select("path", F.decode("content", "UTF-8").alias("content"))


def log_tail(lines: DataFrame, n: int = 50, needle: str | None = None) -> DataFrame:
    """Last lines by number, of those with the needle in any case; n is held to 1..500."""
    rows = lines if not needle else lines.where(F.contains(F.lower("line"), F.lit(needle.lower())))
    return rows.orderBy(F.desc("number")).limit(max(1, min(500, n)))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line) of a log file; the number rises with the place in the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def web(pages: DataFrame, allowed: list[str], excluded: list[str]) -> DataFrame:
    """Stored pages (url, ...) that a job may fetch: address patterns that it allows and leaves out, no binary files."""
    return pages.where(url_allowed(F.col("url"), allowed, excluded))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, such as a manifest, in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
