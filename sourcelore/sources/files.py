"""Readers for source trees and path lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import strip
from ..operators.files import filter_ignored, with_language

#: Rows that a task of ``read_listed_files`` returns at once have about so many bytes.
BATCH_BYTES = 8 << 20


def load_source_files(
    spark: SparkSession,
    root: str,
    repo_id: str,
    glob: str | None = None,
    ignore: Iterable[str] | None = None,
    languages: dict | None = None,
) -> DataFrame:
    """All files below ``root`` as (repo_id, path, content).

    With ``ignore`` (patterns as for ``filter_ignored``) and ``languages`` (as for ``with_language``) files
    that these drop are not opened: the conditions speak of the file's location only, so Spark applies them to
    its list of files before it plans any read. What is left is dealt to tasks by bytes
    (``spark.sql.files.maxPartitionBytes``). Invalid UTF-8 becomes the replacement character. Spark's file
    listing leaves out names that start with ``_`` or ``.``; ``read_listed_files`` reads those too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # Decode what Spark reports as the file's URL, then cut the root off it.
    location = F.regexp_replace(
        F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z][a-z0-9+.-]*:/+", "/"
    )
    clean_root = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    files = reader.load(root).select(
        F.lit(repo_id).alias("repo_id"),
        F.substring_index(location, clean_root, -1).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
    if ignore is not None:
        files = filter_ignored(files, ignore)
    return files if languages is None else with_language(files, languages).drop("language")


def read_listed_files(paths: DataFrame, root: str) -> DataFrame:
    """Contents of the listed (repo_id, path) below a root that every executor can read.

    Each task reads the files of its own rows and hands them on in batches of about BATCH_BYTES, whatever
    the number of files; files that cannot be read are dropped. Filter the list before, not the contents.
    """
    columns = ["repo_id", "path", "content"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for repo_id, path in zip(batch["repo_id"], batch["path"]):
                try:
                    with open(f"{root}/{path}", "rb") as file:
                        raw = file.read()
                except OSError:
                    continue
                rows.append((repo_id, path, raw.decode("utf-8", errors="replace")))
                held += len(raw)
                if held >= BATCH_BYTES or len(rows) >= len(batch):
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return paths.select("repo_id", "path").mapInPandas(read, "repo_id string, path string, content string")


def load_tracked_paths(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """A text file with one path per line as (repo_id, path); blank lines are skipped."""
    lines = spark.read.option("lineSep", "\n").text(path).filter(strip(F.col("value")) != "")
    return lines.select(F.lit(repo_id).alias("repo_id"), F.col("value").alias("path"))
