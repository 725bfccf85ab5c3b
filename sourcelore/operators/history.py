"""Aggregations over the commit log.

``commit_files`` holds one row per commit and touched file and may repeat a pair; history,
ownership and frequency count repeats, commit contents and co-change do not. ``log_pos``
ascends from the newest commit to the oldest.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalize_repo_path


def distinct_touches(commit_files: DataFrame) -> DataFrame:
    """Each file once per commit."""
    return commit_files.dropDuplicates(["repo_id", "hash", "file"])


def file_history(commit_files: DataFrame, paths: DataFrame | str, root: str = "/") -> DataFrame:
    """Commits that touched one path newest first, or those of every path in a table.

    A single path may be relative or, given the repository's ``root``, absolute; one that leads out of it has no commits.
    """
    columns = ["repo_id", "path", "log_pos", "hash", "author", "ts"]
    touches = commit_files.withColumnRenamed("file", "path").select(*columns)
    if isinstance(paths, str):
        asked = normalize_repo_path(F.lit(paths), root)
        return touches.filter(F.col("path") == asked).orderBy("repo_id", "log_pos")
    return touches.join(paths.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def commit_file_list(commit_files: DataFrame, commit: str | None = None) -> DataFrame:
    """Distinct files of one commit, or of every commit."""
    touches = commit_files if commit is None else commit_files.filter(F.col("hash") == commit)
    return distinct_touches(touches).select("repo_id", "hash", "file")


def author_states(commit_files: DataFrame) -> DataFrame:
    """Per file and author what ownership and frequency are made from, in one pass over the log.

    Commits, and the first and last log row with its time. States of authors add up to that of their file.
    """
    row = F.struct("log_pos", "ts")
    return commit_files.groupBy("repo_id", F.col("file").alias("path"), "author").agg(
        F.count("*").alias("commits"), F.min(row).alias("newest"), F.max(row).alias("oldest")
    )


def ranked_authors(states: DataFrame) -> DataFrame:
    """Commits per author of each file, ranked; ties go to the more recent author."""
    order = Window.partitionBy("repo_id", "path").orderBy(F.desc("commits"), "newest.log_pos", "author")
    return states.select(
        "repo_id", "path", "author", "commits", F.row_number().over(order).cast("bigint").alias("rank")
    )


def file_states(states: DataFrame) -> DataFrame:
    """Ownership and change frequency of each file, in one aggregate over its authors."""
    files = states.groupBy("repo_id", "path").agg(
        F.min_by("author", F.struct(-F.col("commits"), "newest.log_pos", "author")).alias("primary_author"),
        F.sum("commits").alias("total_commits"),
        F.count("*").alias("contributor_count"),
        F.min("newest").alias("newest"),
        F.max("oldest").alias("oldest"),
    )
    return files.select(
        "repo_id", "path", "primary_author", "total_commits", "contributor_count", _frequency("total_commits").alias("change_frequency")
    )


def _frequency(commits: str) -> Column:
    span = (F.col("newest.ts") - F.col("oldest.ts")).cast("interval second").cast("decimal(18,6)").cast("double")
    return F.when((F.col(commits) >= 2) & (span > 0), F.col(commits) / (span / 86400.0)).otherwise(0.0)


def file_authors(commit_files: DataFrame) -> DataFrame:
    """Commits per author of each file, ranked; ties go to the more recent author.

    Rows shrink to one per file and author before the window, so a file that holds a
    large part of the log still ranks only its distinct authors.
    """
    return ranked_authors(author_states(commit_files))


def ownership(authors: DataFrame) -> DataFrame:
    """Per file: primary author, number of commits and number of contributors."""
    return authors.groupBy("repo_id", "path").agg(
        F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("primary_author"),
        F.sum("commits").alias("total_commits"),
        F.count("*").alias("contributor_count"),
    )


def ownership_of(paths: DataFrame, authors: DataFrame) -> DataFrame:
    """Ownership of the given paths; a path without history is owned by ``Unknown``."""
    return (
        paths.select("repo_id", "path")
        .join(ownership(authors), ["repo_id", "path"], "left")
        .select(
            "repo_id",
            "path",
            F.coalesce("primary_author", F.lit("Unknown")).alias("primary_author"),
            F.coalesce("total_commits", F.lit(0)).cast("bigint").alias("total_commits"),
            F.coalesce("contributor_count", F.lit(0)).cast("bigint").alias("contributor_count"),
        )
    )


def recently_modified(
    commit_files: DataFrame, commits: DataFrame, days: float = 90, now: datetime | str | Column | None = None
) -> DataFrame:
    """Files of commits dated ``days`` before ``now`` or later; undated commits are kept."""
    moment = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    since = moment.cast("timestamp") - F.make_dt_interval(secs=F.lit(days * 86400).cast("decimal(18,6)"))
    recent = commits.filter(F.col("ts").isNull() | (F.col("ts") >= since))
    return (
        distinct_touches(commit_files)
        .select("repo_id", "hash", "file")
        .join(recent.select("repo_id", "hash", "author", "ts", "message"), ["repo_id", "hash"])
        .select("repo_id", "file", "hash", "author", "ts", "message")
    )


def change_frequency(commit_files: DataFrame) -> DataFrame:
    """Commits per day between the first and the last log row of each file.

    Ends are taken in log order, not by date. Fewer than two commits, an unknown date or
    no positive span give 0.
    """
    row = F.struct("log_pos", "ts")
    ends = commit_files.groupBy("repo_id", F.col("file").alias("path")).agg(
        F.count("*").alias("commits"), F.min(row).alias("newest"), F.max(row).alias("oldest")
    )
    return ends.select("repo_id", "path", "commits", _frequency("commits").alias("change_frequency"))
