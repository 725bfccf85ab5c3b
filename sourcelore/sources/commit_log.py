"""Commit logs from text.

The text is the output of::

    git -c core.quotepath=off log --name-only --date=iso-strict --pretty=format:%H%x09%an%x09%aI%x09%s

A line belongs to the nearest header above it. Ranges of lines are filled independently; only
the last header of each range travels to the lines at the start of the next one, so neither
a long log nor a commit with very many files ends up in one task. Input splits are cut into
ranges too: a compressed log, which Spark reads as one split, is a stream to one reader and
many ranges to all that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import COMMIT_HASH
from ..functions.paths import strip

#: A range has at most 2**RANGE_BITS lines.
RANGE_BITS = 17


def read_log_lines(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """Lines of log files as (repo_id, file, block, seq, value), one log file per repository.

    ``block`` is the byte offset of the input split and ``seq`` ascends within it. Without
    ``repo_id`` the file name up to its first dot names the repository.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # Ascends in reading order within a split, whichever task reads it.
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    name = F.lit(repo_id) if repo_id is not None else F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)
    return lines.withColumn("repo_id", name)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Headers and file lines with the header each belongs to.

    ``lines`` has (repo_id, file, block, seq, value). The result has one row per non-empty
    line below a header: ``header`` (hash, author, date_raw, message, log_pos), ``is_header``
    and ``touched``, the file named by the line.
    """
    parts = F.split("value", "\t")
    is_header = (F.size(parts) >= 4) & F.get(parts, F.lit(0)).rlike(COMMIT_HASH)
    header = F.struct(
        F.get(parts, F.lit(0)).alias("hash"),
        F.get(parts, F.lit(1)).alias("author"),
        F.get(parts, F.lit(2)).alias("date_raw"),
        F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "\t").alias("message"),
    )
    split = ["repo_id", "file", "block", "range"]
    in_range = Window.partitionBy(*split).orderBy("seq")
    upto_before = Window.unboundedPreceding, -1
    length = F.octet_length("value") + 1
    # Bytes read so far in the range, those of empty lines included.
    place = F.coalesce(F.sum(length).over(in_range.rowsBetween(*upto_before)), F.lit(0)).cast("bigint")
    placed = (
        lines.withColumn("range", F.shiftright("seq", RANGE_BITS))
        .withColumn("is_header", is_header)
        .withColumn("place", place)
        .withColumn("header", F.when(F.col("is_header"), header.withField("log_pos", F.col("place"))))
    )

    def from_start(name: str):
        """A header whose position is counted from the beginning of the file."""
        return F.col(name).withField("log_pos", F.col("start") + F.col(f"{name}.log_pos"))

    ranges = placed.groupBy(*split).agg(F.sum(length).alias("bytes"), F.max_by("header", F.when(F.col("is_header"), F.col("seq"))).alias("last"))
    in_block = Window.partitionBy("repo_id", "file", "block").orderBy("range").rowsBetween(*upto_before)
    in_file = Window.partitionBy("repo_id", "file").orderBy("block", "range").rowsBetween(*upto_before)
    started = ranges.withColumn("start", F.col("block") + F.coalesce(F.sum("bytes").over(in_block), F.lit(0)))
    carried = started.select(*split, "start", F.last(from_start("last"), ignorenulls=True).over(in_file).alias("carried"))

    kept = placed.filter(F.col("is_header") | (strip(F.col("value")) != ""))
    filled = kept.withColumn("header", F.last("header", ignorenulls=True).over(in_range))
    whole = filled.join(carried, split).withColumn("header", F.coalesce(from_start("header"), "carried"))
    return whole.filter(F.col("header").isNotNull()).select(
        "repo_id",
        "header",
        "is_header",
        F.replace(strip(F.col("value")), F.lit("\\"), F.lit("/")).alias("touched"),
    )


def _timestamp(header: str = "header"):
    return F.try_to_timestamp(F.col(f"{header}.date_raw")).alias("ts")


def commits(parsed: DataFrame) -> DataFrame:
    """One row per commit, those without files included."""
    return parsed.filter("is_header").select(
        "repo_id",
        "header.hash",
        "header.author",
        _timestamp(),
        "header.date_raw",
        "header.message",
        "header.log_pos",
    )


def commit_files(parsed: DataFrame) -> DataFrame:
    """One row per commit and file line."""
    return parsed.filter(~F.col("is_header")).select(
        "repo_id", "header.hash", "header.author", _timestamp(), "header.log_pos", F.col("touched").alias("file")
    )


def load_commit_log(spark: SparkSession, path: str, repo_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``commits`` and ``commit_files`` of a log file, or of a folder with one log per repository."""
    parsed = parse_log_lines(read_log_lines(spark, path, repo_id))
    return commits(parsed), commit_files(parsed)
