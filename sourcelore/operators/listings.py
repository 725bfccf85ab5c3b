"""Ranked and limited lists of the reports.

A "first k per repository" list is a row number with an upper bound, which Spark cuts down
to k rows per partition before it shuffles. Ties and "input order" are by path or name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import complexity_label
from ..session import ensure_checkpoint_dir
from .summary import may_be


def top_per(rows: DataFrame, keys: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key, numbered from 1 in ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def with_remainder(rows: DataFrame, keys: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """``top_per`` plus, in ``remaining``, the number of rows of the key that it left out."""
    counts = rows.groupBy(*keys).agg(F.greatest(F.count("*") - limit, F.lit(0)).cast("bigint").alias("remaining"))
    return top_per(rows, keys, order, limit).join(counts, keys)


def position_in_repo(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Number all rows of each repository in the given order, without gathering a repository in one task.

    The rows are range-sorted over the cluster and written to the checkpoint folder, which
    fixes their partitions. Each partition then needs only the number of rows that its
    repository has in the partitions before it.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = (
        rows.orderBy("repo_id", *order)
        .checkpoint()
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    # One row per repository and partition that holds part of it.
    parts = placed.groupBy("repo_id", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("repo_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    rank = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return (
        placed.join(offsets, ["repo_id", "_part"])
        .withColumn("rank", rank.cast("bigint"))
        .drop("_place", "_part", "_first", "_before")
    )


def threshold_value(option: str | int | float | None) -> int:
    """A threshold option as a number: leading digits count, anything else and 0 become 5."""
    text = str(option if option is not None else "").strip()
    sign = text[:1] if text[:1] in "+-" else ""
    digits = ""
    for character in text[len(sign) :]:
        if not ("0" <= character <= "9"):
            break
        digits += character
    number = int(sign + digits) if digits else 0
    return number or 5


def high_risk_files(scored: DataFrame, threshold: int = 5) -> DataFrame:
    """All files at or above the threshold, the riskiest first, with their rank."""
    risky = scored.filter(F.col("risk_score") >= threshold).select(
        "repo_id", "path", "risk_score", "lines", "complexity", "incoming"
    )
    return position_in_repo(risky, [F.desc("risk_score"), F.asc("path")])


def top_risk_files(scored: DataFrame, threshold: int = 5, limit: int = 20) -> DataFrame:
    """The first files of ``high_risk_files`` and how many more there are."""
    risky = scored.filter(F.col("risk_score") >= threshold).select(
        "repo_id", "path", "risk_score", "lines", "complexity", "incoming"
    )
    return with_remainder(risky, ["repo_id"], [F.desc("risk_score"), "path"], limit)


def top_contributors(contributors: DataFrame, limit: int = 10) -> DataFrame:
    return top_per(contributors, ["repo_id"], [F.desc("total_commits"), "author"], limit)


def key_dependencies(files: DataFrame, limit: int = 10) -> DataFrame:
    imported = files.filter(F.col("incoming") > 0).select("repo_id", "path", "incoming")
    return top_per(imported, ["repo_id"], [F.desc("incoming"), "path"], limit)


def core_files(categorized: DataFrame, limit: int = 10) -> DataFrame:
    core = categorized.filter(may_be("core") & (F.col("category") == "core")).select(
        "repo_id",
        "path",
        "incoming",
        "primary_author",
        F.size("functions").cast("bigint").alias("function_count"),
        F.size("classes").cast("bigint").alias("class_count"),
    )
    return with_remainder(core, ["repo_id"], ["path"], limit)


def entry_points(categorized: DataFrame, limit: int | None = None) -> DataFrame:
    """Entry points with owner and complexity label: all of them, or the first few ranked."""
    listed = categorized.filter(may_be("entryPoints") & (F.col("category") == "entryPoints")).select(
        "repo_id", "path", "language", "lines", "primary_author", complexity_label(F.col("complexity")).alias("complexity_label")
    )
    return listed if limit is None else top_per(listed, ["repo_id"], ["path"], limit)


def feature_listing(feature_files: DataFrame, limit: int = 5) -> DataFrame:
    """First files of every feature and how many more it has."""
    return with_remainder(feature_files, ["repo_id", "name"], ["path"], limit)


def first_features(features: DataFrame, limit: int = 8) -> DataFrame:
    return top_per(features, ["repo_id"], ["name"], limit)


def dead_code_listing(dead: DataFrame, limit: int = 10) -> DataFrame:
    return with_remainder(dead.select("repo_id", "path", "reason"), ["repo_id"], ["path"], limit)
