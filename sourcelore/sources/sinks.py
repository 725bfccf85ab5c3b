"""Writers: one folder per table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import feature_files


def write_tables(tables: Mapping[str, DataFrame], directory: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write every table of a result below ``directory`` as parquet, JSON or any Spark format."""
    for name, table in tables.items():
        table.write.mode(mode).format(format).save(f"{directory}/{name}")


def write_report_sections(report: Mapping[str, DataFrame], directory: str, format: str = "json", mode: str = "overwrite") -> None:
    """Write the sections of a report, each sorted by its repository and rank, as one folder per section."""
    for name, section in report.items():
        order = [c for c in ("repo_id", "rank", "path", "name") if c in section.columns]
        write_tables({name: section.repartitionByRange(*order).sortWithinPartitions(*order)}, directory, format, mode)


def document_tables(analysis: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Files and features in document form.

    A file's few co-changed files are a list in its row. Contributors, neighbours in the import graph and the files of a
    feature may be very many, so they are tables of their own with one row per item, by the key of what they belong to.
    """
    files, listed = analysis["files"], analysis["paths"]
    key = ["repo_id", "path"]
    facts = [c for c in files.columns if c not in (*key, "primary_author", "total_commits")]
    owner = F.struct(F.col("primary_author").alias("primary"), "total_commits")
    analysed = listed.select(*key)
    grouped = feature_files(listed)
    return {
        "files": files.select(*key, *facts, owner.alias("ownership")),
        "contributors": analysis["file_authors"].join(analysed, key, "left_semi").select(*key, "rank", "author", "commits"),
        "neighbours": analysis["call_graph"].select(*key, "direction", "other", "import"),
        "features": grouped.groupBy("repo_id", "name").agg(F.count("*").alias("file_count")),
        "feature_files": grouped.select("repo_id", "name", "path"),
    }
