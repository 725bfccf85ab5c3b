"""The file-level import graph, a directed multigraph of (src, dst, import) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed import DEAD_CODE_CONFIDENCE, DEAD_CODE_REASON


def call_graph(edges: DataFrame) -> DataFrame:
    """Both directions in long form: ``path`` calls ``other`` or is called by it."""
    both = F.array(
        F.struct(F.col("src").alias("path"), F.lit("calls").alias("direction"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("path"), F.lit("calledBy").alias("direction"), F.col("src").alias("other")),
    )
    return edges.select("repo_id", "import", F.explode(both).alias("e")).select("repo_id", "e.*", "import")


def degrees(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming and outgoing imports of every analysed file, repeats counted."""
    counts = (
        call_graph(edges)
        .groupBy("repo_id", "path")
        .agg(
            F.count_if(F.col("direction") == "calledBy").alias("incoming"),
            F.count_if(F.col("direction") == "calls").alias("outgoing"),
        )
    )
    return (
        facts.select("repo_id", "path")
        .join(counts, ["repo_id", "path"], "left")
        .select(
            "repo_id",
            "path",
            F.coalesce("incoming", F.lit(0)).cast("bigint").alias("incoming"),
            F.coalesce("outgoing", F.lit(0)).cast("bigint").alias("outgoing"),
        )
    )


def dead_code(facts: DataFrame, edges: DataFrame, include_tests: bool = False) -> DataFrame:
    """Files that export something, start nothing and are imported by no file."""
    path = F.col("path")
    suspects = facts.select("repo_id", "path", "exports").filter((F.size("exports") > 0) & ~paths.is_entry_point(path))
    if not include_tests:
        suspects = suspects.filter(~paths.is_test_file(path))
    imported = edges.select("repo_id", F.col("dst").alias("path")).distinct()
    return suspects.join(imported, ["repo_id", "path"], "left_anti").select(
        "repo_id",
        "path",
        F.lit(DEAD_CODE_REASON).alias("reason"),
        "exports",
        F.lit(DEAD_CODE_CONFIDENCE).alias("confidence"),
    )
