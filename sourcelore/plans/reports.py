"""The data behind each report: one table per section."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import listings, summary


def analysis_summary(analysis: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Sections of the plain analysis report."""
    return {
        "overview": summary.overview(analysis["paths"], analysis["dead_code"], analysis["repositories"]),
        "languages": analysis["languages"],
        "top_contributors": listings.top_contributors(analysis["contributors"], 5),
        "dead_code": listings.dead_code_listing(analysis["dead_code"]),
    }


def architecture_map(analysis: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Categories, features, graph and the most imported files."""
    categorized = summary.categorize(analysis["measures"])
    grouped = summary.feature_files(analysis["paths"])
    return {
        "overview": summary.overview(analysis["paths"], analysis["dead_code"], analysis["repositories"]),
        "categories": summary.categorize(analysis["files"]),
        "category_counts": summary.category_counts(categorized),
        "entry_points": listings.entry_points(categorized),
        "core_files": listings.core_files(categorized, 10),
        "features": summary.features(analysis["paths"]),
        "feature_files": listings.feature_listing(grouped),
        "key_dependencies": listings.key_dependencies(analysis["measures"]),
        "call_graph": analysis["call_graph"],
    }


def onboarding(analysis: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What a newcomer looks at first."""
    categorized = summary.categorize(analysis["measures"])
    tests = categorized.filter(F.col("category") == "tests")
    return {
        "overview": summary.overview(analysis["paths"], analysis["dead_code"], analysis["repositories"]),
        "languages": summary.language_percentages(analysis["languages"]),
        "entry_points": listings.entry_points(categorized, 5),
        "core_files": listings.core_files(categorized, 5),
        "features": listings.first_features(summary.features(analysis["paths"])),
        "top_contributors": listings.top_contributors(analysis["contributors"], 5),
        "test_files": tests.groupBy("repo_id").agg(F.count("*").alias("test_files")),
        "test_directories": summary.test_directories(categorized),
        "config_files": summary.config_files(categorized),
    }


def risk_report(analysis: Mapping[str, DataFrame], threshold: str | int | None = None) -> dict[str, DataFrame]:
    """Risky files by rank, their summary and the critical ones."""
    value = listings.threshold_value(threshold)
    scored = summary.with_risk(analysis["measures"])
    ranked = listings.high_risk_files(scored, value)
    return {
        "high_risk_files": ranked,
        "top_risk_files": listings.top_risk_files(scored, value),
        "summary": summary.risk_summary(scored, value, analysis["repositories"]),
        "critical_files": ranked.filter(F.col("risk_score") >= 10).select("repo_id", "path", "risk_score", "rank"),
    }
