"""Queries next to their SQL counterparts on the smallest data; ``python -m checks.compare`` runs all of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from checks import compare, oracles, registry

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "text_metrics",
    "path_parts",
    "filter_ignored",
    "names_regex",
    "names_lexical",
    "names_regex_scripts",
    "names_lexical_scripts",
    "expand_candidates",
    "import_edges",
    "dead_code",
    "resolve_configured_imports",
    "parsed_commit_files",
    "file_authors",
    "recently_modified",
    "change_frequency",
    "co_change",
    "co_change_bulk",
    "co_change_top",
    "contributor_stats",
    "category_counts",
    "feature_listing",
    "high_risk_files",
    "analyze_edges",
    "analyze_total_files",
    "analysis_overview",
    "risk_report_summary",
    "documents_files",
    "documents_neighbours",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, connection, name):
    assert compare.compare(spark, connection, SF_DIR, name) == ""


def test_every_query_of_the_library_has_sql():
    assert set(registry.build()) == set(oracles.build())


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["repo_id", "path", "risk_score", "lines", "complexity", "incoming", "rank"]
    assert frame.count() > 0
