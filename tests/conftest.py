from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sourcelore.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def source_files(spark):
    """Build a (repo_id, path, content) table from a dict."""

    def build(files: dict[str, str], repo_id: str = "r"):
        rows = [(repo_id, path, content) for path, content in files.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, content string")

    return build
