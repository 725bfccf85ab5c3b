from __future__ import annotations

import pytest

from sourcelore.llm.common import let_workers_import


@pytest.fixture(scope="session", autouse=True)
def workers_can_import(spark):
    let_workers_import(spark)
