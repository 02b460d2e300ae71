from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from callshelf.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def store(spark):
    from callshelf.session import scratch
    from callshelf.sources.store import CatalogStore

    return CatalogStore.create(spark, scratch(spark, "catalog"))


@pytest.fixture()
def sources(spark):
    """``sources({path: content})`` as a table of source files."""

    def build(files: dict[str, str | None]):
        return spark.createDataFrame(list(files.items()), "path string, content string")

    return build
