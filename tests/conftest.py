from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tenderlake.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # where no cluster names a shared folder, tests name their own
    SparkSession.builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
