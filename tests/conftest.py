from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from checks.compare import session

    spark = session(folder=str(tmp_path_factory.mktemp("checkpoint")))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture()
def workspace(spark):
    from peaklake.workspace import Workspace

    return Workspace(spark, "test")
