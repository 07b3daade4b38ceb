import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from reviewloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def games(spark):
    """Make a catalogue frame from (app_id, name, genres, ...) rows."""
    def make(*rows, schema="app_id bigint, name string, genres array<string>"):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture
def reviews(spark):
    """Make a review frame from {(app_id, score): copies}."""
    def make(counts):
        rows = [key for key, copies in counts.items() for _ in range(copies)]
        return spark.createDataFrame(rows, "app_id bigint, score tinyint")

    return make
