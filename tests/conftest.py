from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sumwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Builds a series table from lists of values, one list per name; months from 2023-01 on."""

    def build(**values):
        rows = [
            (name, f"{2023 + i // 12}-{i % 12 + 1:02d}", v) for name, vs in values.items() for i, v in enumerate(vs)
        ]
        return spark.createDataFrame(rows, "id string, period string, value double")

    return build


def by(df, key="id"):
    return {r[key]: r for r in df.collect()}
