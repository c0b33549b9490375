import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablework.session import build_session  # noqa: E402

DATA = Path(os.environ.get("TABLEWORK_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tablework-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.sql.legacy.javaCharsets": "true",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf():
    return str(DATA)


@pytest.fixture
def split_groups(spark):
    """Force the split form of the group helpers, with everything counted as hot."""
    conf = {
        "spark.tablework.splitBytes": "0",
        "spark.tablework.broadcastBytes": "0",
        "spark.tablework.hotMinRows": "1",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
