from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from funnelry.schema import EVENT_SCHEMA  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "checkpoint"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Builds an event table from short rows: (user, session, second, type) and more by name."""

    def build(*rows, **common):
        full = []
        for row in rows:
            user, session, second, kind, *rest = row
            named = {"product_id": 1, "category_code": "a.b", "brand": "x", "price": 1.0}
            named |= common | (rest[0] if rest else {})
            named |= {"event_ts": second, "event_type": kind, "user_id": user}
            named |= {"user_session": session, "event_time": f"{second:019d} UTC"}
            full.append(tuple(named[c] for c in EVENT_SCHEMA.names))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return build


@pytest.fixture
def rows():
    """Result rows as plain tuples, in order."""
    return lambda df: [tuple(r) for r in df.collect()]
