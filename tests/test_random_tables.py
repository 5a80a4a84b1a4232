"""Every query against SQL on tables with missing, odd and very frequent values."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_oracles import ordered

from funnelry.functions.times import display_time
from funnelry.schema import EVENT_COLUMNS, EVENT_SCHEMA
from funnelry.verification.oracles import all_oracles, over_table
from funnelry.verification.queries import over_events

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), *EVENT_SCHEMA])
ROWS = 6000
START = 1_700_000_000


def table(seed):
    draw = random.Random(seed)
    pick = draw.choices
    for i in range(ROWS):
        hot = draw.random() < 0.33
        user = 7 if hot else draw.randrange(1, 700)
        second = START if hot and draw.random() < 0.5 else START + draw.randrange(6) * 86_400 + draw.randrange(3000)
        kind = pick(["view", "cart", "purchase", "wishlist", None], [70, 15, 8, 4, 3])[0]
        code = pick(["a.b", "c", "", None, ".x", "d.e.f"], [40, 20, 10, 10, 5, 15])[0]
        brand = pick(["x", "y", "", None], [4, 3, 2, 1])[0]
        price = pick([9.99, round(draw.lognormvariate(2, 1), 2), 0.0, -3.5, None], [30, 60, 3, 3, 4])[0]
        session = f"{user}-{draw.randrange(3)}" if draw.random() < 0.97 else "shared"
        yield (i, second, kind, draw.randrange(12) or None, code, brand, price, user, session)


@pytest.fixture(scope="module", params=[1, 2])
def shop(request, spark):
    rows = list(table(request.param))
    rows += draw_copies(rows)
    names = ["event_id", *(c for c in EVENT_COLUMNS if c != "event_time")]
    short = T.StructType([SCHEMA[n] for n in names])
    df = spark.createDataFrame(rows, short).withColumn("event_time", display_time(F.col("event_ts")))
    return df.select("event_id", *EVENT_COLUMNS).cache()


def draw_copies(rows):
    """One row many times over, and some rows twice."""
    return [rows[5]] * 400 + rows[100:200]


@pytest.fixture(scope="module")
def duck(shop):
    found = duckdb.connect()
    rows = [tuple(r) for r in shop.collect()]
    found.execute(
        "CREATE TABLE t (event_id BIGINT, event_time VARCHAR, event_ts BIGINT, event_type VARCHAR,"
        " product_id BIGINT, category_code VARCHAR, brand VARCHAR, price DOUBLE, user_id BIGINT,"
        " user_session VARCHAR)"
    )
    frame = pd.DataFrame(rows, columns=shop.columns, dtype=object)  # noqa: F841
    found.execute("INSERT INTO t SELECT * FROM frame")
    return found


@pytest.mark.parametrize("name", over_events())
def test_same_rows(shop, duck, name):
    df = over_events()[name](shop)
    columns = sorted(df.columns)
    expected = duck.execute(over_table(all_oracles()[name], "t"))
    place = [[c[0] for c in expected.description].index(c) for c in columns]
    theirs = ordered(tuple(row[i] for i in place) for row in expected.fetchall())
    assert ordered(tuple(row[c] for c in columns) for row in df.collect()) == theirs
