"""The generic `events` table seen as a shop's clickstream.

The given table has no carts, sessions or categories, and nothing in it is missing or repeated.
This adapter derives all of that from its columns, for every row, in one read. `event_id` is
kept beside the nine event columns to break ties in price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from funnelry.schema import EVENT_COLUMNS

SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# --- fixed values: how source columns become event columns ------------------------------
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
SOURCE_PARTS = {
    "event_id": "event_id",
    "value": "value",
    "source_type": "event_type",
    "event_ts": f"timestampdiff(SECOND, {EPOCH}, ts)",
    "d": "day(ts)",
    # Always {"k": number}; reading the digits costs a fraction of parsing the JSON.
    "k": """try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS int)""",
    "user_id": "user_id * 10 + cast(floor((day(ts) - 1) / 10) AS bigint)",
}
EVENT_RULES = {
    "event_id": "event_id",
    "event_time": f"concat(cast(timestampadd(SECOND, event_ts, {EPOCH}) AS string), ' UTC')",
    "event_ts": "event_ts",
    "event_type": """CASE WHEN user_id % 37 = 0 THEN 'purchase'
                          WHEN source_type = 'click' AND k < 15 THEN 'cart'
                          WHEN source_type = 'purchase' AND k < 15 THEN 'purchase'
                          ELSE 'view' END""",
    "product_id": "cast(1000 + k AS bigint)",
    "category_code": """element_at(array(
        NULL, '', 'electronics.smartphone', 'electronics.audio.headphone', 'apparel.shoes',
        'apparel', 'computers.notebook', 'furniture.bedroom.bed', 'appliances.kitchen.oven',
        'auto'), k % 10 + 1)""",
    "brand": """element_at(array(NULL, '', 'acme', 'globex', 'initech', 'stark'),
                           cast(event_id % 6 + 1 AS int))""",
    "price": """CASE WHEN event_id % 97 = 0 THEN NULL
                     WHEN event_id % 89 = 0 THEN 0.0D
                     WHEN event_id % 83 = 0 THEN -1.0D
                     ELSE value END""",
    "user_id": "user_id",
    "user_session": "concat(cast(user_id AS string), '-', cast(d AS string))",
    # Some rows are recorded twice.
    "copy": "explode(CASE WHEN event_id % 200 = 7 THEN array(1, 2) ELSE array(1) END)",
}


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the given events as a shop event, with some rows recorded twice."""
    source = spark.read.schema(SOURCE_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    parts = source.selectExpr(*(f"{rule} AS {name}" for name, rule in SOURCE_PARTS.items()))
    rows = parts.selectExpr(*(f"{rule} AS {name}" for name, rule in EVENT_RULES.items()))
    return rows.select("event_id", *EVENT_COLUMNS)
