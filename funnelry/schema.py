"""The event table: one row per user action, nine scalar columns in a fixed order."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("event_ts", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.names

# What a raw file must provide: every event column but the derived epoch.
RAW_SCHEMA = T.StructType([f for f in EVENT_SCHEMA if f.name != "event_ts"])
RAW_COLUMNS = RAW_SCHEMA.names

# A row without these cannot be placed in any journey.
REQUIRED_COLUMNS = ("event_ts", "user_id", "user_session")

# Rows equal in all of these are the same recorded action.
IDENTITY_COLUMNS = ("user_id", "user_session", "event_ts", "event_type", "product_id")
