"""Timestamps as text and as epoch seconds (SRC-7, SRC-8, SRC-13).

Both directions spell out the zone, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelry.fixed_values import TIME_PATTERN, UTC_SUFFIX


def epoch_seconds(event_time: Column) -> Column:
    """Epoch seconds of 'yyyy-MM-dd HH:mm:ss[ UTC]'; anything else is NULL."""
    plain = F.replace(event_time, F.lit(UTC_SUFFIX), F.lit(""))
    stamp = F.try_to_timestamp(F.concat(plain, F.lit("+00:00")), F.lit(TIME_PATTERN + "XXX"))
    return F.unix_seconds(stamp)


def display_time(event_ts: Column) -> Column:
    """Epoch seconds back to 'yyyy-MM-dd HH:mm:ss UTC'."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stamp = F.timestamp_add("SECOND", event_ts, start)
    # A zone-free timestamp prints as TIME_PATTERN; date_format would shift it to the session zone.
    return F.concat(stamp.cast("string"), F.lit(UTC_SUFFIX))
