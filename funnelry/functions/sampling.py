"""Whole-user sampling by hash (SRC-3..6).

Keeping or dropping whole users keeps every kept journey complete. The bucket depends on the
id alone, so the same user is kept in every file, batch and run, and the filter is a plain
expression: no list of users, no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.fixed_values import HASH_SPACE


def user_bucket(user_id: str = "user_id") -> Column:
    """Leading 32 bits of the id's md5, modulo the hash space; the id is hashed as an integer."""
    digits = F.md5(F.col(user_id).cast("bigint").cast("string"))
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint") % F.lit(HASH_SPACE)


def sample_users(df: DataFrame, keep_buckets: int, user_id: str = "user_id") -> DataFrame:
    """All rows of the users in the first `keep_buckets` buckets. A NULL id is never kept."""
    return df.where(F.col(user_id).isNotNull() & (user_bucket(user_id) < keep_buckets))


def keep_buckets_for(rows: Column, target_events: int) -> Column:
    """Buckets that bring `rows` events close to the target; at least one, at most all."""
    share = F.least(F.lit(1.0), F.lit(float(target_events)) / F.greatest(rows, F.lit(1)))
    return _as_buckets(share)


def keep_buckets_of(fraction: float) -> int:
    """Buckets for a fraction chosen by hand; above 1 simply keeps everybody (SRC-6)."""
    return max(1, round(fraction * HASH_SPACE))


def _as_buckets(share: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(share * HASH_SPACE, 0).cast("bigint"))
