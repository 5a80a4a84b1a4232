"""The named reports, each a function from the event table to a small result (Q-1..Q-14).

Results are lazy DataFrames except that `funnel_by_price_quartile` looks up its three price
borders when called. Orders that a limit cuts carry a tiebreak on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelry import fixed_values as fv
from funnelry.functions.events import has_price, top_category
from funnelry.functions.numbers import percent, round_to
from funnelry.operators import quality, timing
from funnelry.operators.abandonment import abandonment, abandonment_by
from funnelry.operators.funnel import funnel, funnel_by, stage_bit, stage_flags, step_counts
from funnelry.operators.gaps import event_gaps
from funnelry.operators.histogram import histogram, session_sizes, session_spans
from funnelry.operators.ntile import Border, tile_borders, with_tiles
from funnelry.operators.products import product_carts

# Where a missing key sorts.
LOWEST = -(2**63)


def funnel_user(events: DataFrame) -> DataFrame:
    """Q-1: the funnel over users."""
    return funnel(events, "user_id")


def funnel_session(events: DataFrame) -> DataFrame:
    """Q-2: the funnel over sessions; the whole journey must fit in one."""
    return funnel(events, "user_session")


def funnel_by_category(
    events: DataFrame, min_viewers: int = fv.MIN_VIEWERS, limit: int = fv.TOP_CATEGORIES
) -> DataFrame:
    """Q-3: the user funnel in the most viewed top-level categories (FLT-6, ORD-2)."""
    tagged = events.select(top_category().alias("top_category"), "user_id", "event_type")
    return (
        funnel_by(tagged, "top_category")
        .where(F.col("step_view") >= min_viewers)
        .orderBy(F.desc("step_view"), "top_category")
        .limit(limit)
    )


def funnel_by_price_quartile(
    events: DataFrame, tiebreak: Sequence[str] = (), tiles: int = fv.QUARTILES
) -> DataFrame:
    """Q-4: the user funnel in four equal shares of priced events, cheapest first (ORD-4)."""
    found = price_quartiles(events, tiebreak, tiles)
    return found.orderBy("price_quartile").limit(tiles)  # all there are


def _by_price(events: DataFrame, tiebreak: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Priced events and the columns of their order.

    Equal prices on a border are dealt out by the whole-number `tiebreak` columns, then by user
    and stage. Rows that agree in all of these cannot be told apart by the funnel.
    """
    ties = [F.coalesce(F.col(c), F.lit(LOWEST)) for c in (*tiebreak, "user_id")]
    keys = [k.alias(f"_key{i}") for i, k in enumerate([*ties, F.coalesce(stage_bit(), F.lit(0))])]
    order_by = ["price", *(f"_key{i}" for i in range(len(keys)))]
    return events.where(has_price()).select("price", "user_id", "event_type", *keys), order_by


def price_borders(
    events: DataFrame, tiebreak: Sequence[str] = (), tiles: int = fv.QUARTILES
) -> list[Border]:
    """The borders of the price quartiles; found once, they serve every price statistic."""
    return tile_borders(*_by_price(events, tiebreak), tiles)


def price_quartiles(
    events: DataFrame,
    tiebreak: Sequence[str] = (),
    tiles: int = fv.QUARTILES,
    borders: Sequence[Border] | None = None,
) -> DataFrame:
    """Q-4 in no particular order; `borders` are those of `price_borders`, if known."""
    priced, order_by = _by_price(events, tiebreak)
    return (
        stage_flags(
            with_tiles(priced, order_by, tiles, "price_quartile", borders),
            ["price_quartile", "user_id"],
            F.min("price").alias("low"),
            F.max("price").alias("high"),
        )
        .groupBy("price_quartile")
        .agg(F.min("low").alias("price_min"), F.max("high").alias("price_max"), *step_counts())
    )


def events_per_session(events: DataFrame) -> DataFrame:
    """Q-5: how many events a session has."""
    return session_size_histogram(session_sizes(events))


def session_size_histogram(sizes: DataFrame) -> DataFrame:
    return histogram(sizes, "n_events", fv.EVENTS_PER_SESSION, "events_bucket", "sessions")


def session_duration(events: DataFrame) -> DataFrame:
    """Q-6: seconds from a session's first to its last event."""
    return session_span_histogram(session_spans(events))


def session_span_histogram(spans: DataFrame) -> DataFrame:
    return histogram(spans, "duration_sec", fv.SESSION_DURATION, "duration_bucket", "sessions")


def lag_event_gaps(events: DataFrame) -> DataFrame:
    """Q-7: seconds between consecutive events of a user."""
    gaps = event_gaps(events)
    return histogram(gaps, "gap_sec", fv.EVENT_GAP, "gap_bucket", "gap_count", F.col("gaps"))


def time_to_convert(events: DataFrame) -> DataFrame:
    """Q-8: converting users by kind of conversion, with the mean delay in hours."""
    return conversion_kinds(timing.session_converters(events))


def conversion_kinds(users: DataFrame) -> DataFrame:
    return (
        users.groupBy(timing.conversion_kind().alias("convert_bucket"))
        .agg(F.count(F.lit(1)).alias("users"), F.avg("delay").alias("mean"))
        .select(
            "convert_bucket",
            "users",
            round_to(F.col("mean") / 3600.0, 2).alias("avg_hours_to_convert"),
        )
        .orderBy(F.desc("users"), "convert_bucket")
        .limit(1 + len(fv.CONVERSION_KIND))  # all there are
    )


def time_to_convert_distribution(events: DataFrame) -> DataFrame:
    """Q-9: the delays of converting users."""
    return delay_histogram(timing.converters(events))


def delay_histogram(users: DataFrame) -> DataFrame:
    return histogram(users, "delay", fv.CONVERSION_DELAY, "delay_bucket", "users")


def abandonment_overall(events: DataFrame) -> DataFrame:
    """Q-10: carters and abandoned carts, per user and per session (SET-1)."""
    grains = ((fv.PER_USER, "user_id"), (fv.PER_SESSION, "user_session"))
    return reduce(
        DataFrame.unionByName,
        (
            abandonment(events, unit).select(F.lit(name).alias("grain"), "carters", "abandoned")
            for name, unit in grains
        ),
    )


def abandonment_by_category(events: DataFrame, min_carters: int = fv.MIN_CARTERS) -> DataFrame:
    """Q-11: the same per top-level category, worst first."""
    tagged = events.select(top_category().alias("top_category"), "user_id", "event_type")
    return (
        abandonment_by(tagged, "top_category")
        .where(F.col("carters") >= min_carters)
        .withColumn("abandonment_pct", percent(F.col("abandoned"), F.col("carters"), 1))
        .orderBy(F.desc("abandonment_pct"), "top_category")
    )


def top_abandoned_products(
    events: DataFrame, min_cart_adds: int = fv.MIN_CART_ADDS, limit: int = fv.TOP_PRODUCTS
) -> DataFrame:
    """Q-12: products often put in the cart and seldom bought (ORD-3)."""
    return (
        product_carts(events)
        .where(F.col("cart_adds") >= min_cart_adds)
        .orderBy("purchase_per_cart", F.desc("cart_adds"), "product_id")
        .limit(limit)
    )


def data_quality(events: DataFrame) -> DataFrame:
    """Q-13: seven audit metrics from four narrow aggregates."""
    labels = quality.missing_values(events)
    redundant = quality.redundant_rows(events)
    sessions = quality.units_without_view(events, "user_session")
    users = quality.units_without_view(events, "user_id")
    parts = [
        quality.metrics(
            labels,
            [
                (fv.TOTAL_EVENTS, "events", None),
                (fv.MISSING_CATEGORY, "missing_category", "missing_category_pct"),
                (fv.MISSING_BRAND, "missing_brand", "missing_brand_pct"),
                (fv.MISSING_PRICE, "missing_price", "missing_price_pct"),
            ],
        ),
        quality.metric(
            redundant,
            fv.DUPLICATE_EVENTS,
            F.col("redundant"),
            percent(F.col("redundant"), F.col("events"), 2),
        ),
        quality.metric(sessions, fv.SESSIONS_WITHOUT_VIEW, F.col("units")),
        quality.metric(users, fv.USERS_WITHOUT_VIEW, F.col("units")),
    ]
    return reduce(DataFrame.unionByName, parts)


def dataset_summary(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Q-14: events, users, sessions and the time covered."""
    return quality.distinct_counts(events, approximate)


REPORTS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        funnel_user,
        funnel_session,
        funnel_by_category,
        funnel_by_price_quartile,
        events_per_session,
        session_duration,
        lag_event_gaps,
        time_to_convert,
        time_to_convert_distribution,
        abandonment_overall,
        abandonment_by_category,
        top_abandoned_products,
        data_quality,
        dataset_summary,
    )
}
