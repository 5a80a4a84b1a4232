"""Per-product cart and purchase counts (AGG-13..16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelry.fixed_values import CART, PURCHASE
from funnelry.functions.events import brand_label, category_label, did, ones
from funnelry.functions.numbers import ratio, round_to


def product_carts(events: DataFrame) -> DataFrame:
    """Counts events, not users, so purchases per cart add may exceed 1.

    The mean price ignores missing prices but keeps non-positive ones.

    Counting is done per product and its labels first. Numbers alone aggregate by hash in the map
    tasks; the largest label, being text, needs a sort, which then sees one row per product and
    label instead of every event.
    """
    price = F.nanvl("price", F.lit(None).cast("double"))
    labelled = events.groupBy(
        "product_id", brand_label().alias("brand"), category_label().alias("category_code")
    ).agg(
        F.sum(price).alias("price_sum"),
        F.count(price).alias("prices"),
        ones(did(CART)).alias("cart_adds"),
        ones(did(PURCHASE)).alias("purchases"),
    )
    return (
        labelled.groupBy("product_id")
        .agg(
            F.max("brand").alias("brand"),
            F.max("category_code").alias("category_code"),
            ratio(F.sum("price_sum"), F.sum("prices")).alias("mean_price"),
            F.sum("cart_adds").alias("cart_adds"),
            F.sum("purchases").alias("purchases"),
        )
        .select(
            "product_id",
            "brand",
            "category_code",
            round_to(F.col("mean_price"), 2).alias("avg_price"),
            "cart_adds",
            "purchases",
            round_to(ratio(F.col("purchases"), F.col("cart_adds")), 3).alias("purchase_per_cart"),
        )
    )
