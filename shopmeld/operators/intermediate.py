"""Canonical orders and order items: the union of all platforms plus derived columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions import columns as C
from shopmeld.operators.staging import stage


def _union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unified_orders(staged: list[DataFrame]) -> DataFrame:
    """All orders with USD amount, date and time dimensions and status flags; no dedup.

    Every branch carries its platform as a constant, so a platform filter on the result removes
    the other branches from the plan.
    """
    created = F.col("order_created_at")
    return _union_all(staged).withColumns(
        {
            "total_amount_usd": C.convert_to_usd(F.col("total_amount"), F.col("currency_code")),
            **C.date_dimensions(created),
            **C.time_dimensions(created),
            **C.status_flags(
                F.col("payment_status"), F.col("fulfillment_status"), F.col("order_cancelled_at")
            ),
        }
    )


def unified_order_items(staged: list[DataFrame]) -> DataFrame:
    """All order items; no dedup."""
    return _union_all(staged)


def orders_of(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Unified orders straight from the raw tables."""
    return unified_orders([stage(raw, f"stg_{platform}_orders") for platform in config.PLATFORMS])


def order_items_of(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Unified order items straight from the raw tables."""
    return unified_order_items(
        [stage(raw, f"stg_{platform}_order_items") for platform in config.PLATFORMS]
    )


def with_platform_info(df: DataFrame, mappings: DataFrame) -> DataFrame:
    """Add display name, default currency and region; the lookup holds one row per platform.

    No hint: Spark sees the size of the lookup and broadcasts it only while it is small.
    """
    return df.join(mappings, "platform", "left")
