"""KPI reads over the marts: filter, sort, top-k and the dashboard roll-up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeld.functions.columns import day, growth_percent

MAX_DAYS = 365
MAX_PRODUCTS = 500


def _check_limit(limit: int, highest: int) -> None:
    if not 1 <= limit <= highest:
        raise ValueError(f"limit must lie between 1 and {highest}, got {limit}")


def platform_overview(overview: DataFrame) -> DataFrame:
    """All platforms, highest revenue first."""
    return overview.orderBy(F.desc_nulls_first("total_revenue_usd"), "platform")


def daily_snapshots(
    daily: DataFrame,
    as_of: dt.date,
    start: dt.date | None = None,
    end: dt.date | None = None,
    limit: int = 30,
) -> DataFrame:
    """Latest days within [start, end]; by default the `limit` days before `as_of`."""
    _check_limit(limit, MAX_DAYS)
    end = end or as_of
    start = start or end - dt.timedelta(days=limit)
    return (
        daily.filter(F.col("order_date").between(day(start), day(end)))
        .orderBy(F.desc_nulls_first("order_date"))
        .limit(limit)
    )


def revenue_by_platform(
    revenue: DataFrame,
    as_of: dt.date,
    platform: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Daily revenue rows within [start, end], by default the last 30 days, newest first."""
    end = end or as_of
    start = start or end - dt.timedelta(days=30)
    rows = revenue.filter(F.col("order_date").between(day(start), day(end)))
    if platform:
        rows = rows.filter(F.col("platform") == platform)
    return rows.orderBy(F.desc_nulls_first("order_date"), "platform")


def product_performance(
    products: DataFrame, platform: str | None = None, tier: str | None = None, limit: int = 50
) -> DataFrame:
    """Products with the highest revenue, optionally of one platform or tier."""
    _check_limit(limit, MAX_PRODUCTS)
    if platform:
        products = products.filter(F.col("platform") == platform)
    if tier:
        products = products.filter(F.col("performance_tier") == tier)
    return products.orderBy(
        F.desc_nulls_first("total_revenue"), "platform", "product_id", "product_name", "sku"
    ).limit(limit)


def dashboard_summary(overview: DataFrame, daily: DataFrame, as_of: dt.date) -> DataFrame:
    """One row: totals over all platforms, growth, and the platforms and last seven days nested.

    The nested lists hold at most one entry per platform and seven days. Rounding is half-even.
    """
    measures = (
        "total_revenue_usd",
        "total_orders",
        "revenue_this_month_usd",
        "revenue_last_month_usd",
        "orders_this_month",
        "orders_last_month",
    )
    platforms = F.collect_list(F.struct(*overview.columns)).alias("platforms")
    totals = overview.agg(
        *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in measures), platforms
    )
    recent = daily_snapshots(daily, as_of, limit=7)
    recent_days = recent.agg(F.sort_array(F.collect_list(F.struct(*recent.columns)), asc=False))
    revenue, orders = F.col("total_revenue_usd"), F.col("total_orders")
    by_revenue = F.expr(
        "array_sort(platforms, (a, b) -> CASE"
        " WHEN b.total_revenue_usd > a.total_revenue_usd THEN 1"
        " WHEN b.total_revenue_usd < a.total_revenue_usd THEN -1"
        " WHEN a.platform > b.platform THEN 1 ELSE -1 END)"
    )
    return totals.select(
        F.bround(revenue, 2).alias("total_revenue_usd"),
        orders.alias("total_orders"),
        F.when(orders > 0, F.bround(revenue / orders, 2)).otherwise(F.lit(0)).alias("avg_order_value_usd"),
        growth_percent(
            F.col("revenue_this_month_usd"), F.col("revenue_last_month_usd"), F.bround
        ).alias("revenue_growth_pct"),
        growth_percent(F.col("orders_this_month"), F.col("orders_last_month"), F.bround).alias(
            "orders_growth_pct"
        ),
        # Fixed value: the number of customers is not known at this level.
        F.lit(0).alias("total_customers"),
        by_revenue.alias("platforms"),
        recent_days.scalar().alias("recent_days"),
    )


def today_summary(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """The snapshot row of `as_of`; no row when there is none yet."""
    return daily_snapshots(daily, as_of, start=as_of, end=as_of, limit=1)
