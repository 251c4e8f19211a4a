"""Profitability over the raw orders: revenue, discounts, net and period comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions.columns import (
    epoch_seconds,
    exact_avg,
    ntz,
    ntz_from_epoch,
    ratio,
    zero_if_null,
)
from shopmeld.operators.products import order_amount, since
from shopmeld.operators.staging import MONEY

_TIME = {"shopify": "created_at", "amazon": "purchase_date", "lazada": "created_at", "shopee": "create_time"}


def _discount(platform: str) -> Column:
    """The discount of a raw order row; Amazon reports none."""
    column = {"shopify": "total_discounts", "lazada": "voucher", "shopee": "voucher_absorbed"}.get(platform)
    return F.col(column) if column else F.lit(0).cast(MONEY)


def _counted_orders(raw: Mapping[str, DataFrame], platform: str) -> DataFrame:
    """Raw orders that count: Shopify leaves out cancelled ones, the others keep all."""
    orders = raw[f"{platform}_orders"]
    return orders.filter(F.col("cancelled_at").isNull()) if platform == "shopify" else orders


def _order_date(platform: str) -> Column:
    if platform == "shopee":
        return F.to_date(ntz_from_epoch(F.col("create_time")))
    return F.to_date(_TIME[platform])


def profitability_by_platform(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Gross revenue, discounts and orders of each platform over all time."""

    def totals(platform: str) -> DataFrame:
        return _counted_orders(raw, platform).agg(
            F.lit(platform).alias("platform"),
            zero_if_null(F.sum(order_amount(platform))).alias("gross_revenue"),
            zero_if_null(F.sum(_discount(platform))).alias("discounts"),
            F.count("*").alias("orders"),
        )

    return reduce(DataFrame.unionByName, (totals(platform) for platform in config.PLATFORMS))


def profitability_summary(by_platform: DataFrame) -> DataFrame:
    """One row of totals over all platforms."""
    gross, discounts, orders = F.col("gross_revenue"), F.col("total_discounts"), F.col("total_orders")
    return by_platform.agg(
        zero_if_null(F.sum("gross_revenue")).alias("gross_revenue"),
        zero_if_null(F.sum("discounts")).alias("total_discounts"),
        zero_if_null(F.sum("orders")).alias("total_orders"),
    ).select(
        gross,
        discounts,
        (gross - discounts).alias("net_revenue"),
        orders,
        zero_if_null(ratio(gross, orders)).alias("avg_order_value"),
        F.when(gross > 0, ratio(discounts, gross) * 100).otherwise(F.lit(0.0)).alias("discount_rate"),
    )


def platform_profitability(
    raw: Mapping[str, DataFrame], now: dt.datetime, platform: str, days: int = 30
) -> DataFrame:
    """One row for the recent orders of a platform.

    Net revenue is 0 when there is no discount at all, a rule kept from the source system.
    """
    name = config.check_platform(platform)
    amount = order_amount(name)
    subtotal = F.col("subtotal_price") if name == "shopify" else amount
    tax = F.col("total_tax") if name == "shopify" else F.lit(0).cast(MONEY)
    gross, discounts = F.col("gross_revenue"), F.col("total_discounts")
    return (
        _counted_orders(raw, name)
        .filter(since(name, now - dt.timedelta(days=days)))
        .agg(
            zero_if_null(F.sum(amount)).alias("gross_revenue"),
            zero_if_null(F.sum(subtotal)).alias("subtotal"),
            zero_if_null(F.sum(tax)).alias("total_tax"),
            zero_if_null(F.sum(_discount(name))).alias("total_discounts"),
            F.count("*").alias("total_orders"),
            zero_if_null(exact_avg(amount)).alias("avg_order_value"),
        )
        .select(
            gross,
            "subtotal",
            "total_tax",
            discounts,
            F.when((gross != 0) & (discounts != 0), gross - discounts)
            .otherwise(F.lit(0))
            .alias("net_revenue"),
            "total_orders",
            "avg_order_value",
            F.when(gross > 0, ratio(discounts, gross) * 100)
            .otherwise(F.lit(0.0))
            .alias("discount_rate"),
        )
    )


def platform_profitability_daily(
    raw: Mapping[str, DataFrame], now: dt.datetime, platform: str, days: int = 30
) -> DataFrame:
    """The recent orders of a platform per day."""
    name = config.check_platform(platform)
    return (
        _counted_orders(raw, name)
        .filter(since(name, now - dt.timedelta(days=days)))
        .groupBy(_order_date(name).alias("day"))
        .agg(
            zero_if_null(F.sum(order_amount(name))).alias("gross_revenue"),
            zero_if_null(F.sum(_discount(name))).alias("discounts"),
            F.count("*").alias("orders"),
        )
        .orderBy("day")
        .select(F.col("day").cast("string").alias("date"), "gross_revenue", "discounts", "orders")
    )


def comparison_periods(as_of: dt.date) -> dict[str, tuple[dt.date, dt.date]]:
    """Half-open, overlapping periods around a date; weeks start on Monday."""
    one = dt.timedelta(days=1)
    tomorrow, monday, first = as_of + one, as_of - one * as_of.weekday(), as_of.replace(day=1)
    return {
        "today": (as_of, tomorrow),
        "yesterday": (as_of - one, as_of),
        "this_week": (monday, tomorrow),
        "last_week": (monday - one * 7, monday),
        "this_month": (first, tomorrow),
        "last_month": ((first - one).replace(day=1), first),
    }


def profitability_comparison(
    raw: Mapping[str, DataFrame], as_of: dt.date, platform: str | None = None
) -> DataFrame:
    """One row per period, also for periods without orders.

    A single scan, limited to the span of all periods on the raw time column, folds every order
    into all periods it belongs to; the one resulting row is then turned into one row per period.
    """
    name = config.check_platform(platform)
    periods = comparison_periods(as_of)
    midnight = dt.time()

    def in_range(start: dt.date, end: dt.date) -> Column:
        low, high = (dt.datetime.combine(value, midnight) for value in (start, end))
        moment = F.col(_TIME[name])
        if name == "shopee":
            return (moment >= epoch_seconds(low)) & (moment < epoch_seconds(high))
        return (moment >= ntz(low)) & (moment < ntz(high))

    starts, ends = zip(*periods.values())
    sums = []
    for period, (start, end) in periods.items():
        inside = in_range(start, end)
        sums += [
            zero_if_null(F.sum(F.when(inside, order_amount(name)))).alias(f"{period}_revenue"),
            zero_if_null(F.sum(F.when(inside, _discount(name)))).alias(f"{period}_discounts"),
            F.count_if(inside).alias(f"{period}_orders"),
        ]
    row = _counted_orders(raw, name).filter(in_range(min(starts), max(ends))).agg(*sums)
    return row.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(period).alias("period"),
                        *(
                            F.col(f"{period}_{measure}").alias(measure)
                            for measure in ("revenue", "discounts", "orders")
                        ),
                    )
                    for period in periods
                )
            )
        )
    )
