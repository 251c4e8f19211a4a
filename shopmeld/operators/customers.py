"""Customer analytics: Shopify has a customer table, the other platforms derive buyers from orders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions.columns import (
    case,
    exact_avg,
    joined_name,
    ntz_from_epoch,
    or_default,
    ratio,
    zero_if_null,
)
from shopmeld.operators.products import order_amount, since

TOP = 10
COHORTS = 12

_BUYER = {"amazon": "buyer_email", "lazada": "buyer_email", "shopee": "buyer_username"}


def _order_time(platform: str) -> Column:
    if platform == "shopee":
        return ntz_from_epoch(F.col("create_time"))
    return F.col("purchase_date" if platform == "amazon" else "created_at")


def customer_summary_shopify(customers: DataFrame) -> DataFrame:
    """One row: customers, those with orders, orders and value per customer."""
    spent = F.col("total_spent")
    return customers.agg(
        F.count("*").alias("total_customers"),
        F.count_if(F.col("orders_count") > 0).alias("customers_with_orders"),
        zero_if_null(exact_avg(F.col("orders_count"))).alias("avg_orders_per_customer"),
        zero_if_null(exact_avg(spent)).alias("avg_lifetime_value"),
        zero_if_null(F.sum(spent)).alias("total_customer_value"),
        F.lit("shopify").alias("platform"),
    )


def customer_segments(customers: DataFrame) -> DataFrame:
    """Customers grouped by what they spent so far."""
    spent = F.col("total_spent")
    segment = case(
        (
            *((spent >= bound, F.lit(name)) for name, bound in config.CUSTOMER_SEGMENTS),
            (spent > 0, F.lit("Low Value")),
        ),
        F.lit("No Purchases"),
    )
    return (
        customers.groupBy(segment.alias("segment"))
        .agg(
            F.count("*").alias("customer_count"),
            zero_if_null(exact_avg(spent)).alias("avg_spent"),
            F.sum(spent).alias("spent"),
        )
        .orderBy(F.desc_nulls_first("spent"), "segment")
        .select("segment", "customer_count", "avg_spent", zero_if_null(F.col("spent")).alias("total_spent"))
    )


def customer_cohorts(customers: DataFrame) -> DataFrame:
    """The latest 12 sign-up months."""
    return (
        customers.filter(F.col("created_at").isNotNull())
        .groupBy(F.date_format(F.to_date("created_at"), "yyyy-MM").alias("cohort_month"))
        .agg(
            F.count("*").alias("customers"),
            zero_if_null(exact_avg(F.col("orders_count"))).alias("avg_orders"),
            zero_if_null(exact_avg(F.col("total_spent"))).alias("avg_ltv"),
        )
        .orderBy(F.desc("cohort_month"))
        .limit(COHORTS)
    )


def customer_retention(customers: DataFrame) -> DataFrame:
    """New, returning and loyal customers; an unknown order count counts as loyal."""
    orders = F.col("orders_count")
    kind = F.when(orders <= 1, "New").when(orders <= 3, "Returning").otherwise("Loyal")
    return customers.groupBy(kind.alias("customer_type")).agg(
        F.count("*").alias("count"), zero_if_null(exact_avg(F.col("total_spent"))).alias("avg_spent")
    )


def top_customers_shopify(customers: DataFrame) -> DataFrame:
    """The ten customers who spent most."""
    return (
        customers.orderBy(F.desc_nulls_first("total_spent"), "id")
        .limit(TOP)
        .select(
            joined_name(F.col("first_name"), F.col("last_name")).alias("name"),
            "email",
            "orders_count",
            zero_if_null(F.col("total_spent")).alias("total_spent"),
            F.to_date("created_at").cast("string").alias("customer_since"),
        )
    )


def customer_summary_from_orders(orders: DataFrame, platform: str) -> DataFrame:
    """The Shopify summary for a platform that only knows buyers by their orders."""
    buyers = F.count_distinct(_BUYER[platform])
    value = F.sum(order_amount(platform))
    return orders.agg(
        buyers.alias("total_customers"),
        buyers.alias("customers_with_orders"),
        zero_if_null(ratio(F.count("*"), buyers)).alias("avg_orders_per_customer"),
        zero_if_null(ratio(value, buyers)).alias("avg_lifetime_value"),
        zero_if_null(value).alias("total_customer_value"),
        F.lit(platform).alias("platform"),
    )


def top_customers_from_orders(orders: DataFrame, platform: str) -> DataFrame:
    """The ten buyers with the highest order value."""
    return (
        orders.groupBy(F.col(_BUYER[platform]).alias("email"))
        .agg(
            F.count("*").alias("orders_count"),
            F.sum(order_amount(platform)).alias("spent"),
            F.min(_order_time(platform)).alias("first_order"),
        )
        .orderBy(F.desc_nulls_first("spent"), F.asc_nulls_last("email"))
        .limit(TOP)
        .select(
            or_default(F.col("email"), "Unknown").alias("name"),
            "email",
            "orders_count",
            zero_if_null(F.col("spent")).alias("total_spent"),
            F.to_date("first_order").cast("string").alias("customer_since"),
        )
    )


def customer_summary(raw: Mapping[str, DataFrame], platform: str | None = None) -> DataFrame:
    """Customer summary of one platform; Shopify when none is named."""
    name = config.check_platform(platform)
    if name == "shopify":
        return customer_summary_shopify(raw["shopify_customers"])
    return customer_summary_from_orders(raw[f"{name}_orders"], name)


def top_customers(raw: Mapping[str, DataFrame], platform: str | None = None) -> DataFrame:
    """Top customers of one platform; Shopify when none is named."""
    name = config.check_platform(platform)
    if name == "shopify":
        return top_customers_shopify(raw["shopify_customers"])
    return top_customers_from_orders(raw[f"{name}_orders"], name)


def customer_acquisition(
    raw: Mapping[str, DataFrame], now: dt.datetime, platform: str | None = None, days: int = 90
) -> DataFrame:
    """Per day: sign-ups on Shopify, distinct buyers active that day elsewhere."""
    name = config.check_platform(platform)
    cutoff = now - dt.timedelta(days=days)
    if name == "shopify":
        rows, newcomers = raw["shopify_customers"], F.count("*")
    else:
        rows, newcomers = raw[f"{name}_orders"], F.count_distinct(_BUYER[name])
    return (
        rows.filter(since(name, cutoff))
        .groupBy(F.to_date(_order_time(name)).alias("day"))
        .agg(newcomers.alias("new_customers"))
        .orderBy("day")
        .select(F.col("day").cast("string").alias("date"), "new_customers")
    )
