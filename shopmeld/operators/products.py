"""Product analytics straight over the raw tables. `now` is the clock; windows have no upper end."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.config import check_platform
from shopmeld.functions.columns import epoch_seconds, exact_avg, ntz, or_default, zero_if_null

TOP = 20
TRENDING = 10
#: Amounts inside JSON payloads are summed as written; only staging rounds them to two digits.
PAYLOAD_MONEY = f"decimal(20,{config.PAYLOAD_DIGITS})"


def since(platform: str, cutoff: dt.datetime) -> Column:
    """Orders created at or after the cutoff, on the raw column so the scan can skip files."""
    if platform == "shopee":
        return F.col("create_time") >= epoch_seconds(cutoff)
    column = "purchase_date" if platform == "amazon" else "created_at"
    return F.col(column) >= ntz(cutoff)


def order_amount(platform: str) -> Column:
    """The order total of a raw order row."""
    if platform == "amazon":
        return F.get_json_object("order_total", "$.Amount").cast(PAYLOAD_MONEY)
    return F.col({"shopify": "total_price", "lazada": "price", "shopee": "total_amount"}[platform])


def _recent_shopify_lines(raw: Mapping[str, DataFrame], cutoff: dt.datetime) -> DataFrame:
    """Order lines of recent orders with the order time."""
    recent = (
        raw["shopify_orders"]
        .filter(since("shopify", cutoff))
        .select(F.col("id").alias("order_id"), "created_at")
    )
    return raw["shopify_order_line_items"].select(
        "order_id", "product_id", "quantity", "price", (F.col("price") * F.col("quantity")).alias("amount")
    ).join(recent, "order_id")


def _products(raw: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    return raw["shopify_products"].select(F.col("id").alias("product_id"), *columns)


def top_products_shopify(
    raw: Mapping[str, DataFrame], now: dt.datetime, days: int = 30
) -> DataFrame:
    """The 20 products with the highest revenue.

    Lines are folded per product before the product table is joined, so a best seller crosses the
    shuffle as one row per task, and the lines are still partitioned by order when the distinct
    orders are counted.
    """
    per_product = (
        _recent_shopify_lines(raw, now - dt.timedelta(days=days))
        .groupBy("product_id")
        .agg(
            F.count_distinct("order_id").alias("orders"),
            F.sum("quantity").alias("units"),
            F.sum("amount").alias("revenue"),
            F.sum("price").alias("price_sum"),
            F.count("price").alias("prices"),
        )
    )
    key = ["product_id", "title", "product_type", "vendor"]
    return (
        per_product.join(_products(raw, "title", "product_type", "vendor"), "product_id")
        .groupBy(*key)
        .agg(
            F.max("orders").alias("total_orders"),
            F.sum("units").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
            (F.sum("price_sum").cast("double") / F.nullif(F.sum("prices"), F.lit(0))).alias("price"),
        )
        .orderBy(F.desc_nulls_first("revenue"), "product_id")
        .limit(TOP)
        .select(
            F.col("title").alias("product_name"),
            or_default(F.col("product_type"), "Uncategorized").alias("category"),
            or_default(F.col("vendor"), "Unknown").alias("vendor"),
            "total_orders",
            "units_sold",
            zero_if_null(F.col("revenue")).alias("total_revenue"),
            zero_if_null(F.col("price")).alias("avg_price"),
            F.lit("shopify").alias("platform"),
        )
    )


def category_performance(
    raw: Mapping[str, DataFrame], now: dt.datetime, days: int = 30
) -> DataFrame:
    """Products, units and revenue per category; products without one form their own row."""
    per_product = (
        _recent_shopify_lines(raw, now - dt.timedelta(days=days))
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), F.sum("amount").alias("revenue"))
    )
    return (
        per_product.join(_products(raw, "product_type"), "product_id")
        .groupBy("product_type")
        .agg(
            F.count_distinct("product_id").alias("product_count"),
            F.sum("units").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
        )
        .orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_last("product_type"))
        .select(
            F.coalesce("product_type", F.lit("Uncategorized")).alias("category"),
            "product_count",
            "units_sold",
            zero_if_null(F.col("revenue")).alias("total_revenue"),
        )
    )


def product_summary(raw: Mapping[str, DataFrame], now: dt.datetime, days: int = 30) -> DataFrame:
    """One row of totals over the recent lines whose product exists.

    Lines fold per product before they meet the products, so a best seller is one row per task there;
    orders are counted apart, from distinct (order, product) pairs.
    """
    lines = _recent_shopify_lines(raw, now - dt.timedelta(days=days))
    per_product = (
        lines.groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), F.sum("amount").alias("revenue"), F.count("amount").alias("valued"))
        .join(_products(raw), "product_id", "left_semi")
        .select(F.lit(1).alias("product"), F.lit(0).alias("order"), "units", "revenue", "valued")
    )
    per_order = (
        lines.select("order_id", "product_id")
        .distinct()
        .join(_products(raw), "product_id", "left_semi")
        .select("order_id")
        .distinct()
        .select(F.lit(0).alias("product"), F.lit(1).alias("order"))
    )
    average = F.sum("revenue").cast("double") / F.nullif(F.sum("valued"), F.lit(0))
    return per_product.unionByName(per_order, allowMissingColumns=True).agg(
        zero_if_null(F.sum("product")).alias("total_products"),
        zero_if_null(F.sum("order")).alias("orders_with_products"),
        zero_if_null(F.sum("units")).alias("total_units_sold"),
        zero_if_null(F.sum("revenue")).alias("total_revenue"),
        zero_if_null(average).alias("avg_item_value"),
        F.lit(days).alias("period_days"),
        F.lit("shopify").alias("platform"),
    )


def _marketplace_lines(raw: Mapping[str, DataFrame], platform: str) -> DataFrame:
    """Lines of a marketplace as (order key, name, sku, units, revenue, price)."""
    if platform == "amazon":
        amount = F.get_json_object("item_price", "$.Amount").cast(PAYLOAD_MONEY)
        return raw["amazon_order_items"].select(
            F.col("amazon_order_id").alias("order_key"),
            F.col("title").alias("name"),
            F.col("seller_sku").alias("sku"),
            F.col("quantity_ordered").alias("units"),
            amount.alias("revenue"),
            amount.alias("price"),
        )
    if platform == "lazada":
        return raw["lazada_order_items"].select(
            F.col("order_id").alias("order_key"),
            "name",
            "sku",
            F.lit(1).alias("units"),
            F.col("paid_price").alias("revenue"),
            F.col("paid_price").alias("price"),
        )
    price, units = F.col("model_discounted_price"), F.col("model_quantity_purchased")
    return raw["shopee_order_items"].select(
        F.col("order_sn").alias("order_key"),
        F.col("item_name").alias("name"),
        F.col("model_sku").alias("sku"),
        units.alias("units"),
        (price * units).alias("revenue"),
        price.alias("price"),
    )


def _top_products_marketplace(
    raw: Mapping[str, DataFrame], platform: str, now: dt.datetime, days: int
) -> DataFrame:
    order_key = {"amazon": "amazon_order_id", "lazada": "order_id", "shopee": "order_sn"}[platform]
    recent = (
        raw[f"{platform}_orders"]
        .filter(since(platform, now - dt.timedelta(days=days)))
        .select(F.col(order_key).alias("order_key"))
    )
    return (
        _marketplace_lines(raw, platform)
        .join(recent, "order_key")
        .groupBy("name", "sku")
        .agg(
            F.count_distinct("order_key").alias("total_orders"),
            F.sum("units").alias("units"),
            F.sum("revenue").alias("revenue"),
            exact_avg(F.col("price")).alias("price"),
        )
        .orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_last("name"), F.asc_nulls_last("sku"))
        .limit(TOP)
        .select(
            or_default(F.col("name"), "Unknown").alias("product_name"),
            F.lit(platform.capitalize()).alias("category"),
            or_default(F.col("sku"), "Unknown").alias("vendor"),
            "total_orders",
            zero_if_null(F.col("units")).alias("units_sold"),
            zero_if_null(F.col("revenue")).alias("total_revenue"),
            zero_if_null(F.col("price")).alias("avg_price"),
            F.lit(platform).alias("platform"),
        )
    )


def top_products_amazon(raw: Mapping[str, DataFrame], now: dt.datetime, days: int = 30) -> DataFrame:
    """Top 20 by title and seller SKU; revenue is the item price of the line."""
    return _top_products_marketplace(raw, "amazon", now, days)


def top_products_lazada(raw: Mapping[str, DataFrame], now: dt.datetime, days: int = 30) -> DataFrame:
    """Top 20 by name and SKU; every line is one unit."""
    return _top_products_marketplace(raw, "lazada", now, days)


def top_products_shopee(raw: Mapping[str, DataFrame], now: dt.datetime, days: int = 30) -> DataFrame:
    """Top 20 by item name and model SKU; revenue is the discounted price times the quantity."""
    return _top_products_marketplace(raw, "shopee", now, days)


def top_products(
    raw: Mapping[str, DataFrame], now: dt.datetime, platform: str | None = None, days: int = 30
) -> DataFrame:
    """Top products of one platform; Shopify when none is named."""
    name = check_platform(platform)
    build = {
        "shopify": top_products_shopify,
        "amazon": top_products_amazon,
        "lazada": top_products_lazada,
        "shopee": top_products_shopee,
    }[name]
    return build(raw, now, days)


def top_products_rollup(top: DataFrame, platform: str, days: int = 30) -> DataFrame:
    """Summary of the marketplaces: totals of the listed top products and their one category."""
    revenue, listed = F.sum("total_revenue"), F.count("*")
    return top.agg(
        listed.alias("total_products"),
        zero_if_null(F.sum("total_orders")).alias("orders_with_products"),
        zero_if_null(F.sum("units_sold")).alias("total_units_sold"),
        zero_if_null(revenue).alias("total_revenue"),
        zero_if_null(revenue.cast("double") / F.greatest(listed, F.lit(1))).alias("avg_item_value"),
        F.lit(days).alias("period_days"),
        F.lit(platform).alias("platform"),
        F.lit(f"{platform.capitalize()} Products").alias("category"),
    )


def trending_products(
    raw: Mapping[str, DataFrame], now: dt.datetime, days: int = 7, platform: str | None = None
) -> DataFrame:
    """The 10 fastest growing products: last `days` days against the `days` before.

    One pass with conditional sums instead of two joins; only products sold in the current period
    stay. Only Shopify has the data; `platform` merely labels the rows.
    """
    current_start = now - dt.timedelta(days=days)
    current = F.col("created_at") >= ntz(current_start)
    per_product = (
        _recent_shopify_lines(raw, current_start - dt.timedelta(days=days))
        .groupBy("product_id")
        .agg(
            F.count_if(current).alias("current_lines"),
            F.sum(F.when(current, F.col("quantity"))).alias("current_units"),
            F.sum(F.when(current, F.col("amount"))).alias("current_revenue"),
            F.sum(F.when(~current, F.col("quantity"))).alias("previous_units"),
            F.sum(F.when(~current, F.col("amount"))).alias("previous_revenue"),
        )
        .filter("current_lines > 0")
    )
    names = ["current_units", "current_revenue", "previous_units", "previous_revenue"]
    sold, before = F.col("current_revenue"), F.col("previous_revenue")
    growth = F.when(before > 0, (sold - before).cast("double") / before.cast("double") * 100)
    return (
        per_product.join(_products(raw, "title"), "product_id")
        .groupBy("product_id", "title")
        .agg(*(F.sum(name).alias(name) for name in names))
        .withColumn("growth", F.when(before > 0, growth).otherwise(F.lit(100.0)))
        .orderBy(F.desc_nulls_first("growth"), "product_id")
        .limit(TRENDING)
        .select(
            F.col("title").alias("product_name"),
            *(
                F.col(name) if name == "current_units" else zero_if_null(F.col(name)).alias(name)
                for name in names
            ),
            zero_if_null(F.col("growth")).alias("growth_pct"),
            F.lit(platform or "shopify").alias("platform"),
        )
    )
