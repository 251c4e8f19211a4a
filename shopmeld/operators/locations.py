"""Revenue by place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopmeld.config import check_platform
from shopmeld.functions.columns import exact_avg, zero_if_null
from shopmeld.operators.products import order_amount

TOP = 20


RANK = "listing_rank"


def _by_place(df: DataFrame, amount, places: dict, average: bool, ranked: bool) -> DataFrame:
    """The 20 places with the highest revenue; rows and revenue per place.

    Places without any amount come first. `ranked` adds the place in the listing, which the shown
    revenue (0 for a missing one) does not tell.
    """
    averages = [exact_avg(amount).alias("average")] if average else []
    names = list(places)
    found = (
        df.groupBy(*(F.coalesce(column, F.lit("Unknown")).alias(name) for name, column in places.items()))
        .agg(F.count("*").alias("customer_count"), F.sum(amount).alias("revenue"), *averages)
        .orderBy(F.desc_nulls_first("revenue"), *names)
        .limit(TOP)
    )
    if ranked:
        found = found.withColumn(RANK, F.row_number().over(W.orderBy(F.desc_nulls_first("revenue"), *names)))
    return found.select(
        *names,
        "customer_count",
        zero_if_null(F.col("revenue")).alias("total_revenue"),
        *([zero_if_null(F.col("average")).alias("avg_customer_value")] if average else []),
        *([RANK] if ranked else []),
    )


def _with_address(df: DataFrame, column: str, city: str, country: str) -> DataFrame:
    """Rows with an address, its JSON parsed once."""
    parsed = F.from_json(column, f"`{city}` string, `{country}` string")
    return df.filter(F.col(column).isNotNull()).withColumn("address", parsed)


def by_country_shopify(customers: DataFrame, ranked: bool = False) -> DataFrame:
    located = _with_address(customers, "default_address", "city", "country")
    return _by_place(located, F.col("total_spent"), {"country": F.col("address.country")}, True, ranked)


def by_city_shopify(customers: DataFrame, ranked: bool = False) -> DataFrame:
    located = _with_address(customers, "default_address", "city", "country")
    places = {"city": F.col("address.city"), "country": F.col("address.country")}
    return _by_place(located, F.col("total_spent"), places, False, ranked)


def by_country_amazon(orders: DataFrame, ranked: bool = False) -> DataFrame:
    located = _with_address(orders, "shipping_address", "City", "CountryCode")
    return _by_place(located, order_amount("amazon"), {"country": F.col("address.CountryCode")}, True, ranked)


def by_city_amazon(orders: DataFrame, ranked: bool = False) -> DataFrame:
    located = _with_address(orders, "shipping_address", "City", "CountryCode")
    places = {"city": F.col("address.City"), "country": F.col("address.CountryCode")}
    return _by_place(located, order_amount("amazon"), places, False, ranked)


def by_country_const(orders: DataFrame, platform: str) -> DataFrame:
    """Lazada and Shopee orders carry no usable place: one row for the region."""
    amount = order_amount(platform)
    return orders.agg(
        F.lit("Southeast Asia").alias("country"),
        F.count("*").alias("customer_count"),
        zero_if_null(F.sum(amount)).alias("total_revenue"),
        zero_if_null(exact_avg(amount)).alias("avg_customer_value"),
    )


def by_city_const(orders: DataFrame, platform: str) -> DataFrame:
    """As by_country_const, with a stand-in city."""
    return orders.agg(
        F.lit("Various").alias("city"),
        F.lit("Southeast Asia").alias("country"),
        F.count("*").alias("customer_count"),
        zero_if_null(F.sum(order_amount(platform))).alias("total_revenue"),
    )


def by_country(raw: Mapping[str, DataFrame], platform: str | None = None, ranked: bool = False) -> DataFrame:
    """Revenue by country of one platform; Shopify when none is named."""
    name = check_platform(platform)
    if name == "shopify":
        return by_country_shopify(raw["shopify_customers"], ranked)
    if name == "amazon":
        return by_country_amazon(raw["amazon_orders"], ranked)
    region = by_country_const(raw[f"{name}_orders"], name)
    return region.withColumn(RANK, F.lit(1)) if ranked else region


def by_city(raw: Mapping[str, DataFrame], platform: str | None = None, ranked: bool = False) -> DataFrame:
    """Revenue by city of one platform; Shopify when none is named."""
    name = check_platform(platform)
    if name == "shopify":
        return by_city_shopify(raw["shopify_customers"], ranked)
    if name == "amazon":
        return by_city_amazon(raw["amazon_orders"], ranked)
    region = by_city_const(raw[f"{name}_orders"], name)
    return region.withColumn(RANK, F.lit(1)) if ranked else region


def location_summary(countries: DataFrame, cities: DataFrame, platform: str) -> DataFrame:
    """One row over the two ranked listings: their lengths and first places.

    The totals count the listings, hence never pass the 20 places that a listing holds.
    """

    def first_place(listing: DataFrame, name: str, kind: str) -> DataFrame:
        return listing.select(F.lit(kind).alias("kind"), F.col(name).alias("place"), F.col(RANK).alias("rank"))

    places = first_place(countries, "country", "country").unionByName(
        first_place(cities, "city", "city")
    )

    def listed(kind: str):
        return F.count_if(F.col("kind") == kind)

    def top(kind: str):
        leader = (F.col("kind") == kind) & (F.col("rank") == 1)
        return F.coalesce(F.max(F.when(leader, F.col("place"))), F.lit("N/A"))

    return places.agg(
        listed("country").alias("total_countries"),
        listed("city").alias("total_cities"),
        top("country").alias("top_country"),
        top("city").alias("top_city"),
        F.lit(platform).alias("platform"),
    )
