"""The four KPI marts. `as_of` is the business date ("today")."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions.columns import (
    case,
    day,
    exact_avg,
    growth_percent,
    percent,
    rounded_ratio,
)
from shopmeld.functions.ranking import spread_percent_rank, spread_row_number


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("_generated_at", F.current_timestamp())


def _sum_where(condition: Column, value: Column) -> Column:
    """Sum over the matching rows; rows that do not match count as 0."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


#: What the marts read of an order.
FACT_COLUMNS = (
    "order_id",
    "platform",
    "customer_id",
    "order_date",
    "order_month",
    "total_amount",
    "total_amount_usd",
    "discount_amount",
    "item_count",
    "is_paid",
    "is_fulfilled",
    "is_cancelled",
)


def order_facts(orders: DataFrame) -> DataFrame:
    """The narrow columns of the canonical orders that all marts read; stored once, they replace the parsing of
    the raw orders in each of them."""
    return orders.select(*FACT_COLUMNS)


def kpi_daily_snapshot(orders: DataFrame) -> DataFrame:
    """One row per order date over all platforms: volumes, platform split, averages, deltas."""
    return snapshot_trends(snapshot_days(orders))


def snapshot_days(orders: DataFrame) -> DataFrame:
    """The figures of each order date that follow from its own orders.

    Six distinct counts would make Spark copy every order seven times. Instead each order gives
    two narrow rows, one for its order id (with its platform as a bit) and one for its customer;
    these are made distinct first, which also dissolves a hot day, and then counted per day.
    """
    kept = orders.filter(~F.col("is_cancelled"))
    usd, on_platform = F.col("total_amount_usd"), {p: F.col("platform") == p for p in config.PLATFORMS}
    sums = kept.groupBy("order_date").agg(
        F.sum(usd).alias("total_revenue_usd"),
        exact_avg(usd).alias("avg_order_value_usd"),
        F.sum("item_count").alias("total_items_sold"),
        *(
            _sum_where(condition, usd).alias(f"{platform}_revenue_usd")
            for platform, condition in on_platform.items()
        ),
        F.count_if("is_fulfilled").alias("fulfilled_orders"),
        percent(F.count_if("is_fulfilled"), F.count("*")).alias("fulfillment_rate"),
    )

    other = 1 << len(config.PLATFORMS)
    platform_bit = case(
        ((condition, F.lit(1 << i)) for i, condition in enumerate(on_platform.values())), F.lit(other)
    )
    ids = kept.select(
        "order_date",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("is_order"), F.col("order_id").alias("id"), platform_bit.alias("bits")),
                F.struct(F.lit(False).alias("is_order"), F.col("customer_id").alias("id"), F.lit(0).alias("bits")),
            )
        ).alias("entry"),
    ).select("order_date", "entry.*")
    distinct = ids.groupBy("order_date", "is_order", "id").agg(F.bit_or("bits").alias("bits"))
    known = F.col("id").isNotNull()
    counts = distinct.groupBy(F.col("order_date").alias("_date")).agg(
        F.count_if(known & F.col("is_order")).alias("total_orders"),
        *(
            F.count_if(known & (F.col("bits").bitwiseAND(1 << i) != 0)).alias(f"{platform}_orders")
            for i, platform in enumerate(config.PLATFORMS)
        ),
        F.count_if(known & ~F.col("is_order")).alias("unique_customers"),
    )

    return sums.join(counts, F.col("order_date").eqNullSafe(F.col("_date"))).drop("_date")


def snapshot_trends(daily: DataFrame) -> DataFrame:
    """Moving averages and deltas; with one row per calendar day, a window without partitions stays small."""
    by_date = W.orderBy(F.asc_nulls_last("order_date"))
    trends = {}
    for measure, column in (("revenue", "total_revenue_usd"), ("orders", "total_orders")):
        for days in (7, 30):
            frame = by_date.rowsBetween(1 - days, 0)
            total, rows = F.sum(column).over(frame), F.count(column).over(frame)
            trends[f"{measure}_{days}d_avg"] = total.cast("double") / F.nullif(rows, F.lit(0))
        for label, back in (("dod", 1), ("wow", 7)):
            trends[f"{measure}_{label}_change"] = F.col(column) - F.lag(column, back).over(by_date)
    return _stamped(daily.withColumns(trends))


def kpi_platform_overview(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per platform: all-time, this month, last month and today, rates and growth.

    Sums are folded per platform and day first. The five distinct order counts come from one pass that makes
    (platform, order id) distinct and keeps, as bits, which of the five the id belongs to.
    """
    kept, date = ~F.col("is_cancelled"), F.col("order_date")
    today, this_month, last_month = _calendar(as_of)
    sums = _overview_sums(overview_days(orders), as_of)

    memberships = {
        "completed_orders": kept,
        "cancelled_orders": F.col("is_cancelled"),
        "orders_this_month": F.col("order_month") == this_month,
        "orders_last_month": F.col("order_month") == last_month,
        "orders_today": date == today,
    }
    bits = [
        F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
        for i, condition in enumerate(memberships.values())
    ]
    distinct = (
        orders.filter(F.col("order_id").isNotNull())
        .groupBy("platform", "order_id")
        .agg(F.bit_or(sum(bits[1:], bits[0])).alias("bits"))
    )
    counts = distinct.groupBy(F.col("platform").alias("_platform")).agg(
        F.count("*").alias("total_orders"),
        *(
            F.count_if(F.col("bits").bitwiseAND(1 << i) != 0).alias(name)
            for i, name in enumerate(memberships)
        ),
    )

    overview = sums.join(counts, F.col("platform").eqNullSafe(F.col("_platform")), "left")
    return _overview_growth(overview.drop("_platform").na.fill(0, ["total_orders", *memberships]))


def _calendar(as_of: dt.date) -> tuple[Column, Column, Column]:
    """Today, and the first days of this month and the last."""
    today = day(as_of)
    return today, F.trunc(today, "month"), F.trunc(F.add_months(today, -1), "month")


def overview_days(orders: DataFrame) -> DataFrame:
    """What the overview sums up, per platform and order date; the counts of ids hold where an id occurs once."""
    usd, kept = F.col("total_amount_usd"), ~F.col("is_cancelled")
    known = F.col("order_id").isNotNull()
    return orders.groupBy("platform", "order_date").agg(
        F.count("*").alias("rows"),
        F.sum(F.when(kept, usd).otherwise(F.lit(0))).alias("revenue"),
        F.sum(F.when(kept, usd)).alias("kept_revenue"),
        F.count(F.when(kept, usd)).alias("kept_amounts"),
        F.sum(F.when(kept, F.col("item_count"))).alias("kept_items"),
        F.count(F.when(kept, F.col("item_count"))).alias("kept_item_counts"),
        *(F.count_if(flag).alias(flag) for flag in ("is_paid", "is_fulfilled", "is_cancelled")),
        F.count_if(known).alias("ids"),
        F.count_if(known & kept).alias("kept_ids"),
        F.count_if(known & F.col("is_cancelled")).alias("cancelled_ids"),
    )


def _overview_sums(days: DataFrame, as_of: dt.date, *counts: Column) -> DataFrame:
    """A few thousand rows per platform folded to one, which also gives the active days."""
    today, this_month, last_month = _calendar(as_of)
    month, date = F.trunc("order_date", "month"), F.col("order_date")
    total = {name: F.sum(name) for name in days.columns if name not in ("platform", "order_date")}
    return days.groupBy("platform").agg(
        total["revenue"].alias("total_revenue_usd"),
        _sum_where(month == this_month, F.col("revenue")).alias("revenue_this_month_usd"),
        _sum_where(month == last_month, F.col("revenue")).alias("revenue_last_month_usd"),
        _sum_where(date == today, F.col("revenue")).alias("revenue_today_usd"),
        (total["kept_revenue"].cast("double") / F.nullif(total["kept_amounts"], F.lit(0))).alias(
            "avg_order_value_usd"
        ),
        (total["kept_items"].cast("double") / F.nullif(total["kept_item_counts"], F.lit(0))).alias(
            "avg_items_per_order"
        ),
        percent(total["is_paid"], total["rows"]).alias("payment_rate"),
        percent(total["is_fulfilled"], total["is_paid"]).alias("fulfillment_rate"),
        percent(total["is_cancelled"], total["rows"]).alias("cancellation_rate"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count("order_date").alias("active_days"),
        *counts,
    )


def overview_of_days(days: DataFrame, as_of: dt.date) -> DataFrame:
    """The overview out of `overview_days` of orders whose ids occur once: the counts of its days add up."""
    today, this_month, last_month = _calendar(as_of)
    month, ids = F.trunc("order_date", "month"), F.col("ids")
    counts = (
        F.sum(ids).alias("total_orders"),
        F.sum("kept_ids").alias("completed_orders"),
        F.sum("cancelled_ids").alias("cancelled_orders"),
        _sum_where(month == this_month, ids).alias("orders_this_month"),
        _sum_where(month == last_month, ids).alias("orders_last_month"),
        _sum_where(F.col("order_date") == today, ids).alias("orders_today"),
    )
    return _overview_growth(_overview_sums(days, as_of, *counts))


def _overview_growth(overview: DataFrame) -> DataFrame:
    return _stamped(
        overview.withColumns(
            {
                "revenue_mom_growth_pct": growth_percent(
                    F.col("revenue_this_month_usd"), F.col("revenue_last_month_usd")
                ),
                "orders_mom_growth_pct": growth_percent(
                    F.col("orders_this_month"), F.col("orders_last_month")
                ),
            }
        )
    )


#: Columns that need the products ranked.
RANK_COLUMNS = ("revenue_rank", "units_rank", "revenue_percentile", "performance_tier")


def kpi_product_performance(items: DataFrame, orders: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per (platform, product, name, SKU) of non-cancelled orders, ranked per platform.

    A platform's products are ranked over many tasks, whatever their number; the two numberings are
    written to the shared folder while the plan is built (see functions/ranking.py).
    """
    ranked = _ranked(product_metrics(items, orders, as_of))
    tier = (
        F.when(F.col("revenue_rank") <= config.TOP_RANK, "Top 10")
        .when(F.col("revenue_percentile") >= config.TOP_PERCENTILE, "Top Performer")
        .when(F.col("revenue_percentile") >= config.AVERAGE_PERCENTILE, "Average")
        .otherwise("Underperformer")
    )
    return _stamped(ranked.withColumn("performance_tier", tier))


def product_metrics(items: DataFrame, orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Volume, revenue, price and time measures per product.

    The join leaves the rows hash-partitioned by order, so folding a product's lines per order
    and marking each (product, order) once need no further shuffle; that replaces the distinct
    order count. Only the distinct day count is left for the final aggregation.
    """
    keys = ["platform", "product_id", "product_name", "sku"]
    kept = orders.filter(~F.col("is_cancelled")).select("order_id", "platform", "order_date")
    per_order = (
        items.join(kept, ["order_id", "platform"])
        .groupBy(*keys, "order_id", "order_date")
        .agg(
            F.sum("quantity").alias("units"),
            F.sum("line_total").alias("revenue"),
            F.sum("unit_price").alias("price_sum"),
            F.count("unit_price").alias("prices"),
        )
    )
    same_order = W.partitionBy(*keys, "order_id").orderBy("order_date")
    this_month = F.trunc("order_date", "month") == F.trunc(day(as_of), "month")
    days = F.count_distinct("order_date")
    return (
        per_order.withColumn("first_of_order", F.row_number().over(same_order) == 1)
        .groupBy(*keys)
        .agg(
            F.count_if("first_of_order").alias("total_orders"),
            F.sum("units").alias("total_units_sold"),
            F.sum("revenue").alias("total_revenue"),
            (F.sum("price_sum").cast("double") / F.nullif(F.sum("prices"), F.lit(0))).alias(
                "avg_selling_price"
            ),
            days.alias("days_with_sales"),
            F.min("order_date").alias("first_sale_date"),
            F.max("order_date").alias("last_sale_date"),
            _sum_where(this_month, F.col("units")).alias("units_this_month"),
            _sum_where(this_month, F.col("revenue")).alias("revenue_this_month"),
            F.when(days > 0, rounded_ratio(F.sum("units"), days)).otherwise(F.lit(0)).alias(
                "avg_daily_units"
            ),
        )
    )


def _order_by(measure: str) -> list[Column]:
    """Descending by a measure; equal values are ordered by the product key."""
    ties = (F.asc_nulls_last(name) for name in ("product_id", "product_name", "sku"))
    return [F.desc_nulls_first(measure), *ties]


def _ranked(metrics: DataFrame) -> DataFrame:
    by_units = spread_row_number(metrics, "platform", _order_by("total_units_sold"), "units_rank")
    by_both = spread_row_number(
        by_units, "platform", _order_by("total_revenue"), "revenue_rank", size="_size"
    )
    return spread_percent_rank(
        by_both, "platform", "total_revenue", "revenue_rank", "_size", "revenue_percentile"
    )


def kpi_revenue_summary(orders: DataFrame) -> DataFrame:
    """One row per order date and platform with growth and month-to-date totals."""
    return revenue_growth(revenue_days(orders))


def revenue_days(orders: DataFrame) -> DataFrame:
    """The figures of each order date and platform that follow from its own orders.

    Sums fold to a few rows per task before they are shuffled; only the distinct order count moves
    one narrow row per order, so it is kept apart instead of dragging all sums along.
    """
    paid, fulfilled = F.col("is_paid"), F.col("is_fulfilled")
    kept = orders.filter(~F.col("is_cancelled"))
    sums = kept.groupBy("order_date", "platform").agg(
        F.sum("total_amount").alias("gross_revenue"),
        F.sum("total_amount_usd").alias("gross_revenue_usd"),
        F.sum("discount_amount").alias("total_discounts"),
        F.sum(F.col("total_amount") - F.col("discount_amount")).alias("net_revenue"),
        exact_avg(F.col("total_amount")).alias("avg_order_value"),
        exact_avg(F.col("total_amount_usd")).alias("avg_order_value_usd"),
        exact_avg(F.col("item_count")).alias("avg_items_per_order"),
        F.count_if(paid).alias("paid_orders"),
        F.count_if(~paid).alias("unpaid_orders"),
        F.count_if(fulfilled).alias("fulfilled_orders"),
        F.count_if(~fulfilled & paid).alias("pending_fulfillment"),
    )
    counts = kept.groupBy(
        F.col("order_date").alias("_date"), F.col("platform").alias("_platform")
    ).agg(F.count_distinct("order_id").alias("total_orders"))
    same_row = F.col("order_date").eqNullSafe(F.col("_date")) & F.col("platform").eqNullSafe(
        F.col("_platform")
    )
    return sums.join(counts, same_row).drop("_date", "_platform")


def revenue_growth(daily: DataFrame) -> DataFrame:
    """Changes and month-to-date totals; a platform has one row per calendar day."""
    by_date = W.partitionBy("platform").orderBy(F.asc_nulls_last("order_date"))
    in_month = W.partitionBy("platform", F.trunc("order_date", "month")).orderBy(
        F.asc_nulls_last("order_date")
    )
    revenue, previous = F.col("gross_revenue_usd"), F.col("prev_day_revenue")
    return _stamped(
        daily.withColumns(
            {
                "prev_day_revenue": F.lag(revenue).over(by_date),
                "mtd_revenue_usd": F.sum(revenue).over(in_month),
                "mtd_orders": F.sum("total_orders").over(in_month),
            }
        ).withColumns(
            {
                "revenue_change": revenue - previous,
                "revenue_growth_pct": growth_percent(revenue, previous),
            }
        )
    )
