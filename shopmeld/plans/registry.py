"""Every operator as a query over the driver's tables, under a fixed clock."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FloatType, IntegerType, ShortType

from shopmeld import config
from shopmeld.functions import columns as C
from shopmeld.functions.scratch import scratch_dir
from shopmeld.operators import (
    adhoc,
    customers,
    formatting,
    kpis,
    locations,
    marts,
    products,
    profitability,
    quality,
    rejects,
)
from shopmeld.operators.intermediate import order_items_of, orders_of, with_platform_info
from shopmeld.operators.staging import STAGING, stage
from shopmeld.plans import incremental, pipeline
from shopmeld.schemas import RAW_SCHEMAS
from shopmeld.sources.fixture import DerivedRawTables
from shopmeld.sources.raw import platform_mappings
from shopmeld.streaming import landing, live

AS_OF = dt.date(2001, 7, 15)
NOW = dt.datetime(2001, 7, 15, 12)

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Types both engines share: decimals as double, integers as bigint, build stamps left out.

    Decimals of more than eight digits behind the point are quotients; six digits are compared.
    """

    def column(field):
        value = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            value = F.round(value, 6) if field.dataType.scale > 8 else value
            return value.cast("double").alias(field.name)
        if isinstance(field.dataType, (IntegerType, ShortType)):
            return value.cast("bigint").alias(field.name)
        if isinstance(field.dataType, FloatType):
            return value.cast("double").alias(field.name)
        return value

    return df.select(*(column(f) for f in df.schema if f.name not in config.STAMP_COLUMNS))


class Shop:
    """The relations of one data directory, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = DerivedRawTables(spark, sf_dir)

    @cached_property
    def orders(self) -> DataFrame:
        return orders_of(self.raw)

    @cached_property
    def items(self) -> DataFrame:
        return order_items_of(self.raw)

    @property
    def daily(self) -> DataFrame:
        return marts.kpi_daily_snapshot(self.orders)

    @property
    def overview(self) -> DataFrame:
        return marts.kpi_platform_overview(self.orders, AS_OF)

    @property
    def revenue(self) -> DataFrame:
        return marts.kpi_revenue_summary(self.orders)

    @property
    def products(self) -> DataFrame:
        return marts.kpi_product_performance(self.items, self.orders, AS_OF)

    @property
    def dashboard(self) -> DataFrame:
        models = pipeline.Models(self.raw, AS_OF, share_facts=True)
        return kpis.dashboard_summary(models["kpi_platform_overview"], models["kpi_daily_snapshot"], AS_OF)

    @property
    def mappings(self) -> DataFrame:
        return platform_mappings(self.spark)

    def new_folder(self) -> str:
        return f"{scratch_dir(self.spark)}/{uuid.uuid4().hex}"


def _listed(rows: str, *texts: str, separator: str) -> Column:
    """A nested list of rows as one text, for comparison across engines."""
    return F.array_join(
        F.transform(rows, lambda row: F.concat_ws(":", *(row[t].cast("string") for t in texts))), separator
    )


def _dashboard_summary(shop: Shop) -> DataFrame:
    return shop.dashboard.withColumns(
        {
            "platforms": _listed("platforms", "platform", "total_orders", separator=","),
            "recent_days": _listed("recent_days", "order_date", "total_orders", separator=","),
        }
    )


def _fmt_dashboard(shop: Shop) -> DataFrame:
    texts = ("platform", "total_revenue_formatted", "revenue_this_month_formatted", "revenue_today_formatted")
    return formatting.formatted_dashboard(shop.dashboard).select(
        "total_revenue_formatted",
        "avg_order_value_formatted",
        _listed("platforms", *texts, separator=";").alias("platforms"),
    )


def _fmt_platforms(shop: Shop) -> DataFrame:
    formatted = formatting.formatted_platforms(shop.overview, shop.mappings)
    return formatted.select(
        "platform", *(c for c in formatted.columns if c.endswith("_formatted")), "platform_name"
    )


def _standardized(shop: Shop) -> DataFrame:
    platform = F.col("platform")
    status = F.when(platform == "shopify", F.col("payment_status")).otherwise(F.col("fulfillment_status"))
    return shop.orders.select(
        "order_id", platform, status.alias("status"), C.standardize_status(platform, status).alias("standard_status")
    )


def _platform_info(shop: Shop) -> DataFrame:
    return with_platform_info(shop.orders.select("order_id", "platform"), shop.mappings)


def _guarded_sql(shop: Shop) -> DataFrame:
    pipeline.register_views({"int_unified_orders": shop.orders})
    return adhoc.run_sql(
        shop.spark,
        """SELECT platform, currency_code, count(*) AS orders, sum(total_amount) AS gross_amount,
            max(order_updated_at) AS updated_at
        FROM int_unified_orders GROUP BY platform, currency_code""",
    )


def _bound_sql(shop: Shop) -> DataFrame:
    pipeline.register_views({"int_unified_orders": shop.orders})
    return adhoc.run_sql(
        shop.spark,
        """SELECT platform, count(*) AS orders, sum(total_amount) AS gross_amount
        FROM int_unified_orders WHERE platform = :platform AND order_date >= :start
        GROUP BY platform""",
        args={"platform": "lazada", "start": dt.date(2000, 1, 1)},
    )


def _table_preview(shop: Shop) -> DataFrame:
    rows = profitability.profitability_by_platform(shop.raw)
    rows.createOrReplaceGlobalTempView("profitability_by_platform")
    return adhoc.preview_table(shop.spark, "global_temp", "profitability_by_platform")


def _dq_suite(shop: Shop) -> DataFrame:
    return quality.run_quality_suite(pipeline.Models(shop.raw, AS_OF, share_facts=True))


def _dq_observed(shop: Shop) -> DataFrame:
    """The suite counted while the marts are written."""
    report = quality.Report()
    run = pipeline.run_models(shop.raw, AS_OF, warehouse=shop.new_folder(), report=report)
    return report.result(run)


def _model_row_counts(shop: Shop) -> DataFrame:
    """A full run with the marts stored, then the size of every model through its SQL view."""
    models = pipeline.run_models(shop.raw, AS_OF, warehouse=shop.new_folder())
    counts = (f"SELECT '{name}' AS model, count(*) AS n_rows FROM {name}" for name in models)
    return shop.spark.sql(" UNION ALL ".join(counts))


def _stored_marts(shop: Shop) -> DataFrame:
    """A run of one mart with the canonical relations stored as well."""
    models = pipeline.run_models(
        shop.raw, AS_OF, warehouse=shop.new_folder(), select="revenue", store_intermediate=True
    )
    return models["kpi_revenue_summary"]


def _live_daily_revenue(shop: Shop) -> DataFrame:
    """The order stream run until it is drained; the published state is returned."""
    stream = orders_of(DerivedRawTables(shop.spark, shop.sf_dir, streaming=True))
    target = shop.new_folder()
    live.live_daily_revenue(stream, target, shop.new_folder(), refresh=None).awaitTermination()
    return live.live_result(shop.spark, target).drop("approx_buyers")


def order_loads(orders: DataFrame) -> list[DataFrame]:
    """Order versions in four loads: all orders; pending ones changed two days later; stale versions of all;
    shipped ones cancelled three days later."""

    def load(condition: str, days: int, **columns: Column) -> DataFrame:
        moved = F.col("order_updated_at") + F.make_dt_interval(days=F.lit(days))
        return live.order_versions(orders.filter(condition).withColumns({"order_updated_at": moved, **columns}))

    usd = F.col("total_amount_usd")
    return [
        load("true", 0),
        load("payment_status = 'pending'", 2, total_amount_usd=usd * 2, item_count=F.col("item_count") + 1),
        load("true", -1, total_amount_usd=F.lit(1)),
        load("fulfillment_status IN ('shipped', 'SHIPPED', 'Shipped')", 3, is_cancelled=F.lit(True)),
    ]


def _live_corrected_revenue(shop: Shop) -> DataFrame:
    """The loads arrive one after the other; each is drained by a stream that resumes from its checkpoint."""
    source, target, checkpoint = shop.new_folder(), shop.new_folder(), shop.new_folder()
    for load in order_loads(shop.orders):
        load.write.mode("append").parquet(source)
        stream = shop.spark.readStream.schema(load.schema).parquet(source)
        live.live_corrected_revenue(stream, target, checkpoint, refresh=None).awaitTermination()
    return live.live_result(shop.spark, target)


def changed_loads(raw: Mapping[str, DataFrame]) -> list[dict[str, DataFrame]]:
    """Raw orders in four loads: all; Shopify's pending ones paid at twice the price; Lazada's shipped ones
    delivered and moved forty days on; Shopee's all as they were before, at no amount."""

    def moved(column: str, days: int) -> Column:
        return F.col(column) + F.make_dt_interval(days=F.lit(days))

    shopify, lazada, shopee = (raw[f"{p}_orders"] for p in ("shopify", "lazada", "shopee"))
    paid = {"financial_status": F.lit("paid"), "updated_at": moved("updated_at", 1), "total_price": (F.col("total_price") * 2).cast("decimal(12,2)")}
    delivered = {"statuses": F.lit("delivered"), "updated_at": moved("updated_at", 50), "created_at": moved("created_at", 40)}
    return [
        {f"{p}_orders": raw[f"{p}_orders"] for p in config.PLATFORMS},
        {"shopify_orders": shopify.filter("financial_status = 'pending'").withColumns(paid)},
        {"lazada_orders": lazada.filter("statuses = 'shipped'").withColumns(delivered)},
        {"shopee_orders": shopee.withColumns({"update_time": F.col("update_time") - 1, "total_amount": F.lit(0).cast("decimal(12,2)")})},
    ]


def spoiled(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw tables with payloads cut off (cancelled Amazon orders, one of each size of order lines) or without
    a number (pending Amazon orders)."""
    total, status = F.col("order_total"), F.col("order_status")
    orders = F.when(status == "Canceled", F.substring(total, 1, 7)).when(
        status == "Pending", F.lit('{"Amount": "n/a", "CurrencyCode": "USD"}')
    )
    lines = F.when(F.col("quantity_ordered") >= 40, F.substring("item_price", 1, 7)).otherwise(F.col("item_price"))
    return dict(raw) | {
        "amazon_orders": raw["amazon_orders"].withColumn("order_total", orders.otherwise(total)),
        "amazon_order_items": raw["amazon_order_items"].withColumn("item_price", lines),
    }


def _staging_rejects(shop: Shop) -> DataFrame:
    raw = spoiled(shop.raw)
    found = (rejects.rejects(raw, model) for model in rejects.reject_models())
    return reduce(DataFrame.unionByName, found).groupBy("model", "column_name", "reason").agg(F.count("*").alias("n_rows"))


def _staged_with_rejects(shop: Shop) -> DataFrame:
    """Orders of spoiled payloads are staged without their amounts."""
    staged = stage(rejects.ReadableRaw(spoiled(shop.raw)), "stg_amazon_orders")
    return staged.groupBy("fulfillment_status").agg(
        F.count("*").alias("orders"), F.count("total_amount").alias("amounts"), F.sum("total_amount").alias("total_amount")
    )


def _incremental(shop: Shop, name: str) -> DataFrame:
    """The loads land one after the other, and the marts are brought up to date after each."""
    landed = shop.new_folder()
    kept = incremental.IncrementalMarts(shop.spark, landed, shop.new_folder(), slot="month")
    for batch, load in enumerate(changed_loads(shop.raw)):
        for table, rows in load.items():
            landing.land_batch(rows, landed, table, batch)
        kept.refresh()
    return kept.marts(AS_OF)[name]


def _upsert_raw(shop: Shop) -> DataFrame:
    """All Shopify orders land, then a second load pays the pending ones; the newest rows win."""
    table, target, checkpoint = "shopify_orders", shop.new_folder(), shop.new_folder()
    first = DerivedRawTables(shop.spark, shop.sf_dir, streaming=True)[table]
    paid = first.filter(F.col("financial_status") == "pending").withColumns(
        {
            "financial_status": F.lit("paid"),
            "updated_at": F.col("updated_at") + F.make_dt_interval(days=F.lit(1)),
        }
    )
    landing.upsert_raw(first.unionByName(paid), target, table, checkpoint).awaitTermination()
    return landing.current_rows(shop.spark, target, table).select(
        "id", "updated_at", "financial_status", "total_price"
    )


def _upsert_items(shop: Shop) -> DataFrame:
    """All Lazada order lines land, then a second load returns some of them; the later batch wins.

    The derived lines repeat ids; within a batch the largest row of an id stands.
    """
    table, target, checkpoint = "lazada_order_items", shop.new_folder(), shop.new_folder()
    source = shop.new_folder()
    lines = DerivedRawTables(shop.spark, shop.sf_dir)[table]
    returned = lines.filter(F.col("status") == "delivered").withColumn("status", F.lit("returned"))
    for load in (lines, returned):
        load.write.mode("append").parquet(source)
        stream = shop.spark.readStream.schema(RAW_SCHEMAS[table]).parquet(source)
        landing.upsert_raw(stream, target, table, checkpoint).awaitTermination()
    return landing.current_rows(shop.spark, target, table)


def _builders() -> dict[str, Callable[[Shop], DataFrame]]:
    found: dict[str, Callable[[Shop], DataFrame]] = {}
    for name in STAGING:
        found[name] = lambda s, name=name: stage(s.raw, name)
    unified = {
        "currency_conversion": "order_id platform currency_code total_amount total_amount_usd",
        "date_dims": "order_id platform order_date order_week order_month order_quarter order_year",
        "time_dims": "order_id platform order_hour order_day_of_week",
        "status_flags": "order_id platform is_paid is_fulfilled is_cancelled",
    }
    for name, wanted in unified.items():
        found[name] = lambda s, wanted=wanted: s.orders.select(*wanted.split())
    found |= {
        "int_unified_orders": lambda s: s.orders,
        "int_unified_order_items": lambda s: s.items,
        "status_standardized": _standardized,
        "platform_info": _platform_info,
        "kpi_daily_snapshot": lambda s: s.daily,
        "kpi_platform_overview": lambda s: s.overview,
        "kpi_product_performance": lambda s: s.products,
        "kpi_product_performance_spread": lambda s: s.products,
        "kpi_revenue_summary": lambda s: s.revenue,
        "platform_overview": lambda s: kpis.platform_overview(s.overview),
        "daily_snapshots": lambda s: kpis.daily_snapshots(s.daily, AS_OF),
        "revenue_by_platform": lambda s: kpis.revenue_by_platform(s.revenue, AS_OF),
        "revenue_by_platform_shopee": lambda s: kpis.revenue_by_platform(s.revenue, AS_OF, "shopee"),
        "product_performance": lambda s: kpis.product_performance(s.products),
        "product_performance_tier": lambda s: kpis.product_performance(
            s.products, "lazada", "Top Performer"
        ),
        "dashboard_summary": _dashboard_summary,
        "today_summary": lambda s: kpis.today_summary(s.daily, AS_OF),
        "category_performance": lambda s: products.category_performance(s.raw, NOW),
        "product_summary": lambda s: products.product_summary(s.raw, NOW),
        "trending_products": lambda s: products.trending_products(s.raw, NOW),
        "customer_segments": lambda s: customers.customer_segments(s.raw["shopify_customers"]),
        "customer_cohorts": lambda s: customers.customer_cohorts(s.raw["shopify_customers"]),
        "customer_retention": lambda s: customers.customer_retention(s.raw["shopify_customers"]),
        "profitability_by_platform": lambda s: profitability.profitability_by_platform(s.raw),
        "profitability_summary": lambda s: profitability.profitability_summary(
            profitability.profitability_by_platform(s.raw)
        ),
        "guarded_sql": _guarded_sql,
        "bound_sql": _bound_sql,
        "table_preview": _table_preview,
        "dq_unique": lambda s: quality.dq_unique(s.items, "line_item_id"),
        "dq_not_null": lambda s: quality.dq_not_null(stage(s.raw, "stg_shopify_products"), "category").select(
            "product_id", "platform", "product_name"
        ),
        "dq_accepted_values": lambda s: quality.dq_accepted_values(
            s.orders, "fulfillment_status", config.FULFILLED_STATUSES
        ),
        "dq_suite": _dq_suite,
        "dq_readable": lambda s: rejects.reject_report(spoiled(s.raw)),
        "staging_rejects": _staging_rejects,
        "staged_with_rejects": _staged_with_rejects,
        "dq_observed": _dq_observed,
        "fmt_platforms": _fmt_platforms,
        "fmt_dashboard": _fmt_dashboard,
        "model_row_counts": _model_row_counts,
        "stored_marts": _stored_marts,
        "live_daily_revenue": _live_daily_revenue,
        "live_corrected_revenue": _live_corrected_revenue,
        "incremental_revenue_summary": lambda s: _incremental(s, "kpi_revenue_summary"),
        "incremental_daily_snapshot": lambda s: _incremental(s, "kpi_daily_snapshot"),
        "incremental_platform_overview": lambda s: _incremental(s, "kpi_platform_overview"),
        "upsert_raw": _upsert_raw,
        "upsert_items": _upsert_items,
    }
    per_platform: dict[str, Callable[[Shop, str], DataFrame]] = {
        "top_products": lambda s, p: products.top_products(s.raw, NOW, p),
        "customer_summary": lambda s, p: customers.customer_summary(s.raw, p),
        "top_customers": lambda s, p: customers.top_customers(s.raw, p),
        "customer_acquisition": lambda s, p: customers.customer_acquisition(s.raw, NOW, p),
        "by_country": lambda s, p: locations.by_country(s.raw, p),
        "by_city": lambda s, p: locations.by_city(s.raw, p),
        "location_summary": lambda s, p: locations.location_summary(
            locations.by_country(s.raw, p, ranked=True), locations.by_city(s.raw, p, ranked=True), p
        ),
        "platform_profitability": lambda s, p: profitability.platform_profitability(s.raw, NOW, p),
        "platform_profitability_daily": lambda s, p: profitability.platform_profitability_daily(
            s.raw, NOW, p
        ),
        "profitability_comparison": lambda s, p: profitability.profitability_comparison(s.raw, AS_OF, p),
    }
    for name, build in per_platform.items():
        for platform in config.PLATFORMS:
            found[f"{name}_{platform}"] = lambda s, build=build, platform=platform: build(s, platform)
    for platform in config.PLATFORMS[1:]:
        found[f"top_products_rollup_{platform}"] = lambda s, platform=platform: products.top_products_rollup(
            products.top_products(s.raw, NOW, platform), platform
        )
    return found


def queries() -> dict[str, Query]:
    """Query name -> callable(spark, data directory) -> DataFrame."""

    def query(build: Callable[[Shop], DataFrame]) -> Query:
        return lambda spark, sf_dir: plain(build(Shop(spark, sf_dir)))

    return {name: query(build) for name, build in _builders().items()}
