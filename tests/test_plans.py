"""The physical plans hold what the code promises: pruning, pushdown, few shuffles, no Python."""

from __future__ import annotations

import re

import pytest
from conftest import day, moment

from shopmeld.operators import customers, marts, products, profitability
from shopmeld.operators.intermediate import order_items_of, orders_of, with_platform_info
from shopmeld.plans import pipeline
from shopmeld.sources.raw import RawTables, platform_mappings
from shopmeld.sources.synth import synth_raw

NOW = moment("2024-06-30 12:00:00")
AS_OF = day("2024-06-30")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("plans"))
    for name, df in synth_raw(spark, n_orders=50, n_products=10, n_customers=5).items():
        df.write.parquet(f"{base}/{name}")
    return RawTables(spark, base)


@pytest.fixture
def no_broadcast(spark):
    """Plan joins as for large inputs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^\n]*)\)", text)


def read_columns(text: str) -> set[str]:
    return {name for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for name in re.findall(r"(\w+):", schema)}


def test_marts_read_only_what_they_need(raw):
    text = plan(marts.kpi_revenue_summary(orders_of(raw)))
    assert not read_columns(text) & {"email", "shipping_address", "tags", "note", "item_list", "processed_at"}


def test_platform_filter_keeps_one_scan(raw):
    text = plan(orders_of(raw).filter("platform = 'lazada'"))
    assert text.count("FileScan") == 1


@pytest.mark.parametrize("platform,column", [("shopify", "created_at"), ("amazon", "purchase_date"), ("lazada", "created_at"), ("shopee", "create_time")])
def test_time_windows_reach_the_scan(raw, platform, column):
    for df in (
        profitability.platform_profitability(raw, NOW, platform),
        profitability.profitability_comparison(raw, AS_OF, platform),
        products.top_products(raw, NOW, platform),
    ):
        assert f"GreaterThanOrEqual({column}," in plan(df)


def test_comparison_is_one_scan(raw):
    assert plan(profitability.profitability_comparison(raw, AS_OF)).count("FileScan") == 1


def test_no_python_and_no_nested_loops(raw):
    models = pipeline.Models(raw, AS_OF)
    for df in (*models.values(), products.trending_products(raw, NOW), customers.top_customers(raw)):
        text = plan(df)
        assert "Python" not in text and "ArrowEval" not in text
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_product_metrics_fold_on_the_join_partitioning(raw, no_broadcast):
    shuffles = exchanges(plan(marts.product_metrics(order_items_of(raw), orders_of(raw), AS_OF)))
    # Two for the join, one for the distinct days, one for the products.
    assert len(shuffles) == 4
    assert sum(s.startswith("order_id") for s in shuffles) == 2


def test_daily_snapshot_expands_nothing(raw):
    assert "Expand" not in plan(marts.kpi_daily_snapshot(orders_of(raw)))
    assert "Expand" not in plan(marts.kpi_platform_overview(orders_of(raw), AS_OF))


def test_bucketed_tables_join_without_shuffle(spark, raw, no_broadcast):
    pipeline.create_namespaces(spark)
    orders = pipeline.save_bucketed(orders_of(raw), "shop_intermediate.orders", 4)
    items = pipeline.save_bucketed(order_items_of(raw), "shop_intermediate.order_items", 4)
    metrics = marts.product_metrics(items, orders, AS_OF)
    assert not any(s.startswith("order_id") for s in exchanges(plan(metrics)))
    straight = marts.product_metrics(order_items_of(raw), orders_of(raw), AS_OF)
    assert sorted(metrics.collect()) == sorted(straight.collect())


def test_platform_lookup_never_shuffles_orders(spark, raw):
    text = plan(with_platform_info(orders_of(raw), platform_mappings(spark)))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_top_lists_do_not_sort_everything(raw):
    assert "TakeOrderedAndProject" in plan(products.top_products(raw, NOW))
    assert "TakeOrderedAndProject" in plan(customers.top_customers(raw, "amazon"))


def test_product_summary_folds_before_the_products(raw, no_broadcast):
    text = plan(products.product_summary(raw, NOW))
    assert "Expand" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
