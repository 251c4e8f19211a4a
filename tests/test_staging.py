"""Casts, JSON fields, NULL handling and flags on single rows."""

from __future__ import annotations

from decimal import Decimal
from decimal import Decimal as D

import pytest
from conftest import day, moment
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions import columns as C
from shopmeld.operators import rejects, staging
from shopmeld.operators.intermediate import unified_orders, with_platform_info
from shopmeld.schemas import ORDER_COLUMNS, ORDER_ITEM_COLUMNS, RAW_SCHEMAS
from shopmeld.sources.raw import platform_mappings


def test_column_order_is_shared(raw_rows):
    for model, (table, build) in staging.STAGING.items():
        columns = tuple(build(raw_rows(table)).columns)
        if model.endswith("_orders"):
            assert columns == ORDER_COLUMNS, model
        elif model.endswith("_order_items"):
            assert columns == ORDER_ITEM_COLUMNS, model


def test_no_void_columns(raw_rows):
    for table, build in staging.STAGING.values():
        assert "void" not in dict(build(raw_rows(table)).dtypes).values()


def test_shopify_missing_line_count_is_zero(raw_rows):
    row = staging.stg_shopify_orders(raw_rows("shopify_orders", {"id": 1})).first()
    assert row.order_id == "1" and row.item_count == 0 and row.total_amount is None


def test_first_variant_or_nothing(raw_rows):
    rows = staging.stg_shopify_products(
        raw_rows(
            "shopify_products",
            {"id": 1, "variants": '[{"price":"9.90","sku":"A","inventory_quantity":3},{"price":"1"}]', "images": '[{"src":"u"}]'},
            {"id": 2, "variants": "[]", "images": None},
        )
    ).orderBy("product_id").collect()
    assert (rows[0].price, rows[0].sku, rows[0].inventory_quantity) == (Decimal("9.90"), "A", 3)
    assert rows[0].primary_image_url == "u" and rows[0].compare_at_price is None
    assert rows[1].price is None and rows[1].primary_image_url is None


def test_name_skips_missing_parts(raw_rows):
    names = [
        r.full_name
        for r in staging.stg_shopify_customers(
            raw_rows(
                "shopify_customers",
                {"id": 1, "first_name": "A", "last_name": "B"},
                {"id": 2, "last_name": "B"},
                {"id": 3},
            )
        ).orderBy("customer_id").collect()
    ]
    assert names == ["A B", " B", " "]


def test_amazon_unit_price_without_units(raw_rows):
    rows = staging.stg_amazon_order_items(
        raw_rows(
            "amazon_order_items",
            {"order_item_id": "a", "quantity_ordered": 0, "quantity_shipped": 0, "item_price": '{"Amount":"5.00"}'},
            {"order_item_id": "b", "quantity_ordered": 3, "quantity_shipped": 1, "item_price": '{"Amount":"10.00"}', "promotion_discount": '{"Amount":"1.50"}'},
        )
    ).orderBy("line_item_id").collect()
    assert rows[0].unit_price is None and rows[0].fulfillment_status == "pending"
    assert round(rows[1].unit_price, 6) == Decimal("3.333333")
    assert rows[1].fulfillment_status == "shipped" and rows[1].fulfillable_quantity == 2
    assert rows[0].discount_amount == 0 and rows[1].discount_amount == Decimal("1.50")


def test_amazon_item_count_needs_both_parts(raw_rows):
    rows = staging.stg_amazon_orders(
        raw_rows(
            "amazon_orders",
            {"amazon_order_id": "a", "number_of_items_shipped": 1, "number_of_items_unshipped": 2},
            {"amazon_order_id": "b", "number_of_items_shipped": 1},
        )
    ).orderBy("order_id").collect()
    assert [r.item_count for r in rows] == [3, None]


def test_shopee_times_and_status(raw_rows):
    rows = staging.stg_shopee_orders(
        raw_rows(
            "shopee_orders",
            {"order_sn": "a", "create_time": 0, "update_time": 86400, "order_status": "CANCELLED", "total_amount": Decimal("10"), "estimated_shipping_fee": Decimal("3")},
            {"order_sn": "b", "create_time": 0, "update_time": 60, "order_status": "COMPLETED", "total_amount": Decimal("10")},
            {"order_sn": "c", "create_time": 0, "order_status": "UNPAID", "total_amount": Decimal("10")},
        )
    ).orderBy("order_id").collect()
    assert rows[0].order_created_at == moment("1970-01-01") and rows[0].order_processed_at is None
    assert rows[0].order_cancelled_at == moment("1970-01-02") and rows[0].order_closed_at is None
    assert rows[1].order_closed_at == moment("1970-01-01 00:01:00")
    assert [r.payment_status for r in rows] == ["unknown", "paid", "pending"]
    assert [r.subtotal_amount for r in rows] == [Decimal("7"), Decimal("10"), Decimal("10")]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch_does_not_depend_on_the_session_zone(spark, raw_rows, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = staging.stg_shopee_orders(raw_rows("shopee_orders", {"order_sn": "a", "create_time": 3600})).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.order_created_at == moment("1970-01-01 01:00:00")


def test_shopee_line_id_and_discount(raw_rows):
    row = staging.stg_shopee_order_items(
        raw_rows(
            "shopee_order_items",
            {"order_sn": "S", "item_id": 7, "model_quantity_purchased": 2, "model_original_price": Decimal("11"), "model_discounted_price": Decimal("10")},
        )
    ).first()
    assert (row.line_item_id, row.line_total, row.discount_amount) == ("S_7", Decimal("20"), Decimal("2"))


def test_currency(spark):
    df = spark.createDataFrame(
        [("USD",), ("PHP",), ("MYR",), ("SGD",), ("IDR",), ("EUR",), (None,)], "c string"
    ).select(C.convert_to_usd(F.lit(Decimal("100.00")), F.col("c")).alias("v"))
    assert [float(r.v) for r in df.collect()] == [100, 1.8, 21, 74, 0.0063, 100, 100]


def test_date_and_time_dimensions(spark):
    df = spark.createDataFrame([(moment("2024-05-12 23:30:00"),)], "t timestamp_ntz")
    row = df.select(
        *(c.alias(n) for n, c in {**C.date_dimensions(F.col("t")), **C.time_dimensions(F.col("t"))}.items())
    ).first()
    assert row.order_week == day("2024-05-06") and row.order_quarter == day("2024-04-01")
    assert row.order_year == day("2024-01-01") and row.order_hour == 23
    assert row.order_day_of_week == 0  # a Sunday


def test_flags_of_missing_status_are_false(raw_rows):
    raw = {
        "shopify": raw_rows("shopify_orders", {"id": 1}),
        "amazon": raw_rows("amazon_orders", {"amazon_order_id": "a", "order_status": "Canceled"}),
        "lazada": raw_rows("lazada_orders", {"order_id": 1, "statuses": "canceled"}),
        "shopee": raw_rows("shopee_orders", {"order_sn": "s", "order_status": "SHIPPED"}),
    }
    staged = [staging.STAGING[f"stg_{p}_orders"][1](raw[p]) for p in config.PLATFORMS]
    rows = {r.platform: r for r in unified_orders(staged).collect()}
    assert len(rows) == 4
    assert not rows["shopify"].is_paid and not rows["shopify"].is_fulfilled
    assert not rows["amazon"].is_cancelled and not rows["lazada"].is_cancelled
    assert rows["shopee"].is_paid and not rows["shopee"].is_fulfilled


def test_standard_status(spark):
    df = spark.createDataFrame(
        [("shopify", "paid"), ("amazon", "Canceled"), ("lazada", "shipped"), ("shopee", "READY_TO_SHIP"), ("other", "x"), ("shopee", None)],
        "p string, s string",
    )
    got = [r[0] for r in df.select(C.standardize_status(F.col("p"), F.col("s"))).collect()]
    assert got == ["completed", "cancelled", "shipped", "processing", "x", None]
    assert df.select(C.standardize_status("amazon", F.lit("Shipped"))).first()[0] == "completed"


def test_platform_info_keeps_unknown_platforms(spark, tmp_path):
    df = spark.createDataFrame([("shopee",), ("other",)], "platform string")
    rows = {r.platform: r for r in with_platform_info(df, platform_mappings(spark)).collect()}
    assert rows["shopee"].default_currency == "PHP" and rows["other"].region is None
    platform_mappings(spark).write.option("header", True).csv(str(tmp_path / "seed"))
    from_csv = platform_mappings(spark, str(tmp_path / "seed"))
    assert sorted(from_csv.collect()) == sorted(platform_mappings(spark).collect())


def test_raw_schemas_parse(spark):
    assert len(RAW_SCHEMAS) == 13
    for ddl in RAW_SCHEMAS.values():
        assert spark.createDataFrame([], ddl).columns


def test_payloads_that_cannot_be_read_are_rejected(spark, raw_rows):
    texts = ['{"Amount": "1.50", "CurrencyCode": "USD"}', None, "null", '{"Amount": null}', "{}", '{"Amount": ', "oops", "[1]", '{"Amount": "n/a"}', '{"Amount": "99999999999999"}']
    raw = {
        "amazon_orders": raw_rows("amazon_orders", *({"amazon_order_id": str(i), "order_total": t} for i, t in enumerate(texts))),
        "amazon_order_items": raw_rows("amazon_order_items", {"order_item_id": "a", "item_price": "{", "promotion_discount": '{"Amount": "x"}'}),
        "shopify_products": raw_rows("shopify_products", {"id": 1, "variants": '[{"price": "2"}]', "images": "[]"}, {"id": 2, "variants": '[{"price": "two"}]', "images": "[{"}),
        "shopify_customers": raw_rows("shopify_customers", {"id": 5, "default_address": "{"}, {"id": 6}),
    }
    found = {m: {(r.row_key, r.column_name): r.reason for r in rejects.rejects(raw, m).collect()} for m in rejects.reject_models()}
    assert found == {
        "stg_amazon_orders": {
            **{(i, "order_total"): "unreadable" for i in "567"},
            **{(i, "order_total"): "no number: Amount" for i in "89"},
        },
        "stg_amazon_order_items": {("a", "item_price"): "unreadable", ("a", "promotion_discount"): "no number: Amount"},
        "stg_shopify_products": {("2", "variants"): "no number: price", ("2", "images"): "unreadable"},
        "stg_shopify_customers": {("5", "default_address"): "unreadable"},
    }
    report = {(r.model, r.column_name): r.failures for r in rejects.reject_report(raw).collect()}
    assert report == {(m, p.column): sum(c == p.column for _, c in found[m]) for m in found for p in rejects.PAYLOADS[staging.STAGING[m][0]]}
    readable = rejects.ReadableRaw(raw)
    amounts = {r.order_id: r.total_amount for r in staging.stage(readable, "stg_amazon_orders").collect()}
    assert amounts == {"0": D("1.50"), **{str(i): None for i in range(1, 10)}}
    assert staging.stage(readable, "stg_shopify_products").count() == 2 and len(readable) == len(raw)
