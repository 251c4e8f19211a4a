"""Products, customers, places and profitability on small raw tables."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from conftest import day, moment

from shopmeld.operators import customers, locations, products, profitability

NOW = moment("2024-05-15 12:00:00")


@pytest.fixture(scope="module")
def raw(raw_rows):
    recent, last_week, old = moment("2024-05-14"), moment("2024-05-05"), moment("2024-01-01")
    return {
        "shopify_orders": raw_rows(
            "shopify_orders",
            {"id": 1, "created_at": recent, "total_price": D("30"), "subtotal_price": D("28"), "total_tax": D("2"), "total_discounts": D("3")},
            {"id": 2, "created_at": last_week, "total_price": D("10"), "subtotal_price": D("9"), "total_tax": D("1"), "total_discounts": D("0")},
            {"id": 3, "created_at": old, "total_price": D("5"), "total_discounts": D("1")},
            {"id": 4, "created_at": recent, "total_price": D("99"), "total_discounts": D("9"), "cancelled_at": recent},
        ),
        "shopify_order_line_items": raw_rows(
            "shopify_order_line_items",
            {"id": 1, "order_id": 1, "product_id": 1, "quantity": 2, "price": D("10")},
            {"id": 2, "order_id": 1, "product_id": 1, "quantity": 1, "price": D("10")},
            {"id": 3, "order_id": 2, "product_id": 1, "quantity": 1, "price": D("20")},
            {"id": 4, "order_id": 1, "product_id": 2, "quantity": 1, "price": D("7")},
            {"id": 5, "order_id": 3, "product_id": 2, "quantity": 9, "price": D("7")},
            {"id": 6, "order_id": 1, "product_id": 99, "quantity": 9, "price": D("7")},
        ),
        "shopify_products": raw_rows(
            "shopify_products",
            {"id": 1, "title": "A", "product_type": "Toys", "vendor": "V"},
            {"id": 2, "title": "B", "product_type": "", "vendor": None},
            {"id": 3, "title": "C", "product_type": "Uncategorized"},
        ),
        "amazon_orders": raw_rows(
            "amazon_orders",
            {"amazon_order_id": "a", "purchase_date": recent, "buyer_email": "x", "order_total": '{"Amount":"10.00"}', "shipping_address": '{"City":"Rome","CountryCode":"IT"}'},
            {"amazon_order_id": "b", "purchase_date": recent, "buyer_email": "x", "order_total": '{"Amount":"5.00"}', "shipping_address": '{"city":"Rome"}'},
            {"amazon_order_id": "c", "purchase_date": old, "buyer_email": None, "order_total": '{"Amount":"1.00"}'},
        ),
        "lazada_orders": raw_rows(
            "lazada_orders", {"order_id": 1, "created_at": recent, "buyer_email": "q", "price": D("4"), "voucher": None}
        ),
        "lazada_order_items": raw_rows(
            "lazada_order_items",
            {"order_item_id": 1, "order_id": 1, "name": "N", "sku": None, "paid_price": D("4")},
            {"order_item_id": 2, "order_id": 1, "name": "N", "sku": None, "paid_price": D("6")},
        ),
        "shopee_orders": raw_rows(
            "shopee_orders",
            {"order_sn": "s", "create_time": 1715644800, "buyer_username": "u", "total_amount": D("8"), "voucher_absorbed": D("2")},
        ),
        "shopify_customers": raw_rows(
            "shopify_customers",
            {"id": 1, "email": "a", "first_name": "A", "last_name": "B", "orders_count": 1, "total_spent": D("1000"), "created_at": recent, "default_address": '{"city":"Rome","country":"IT"}'},
            {"id": 2, "email": "b", "orders_count": 3, "total_spent": D("99.99"), "created_at": old, "default_address": '{"city":"Oslo"}'},
            {"id": 3, "email": "c", "orders_count": None, "total_spent": D("0"), "created_at": None},
            {"id": 4, "email": "d", "orders_count": 0, "total_spent": None, "created_at": recent},
        ),
    }


def test_top_products(raw):
    rows = products.top_products(raw, NOW).collect()
    assert [(r.product_name, r.total_orders, r.units_sold, r.total_revenue) for r in rows] == [
        ("A", 2, 4, D("50.00")),
        ("B", 1, 1, D("7.00")),
    ]
    assert rows[0].avg_price == pytest.approx(40 / 3)
    assert (rows[1].category, rows[1].vendor) == ("Uncategorized", "Unknown")


def test_categories_and_summary(raw):
    rows = [(r.category, r.product_count, r.units_sold) for r in products.category_performance(raw, NOW).collect()]
    assert rows == [("Toys", 1, 4), ("", 1, 1)]
    summary = products.product_summary(raw, NOW).first()
    assert (summary.total_products, summary.orders_with_products, summary.total_units_sold) == (2, 2, 5)
    assert summary.avg_item_value == 57 / 4 and summary.period_days == 30


def test_marketplace_products_and_rollup(raw):
    top = products.top_products(raw, NOW, "Lazada")
    (row,) = top.collect()
    assert (row.vendor, row.total_orders, row.units_sold, row.total_revenue, row.avg_price) == ("Unknown", 1, 2, 10, 5)
    rollup = products.top_products_rollup(top, "lazada").first()
    assert (rollup.total_products, rollup.avg_item_value, rollup.category) == (1, 10, "Lazada Products")
    empty = products.top_products_rollup(top.filter("false"), "lazada").first()
    assert (empty.total_products, empty.total_revenue, empty.avg_item_value) == (0, 0, 0)


def test_trending(raw):
    rows = {r.product_name: r for r in products.trending_products(raw, NOW).collect()}
    assert (rows["A"].current_revenue, rows["A"].previous_revenue, rows["A"].growth_pct) == (30, 20, 50)
    assert (rows["B"].previous_units, rows["B"].growth_pct) == (0, 100)


def test_customers(raw):
    table = raw["shopify_customers"]
    summary = customers.customer_summary(raw).first()
    assert (summary.total_customers, summary.customers_with_orders) == (4, 2)
    assert summary.avg_orders_per_customer == pytest.approx(4 / 3)
    segments = {r.segment: r.customer_count for r in customers.customer_segments(table).collect()}
    assert segments == {"VIP": 1, "Low Value": 1, "No Purchases": 2}
    assert [r.cohort_month for r in customers.customer_cohorts(table).collect()] == ["2024-05", "2024-01"]
    kinds = {r.customer_type: r["count"] for r in customers.customer_retention(table).collect()}
    assert kinds == {"New": 2, "Returning": 1, "Loyal": 1}
    top = customers.top_customers(raw).collect()
    # No amount sorts first, as the source database does.
    assert [(r.email, r.total_spent) for r in top[:2]] == [("d", 0), ("a", 1000)]
    assert (top[1].name, top[1].customer_since, top[0].name) == ("A B", "2024-05-14", " ")


def test_buyers(raw):
    summary = customers.customer_summary(raw, "amazon").first()
    assert (summary.total_customers, summary.avg_orders_per_customer, summary.avg_lifetime_value) == (1, 3, 16)
    rows = customers.top_customers(raw, "amazon").collect()
    assert [(r.name, r.email, r.orders_count) for r in rows] == [("x", "x", 2), ("Unknown", None, 1)]
    assert customers.top_customers(raw, "shopee").first().customer_since == "2024-05-14"


def test_acquisition(raw):
    assert [tuple(r) for r in customers.customer_acquisition(raw, NOW).collect()] == [("2024-05-14", 2)]
    assert [tuple(r) for r in customers.customer_acquisition(raw, NOW, "amazon").collect()] == [("2024-05-14", 1)]
    assert [tuple(r) for r in customers.customer_acquisition(raw, NOW, "shopee").collect()] == [("2024-05-14", 1)]


def test_places(raw):
    assert [(r.country, r.customer_count) for r in locations.by_country(raw).collect()] == [("IT", 1), ("Unknown", 1)]
    assert [(r.city, r.country) for r in locations.by_city(raw, "amazon").collect()] == [("Rome", "IT"), ("Unknown", "Unknown")]
    assert locations.by_country(raw, "shopee").first().country == "Southeast Asia"
    summary = locations.location_summary(locations.by_country(raw, ranked=True), locations.by_city(raw, ranked=True), "shopify").first()
    assert tuple(summary) == (2, 2, "IT", "Rome", "shopify")
    nothing = locations.by_country(raw, ranked=True).filter("false"), locations.by_city(raw, ranked=True).filter("false")
    assert tuple(locations.location_summary(*nothing, "shopify").first()) == (0, 0, "N/A", "N/A", "shopify")


def test_profitability(raw):
    by_platform = profitability.profitability_by_platform(raw)
    rows = {r.platform: r for r in by_platform.collect()}
    assert (rows["shopify"].gross_revenue, rows["shopify"].orders) == (45, 3)
    assert rows["amazon"].discounts == 0 and rows["lazada"].discounts == 0
    summary = profitability.profitability_summary(by_platform).first()
    assert (summary.gross_revenue, summary.total_discounts, summary.net_revenue, summary.total_orders) == (73, 6, 67, 8)
    shop = profitability.platform_profitability(raw, NOW, "shopify").first()
    assert (shop.gross_revenue, shop.subtotal, shop.net_revenue, shop.total_orders) == (40, 37, 37, 2)
    # Without any discount the net revenue is reported as 0.
    assert profitability.platform_profitability(raw, NOW, "amazon").first().net_revenue == 0
    daily = profitability.platform_profitability_daily(raw, NOW, "shopify").collect()
    assert [(r.date, r.gross_revenue) for r in daily] == [("2024-05-05", 10), ("2024-05-14", 30)]


@pytest.mark.parametrize("platform,expected", [("shopify", {"yesterday": 30, "this_week": 30, "this_month": 40}), ("shopee", {"yesterday": 8, "this_week": 8, "this_month": 8})])
def test_comparison(raw, platform, expected):
    rows = {r.period: r for r in profitability.profitability_comparison(raw, day("2024-05-15"), platform).collect()}
    assert set(rows) == {"today", "yesterday", "this_week", "last_week", "this_month", "last_month"}
    assert {p: rows[p].revenue for p in expected} == expected
    assert (rows["today"].revenue, rows["today"].orders, rows["last_month"].discounts) == (0, 0, 0)


def test_periods_across_a_year():
    periods = profitability.comparison_periods(day("2024-01-01"))
    assert periods["last_month"] == (day("2023-12-01"), day("2024-01-01"))
    assert periods["last_week"] == (day("2023-12-25"), day("2024-01-01"))


def test_unknown_platform(raw):
    with pytest.raises(ValueError):
        locations.by_city(raw, "ebay")


def test_place_without_amounts_leads_and_amounts_are_not_rounded(raw_rows):
    customers_raw = raw_rows(
        "shopify_customers",
        {"id": 1, "default_address": '{"city": "A", "country": "AA"}'},
        {"id": 2, "default_address": '{"city": "B", "country": "BB"}', "total_spent": D("5")},
    )
    orders = raw_rows(
        "amazon_orders",
        *({"amazon_order_id": x, "order_total": '{"Amount": "10.005"}', "shipping_address": '{"CountryCode": "IT"}'} for x in "ab"),
    )
    raw = {"shopify_customers": customers_raw, "amazon_orders": orders}
    listings = locations.by_country(raw, ranked=True), locations.by_city(raw, ranked=True)
    assert locations.location_summary(*listings, "shopify").first()[2:4] == ("AA", "A")
    assert locations.by_country(raw, "amazon").first().total_revenue == D("20.01")
