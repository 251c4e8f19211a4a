"""Hand-computed marts, ties, NULLs, collisions and the spread ranking."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import day
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopmeld.functions import ranking
from shopmeld.operators import kpis, marts

AS_OF = day("2024-03-31")


def test_daily_counts_and_split(orders_frame):
    rows = marts.kpi_daily_snapshot(
        orders_frame(
            {"id": "1", "platform": "shopify", "date": day("2024-03-01"), "usd": 10, "customer": "a", "fulfilled": True},
            {"id": "1", "platform": "amazon", "date": day("2024-03-01"), "usd": 20, "customer": "1"},
            {"id": "2", "platform": "amazon", "date": day("2024-03-01"), "usd": 30, "customer": None},
            {"id": "2", "platform": "amazon", "date": day("2024-03-01"), "usd": 30, "customer": "a"},
            {"id": None, "platform": "shopee", "date": day("2024-03-01"), "usd": 5, "customer": "a"},
            {"id": "9", "platform": "lazada", "date": day("2024-03-01"), "usd": 99, "cancelled": True},
        )
    ).collect()
    (row,) = rows
    # Id 1 occurs on two platforms but is one order id; customer "1" is not order "1".
    assert row.total_orders == 2 and row.unique_customers == 2
    assert (row.shopify_orders, row.amazon_orders, row.lazada_orders, row.shopee_orders) == (1, 2, 0, 0)
    assert row.total_revenue_usd == 95 and row.amazon_revenue_usd == 80 and row.lazada_revenue_usd == 0
    assert row.avg_order_value_usd == 19 and row.fulfilled_orders == 1
    assert row.fulfillment_rate == Decimal("20.00")


def test_daily_windows_count_rows_not_days(orders_frame):
    dates = [day("2024-01-01") + dt.timedelta(days=3 * i) for i in range(9)]
    rows = marts.kpi_daily_snapshot(
        orders_frame(*({"id": str(i), "date": d, "usd": i + 1} for i, d in enumerate(dates)))
    ).orderBy("order_date").collect()
    assert rows[0].revenue_dod_change is None and rows[6].revenue_wow_change is None
    assert rows[7].revenue_wow_change == 7 and rows[8].orders_wow_change == 0
    assert rows[8].revenue_7d_avg == sum(range(3, 10)) / 7
    assert rows[8].revenue_30d_avg == 5 and rows[8].orders_7d_avg == 1


def test_daily_keeps_orders_without_date(orders_frame):
    rows = marts.kpi_daily_snapshot(
        orders_frame({"id": "1", "date": None}, {"id": "2", "date": day("2024-01-01")})
    ).collect()
    assert {r.order_date: r.total_orders for r in rows} == {None: 1, day("2024-01-01"): 1}


def test_platform_split_adds_up(orders_frame):
    rng = random.Random(5)
    rows = [
        {
            "id": str(rng.randrange(60)),
            "platform": rng.choice(["shopify", "amazon", "lazada", "shopee"]),
            "date": day("2024-01-01") + dt.timedelta(days=rng.randrange(20)),
            "usd": rng.randrange(1, 500),
            "customer": str(rng.randrange(10)),
            "cancelled": rng.random() < 0.2,
        }
        for _ in range(400)
    ]
    frame = orders_frame(*rows)
    daily = marts.kpi_daily_snapshot(frame).collect()
    for row in daily:
        kept = [r for r in rows if r["date"] == row.order_date and not r["cancelled"]]
        assert row.total_orders == len({r["id"] for r in kept})
        assert row.amazon_orders == len({r["id"] for r in kept if r["platform"] == "amazon"})
        assert row.unique_customers == len({r["customer"] for r in kept})
        split = row.shopify_revenue_usd + row.amazon_revenue_usd + row.lazada_revenue_usd + row.shopee_revenue_usd
        assert split == row.total_revenue_usd
    summary = marts.kpi_revenue_summary(frame)
    by_day = {r[0]: r[1] for r in summary.groupBy("order_date").agg(F.sum("gross_revenue_usd")).collect()}
    assert by_day == {r.order_date: r.total_revenue_usd for r in daily}
    month = summary.groupBy("platform").agg(
        F.max_by("mtd_revenue_usd", "order_date").alias("mtd"), F.sum("gross_revenue_usd").alias("total")
    )
    assert all(r.mtd == r.total for r in month.collect())


def test_overview(orders_frame):
    frame = orders_frame(
        {"id": "1", "date": day("2024-03-31"), "usd": 100, "paid": True, "fulfilled": True},
        {"id": "2", "date": day("2024-03-05"), "usd": 50, "cancelled": True},
        {"id": "3", "date": day("2024-02-29"), "usd": 80, "fulfilled": True, "paid": True},
        {"id": "4", "date": day("2024-02-01"), "usd": 20},
        {"id": "5", "platform": "amazon", "date": day("2024-03-31"), "usd": 7, "fulfilled": True},
    )
    rows = {r.platform: r for r in marts.kpi_platform_overview(frame, AS_OF).collect()}
    shop = rows["shopify"]
    assert (shop.total_orders, shop.completed_orders, shop.cancelled_orders) == (4, 3, 1)
    # Orders count cancelled ones, revenue does not; 31 March minus a month is February.
    assert (shop.orders_this_month, shop.orders_last_month, shop.orders_today) == (2, 2, 1)
    assert shop.revenue_this_month_usd == 100 and shop.revenue_last_month_usd == 100
    assert shop.revenue_mom_growth_pct == 0 and shop.orders_mom_growth_pct == 0
    assert shop.payment_rate == 50 and shop.fulfillment_rate == 100 and shop.cancellation_rate == 25
    assert shop.active_days == 4 and shop.first_order_date == day("2024-02-01")
    amazon = rows["amazon"]
    # Nothing paid: no fulfilment rate. No base month: growth 0.
    assert amazon.fulfillment_rate is None and amazon.revenue_mom_growth_pct == 0
    assert shop.avg_order_value_usd == pytest.approx(200 / 3)


def test_overview_order_in_two_states(orders_frame):
    (row,) = marts.kpi_platform_overview(
        orders_frame(
            {"id": "1", "date": day("2024-03-01")},
            {"id": "1", "date": day("2024-02-01"), "cancelled": True},
        ),
        AS_OF,
    ).collect()
    assert (row.total_orders, row.completed_orders, row.cancelled_orders) == (1, 1, 1)
    assert (row.orders_this_month, row.orders_last_month) == (1, 1)


def test_revenue_growth_and_month_to_date(orders_frame):
    rows = marts.kpi_revenue_summary(
        orders_frame(
            {"id": "1", "date": day("2024-01-30"), "usd": 30, "discount": 5},
            {"id": "2", "date": day("2024-01-31"), "usd": 40, "paid": True},
            {"id": "3", "date": day("2024-02-01"), "usd": 0},
            {"id": "4", "date": day("2024-02-02"), "usd": 9, "fulfilled": True},
        )
    ).orderBy("order_date").collect()
    assert [r.mtd_revenue_usd for r in rows] == [30, 70, 0, 9]
    assert [r.mtd_orders for r in rows] == [1, 2, 1, 2]
    assert [r.revenue_growth_pct for r in rows] == [0, Decimal("33.33"), -100, 0]
    assert rows[0].prev_day_revenue is None and rows[0].net_revenue == 25
    assert [r.pending_fulfillment for r in rows] == [0, 1, 0, 0]


def _items(spark, rows):
    schema = """order_id string, platform string, product_id string, product_name string, sku string,
        quantity int, unit_price decimal(23,13), line_total decimal(12,2)"""
    return spark.createDataFrame(
        [(o, p, i, f"n{i}", f"s{i}", q, Decimal(u), Decimal(u) * q) for o, p, i, q, u in rows], schema
    )


def test_products(spark, orders_frame):
    orders = orders_frame(
        {"id": "1", "date": day("2024-03-01")},
        {"id": "2", "date": day("2024-03-01")},
        {"id": "3", "date": day("2024-02-01")},
        {"id": "4", "date": day("2024-03-02"), "cancelled": True},
        {"id": "1", "platform": "amazon", "date": day("2024-03-09")},
    )
    items = _items(
        spark,
        [
            ("1", "shopify", "a", 2, "10"),
            ("1", "shopify", "a", 1, "10"),
            ("2", "shopify", "a", 1, "20"),
            ("3", "shopify", "b", 5, "8"),
            ("4", "shopify", "b", 100, "8"),
            ("9", "shopify", "b", 100, "8"),
            ("1", "amazon", "a", 1, "1"),
        ],
    )
    rows = {
        (r.platform, r.product_id): r
        for r in marts.kpi_product_performance(items, orders, AS_OF).collect()
    }
    a, b = rows["shopify", "a"], rows["shopify", "b"]
    assert (a.total_orders, a.total_units_sold, a.total_revenue, a.days_with_sales) == (2, 4, 50, 1)
    assert a.avg_selling_price == pytest.approx(40 / 3) and a.avg_daily_units == 4
    assert (b.total_orders, b.total_units_sold, b.units_this_month) == (1, 5, 0)
    assert (a.revenue_rank, b.revenue_rank, a.units_rank, b.units_rank) == (1, 2, 2, 1)
    assert (a.revenue_percentile, b.revenue_percentile) == (1.0, 0.0)
    assert rows["amazon", "a"].revenue_percentile == 0.0
    assert a.performance_tier == b.performance_tier == "Top 10"


def test_product_orders_stay_distinct_when_an_order_is_stored_twice(spark, orders_frame):
    orders = orders_frame(
        {"id": "1", "date": day("2024-03-01")},
        {"id": "1", "date": day("2024-03-02")},
        {"id": "1", "date": day("2024-03-02")},
    )
    (row,) = marts.product_metrics(_items(spark, [("1", "shopify", "a", 2, "10")]), orders, AS_OF).collect()
    assert (row.total_orders, row.days_with_sales, row.total_units_sold) == (1, 2, 6)


def test_spread_ranking_equals_windows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        group = "big" if rng.random() < 0.7 else rng.choice(["x", "y", "z"])
        # A third of all rows share one value; some have none.
        value = 5 if rng.random() < 0.33 else rng.choice([None, *range(200)])
        rows.append((group, f"p{i:05d}", value))
    rows.append(("single", "p", 1))
    df = spark.createDataFrame(rows, "g string, k string, v int").repartition(7)
    order = [F.desc_nulls_first("v"), F.asc("k")]
    ranked = ranking.spread_row_number(df, "g", order, "rn", size="n")
    ranked = ranking.spread_percent_rank(ranked, "g", "v", "rn", "n", "pr")
    w = W.partitionBy("g")
    expected = df.withColumns(
        {
            "rn": F.row_number().over(w.orderBy(*order)),
            "pr": F.percent_rank().over(w.orderBy(F.asc_nulls_last("v"))),
        }
    )
    columns = ["g", "k", "v", "rn", "pr"]
    assert sorted(ranked.select(columns).collect(), key=repr) == sorted(expected.select(columns).collect(), key=repr)


def test_kpi_reads(orders_frame):
    frame = orders_frame(
        *(
            {"id": f"{p}{i}", "platform": p, "date": AS_OF - dt.timedelta(days=i), "usd": 10 * (i + 1)}
            for p in ("shopify", "lazada")
            for i in range(40)
        )
    )
    daily, revenue = marts.kpi_daily_snapshot(frame), marts.kpi_revenue_summary(frame)
    dates = [r.order_date for r in kpis.daily_snapshots(daily, AS_OF, limit=7).collect()]
    assert dates == [AS_OF - dt.timedelta(days=i) for i in range(7)]
    ranged = kpis.daily_snapshots(daily, AS_OF, start=day("2024-03-30"), end=day("2024-03-31"))
    assert ranged.count() == 2
    rows = kpis.revenue_by_platform(revenue, AS_OF).collect()
    assert len(rows) == 62 and [r.platform for r in rows[:2]] == ["lazada", "shopify"]
    assert kpis.revenue_by_platform(revenue, AS_OF, platform="lazada").count() == 31
    assert kpis.today_summary(daily, AS_OF).count() == 1
    assert kpis.today_summary(daily, day("2030-01-01")).count() == 0
    for limit in (0, 366):
        with pytest.raises(ValueError):
            kpis.daily_snapshots(daily, AS_OF, limit=limit)


def test_dashboard_rounds_half_even_and_nests(orders_frame):
    # 12.125 and 0.375 are exact ties at two digits.
    frame = orders_frame(
        {"id": "1", "date": AS_OF, "usd": "8.00", "platform": "amazon"},
        *({"id": f"s{i}", "date": day("2024-02-01"), "usd": "8.00"} for i in range(8)),
        {"id": "2", "date": day("2024-03-02"), "usd": "56.01"},
    )
    overview = marts.kpi_platform_overview(frame, AS_OF)
    summary = kpis.dashboard_summary(overview, marts.kpi_daily_snapshot(frame), AS_OF).first()
    assert summary.total_revenue_usd == Decimal("128.01") and summary.total_orders == 10
    assert summary.avg_order_value_usd == Decimal("12.80")
    # (64.01 - 64) / 64 = 0.015625 %, 0.02 either way; orders: (2 - 8) / 8.
    assert summary.revenue_growth_pct == Decimal("0.02") and summary.orders_growth_pct == Decimal("-75.00")
    assert [p.platform for p in summary.platforms] == ["shopify", "amazon"]
    assert [d.order_date for d in summary.recent_days] == [AS_OF]
    assert summary.total_customers == 0


def test_empty_dashboard(orders_frame):
    frame = orders_frame()
    row = kpis.dashboard_summary(
        marts.kpi_platform_overview(frame, AS_OF), marts.kpi_daily_snapshot(frame), AS_OF
    ).first()
    assert row.total_orders == 0 and row.avg_order_value_usd == 0 and row.platforms == []
    assert row.revenue_growth_pct == 0 and row.recent_days == []
