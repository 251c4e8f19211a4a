"""Marts from landed batches against full refreshes; the commit log; observed checks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as D

import pytest
from conftest import day, moment
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions.commits import CommitLog
from shopmeld.operators import quality
from shopmeld.plans import pipeline
from shopmeld.plans.incremental import IncrementalMarts
from shopmeld.plans.registry import changed_loads
from shopmeld.sources.synth import synth_raw
from shopmeld.streaming import landing

AS_OF = day("2024-06-30")
MARTS = ("kpi_revenue_summary", "kpi_daily_snapshot", "kpi_platform_overview")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(repr, df.drop("_generated_at").collect()))


def land(loads, landed, first=0):
    for batch, load in enumerate(loads, first):
        for table, rows in load.items():
            landing.land_batch(rows, landed, table, batch)


def full(spark, landed):
    """The marts built anew from the current rows."""
    raw = {f"{p}_orders": landing.current_rows(spark, landed, f"{p}_orders") for p in config.PLATFORMS}
    return pipeline.Models(raw, AS_OF)


@pytest.mark.parametrize("slot", ["month", "day"])
def test_equals_a_full_refresh_after_each_batch(spark, tmp_path, slot):
    landed, warehouse = str(tmp_path / "landed"), str(tmp_path / "marts")
    raw = {t: df.coalesce(1) for t, df in synth_raw(spark, n_orders=60, n_products=5, n_customers=9).items()}
    kept = IncrementalMarts(spark, landed, warehouse, slot)
    assert kept.refresh() == 0
    with pytest.raises(ValueError, match="refresh"):
        kept.marts(AS_OF)
    for batch, load in enumerate(changed_loads(raw)):
        land([load], landed, batch)
        days = kept.refresh()
        want = full(spark, landed)
        for name, mart in kept.marts(AS_OF).items():
            assert sorted(mart.columns) == sorted(want[name].columns)
            assert rows_of(mart.select(*want[name].columns)) == rows_of(want[name]), (batch, name)
        # All days; those of pending orders; those that shipped orders left and came to; none for stale versions.
        assert (days > 0) == (batch < 3)
    assert kept.refresh() == 0


def test_only_touched_days_are_read_and_written(spark, raw_rows, tmp_path):
    landed, warehouse = str(tmp_path / "landed"), str(tmp_path / "marts")

    def order(i, created, updated, price):
        return {"id": i, "created_at": moment(created) if created else None, "updated_at": moment(updated), "total_price": D(price), "currency": "USD"}

    kept = IncrementalMarts(spark, landed, warehouse)
    land([{"shopify_orders": raw_rows("shopify_orders", *(order(i, f"2024-06-{i:02d}", "2024-06-30", i) for i in range(1, 11)), order(20, None, "2024-06-30", 1))}], landed)
    assert kept.refresh() == 11
    land([{"shopify_orders": raw_rows("shopify_orders", order(3, "2024-06-07", "2024-07-01", 50), order(4, "2024-06-04", "2024-06-29", 99), order(20, None, "2024-07-02", 7))}], landed, 1)
    # An unfinished batch waits.
    (tmp_path / "landed" / "shopify_orders" / "_batch=2").mkdir()
    assert kept.refresh() == 3  # 3 June is left, 7 June joined, and the orders without a date
    got = {r.order_date and r.order_date.day: r.gross_revenue for r in kept.marts(AS_OF)["kpi_revenue_summary"].collect()}
    assert got == {1: 1, 2: 2, 4: 4, 5: 5, 6: 6, 7: 57, 8: 8, 9: 9, 10: 10, None: 7}
    runs = sorted((tmp_path / "marts" / "facts").glob("run=*"), key=lambda p: p.stat().st_mtime)
    assert sorted(p.name[-2:] for p in runs[1].glob("slot=*")) == ["07", "__"]
    plan = plan_of(kept.facts(["2024-06-07", "2024-06-09"]))
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "slot" in filters and "run" in filters
    assert kept.facts(["2024-06-07"]).count() == 2


def test_a_late_writer_starts_again(spark, raw_rows, tmp_path, monkeypatch):
    landed, warehouse = str(tmp_path / "landed"), str(tmp_path / "marts")

    def load(i, price):
        return {"shopify_orders": raw_rows("shopify_orders", {"id": i, "created_at": moment("2024-06-01"), "updated_at": moment("2024-06-02"), "total_price": D(price)})}

    land([load(1, 1)], landed)
    late, early = (IncrementalMarts(spark, landed, warehouse) for _ in range(2))
    real, tries = late._rewrite, []

    def rewrite(fresh, state):
        done = real(fresh, state)
        tries.append(len(fresh["shopify_orders"]))
        if len(tries) == 1:
            assert early.refresh() == 1
            land([load(2, 5)], landed, 1)
        return done

    monkeypatch.setattr(late, "_rewrite", rewrite)
    assert late.refresh() == 1 and tries == [1, 1]
    assert late.marts(AS_OF)["kpi_revenue_summary"].first().gross_revenue == 6
    assert late.log.newest()[0] == 2


def test_one_of_many_commits_wins(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.newest() == (0, {})
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: CommitLog(spark, str(tmp_path / "log")).commit(1, {"by": i}), range(8)))
    assert sum(won) == 1 and log.newest() == (1, {"by": won.index(True)})
    assert log.commit(2, {"by": "é"}) and log.newest() == (2, {"by": "é"})
    assert [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("_")] == []


def test_two_runs_publish_without_a_mix(spark, tmp_path):
    raw = {t: df.coalesce(1) for t, df in synth_raw(spark, n_orders=20, n_products=5, n_customers=5).items()}
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda d: pipeline.run_models(raw, day(d), warehouse=str(tmp_path), select=["revenue", "overview"]), ["2024-06-30", "2024-06-29"]))
    number, state = CommitLog(spark, f"{tmp_path}/published").newest()
    assert number == 2 and len(set(state["models"].values())) == 1
    assert set(pipeline.published_marts(spark, str(tmp_path))) == {"kpi_revenue_summary", "kpi_platform_overview"}


def test_observed_checks_equal_the_suite(spark, raw_rows, tmp_path):
    raw = {t: df.coalesce(1) for t, df in synth_raw(spark, n_orders=30, n_products=5, n_customers=5).items()}
    broken = raw_rows("shopify_orders", {"id": None, "total_price": D(1)}, {"id": 7, "created_at": moment("2024-01-01")}, {"id": 7})
    raw["shopify_orders"] = raw["shopify_orders"].unionByName(broken)
    raw["amazon_order_items"] = raw["amazon_order_items"].withColumn("order_item_id", F.when(F.col("order_item_id") != "x", None))
    report = quality.Report()
    built = pipeline.run_models(raw, AS_OF, warehouse=str(tmp_path), report=report)
    got = report.result(built)
    want = quality.run_quality_suite(pipeline.Models(raw, AS_OF))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("failures > 0").count() >= 4
    # Missing and unaccepted values of the written models cost no scan: what is left to run are groupings.
    assert plan_of(got).count("Scan parquet") <= 2 * len(raw)


def test_marts_written_together_read_the_orders_once(spark, tmp_path, monkeypatch):
    raw = {t: df.coalesce(1) for t, df in synth_raw(spark, n_orders=20, n_products=5, n_customers=5).items()}
    written = {}
    real = pipeline.write_model

    def write(df, base, name, *more):
        written[name] = (plan_of(df), df.inputFiles())
        return real(df, base, name, *more)

    monkeypatch.setattr(pipeline, "write_model", write)
    pipeline.run_models(raw, AS_OF, warehouse=str(tmp_path), select=["daily", "revenue", "overview"])
    assert list(written)[0] == "order_facts"
    for name in MARTS:
        plan, files = written[name]
        assert "get_json_object" not in plan and files and all("/order_facts/" in f for f in files)


def test_products_are_not_ranked_for_other_columns(spark):
    raw = {t: df.coalesce(1) for t, df in synth_raw(spark, n_orders=20, n_products=5, n_customers=5).items()}
    models = pipeline.Models(raw, AS_OF)
    assert "revenue_rank" not in models.narrow("kpi_product_performance", ["product_id"]).columns
    assert "revenue_rank" in models.narrow("kpi_product_performance", ["product_id", "revenue_rank"]).columns
