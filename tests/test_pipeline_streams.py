"""Model runs, stored layouts, generated data and streams."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import day, moment
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.operators import marts, quality
from shopmeld.operators.intermediate import orders_of
from shopmeld.plans import pipeline
from shopmeld.schemas import RAW_SCHEMAS
from shopmeld.sources.raw import RawTables, jdbc_options
from shopmeld.sources.synth import MAX_LINES, synth_raw
from shopmeld.streaming import landing, live

AS_OF = day("2024-06-30")


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Generated raw tables, written as parquet."""
    base = str(tmp_path_factory.mktemp("raw"))
    for name, df in synth_raw(spark, n_orders=300, n_products=20, n_customers=10).items():
        df.write.parquet(f"{base}/{name}")
    return base


@pytest.fixture(scope="module")
def raw(spark, landed):
    return RawTables(spark, landed)


def test_generated_tables(raw):
    assert set(raw) == set(RAW_SCHEMAS) and len(raw) == 13
    for platform in config.PLATFORMS:
        assert raw[f"{platform}_orders"].count() == 300
    lines = raw["shopify_order_line_items"]
    per_order = lines.groupBy("order_id").count().agg(F.min("count"), F.max("count")).first()
    assert per_order[0] >= 1 and per_order[1] <= MAX_LINES["shopify"]
    assert lines.join(raw["shopify_products"], lines.product_id == raw["shopify_products"].id, "left_anti").count() == 0
    dates = raw["shopify_orders"].agg(F.min("created_at"), F.max("created_at")).first()
    assert dates[1] - dates[0] <= dt.timedelta(days=180)
    statuses = {r[0] for r in raw["shopee_orders"].select("order_status").distinct().collect()}
    assert statuses <= {"COMPLETED", "SHIPPED", "READY_TO_SHIP", "UNPAID", "CANCELLED"} and len(statuses) >= 4


def test_generated_rows_are_reproducible(spark):
    first, again = (
        {n: sorted(d.collect(), key=repr) for n, d in synth_raw(spark, 20, 5, 5, seed=s).items()} for s in (1, 1)
    )
    assert first == again
    other = synth_raw(spark, 20, 5, 5, seed=2)["shopify_orders"].collect()
    assert sorted(other, key=repr) != first["shopify_orders"]


def test_totals_match_lines(raw):
    lines = raw["shopee_order_items"].groupBy("order_sn").agg(
        F.sum(F.col("model_discounted_price") * F.col("model_quantity_purchased")).alias("lines")
    )
    joined = raw["shopee_orders"].join(lines, "order_sn")
    assert joined.filter("total_amount - estimated_shipping_fee <> lines").count() == 0


def test_run_models(spark, raw, tmp_path):
    built = pipeline.run_models(raw, AS_OF, warehouse=str(tmp_path))
    assert list(built) == pipeline.selected_models()
    assert built["int_unified_orders"].count() == 1200
    assert spark.sql("SELECT count(*) FROM kpi_platform_overview").first()[0] == 4
    again = pipeline.run_models(raw, AS_OF, warehouse=str(tmp_path), store_intermediate=True)
    columns = [c for c in built["kpi_daily_snapshot"].columns if c != "_generated_at"]
    assert sorted(again["kpi_daily_snapshot"].select(columns).collect()) == sorted(
        pipeline.Models(raw, AS_OF)["kpi_daily_snapshot"].select(columns).collect()
    )
    assert again["int_unified_orders"].columns == built["int_unified_orders"].columns
    report = quality.run_quality_suite(again)
    assert report.count() == 22 and report.filter("failures > 0").count() == 0


def test_selection():
    assert pipeline.selected_models("marts") == [
        "kpi_daily_snapshot", "kpi_platform_overview", "kpi_revenue_summary", "kpi_product_performance",
    ]
    assert pipeline.selected_models(["lazada", "daily"]) == [
        "stg_lazada_orders", "stg_lazada_order_items", "kpi_daily_snapshot",
    ]
    assert len(pipeline.selected_models("order_items")) == 5
    with pytest.raises(ValueError):
        pipeline.selected_models("nothing")


def test_namespaces(spark):
    assert pipeline.create_namespaces(spark) == ["shop_raw", "shop_staging", "shop_intermediate", "shop_marts"]
    assert "shop_marts" in {d.name for d in spark.catalog.listDatabases()}


def test_jdbc_options_split_the_table():
    options = jdbc_options("jdbc:x", "raw.orders", "id", "0", "100", partitions=8, user="u")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8" and options["user"] == "u"


def _raw_orders_stream(spark, folder):
    return spark.readStream.schema(RAW_SCHEMAS["shopify_orders"]).option("maxFilesPerTrigger", 1).parquet(folder)


def _all_streams(spark, base):
    return {
        f"{p}_orders": spark.readStream.schema(RAW_SCHEMAS[f"{p}_orders"]).option("maxFilesPerTrigger", 1).parquet(f"{base}/{p}_orders")
        for p in config.PLATFORMS
    }


def test_live_equals_batch_and_resumes(spark, raw, landed, tmp_path):
    # Several files per table in arbitrary order of time, so most batches bring late orders.
    base, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    halves = {p: raw[f"{p}_orders"].repartition(4).randomSplit([0.5, 0.5], 7) for p in config.PLATFORMS}
    for part in (0, 1):
        for platform, parts in halves.items():
            parts[part].write.mode("append").parquet(f"{base}/{platform}_orders")
        orders = orders_of(_all_streams(spark, base))
        live.live_daily_revenue(orders, target, checkpoint, refresh=None).awaitTermination()
    batch = live.daily_revenue(orders_of(raw)).drop("approx_buyers")
    result = live.live_result(spark, target).drop("approx_buyers")
    assert sorted(result.collect()) == sorted(batch.collect())
    total = marts.kpi_daily_snapshot(orders_of(raw)).agg(F.sum("total_revenue_usd")).first()[0]
    assert result.agg(F.sum("revenue_usd")).first()[0] == total


VERSIONS = "platform string, order_id string, changed bigint, date int, counted boolean, usd string, items int"


def _send(spark, folder, *rows):
    spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(folder)


def _drain(spark, source, target, checkpoint):
    stream = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).parquet(source)
    live.live_corrected_revenue(stream, target, checkpoint, refresh=None).awaitTermination()
    return {(r.order_date.day, r.platform): (r.orders, r.revenue_usd, r.items_sold) for r in live.live_result(spark, target).collect()}


def test_newer_versions_take_older_ones_back(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _send(spark, source, ("lazada", "1", 5, 0, True, "10.5", 2), ("lazada", "2", 5, 0, True, "4", 1), ("shopee", "1", 5, 1, True, None, live.MISSING))
    assert _drain(spark, source, target, checkpoint) == {(1, "lazada"): (2, D("14.5"), 3), (2, "shopee"): (1, 0, 0)}
    # Changed amount, cancelled, moved to another day; the query is started anew each time.
    _send(spark, source, ("lazada", "1", 6, 0, True, "20", 2), ("lazada", "2", 6, 0, False, "4", 1), ("shopee", "1", 9, 2, True, "7", 1))
    assert _drain(spark, source, target, checkpoint) == {(1, "lazada"): (1, D("20"), 2), (3, "shopee"): (1, 7, 1)}
    # Late ones: an older version, the same one again, and a newer one hidden among them; one batch has nothing to say.
    _send(spark, source, ("lazada", "1", 4, 0, True, "99", 9), ("lazada", "1", 6, 0, True, "20", 2))
    assert _drain(spark, source, target, checkpoint) == {(1, "lazada"): (1, D("20"), 2), (3, "shopee"): (1, 7, 1)}
    _send(spark, source, ("lazada", "1", 7, 0, True, "1", 1), ("lazada", "1", 8, 0, True, "2", 1), ("lazada", "1", 7, 0, True, "3", 1), ("lazada", "2", -5, live.MISSING, True, "8", 1))
    assert _drain(spark, source, target, checkpoint) == {(1, "lazada"): (1, D("2"), 1), (3, "shopee"): (1, 7, 1)}
    # A batch that was written but not announced, as after a failure, is repeated from the version before.
    _send(spark, source, ("lazada", "2", 9, 0, True, "5", 5))
    stream = spark.readStream.schema(VERSIONS).parquet(source)
    real = live._last_version

    def fail(*args, **kwargs):
        raise OSError("lost")

    live._last_version = fail
    try:
        with pytest.raises(Exception, match="lost"):
            live.live_corrected_revenue(stream, target, checkpoint, refresh=None).awaitTermination()
    finally:
        live._last_version = real
    want = {(1, "lazada"): (2, D("7"), 6), (3, "shopee"): (1, 7, 1)}
    assert _drain(spark, source, target, checkpoint) == want
    # Announced, but not committed by the stream: the same version is computed and announced again.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert _drain(spark, source, target, checkpoint) == want


def test_corrected_stream_equals_batch_over_latest_versions(spark, raw, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    orders = orders_of(raw)
    loads = [
        orders,
        orders.filter("payment_status = 'pending'").withColumns(
            {"order_updated_at": F.expr("order_updated_at + interval 2 days"), "total_amount_usd": F.col("total_amount_usd") * 2}
        ),
        orders.withColumns({"order_updated_at": F.expr("order_updated_at - interval 1 day"), "total_amount_usd": F.lit(D(1))}),
        orders.filter("fulfillment_status = 'shipped'").withColumns(
            {"order_updated_at": F.expr("order_updated_at + interval 3 days"), "is_cancelled": F.lit(True)}
        ),
    ]
    for load in loads:
        live.order_versions(load.withColumn("total_amount_usd", F.col("total_amount_usd").cast("decimal(19,8)"))).coalesce(2).write.mode("append").parquet(source)
        got = _drain(spark, source, target, checkpoint)
    everything = loads[0]
    for load in loads[1:]:
        everything = everything.unionByName(load)
    batch = live.latest_daily_revenue(everything)
    assert batch.columns == live.live_result(spark, target).columns
    assert sorted(live.live_result(spark, target).collect()) == sorted(batch.collect())
    assert sum(v[0] for v in got.values()) < orders.filter("NOT is_cancelled").count()


def test_live_day_does_not_depend_on_the_session_zone(spark, orders_frame):
    orders = orders_frame({"id": "1"}).withColumn("order_created_at", F.lit("2024-01-01 23:30:00").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert live.daily_revenue(orders).first().order_date == day("2024-01-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_upsert_keeps_newest_and_repeats_safely(spark, raw_rows, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    table = "shopify_orders"

    def load(*rows):
        raw_rows(table, *rows).coalesce(1).write.mode("append").parquet(source)
        landing.upsert_raw(_raw_orders_stream(spark, source), target, table, checkpoint, refresh=None).awaitTermination()
        found = landing.current_rows(spark, target, table)
        assert found.columns == spark.createDataFrame([], RAW_SCHEMAS[table]).columns
        return {r.id: (r.financial_status, r.total_price) for r in found.collect()}

    early, late = moment("2024-01-01"), moment("2024-01-02")
    assert load(
        {"id": 1, "updated_at": early, "financial_status": "pending", "total_price": D("1")},
        {"id": 1, "updated_at": late, "financial_status": "paid", "total_price": D("2")},
        {"id": 2, "updated_at": early, "financial_status": "pending", "total_price": D("3")},
    ) == {1: ("paid", 2), 2: ("pending", 3)}
    assert load(
        {"id": 1, "updated_at": early, "financial_status": "stale", "total_price": D("9")},
        {"id": 2, "updated_at": late, "financial_status": "paid", "total_price": D("4")},
        {"id": 3, "updated_at": late, "financial_status": "paid", "total_price": D("5")},
    ) == {1: ("paid", 2), 2: ("paid", 4), 3: ("paid", 5)}
    compacted = str(tmp_path / "compacted")
    landing.compact(spark, target, table, compacted)
    target = compacted
    assert load({"id": 3, "updated_at": late, "financial_status": "refunded", "total_price": D("5")}) == {
        1: ("paid", 2), 2: ("paid", 4), 3: ("refunded", 5),
    }


def test_latest_per_key_prefers_newest_of_many_copies(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("id"), F.col("id").alias("changed"), F.lit("x").alias("v")
    )
    rows = {r.id: r.changed for r in landing.latest_per_key(df, "id", "changed").collect()}
    assert rows[1] == 4998 and len(rows) == df.select("id").distinct().count()


def test_item_tables_land_by_batch(spark, raw_rows, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    table = "shopee_order_items"

    def load(*rows):
        raw_rows(table, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RAW_SCHEMAS[table]).parquet(source)
        landing.upsert_raw(stream, target, table, checkpoint).awaitTermination()
        return {r.id: r.item_name for r in landing.current_rows(spark, target, table).collect()}

    assert load({"id": 1, "item_name": "z"}, {"id": 2, "item_name": "b"}) == {1: "z", 2: "b"}
    assert load({"id": 1, "item_name": "a"}) == {1: "a", 2: "b"}
    assert set(landing.RAW_KEYS) == set(RAW_SCHEMAS)


def test_current_rows_read_only_what_is_asked(spark, raw_rows, tmp_path):
    target = str(tmp_path)
    raw_rows("shopify_orders", {"id": 1}).write.parquet(f"{target}/shopify_orders/_batch=0")
    rows = landing.current_rows(spark, target, "shopify_orders").select("id", "total_price")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,updated_at:timestamp_ntz,total_price:decimal(12,2)>" in plan


def test_a_failed_run_keeps_the_published_one(spark, raw, tmp_path, monkeypatch):
    warehouse = str(tmp_path)
    assert pipeline.published_marts(spark, warehouse) == {}
    pipeline.run_models(raw, AS_OF, warehouse=warehouse, select="marts")
    before = {n: sorted(map(str, df.collect())) for n, df in pipeline.published_marts(spark, warehouse).items()}
    assert set(before) == set(pipeline.selected_models("marts"))
    write = pipeline.write_model

    def fail_in_the_last(df, base, name, *rest):
        if name == "kpi_product_performance":
            raise OSError(name)
        return write(df, base, name, *rest)

    monkeypatch.setattr(pipeline, "write_model", fail_in_the_last)
    with pytest.raises(OSError):
        pipeline.run_models(raw, AS_OF, warehouse=warehouse, select="marts")
    after = {n: sorted(map(str, df.collect())) for n, df in pipeline.published_marts(spark, warehouse).items()}
    assert after == before
    monkeypatch.undo()
    pipeline.run_models(raw, day("2024-06-29"), warehouse=warehouse, select="revenue")
    newest = pipeline.published_marts(spark, warehouse)
    assert set(newest) == set(before)
    stamps = {n: df.first()["_generated_at"] for n, df in newest.items()}
    assert stamps["kpi_revenue_summary"] > stamps["kpi_platform_overview"]
