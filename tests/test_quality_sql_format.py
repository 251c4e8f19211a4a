"""Checks, guarded SQL and presentation columns."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from conftest import day, moment
from pyspark.sql import functions as F

from shopmeld.functions import columns as C
from shopmeld.operators import adhoc, formatting, quality
from shopmeld.sources.raw import platform_mappings


def test_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "z")], "id int, v string")
    assert [tuple(r) for r in quality.dq_unique(df, "id").collect()] == [(1, 2)]
    assert quality.dq_not_null(df, "id").count() == 2
    assert [tuple(r) for r in quality.dq_accepted_values(df, "v", ["a", "b"]).collect()] == [("z", 1)]


def test_suite_counts_per_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "z"), (3, "y")], "id int, v string")
    suite = {"m": {"id": ("unique", "not_null"), "v": ("not_null", ("a", "b"))}, "absent": {"id": ("unique",)}}
    report = {(r.column_name, r.test): r.failures for r in quality.run_quality_suite({"m": df}, suite).collect()}
    assert report == {("id", "unique"): 1, ("id", "not_null"): 2, ("v", "not_null"): 1, ("v", "accepted_values"): 2}
    empty = quality.run_quality_suite({"m": df.filter("false")}, suite)
    assert {r.failures for r in empty.collect()} == {0}


def test_suite_has_all_declared_checks():
    tests = [t for columns in quality.SUITE.values() for ts in columns.values() for t in ts]
    assert (len(tests), tests.count("not_null"), tests.count("unique")) == (22, 15, 6)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE t",
        "WITH x AS (SELECT 1) SELECT * FROM x",
        "SELECT 1; DELETE FROM t",
        "SELECT * FROM t; grant all",
        "selection",
        "",
        "-- SELECT\nINSERT INTO t VALUES (1)",
    ],
)
def test_rejected_sql(spark, sql):
    with pytest.raises(adhoc.ForbiddenSqlError):
        adhoc.run_sql(spark, sql)


READS = [
    "SELECT n, count(*) AS c FROM ok WHERE n BETWEEN 1 AND 9 AND v LIKE 'a%' GROUP BY n HAVING count(*) > 0 ORDER BY n",
    "SELECT * FROM (SELECT n FROM ok) x JOIN ok USING (n) LEFT JOIN ok z ON z.n = x.n",
    "SELECT CASE WHEN n = 1 THEN 'a' ELSE v END, CAST(n AS STRING), n::int, v || 'x', -n, n % 2, n IS NOT NULL FROM ok",
    "SELECT sum(n) OVER (PARTITION BY v ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), rank() OVER w FROM ok WINDOW w AS (ORDER BY n)",
    "SELECT * FROM ok WHERE n = (SELECT max(n) FROM ok) AND EXISTS (SELECT 1 FROM OK) AND n IN (SELECT n FROM ok)",
    "SELECT * FROM (WITH c AS (SELECT n FROM ok), d AS (SELECT n FROM c) SELECT * FROM d) e",
    "SELECT n FROM ok UNION ALL SELECT n FROM ok EXCEPT SELECT n FROM ok",
    "SELECT count(*) FILTER (WHERE n > 1), count(DISTINCT v) FROM ok GROUP BY ROLLUP (n)",
    "SELECT x FROM VALUES (1, 'a') AS v(x, y)",
    "SELECT o.n, k.m FROM ok o CROSS JOIN LATERAL (SELECT o.n + 1 AS m) k",
    "SELECT * FROM ok LATERAL VIEW explode(array(1, 2)) q AS e",
    "SELECT transform(array(1, 2), x -> x + 1), reverse('drop table') FROM ok",
]

REFUSED = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM ok",
    "SELECT try_reflect('a', 'b')",
    "SELECT count(*) FILTER (WHERE reflect('a', 'b') = 'x') FROM ok",
    "SELECT sum(n) OVER (ORDER BY reflect('a', 'b')) FROM ok",
    "SELECT transform(array(1), x -> reflect('a', 'b')) FROM ok",
    "SELECT * FROM ok LATERAL VIEW java_method('a') q",
    "SELECT * FROM range(java_method('a', 'b'))",
    "SELECT IDENTIFIER('reflect')('a', 'b')",
    "SELECT spark_catalog.default.f(1) FROM ok",
    "SELECT TRANSFORM(n) USING 'cat' FROM ok",
    "SELECT input_file_name() FROM ok",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM `parquet`.`/tmp/x`",
    "SELECT n FROM ok JOIN csv.`/tmp/x` USING (n)",
    "SELECT * FROM ok WHERE n = (SELECT max(n) FROM json.`/tmp/x`)",
    "SELECT CASE WHEN EXISTS (SELECT 1 FROM secret) THEN 1 END FROM ok",
    "SELECT n FROM ok WHERE n IN (SELECT n FROM secret)",
    "SELECT * FROM (WITH c AS (SELECT * FROM secret) SELECT * FROM c)",
    "SELECT * FROM (WITH secret AS (SELECT * FROM secret) SELECT * FROM secret)",
    "SELECT * FROM (WITH secret AS (SELECT 1 AS n) SELECT * FROM secret) a JOIN secret USING (n)",
    "SELECT * FROM ok, LATERAL (SELECT * FROM secret)",
    "SELECT n FROM ok LIMIT (SELECT max(n) FROM secret)",
    "SELECT * FROM default.ok",
    "SELECT * FROM IDENTIFIER('secret')",
    "SELECT * FROM read_files('/tmp')",
    "SELECT * FROM ok VERSION AS OF 1",
    "SELECT n FROM ok; SELECT n FROM ok",
]


@pytest.fixture(scope="module")
def ok_and_secret(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, v string").createOrReplaceTempView("ok")
    spark.range(3).withColumnRenamed("id", "n").createOrReplaceTempView("secret")


@pytest.mark.parametrize("sql", READS)
def test_reads_pass_the_plan_check(spark, ok_and_secret, sql):
    assert adhoc.check_plan(spark, sql, ["ok"]) is False
    adhoc.run_sql(spark, sql, relations=["ok"]).collect()


@pytest.mark.parametrize("sql", REFUSED)
def test_plan_check_refuses(spark, ok_and_secret, sql):
    with pytest.raises(adhoc.ForbiddenSqlError):
        adhoc.check_plan(spark, sql, ["ok"])


def test_relations_default_to_temporary_views(spark, ok_and_secret):
    assert adhoc.check_plan(spark, "SELECT * FROM secret LIMIT 2 OFFSET 1")
    spark.range(1).write.mode("overwrite").saveAsTable("kept_elsewhere")
    try:
        with pytest.raises(adhoc.ForbiddenSqlError):
            adhoc.check_plan(spark, "SELECT * FROM kept_elsewhere")
        assert adhoc.check_plan(spark, "SELECT * FROM default.kept_elsewhere", ["default.kept_elsewhere"]) is False
    finally:
        spark.sql("DROP TABLE kept_elsewhere")


def test_sql_text_and_limits(spark):
    spark.createDataFrame(
        [(i, moment("2024-05-01 10:00:00"), True, D("1.50"), None, "drop 'it'") for i in range(150)],
        "n int, created_at timestamp_ntz, ok boolean, amount decimal(12,2), gone string, note string",
    ).createOrReplaceTempView("guarded")
    rows = adhoc.run_sql(spark, "select n, created_at, ok, amount, gone from guarded").collect()
    assert len(rows) == 100
    assert tuple(rows[0])[1:] == ("2024-05-01 10:00:00", "True", "1.50", None)
    assert adhoc.run_sql(spark, "SELECT n FROM guarded LIMIT 120", limit=5).count() == 120
    assert adhoc.run_sql(spark, "SELECT n FROM guarded WHERE note <> 'no limit here'", limit=5).count() == 5
    bound = adhoc.run_sql(spark, "SELECT n FROM guarded WHERE n = :n AND created_at >= :d", args={"n": 7, "d": day("2024-01-01")})
    assert [r.n for r in bound.collect()] == ["7"]
    tail = spark.createDataFrame([(moment("2024-05-01 10:00:00.25"),)], "t timestamp_ntz")
    assert adhoc.as_text(tail).first().t == "2024-05-01 10:00:00.250000"
    amounts = spark.createDataFrame([(D("1.500000"),), (D("2.125000"),), (D("-3.000000"),), (D("0.000001"),), (None,)], "a decimal(20,6)")
    assert [r.a for r in adhoc.as_text(amounts).collect()] == ["1.50", "2.125", "-3.00", "0.000001", None]


def test_preview(spark):
    spark.range(300).createOrReplaceGlobalTempView("numbers")
    assert adhoc.preview_table(spark, "global_temp", "numbers").count() == 10
    assert adhoc.preview_table(spark, "global_temp", "numbers", 100).count() == 100
    with pytest.raises(ValueError):
        adhoc.preview_table(spark, "global_temp", "numbers", 1000)
    assert adhoc.run_sql(spark, "SELECT id FROM range(250)", limit=None).count() == 250
    assert adhoc.run_sql(spark, "SELECT id FROM (SELECT id FROM range(250) LIMIT 200)").count() == 100
    assert adhoc.run_sql(spark, "SELECT id FROM range(250) LIMIT 150").count() == 150
    for schema, table in (("a b", "t"), ("a", "t;x")):
        with pytest.raises(ValueError):
            adhoc.preview_table(spark, schema, table)


def test_texts(spark):
    df = spark.createDataFrame(
        [(D("1234567.50"),), (D("2.50"),), (D("-1234.50"),), (D("0.00"),), (D("-0.04"),), (D("999.99"),), (None,)],
        "v decimal(12,2)",
    )
    value = F.col("v")
    money = [r[0] for r in df.select(C.currency_text(value)).collect()]
    assert money == ["$1,234,568", "$3", "-$1,235", "$0", "-$0", "$1,000", None]
    percents = [r[0] for r in df.select(C.percent_text(value)).collect()]
    assert percents == ["+1234567.5%", "+2.5%", "-1234.5%", "+0.0%", "-0.0%", "+1000.0%", None]
    counts = spark.createDataFrame([(1_250_000,), (1_000,), (999,), (0,)], "v bigint")
    assert [r[0] for r in counts.select(C.compact_text(value)).collect()] == ["1.3M", "1.0K", "999", "0"]


def test_formatted_frames(spark):
    overview = spark.createDataFrame(
        [("shopify", D("10.5"), D("2"), D("0"), D("1.25"), D("-3"), 1500)],
        """platform string, total_revenue_usd decimal(12,2), revenue_this_month_usd decimal(12,2),
        revenue_today_usd decimal(12,2), revenue_mom_growth_pct decimal(12,2),
        orders_mom_growth_pct decimal(12,2), total_orders bigint""",
    )
    row = formatting.formatted_platforms(overview, platform_mappings(spark)).first()
    assert (row.total_revenue_formatted, row.platform_name, row.total_orders_formatted) == ("$11", "Shopify", "1.5K")
    assert (row.revenue_growth_formatted, row.orders_growth_formatted) == ("+1.3%", "-3.0%")
    summary = overview.agg(
        F.sum("total_revenue_usd").alias("total_revenue_usd"),
        F.lit(D("7.5")).alias("avg_order_value_usd"),
        F.collect_list(F.struct(*overview.columns)).alias("platforms"),
    )
    row = formatting.formatted_dashboard(summary).first()
    assert row.avg_order_value_formatted == "$8" and row.platforms[0].revenue_this_month_formatted == "$2"
