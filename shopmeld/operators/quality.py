"""Data-quality checks: each returns its violations; the suite counts them per check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shopmeld import config

# model -> column -> checks; a tuple is a list of accepted values.
SUITE: dict[str, dict[str, tuple]] = {
    "stg_shopify_orders": {"order_id": ("unique", "not_null")},
    "stg_shopify_products": {"product_id": ("unique", "not_null")},
    "stg_shopify_customers": {"customer_id": ("unique", "not_null")},
    "stg_shopify_order_items": {"line_item_id": ("unique", "not_null"), "order_id": ("not_null",)},
    "int_unified_orders": {
        "order_id": ("not_null",),
        "platform": ("not_null", config.PLATFORMS),
    },
    "int_unified_order_items": {
        "line_item_id": ("not_null",),
        "order_id": ("not_null",),
        "platform": ("not_null",),
    },
    "kpi_revenue_summary": {"order_date": ("not_null",), "platform": ("not_null",)},
    "kpi_platform_overview": {"platform": ("unique", "not_null")},
    "kpi_product_performance": {"product_id": ("not_null",)},
    "kpi_daily_snapshot": {"order_date": ("unique", "not_null")},
}


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their row count; NULLs are left out."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("unique_field"))
        .agg(F.count("*").alias("n_records"))
        .filter("n_records > 1")
    )


def dq_not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value."""
    return df.filter(F.col(column).isNull())


def dq_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list, with their row count; NULLs pass."""
    return (
        df.filter(~F.col(column).isin(*values))
        .groupBy(F.col(column).alias("value_field"))
        .agg(F.count("*").alias("n_records"))
    )


def check_model(df: DataFrame, model: str, checks: Mapping[str, tuple]) -> DataFrame:
    """All checks of one model as rows (model, column_name, test, failures).

    Checks on single values (unique, accepted values) group by their column; the first such column
    also carries all not-null counts, so a model needs one scan per grouped column, mostly one in
    all. Grouping folds a value that fills much of the table before the shuffle.
    """
    grouped = [column for column, tests in checks.items() if any(t != "not_null" for t in tests)]
    not_null = [column for column, tests in checks.items() if "not_null" in tests]
    passes = [
        _check_pass(df, model, column, checks[column], not_null if first else [])
        for first, column in zip([True] + [False] * len(grouped), grouped)
    ]
    return reduce(DataFrame.unionByName, passes or [_check_pass(df, model, None, (), not_null)])


def _check_pass(
    df: DataFrame, model: str, grouped: str | None, tests: tuple, not_null: Sequence[str]
) -> DataFrame:
    value = F.col(grouped) if grouped else None
    missing = [F.count_if(F.col(c).isNull()).alias(f"_missing_{i}") for i, c in enumerate(not_null)]
    folded = df.groupBy(*([grouped] if grouped else [])).agg(F.count("*").alias("_rows"), *missing)
    failures = [(c, "not_null", F.sum(f"_missing_{i}")) for i, c in enumerate(not_null)]
    for test in tests:
        if test == "unique":
            failures.append((grouped, test, F.count_if(value.isNotNull() & (F.col("_rows") > 1))))
        elif test != "not_null":
            failures.append((grouped, "accepted_values", F.count_if(~value.isin(*test))))
    counted = folded.agg(
        *(F.coalesce(failed, F.lit(0)).alias(f"_{i}") for i, (_, _, failed) in enumerate(failures))
    )
    rows = (
        F.struct(
            F.lit(model).alias("model"),
            F.lit(column).alias("column_name"),
            F.lit(test).alias("test"),
            F.col(f"_{i}").cast("bigint").alias("failures"),
        )
        for i, (column, test, _) in enumerate(failures)
    )
    return counted.select(F.inline(F.array(*rows)))


def run_quality_suite(
    models: Mapping[str, DataFrame], suite: Mapping[str, Mapping[str, tuple]] = SUITE
) -> DataFrame:
    """The whole report over the models at hand; models are put together for the checked columns only."""
    narrow = getattr(models, "narrow", lambda name, columns: models[name])
    reports = [check_model(narrow(name, checks), name, checks) for name, checks in suite.items() if name in models]
    return reduce(DataFrame.unionByName, reports)


REPORT = "model string, column_name string, test string, failures bigint"


class Report:
    """Checks counted while models are written.

    `watch` adds counters to a model that is about to be written: missing and unaccepted values are counted as
    its rows pass by, by Spark's observed metrics, and cost no scan. Only uniqueness needs a grouping of its
    own; `result` adds those of the watched models, and whole checks for models that were not watched.
    """

    def __init__(self, suite: Mapping[str, Mapping[str, tuple]] = SUITE) -> None:
        self._suite = suite
        self._seen: dict[str, tuple[Observation, list[tuple[str, str]]]] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        """The same rows; a model is watched once, by the first write."""
        checks = self._suite.get(name, {})
        counters, labels = [], []
        for column, tests in checks.items():
            for test in tests:
                if test == "unique":
                    continue
                value = F.col(column)
                wrong = value.isNull() if test == "not_null" else ~value.isin(*test)
                counters.append(F.count_if(wrong).alias(f"_{len(labels)}"))
                labels.append((column, test if test == "not_null" else "accepted_values"))
        if not counters or name in self._seen:
            return df
        seen = Observation(f"checks of {name}")
        self._seen[name] = (seen, labels)
        return df.observe(seen, *counters)

    def result(self, models: Mapping[str, DataFrame]) -> DataFrame:
        """The report of the suite over `models`, after the watched ones were written."""
        any_model = next(models[name] for name in self._suite if name in models)
        rows = [
            (name, column, test, counts[f"_{i}"])
            for name, (seen, labels) in self._seen.items()
            for counts in [seen.get]
            for i, (column, test) in enumerate(labels)
        ]
        parts = [any_model.sparkSession.createDataFrame(rows, REPORT)]
        for name, checks in self._suite.items():
            if name in self._seen:
                checks = {column: ("unique",) for column, tests in checks.items() if "unique" in tests}
            if checks and name in models:
                parts.append(check_model(models[name], name, checks))
        return reduce(DataFrame.unionByName, parts)
