"""Builds the models in order (staging, intermediate, marts) and materialises them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shopmeld import config
from shopmeld.functions.commits import CommitLog
from shopmeld.functions.scratch import written
from shopmeld.operators import marts, quality
from shopmeld.operators.intermediate import unified_order_items, unified_orders
from shopmeld.operators.staging import STAGING, stage

# model -> tags by which a run can select it
MODEL_TAGS: dict[str, tuple[str, ...]] = {
    **{
        name: ("staging", name.split("_")[1], "order_items" if "items" in name else name.split("_")[-1])
        for name in STAGING
    },
    "int_unified_orders": ("intermediate", "orders"),
    "int_unified_order_items": ("intermediate", "order_items"),
    "kpi_daily_snapshot": ("marts", "kpis", "daily"),
    "kpi_platform_overview": ("marts", "kpis", "overview"),
    "kpi_revenue_summary": ("marts", "kpis", "revenue"),
    "kpi_product_performance": ("marts", "kpis", "products"),
}

# The namespaces models are stored under.
LAYERS = ("staging", "intermediate", "marts")


def selected_models(select: str | Iterable[str] | None = None) -> list[str]:
    """Model names by name or tag, in build order; everything by default."""
    if select is None:
        return list(MODEL_TAGS)
    wanted = {select} if isinstance(select, str) else set(select)
    chosen = [name for name, tags in MODEL_TAGS.items() if name in wanted or wanted & set(tags)]
    if not chosen:
        raise ValueError(f"nothing matches {sorted(wanted)}")
    return chosen


class Models(Mapping[str, DataFrame]):
    """All models as lazy DataFrames, each put together once and only when asked for.

    With `share_facts` the first mart asked for writes the narrow order facts to the shared folder, and all marts
    read those: one scan of the raw orders for any number of marts.
    """

    def __init__(self, raw: Mapping[str, DataFrame], as_of: dt.date, share_facts: bool = False):
        self._raw, self._as_of = raw, as_of
        self._built: dict[str, DataFrame] = {}
        self._share_facts = share_facts

    def __getitem__(self, name: str) -> DataFrame:
        if name not in MODEL_TAGS:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(MODEL_TAGS)

    def __len__(self) -> int:
        return len(MODEL_TAGS)

    def replace(self, name: str, stored: DataFrame) -> None:
        """Let a stored copy stand in for a model from now on."""
        self._built[name] = stored

    def _build(self, name: str) -> DataFrame:
        if name in STAGING:
            return stage(self._raw, name)
        if name == "int_unified_orders":
            return unified_orders([self[f"stg_{p}_orders"] for p in config.PLATFORMS])
        if name == "int_unified_order_items":
            return unified_order_items([self[f"stg_{p}_order_items"] for p in config.PLATFORMS])
        if name == "kpi_daily_snapshot":
            return marts.kpi_daily_snapshot(self.facts)
        if name == "kpi_platform_overview":
            return marts.kpi_platform_overview(self.facts, self._as_of)
        if name == "kpi_revenue_summary":
            return marts.kpi_revenue_summary(self.facts)
        return marts.kpi_product_performance(self["int_unified_order_items"], self.facts, self._as_of)

    @cached_property
    def facts(self) -> DataFrame:
        """The orders as the marts read them."""
        facts = marts.order_facts(self["int_unified_orders"])
        return written(facts) if self._share_facts else facts

    def use_facts(self, stored: DataFrame) -> None:
        """Let stored order facts stand in from now on; marts built before keep their own."""
        self.facts = stored

    def narrow(self, name: str, columns: Iterable[str]) -> DataFrame:
        """A model for the sake of some columns only: products are not ranked where no rank is asked for."""
        if name == "kpi_product_performance" and name not in self._built and not set(columns) & set(marts.RANK_COLUMNS):
            return marts.product_metrics(self["int_unified_order_items"], self.facts, self._as_of)
        return self[name]


def register_views(models: Mapping[str, DataFrame]) -> list[str]:
    """Make models queryable by name in SQL."""
    for name, df in models.items():
        df.createOrReplaceTempView(name)
    return list(models)


def write_model(
    df: DataFrame, base: str, name: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Full refresh of one stored model; returns the stored copy."""
    path = f"{base}/{name}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def published_marts(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    """The stored marts as last published: each from the newest run that was written to its end."""
    _, state = CommitLog(spark, f"{warehouse}/published").newest()
    return {model: spark.read.parquet(f"{warehouse}/runs/{run}/{model}") for model, run in state.get("models", {}).items()}


def _publish(spark: SparkSession, warehouse: str, run: str, models: Sequence[str]) -> None:
    """Announce a run whose marts are all written. Of runs that end at once one is first; the other goes on top."""
    log = CommitLog(spark, f"{warehouse}/published")
    while True:
        number, state = log.newest()
        if log.commit(number + 1, {"models": state.get("models", {}) | dict.fromkeys(models, run)}):
            return


def save_bucketed(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """Store orders or items bucketed and sorted by order, so joins of the two need no shuffle.

    Use the same bucket count for both, near the cluster's task slots.
    """
    keys = ["order_id", "platform"]
    writer = df.repartition(buckets, *keys).write.mode("overwrite")
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def create_namespaces(spark: SparkSession, prefix: str = "shop_") -> list[str]:
    """One database per layer, for use with save_bucketed and saveAsTable."""
    names = [f"{prefix}{layer}" for layer in ("raw", *LAYERS)]
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    return names


def run_models(
    raw: Mapping[str, DataFrame],
    as_of: dt.date,
    warehouse: str | None = None,
    select: str | Iterable[str] | None = None,
    store_intermediate: bool = False,
    report: quality.Report | None = None,
) -> dict[str, DataFrame]:
    """Build the selected models; returns them by name in build order.

    Staging and intermediate models are views. With a `warehouse` directory the selected marts are
    written below a folder of this run and the stored copies returned; only when all are written is the
    run published, so `published_marts` shows a complete run at any time and keeps the former one when a
    mart fails. Older run folders can be removed when nobody reads them any more. Where two marts or more are
    written, the order facts are written first, so the raw orders are scanned and parsed once;
    `store_intermediate` stores the whole canonical relations instead, partitioned by platform.

    A `report` collects the quality checks of what is written, without further scans (see `quality.Report`).
    """
    names = selected_models(select)
    models = Models(raw, as_of)
    run = uuid.uuid4().hex
    watch = report.watch if report else lambda name, df: df
    stored_marts = [name for name in names if "marts" in MODEL_TAGS[name]]
    base = f"{warehouse}/runs/{run}"
    items_wanted = {"int_unified_order_items", "kpi_product_performance"} & set(names)
    if warehouse and store_intermediate:
        for name in ["int_unified_orders", *(["int_unified_order_items"] if items_wanted else [])]:
            models.replace(name, write_model(watch(name, models[name]), base, name, ["platform"]))
    elif warehouse and len(stored_marts) > 1:
        orders = watch("int_unified_orders", models["int_unified_orders"])
        models.use_facts(write_model(marts.order_facts(orders), base, "order_facts"))
    if warehouse:
        if report and "kpi_product_performance" in names and not store_intermediate:
            models.replace("int_unified_order_items", watch("int_unified_order_items", models["int_unified_order_items"]))
        for name in stored_marts:
            models.replace(name, write_model(watch(name, models[name]), base, name))
        if stored_marts:
            _publish(models[stored_marts[0]].sparkSession, warehouse, run, stored_marts)
    built = {name: models[name] for name in names}
    register_views(built)
    return built
