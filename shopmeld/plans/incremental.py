"""Marts kept up to date from landed order batches: only the days (or months) that a batch touches are read and
rewritten."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions.commits import CommitLog
from shopmeld.functions.scratch import written
from shopmeld.operators import marts
from shopmeld.operators.intermediate import unified_orders
from shopmeld.operators.staging import stage
from shopmeld.schemas import RAW_KEYS, RAW_SCHEMAS
from shopmeld.streaming.landing import BATCH

KEY = ["platform", "order_id"]

#: Per-day parts of the marts, each a few rows per day.
DAYS = {"revenue": marts.revenue_days, "snapshot": marts.snapshot_days, "overview": marts.overview_days}


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


class IncrementalMarts:
    """Revenue, daily and overview marts over the orders landed by `upsert_raw`.

    Below `warehouse` lie the order facts, `facts/run=<run>/slot=<day>`, and the per-day parts of the marts,
    `<part>/run=<run>`. A commit says which run holds each slot; a run writes the slots that its batches touch,
    old days of moved orders included, and takes them over from older runs when it commits. A slot is a day, or
    a month where days hold too few orders for files of their own. Readers see the state of one commit. A second writer that comes too late starts again from the new state; folders of runs that
    no commit names any more can be removed.

    Rows without a key are left out. Of versions with the same time of change the one of the later batch stands,
    as in `current_rows`.
    """

    def __init__(self, spark: SparkSession, landed: str, warehouse: str, slot: str = "day") -> None:
        if slot not in ("day", "month"):
            raise ValueError(f"a slot is a day or a month, not {slot}")
        self.spark, self.landed, self.warehouse = spark, landed, warehouse
        self._slot = F.col("order_date") if slot == "day" else F.trunc("order_date", "month")
        self.log = CommitLog(spark, f"{warehouse}/commits")
        self._schemas: dict[str, str] = {}

    def refresh(self) -> int:
        """Take in all complete batches that are new; returns how many slots were rewritten."""
        while True:
            number, state = self.log.newest()
            fresh = {t: self._new_batches(t, state.get("batches", {}).get(t)) for t in self._tables()}
            if not any(fresh.values()):
                return 0
            batches = state.get("batches", {}) | {t: max(b) for t, b in fresh.items() if b}
            slots, held = self._rewrite(fresh, state)
            if self.log.commit(number + 1, {"batches": batches, "slots": held, "schemas": self._schemas}):
                return slots

    def marts(self, as_of: dt.date) -> dict[str, DataFrame]:
        """The marts of the newest commit: windows and sums over the stored days."""
        number, state = self.log.newest()
        if not number:
            raise ValueError("nothing is committed yet: refresh first")
        part = {name: self._read(name, state) for name in DAYS}
        return {
            "kpi_revenue_summary": marts.revenue_growth(part["revenue"]),
            "kpi_daily_snapshot": marts.snapshot_trends(part["snapshot"]),
            "kpi_platform_overview": marts.overview_of_days(part["overview"], as_of),
        }

    def facts(self, slots: Iterable[str | None] | None = None) -> DataFrame:
        """The order facts of the newest commit, of some slots only if asked for."""
        return self._read("facts", self.log.newest()[1], slots)

    @staticmethod
    def _tables() -> list[str]:
        return [f"{platform}_orders" for platform in config.PLATFORMS]

    def _new_batches(self, table: str, last: int | None) -> list[int]:
        """Numbers of the batches above the last one taken in that are written to their end."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(f"{self.landed}/{table}")
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        found = []
        for status in store.listStatus(folder):
            name = str(status.getPath().getName())
            if name.startswith(f"{BATCH}=") and store.exists(fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(name.partition("=")[2]))
        return sorted(b for b in found if last is None or b > last)

    def _changes(self, fresh: dict[str, list[int]]) -> DataFrame:
        """The newest version of every order of the new batches, as facts with its time of change."""
        staged = []
        for platform, table in zip(config.PLATFORMS, self._tables()):
            key, changed = RAW_KEYS[table]
            landed = self.spark.read.schema(f"{RAW_SCHEMAS[table]}, {BATCH} INT").parquet(f"{self.landed}/{table}") if fresh[table] else (
                self.spark.createDataFrame([], f"{RAW_SCHEMAS[table]}, {BATCH} INT")
            )
            rows = landed.where(F.col(BATCH).isin(fresh[table]) & F.col(key).isNotNull())
            rest = [name for name in landed.columns if name not in (key, changed, BATCH)]
            newest = rows.groupBy(key).agg(F.max(F.struct(changed, BATCH, *rest)).alias("_row")).select(key, "_row.*")
            staged.append(stage({table: newest.drop(BATCH)}, f"stg_{platform}_orders"))
        orders = unified_orders(staged)
        return orders.select(*marts.FACT_COLUMNS, F.col("order_updated_at").alias("changed"))

    def _rewrite(self, fresh: dict[str, list[int]], state: dict) -> tuple[int, dict[str, list[str | None]]]:
        """Write the touched slots of a new run; returns their number and which run holds each slot."""
        changes = written(self._changes(fresh))
        self._schemas = state.get("schemas") or {"facts": _schema(changes)}
        held = state.get("slots", {})
        before = self._read("facts", state).select(*KEY, F.col("order_date").alias("_day"), F.col("changed").alias("_changed"), F.lit(True).alias("_old"))
        newer = F.col("_old").isNull() | F.col("_changed").isNull() | (F.col("changed") >= F.col("_changed"))
        winners = written(changes.join(before, KEY, "left").where(newer))
        moved = winners.select("order_date").unionByName(winners.where("_old").select(F.col("_day").alias("order_date")))
        touched = sorted((r[0] and str(r[0]) for r in moved.select(self._slot).distinct().collect()), key=str)  # calendar slots
        if not touched:
            return 0, held
        run = uuid.uuid4().hex
        kept = self._read("facts", state, touched).join(winners, KEY, "left_anti")
        rows = winners.drop("_day", "_changed", "_old").unionByName(kept).withColumn("slot", self._slot)
        rows.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{self.warehouse}/facts/run={run}")
        facts = self._read("facts", {"slots": {run: touched}, "schemas": self._schemas})
        for name, days_of in DAYS.items():
            part = days_of(facts)
            self._schemas.setdefault(name, _schema(part))
            part.write.parquet(f"{self.warehouse}/{name}/run={run}")
        left = {r: [d for d in slots if d not in set(touched)] for r, slots in held.items()}
        return len(touched), {r: slots for r, slots in left.items() if slots} | {run: touched}

    def _read(self, name: str, state: dict, slots: Iterable[str | None] | None = None) -> DataFrame:
        """Stored rows of the slots that each run holds; facts of other runs and slots are not opened."""
        wanted = None if slots is None else set(slots)
        schema = state["schemas"][name] if "schemas" in state else self._schemas[name]
        more = "slot date, run string" if name == "facts" else "run string"
        column = F.col("slot") if name == "facts" else self._slot
        of_run = {r: [d for d in held if wanted is None or d in wanted] for r, held in state.get("slots", {}).items()}
        parts = [(F.col("run") == run) & _on(column, held) for run, held in of_run.items() if held]
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, {more}").drop("run", "slot")
        stored = self.spark.read.schema(f"{schema}, {more}").parquet(f"{self.warehouse}/{name}")
        return stored.where(reduce(Column.__or__, parts)).drop("run", "slot")


def _on(slot: Column, slots: list[str | None]) -> Column:
    known = slot.isin([dt.date.fromisoformat(d) for d in slots if d])
    return known | slot.isNull() if None in slots else known
