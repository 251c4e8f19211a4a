"""Ranks inside groups that may be far larger than one task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopmeld.functions.scratch import written


def spread_row_number(df: DataFrame, group: str, order: Sequence[Column], name: str, size: str | None = None) -> DataFrame:
    """`row_number() over (partition by group order by ...)` without one task per group.

    Rows are range-partitioned by group and the whole order, so a group, and even a run of equal
    leading values, spreads over many tasks. Each task numbers its own rows; the numbers are made
    global with the row counts of the preceding tasks (one small row per task and group). The
    numbered rows are written out first because both steps must see the same numbering. `size` names a
    column for the rows of the group, which the same counts give.
    """
    numbered = written(
        df.repartitionByRange(F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_slot", 33))
    before = W.partitionBy(group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(group, "_task")
        .agg(F.count("*").alias("_rows"), F.min("_slot").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    if size:
        offsets = offsets.withColumn(size, F.sum("_rows").over(W.partitionBy(group)))
    position = F.col("_before") + F.col("_slot") - F.col("_first") + 1
    return (
        numbered.join(offsets, [group, "_task"])
        .withColumn(name, position.cast("int"))
        .drop("_slot", "_task", "_before", "_first", "_rows")
    )


def spread_percent_rank(
    df: DataFrame, group: str, value: str, descending_position: str, size: str, name: str
) -> DataFrame:
    """`percent_rank() over (partition by group order by value)` from the group's size and a row number
    that runs from the largest value (NULL counting as the largest) down.

    Only values that occur more than once are joined back: all their rows share the rank of the
    last one.
    """
    ties = (
        df.groupBy(group, value)
        .agg(F.count("*").alias("_ties"), F.max(descending_position).alias("_last"))
        .filter("_ties > 1")
        .select(F.col(group).alias("_group"), F.col(value).alias("_value"), "_last")
    )
    below = F.col(size) - F.coalesce("_last", descending_position)
    rank = F.when(F.col(size) > 1, below / (F.col(size) - 1)).otherwise(F.lit(0.0))
    return (
        df.join(ties, (F.col(group) == F.col("_group")) & F.col(value).eqNullSafe(F.col("_value")), "left")
        .withColumn(name, rank)
        .drop(size, "_group", "_value", "_last")
    )
