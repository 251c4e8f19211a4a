"""Incremental landing of raw rows: newer versions of a row replace older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shopmeld.schemas import RAW_KEYS, RAW_SCHEMAS

BATCH = "_batch"


def latest_per_key(df: DataFrame, key: str, changed: str | None) -> DataFrame:
    """The version of each row that changed last; without a change column, or at equal times, the largest row.

    A maximum over whole rows folds the versions of a key before the shuffle, which a window
    would not; a key with very many versions thus costs one row per task.
    """
    rest = [name for name in df.columns if name not in (key, changed)]
    newest = F.max(F.struct(*([changed] if changed else []), *rest)).alias("_row")
    return df.groupBy(key).agg(newest).select(key, "_row.*").select(*df.columns)


def land_batch(rows: DataFrame, target: str, table: str, batch: int) -> None:
    """Store the latest version per key of one batch; the same batch again replaces itself."""
    latest_per_key(rows, *RAW_KEYS[table]).write.mode("overwrite").parquet(f"{target}/{table}/{BATCH}={batch}")


def upsert_raw(
    changes: DataFrame, target: str, table: str, checkpoint: str, refresh: str | None = None
) -> StreamingQuery:
    """Land a stream of changed rows of a raw table below `target`.

    Each batch is reduced to its latest version per key and stored in a folder of its own, so a
    batch costs its own size only, and one that is repeated after a failure replaces itself.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        land_batch(batch, target, table, batch_id)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land)
    trigger = {"availableNow": True} if refresh is None else {"processingTime": refresh}
    return writer.trigger(**trigger).start()


def current_rows(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The raw table as landed so far: the latest version per key over all batches.

    A batch holds a key once, so change time and batch name a version (the batch alone where a table
    has no change column). Only these, the key and the columns asked for are read.
    """
    key, changed = RAW_KEYS[table]
    landed = spark.read.schema(f"{RAW_SCHEMAS[table]}, {BATCH} INT").parquet(f"{target}/{table}")
    columns = [name for name in landed.columns if name != BATCH]
    newest = W.partitionBy(key).orderBy(*([F.desc(changed)] if changed else []), F.desc(BATCH))
    return landed.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").select(*columns)


def compact(spark: SparkSession, target: str, table: str, new_target: str) -> None:
    """Write the current rows to a new target, as the base on which landing goes on.

    Later batches of the same checkpoint are stored next to the base and win over it.
    """
    base = f"{new_target}/{table}/{BATCH}=-1"
    current_rows(spark, target, table).write.mode("overwrite").parquet(base)
