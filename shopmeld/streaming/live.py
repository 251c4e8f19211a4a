"""The live dashboard as a stream: daily revenue per platform, kept up to date.

`live_daily_revenue` counts every row of a stream that holds each order once. `live_corrected_revenue` reads a
stream of order versions: a newer version of an order takes back what the older one had added.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shopmeld.functions.columns import day, ntz

WATERMARK = "1 day"
REFRESH = "60 seconds"


def daily_revenue(orders: DataFrame) -> DataFrame:
    """Orders, revenue and (approximate) buyers per day and platform, over a stream or a batch.

    The state holds one row per day and platform, whatever the number of orders. Event time needs
    a zoned timestamp: the order's clock time is read as UTC, in which day windows are aligned.
    """
    epoch = ntz(dt.datetime(1970, 1, 1))
    moment = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("order_created_at")))
    days = (F.unix_seconds("window.start") / 86400).cast("int")
    return (
        orders.filter(~F.col("is_cancelled"))
        .select(moment.alias("moment"), "platform", "total_amount_usd", "customer_id")
        .withWatermark("moment", WATERMARK)
        .groupBy(F.window("moment", "1 day"), "platform")
        .agg(
            F.count("*").alias("orders"),
            F.sum("total_amount_usd").alias("revenue_usd"),
            F.approx_count_distinct("customer_id").alias("approx_buyers"),
        )
        .select(
            F.date_add(day(dt.date(1970, 1, 1)), days).alias("order_date"),
            "platform",
            "orders",
            "revenue_usd",
            "approx_buyers",
        )
    )


def live_daily_revenue(
    orders: DataFrame, target: str, checkpoint: str, refresh: str | None = REFRESH
) -> StreamingQuery:
    """Keep `target` at the current daily revenue of an order stream.

    Every trigger writes the small result as a whole to a folder of its own and then announces it, so
    readers always see a complete version, orders that arrive late for an old day still count and a
    repeated batch changes nothing. The state is merged in as many tasks as the session shuffles to.
    Versions count the batches of a checkpoint: a new checkpoint needs a new target. `refresh=None` processes what is there and
    stops; stopping the query pauses it and a new start with the same checkpoint resumes it.
    """

    def publish(batch: DataFrame, version: int) -> None:
        batch.repartition(1).write.mode("overwrite").parquet(f"{target}/version={version}")
        said = batch.sparkSession.range(version, version + 1, numPartitions=1).toDF("version")
        said.write.mode("append").parquet(f"{target}/published")

    writer = (
        daily_revenue(orders)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
    )
    trigger = {"availableNow": True} if refresh is None else {"processingTime": refresh}
    return writer.trigger(**trigger).start()


def live_result(spark: SparkSession, target: str) -> DataFrame:
    """The last published state."""
    return spark.read.parquet(f"{target}/version={_last_version(spark, target)}")


def _last_version(spark: SparkSession, target: str, before: int | None = None) -> int | None:
    """The newest published version, or the newest one before a version; None where there is none."""
    try:
        versions = spark.read.schema("version bigint").parquet(f"{target}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        versions = versions.filter(F.col("version") < before)
    return versions.agg(F.max("version")).first()[0]


#: An order and what a version of it says; of two versions the larger one stands, compared from left to right.
VERSION_COLUMNS = ("platform", "order_id", "changed", "date", "counted", "usd", "items")
CHANGE = "platform string, date int, sign int, usd string, items int"
LIVE = ("order_date", "platform", "orders", "revenue_usd", "items_sold")

#: Groups of orders in the state.
BUCKETS = 1 << 10

#: A missing number, smaller than all others; columns without nulls reach Python as whole numbers.
MISSING = -(1 << 31)


def order_versions(orders: DataFrame) -> DataFrame:
    """The narrow columns of canonical orders that a correction needs, in types a state store keeps.

    Times and dates are numbers since 1970, amounts are texts of exact decimals. Rows without an order id
    cannot be told apart and are left out.
    """
    epoch, missing = ntz(dt.datetime(1970, 1, 1)), F.lit(MISSING)
    changed = F.timestamp_diff("MICROSECOND", epoch, F.col("order_updated_at"))
    date = F.date_diff(F.to_date("order_created_at"), day(dt.date(1970, 1, 1)))
    return orders.filter(F.col("order_id").isNotNull()).select(
        "platform",
        "order_id",
        F.coalesce(changed, F.lit(-(1 << 62))).alias("changed"),
        F.coalesce(date, missing).alias("date"),
        F.coalesce(~F.col("is_cancelled"), F.lit(False)).alias("counted"),
        F.col("total_amount_usd").cast("string").alias("usd"),
        F.coalesce(F.col("item_count").cast("int"), missing).alias("items"),
    )


def _ordered(version: tuple) -> tuple:
    """A version as a value to compare; a missing amount is smallest."""
    changed, date, counted, usd, items = version
    return (changed, date, counted, usd is not None, usd and Decimal(usd), items)


def _corrections(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the largest version of each order of a bucket; where it changes, take the old one back and add the new one."""
    held = {(platform, order): tuple(v) for platform, order, *v in json.loads(state.get[0])} if state.exists else {}
    newer: dict[tuple, tuple] = {}
    for frame in frames:
        for platform, order, *version in zip(*(frame[name].tolist() for name in VERSION_COLUMNS)):
            known = newer.get((platform, order)) or held.get((platform, order))
            if known is None or _ordered(version) > _ordered(known):
                newer[platform, order] = tuple(version)
    if not newer:
        return
    state.update((json.dumps([[*order, *version] for order, version in (held | newer).items()]),))
    both = [(order[0], sign, held.get(order) if sign < 0 else version) for order, version in newer.items() for sign in (-1, 1)]
    rows = [(platform, sign, v) for platform, sign, v in both if v is not None and v[2]]
    if rows:
        yield pd.DataFrame(
            {
                "platform": [platform for platform, _, _ in rows],
                "date": [v[1] for _, _, v in rows],
                "sign": [sign for _, sign, _ in rows],
                "usd": [v[3] or "0" for _, _, v in rows],
                "items": [0 if v[4] == MISSING else v[4] for _, _, v in rows],
            }
        )


def corrections(versions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of order versions as signed changes: rows (CHANGE), at most two for each order of a batch.

    The state holds one version per order, in buckets of orders by hash: calling Python costs the same for one
    order as for some hundreds. A trigger touches the buckets of its orders only. Take a bucket for every few
    hundred orders expected; the number is fixed for the life of a checkpoint. For very many orders set the
    session to the RocksDB state store, which keeps the state off the heap.
    """
    bucket = F.pmod(F.xxhash64("platform", "order_id"), F.lit(buckets))
    return (
        versions.withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandasWithState(_corrections, CHANGE, "orders string", "append", GroupStateTimeout.NoTimeout)
    )


def _daily(changes: DataFrame) -> DataFrame:
    """Signed changes folded per day and platform."""
    sign, date = F.col("sign"), F.nullif(F.col("date"), F.lit(MISSING))
    return changes.groupBy(F.date_add(day(dt.date(1970, 1, 1)), date).alias("order_date"), "platform").agg(
        F.sum(sign).alias("orders"),
        F.sum(sign * F.col("usd").cast("decimal(19,8)")).cast("decimal(38,8)").alias("revenue_usd"),
        F.sum(sign * F.col("items")).cast("bigint").alias("items_sold"),
    )


def latest_daily_revenue(orders: DataFrame) -> DataFrame:
    """The same figures from a table of order versions: the largest version of each order counts."""
    version = F.struct("changed", "date", "counted", F.col("usd").cast("decimal(19,8)").alias("usd"), "items")
    latest = order_versions(orders).groupBy("platform", "order_id").agg(F.max(version).alias("v")).select("platform", "v.*")
    items = F.when(F.col("items") == MISSING, 0).otherwise(F.col("items"))
    counted = latest.filter("counted").withColumns({"sign": F.lit(1), "usd": F.coalesce("usd", F.lit(0)), "items": items})
    return _daily(counted).select(*LIVE)


def live_corrected_revenue(
    versions: DataFrame, target: str, checkpoint: str, refresh: str | None = REFRESH, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep `target` at the daily revenue of the latest version of every order; read it with `live_result`.

    `versions` is a stream of `order_versions`. Every trigger folds the corrections of its batch per day and
    platform, adds them to the version published before and publishes the sum, one row per day and platform. A batch that is
    repeated after a failure starts from the same published version and from the state before it, so nothing
    counts twice. Changed, cancelled, moved and late orders need no special care: a version that is older than
    the one held changes nothing, and days left without orders disappear.
    """

    def publish(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        last = _last_version(spark, target, before=version)
        daily = _daily(batch).select(*LIVE)
        if last is not None:
            daily = daily.unionByName(spark.read.parquet(f"{target}/version={last}"))
        total = daily.groupBy("order_date", "platform").agg(
            F.sum("orders").alias("orders"),
            F.sum("revenue_usd").cast("decimal(38,8)").alias("revenue_usd"),
            F.sum("items_sold").alias("items_sold"),
        )
        total.filter("orders <> 0").select(*LIVE).coalesce(1).write.mode("overwrite").parquet(f"{target}/version={version}")
        said = spark.range(version, version + 1, numPartitions=1).toDF("version")
        said.write.mode("append").parquet(f"{target}/published")

    writer = corrections(versions, buckets).writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    trigger = {"availableNow": True} if refresh is None else {"processingTime": refresh}
    return writer.trigger(**trigger).start()
