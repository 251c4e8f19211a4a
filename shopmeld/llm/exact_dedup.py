"""Exact dedup over an extendible-hash index kept on shared files. DataFrame operations only.

A text's key is its 64-bit hash. Rows of one key are chained: entries of a chain differ in their
bytes, which the grouping on (key, text) compares. A trie over the leading bits of the keys gives the
buckets: one that holds more than `bucket_entries` entries is split by one more bit, and the directory
doubles until its depth is that of the deepest bucket. Owner tasks write contiguous bucket ranges,
sorted by key; rows find their bucket through the directory and then their entry by key and digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_row, partitions_for, stored, whole

#: Deepest directory: 2^20 slots of 12 bytes can be broadcast at any size of the corpus.
MAX_DEPTH = 20


def buckets(entries: DataFrame, bucket_entries: int, n_entries: int) -> DataFrame:
    """Leaves of the trie over key prefixes: depth, bits, entries of each bucket.

    A node is a bucket when it fits, or is as deep as allowed, and its parent does not fit.
    """
    capacity = max(bucket_entries, n_entries >> (MAX_DEPTH - 2))
    deepest = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(1, n_entries / capacity))) + 3))
    nodes = (
        entries.groupBy(F.expr(f"shiftrightunsigned(_key, {64 - deepest})").alias("_prefix"))
        .agg(F.count("*").alias("_n"))
        .select("_n", "_prefix", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("_depth"))
        .groupBy("_depth", F.expr(f"shiftright(_prefix, {deepest} - _depth)").alias("_bits"))
        .agg(F.sum("_n").alias("_n"))
    )
    parents = nodes.where(F.col("_n") > capacity).select(
        (F.col("_depth") + 1).alias("_depth"), F.col("_bits").alias("_above")
    )
    leaves = nodes.where((F.col("_n") <= capacity) | (F.col("_depth") == deepest))
    below = leaves.withColumn("_above", F.expr("shiftright(_bits, 1)")).join(parents, ["_depth", "_above"], "left_semi")
    return below.select("_depth", "_bits", "_n").unionByName(leaves.where("_depth = 0"))


def directory(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Slot -> bucket at the depth of the deepest bucket, and that depth."""
    depth = leaves.agg(F.max("_depth")).first()[0] or 0
    slots = leaves.select(
        F.explode(
            F.expr(f"sequence(shiftleft(_bits, {depth} - _depth), shiftleft(_bits + 1, {depth} - _depth) - 1)")
        ).alias("_slot"),
        F.expr(f"shiftleft(_bits, {depth} - _depth)").alias("_bucket"),
    )
    return slots, depth


def _slot(depth: int) -> Column:
    return F.expr(f"shiftrightunsigned(_key, {64 - depth})") if depth else F.lit(0).cast("long")


def build_index(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_entries: int = 4096
) -> tuple[DataFrame, DataFrame, int]:
    """Index (bucket, key, text_sha256, keep_id, group_size), its directory, and the directory's depth.

    Copies are folded before the shuffle, so a text that fills a third of the rows moves once per task.
    """
    spark = docs.sparkSession
    text = whole(text_column)
    entries = stored(
        docs.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))
        .groupBy("_key", "_text")
        .agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_key", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "dedup-entries",
    )
    n = entries.count()
    leaves = stored(buckets(entries, bucket_entries, n), "dedup-buckets")
    slots, depth = directory(leaves)
    owners = partitions_for(spark, n * 64)
    index = stored(
        entries.withColumn("_slot", _slot(depth))
        .join(F.broadcast(slots), "_slot")
        .drop("_slot")
        .repartitionByRange(owners, "_bucket", "_key")
        .sortWithinPartitions("_bucket", "_key", "text_sha256"),
        "dedup-index",
    )
    return index, slots, depth


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_entries: int = 4096
) -> DataFrame:
    """Per row: id, keep_id (largest id of equal texts), group_size (rows), kept, text_sha256.

    Null text counts as empty. Rows that repeat the largest id of a group are all marked kept. A null
    id never wins; in a group of null ids keep_id is null and all are kept. No rows give no rows.
    """
    index, slots, depth = build_index(docs, id_column, text_column, bucket_entries)
    text = whole(text_column)
    rows = (
        docs.select(
            F.col(f"`{id_column}`").alias(id_column),
            F.xxhash64(text).alias("_key"),
            F.sha2(text, 256).alias("text_sha256"),
        )
        .withColumn("_slot", _slot(depth))
        .join(F.broadcast(slots), "_slot")
    )
    return rows.join(index, ["_bucket", "_key", "text_sha256"]).select(
        f"`{id_column}`",
        "keep_id",
        "group_size",
        F.col(f"`{id_column}`").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, one row per distinct text, with all their columns."""
    kept = exact_dedup(docs, id_column, text_column).where("kept")
    names = docs.columns
    # A null id is no empty id.
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_column}`").cast("string")), F.lit("")).alias("_id")
    rows = docs.select(packed_row(names), key, F.sha2(whole(text_column), 256).alias("_sha"))
    wanted = kept.select(key, F.col("text_sha256").alias("_sha")).distinct()
    one = rows.join(wanted, ["_id", "_sha"]).dropDuplicates(["_id", "_sha"])
    return one.select(*[F.col("_row").getField(c).alias(c) for c in names])
