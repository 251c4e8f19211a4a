"""Benchmark decontamination: windows of 13 words of benchmark items found in training documents.

DataFrame operations only. The distinct item windows, keyed by a hash of their length and their first,
middle and last word, are broadcast as a hash set; one scan of the documents gives a key per word
position, and a hit counts only if all words of the window are equal. The set is broadcast in blocks
of at most `max_broadcast_bytes`, one scan per block, so a large benchmark is handled as exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_ANY_CASE, packed_row, whole, words

WINDOW = 13
BROADCAST_BYTES = 64 << 20


def _key(length: Column, first: Column, middle: Column, last: Column) -> Column:
    return F.xxhash64(length, first, middle, last)


def item_windows(
    benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """Distinct windows: _len, _gram (words), _items (ids as strings), _key."""
    split = benchmark.select(F.col(f"`{id_column}`").cast("string").alias("_item"), words(whole(text_column)).alias("_w"))
    grams = (
        split.where(F.size("_w") > 0)
        .withColumn("_len", F.least(F.size("_w"), F.lit(window)))
        .select("_item", "_w", "_len", F.explode(F.expr("sequence(1, size(_w) - _len + 1)")).alias("_at"))
        .select("_item", "_len", F.slice("_w", F.col("_at"), F.col("_len")).alias("_gram"))
    )
    get = lambda i: F.get("_gram", i)
    return (
        grams.groupBy("_len", "_gram")
        .agg(F.collect_set("_item").alias("_items"))
        .withColumn("_key", _key(F.col("_len"), get(F.lit(0)), get(F.expr("_len div 2").cast("int")), get(F.col("_len") - 1)))
    )


def window_hits(docs: DataFrame, grams: DataFrame, max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified hits of windows in rows of docs (_id, _hash, _w): _id, _hash, _n_words, _block, _from, _to, _items.

    The words are split once: next to the places of its words each row has one more place, before the first
    word, of length 0. It meets the empty window that every block holds, so each row of docs comes back once
    per block with _from null, whether it has hits or not.
    """
    stats = grams.agg(
        F.sum(F.length(F.concat_ws(" ", "_gram")) * 2 + F.length(F.concat_ws(" ", "_items")) * 2 + 64).alias("b"),
        F.collect_set("_len").alias("l"),
    ).first()
    lengths, blocks = stats["l"] or [WINDOW], -(-(stats["b"] or 1) // max_broadcast_bytes)
    begin = F.col("_place") == 0
    lens = F.explode(F.when(begin, F.array(F.lit(0))).otherwise(F.array(*[F.lit(n) for n in sorted(lengths)])))
    at = F.when(begin, 0).otherwise(F.col("_place") - 1)
    key = _key(
        F.col("_len"), F.col("_first"), F.get("_w", F.expr("_at + _len div 2").cast("int")), F.get("_w", F.col("_at") + F.col("_len") - 1)
    )
    places = (
        docs.select("_id", "_hash", "_w", F.posexplode(F.concat(F.array(F.lit("")), "_w")).alias("_place", "_first"))
        .withColumn("_len", lens if len(lengths) > 1 else F.when(begin, 0).otherwise(lengths[0]))
        .withColumn("_at", at)
        .where(F.col("_at") + F.col("_len") <= F.size("_w"))
        .withColumn("_key", F.when(F.col("_len") == 0, F.lit(0)).otherwise(key))
    )
    empty = grams.sparkSession.range(1, numPartitions=1).select(
        F.lit(0).alias("_len"), F.array().cast("array<string>").alias("_gram"), F.array().cast("array<string>").alias("_items"), F.lit(0).cast("bigint").alias("_key")
    )
    parts = []
    for block in range(blocks):
        some = grams.where(F.pmod(F.hash("_key"), F.lit(blocks)) == block) if blocks > 1 else grams
        some = some.unionByName(empty).withColumnRenamed("_len", "_n")
        hit = (places["_key"] == some["_key"]) & (places["_len"] == some["_n"]) & (
            F.slice(places["_w"], places["_at"] + 1, places["_len"]) == some["_gram"]
        )
        real = F.col("_len") > 0
        parts.append(
            places.join(F.broadcast(some), hit).select(
                "_id",
                "_hash",
                F.size("_w").cast("long").alias("_n_words"),
                F.lit(block).alias("_block"),
                F.when(real, F.col("_at")).alias("_from"),
                F.when(real, F.col("_at") + F.col("_len")).alias("_to"),
                F.when(real, F.col("_items")).alias("_items"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _covered() -> Column:
    """Words inside any of the sorted spans."""
    return F.expr(
        "aggregate(array_sort(_spans), named_struct('n', 0L, 'to', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s._to - greatest(a.to, s._from)), 'to', greatest(a.to, s._to))).n"
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    with_spans: bool = False,
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated (5 % or more of the words hit).

    Null and empty texts have no words. Items without words have no windows; hits of items with a null
    id count as hits and not as items. Equal rows get equal results. An empty benchmark hits nothing.
    """
    text = whole(text_column)
    grams = item_windows(benchmark, item_column, item_text_column, window)
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64(text).alias("_hash"), words(text).alias("_w"))
    hit = F.col("_from").isNotNull()
    found = window_hits(rows, grams, max_broadcast_bytes).groupBy("_id", "_hash").agg(
        F.max("_n_words").alias("n_words"),
        F.count_if(~hit & (F.col("_block") == 0)).cast("int").alias("_rows"),
        F.collect_set(F.when(hit, F.struct("_from", "_to"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"),
    )
    return (
        found.withColumn("n_hit", _covered())
        .withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))))
        .select(
            F.col("_id").alias(id_column),
            "n_words",
            "n_hit",
            F.size("_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            *(["_hash", F.array_sort("_spans").alias("_spans")] if with_spans else []),
        )
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    id_column: str = "doc_id",
    text_column: str = "text",
    **options,
) -> DataFrame:
    """The documents without contaminated ones, or with hit words cut out of the text ("spans").

    A cut word takes the characters up to the next word with it. All columns and clean texts stay.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    names = docs.columns
    marks = contamination(docs, benchmark, id_column, text_column, with_spans=True, **options)
    marks = marks.where("contaminated" if remove == "documents" else "n_hit > 0").select(
        F.col(f"`{id_column}`").alias("_id"), "_hash", "_spans"
    ).dropDuplicates(["_id", "_hash"])
    rows = docs.select(
        packed_row(names), F.col(f"`{id_column}`").alias("_rid"), F.xxhash64(whole(text_column)).alias("_rhash")
    )
    same = rows["_rid"].eqNullSafe(marks["_id"]) & (rows["_rhash"] == marks["_hash"])
    if remove == "documents":
        return rows.join(marks, same, "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in names])
    text = F.col("_row").getField(text_column)
    own = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
    cut = F.expr(
        "concat(_gaps[0], array_join(transform(filter(sequence(1, size(_own)), i -> "
        "not exists(_spans, s -> i > s._from and i <= s._to)), i -> concat(_own[i - 1], _gaps[i])), ''))"
    )
    joined = rows.join(marks, same, "left").withColumns({"_own": own, "_gaps": F.split(text, WORD_ANY_CASE, -1)})
    value = F.when(F.col("_spans").isNull(), text).otherwise(cut)
    return joined.select(
        *[(value if c == text_column else F.col("_row").getField(c)).alias(c) for c in names]
    )
