"""Best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens. A full piece is a sequence of its own; the others
are dealt evenly to groups and packed there by best-fit decreasing. Dual-feasible functions give a lower
bound on each group's sequences: a group that meets it is certified and gives back only its emptiest
sequence, a group with a gap gives back its emptiest tenth. What was given back is exchanged between
`fan_in` groups at a time and packed again, until one group is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, whole
from .tokens import encoder

CAPACITY = 4096
GROUP_PIECES = 40_000
FAN_IN = 16


def _pieces(tokenizer: str, end_id: int, capacity: int):
    """Batches of (_id, _text) -> the pieces of each text with its end id."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_column = batch.column("_id")
            for start, stop, ids, begin in own.encode_steps(batch.column("_text")):
                at, piece, first, length, crc = [], [], [], [], []
                for i in range(stop - start):
                    doc = np.append(ids[begin[i] : begin[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, a in enumerate(range(0, len(doc), capacity)):
                        part = doc[a : a + capacity]
                        at.append(start + i)
                        piece.append(p)
                        first.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_column.take(pa.array(at, pa.int64())),
                        pa.array(range(row, row + len(at)), pa.int64()),
                        pa.array(piece, pa.int32()),
                        pa.array(first, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["_id", "_uid", "piece", "start", "length", "ids_crc32"],
                )
                row += len(at)

    return pieces


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item: longest first, each into the fullest bin that still holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, opened = 0, 0  # bit r of rooms: some bin has exactly r tokens left
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, opened
            opened += 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - n
        if left:
            by_room.setdefault(left, []).append(chosen)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs. counts[n]: items of length n.

    The largest of: the total length; for each threshold e, items above capacity - e taken as whole bins and
    items below e left out; the functions that round x * (k + 1) / capacity down to k-ths where it is no integer.
    """
    lengths = np.arange(capacity + 1)
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    number, mass = np.cumsum(counts), np.cumsum(counts * lengths)
    for e in range(1, capacity // 2 + 1):
        large = int(number[capacity] - number[capacity - e])
        middle = int(mass[capacity - e] - mass[e - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 33):
        scaled = lengths * (k + 1)
        weight = np.where(scaled % capacity == 0, lengths * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * weight).sum()) // (capacity * k)))
    return best


def _pack(capacity: int, last: bool, level: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("_uid", kind="stable")
        lengths = items["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        opened = int(bins.max()) + 1
        gap = opened - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        used = np.bincount(bins, lengths, opened)
        back = np.zeros(opened, bool)
        if not last:
            emptiest = np.argsort(used, kind="stable")[: max(1, gap * 4, opened // 10) if gap else 1]
            back[emptiest[used[emptiest] < capacity]] = True
        group = items["_group"].to_numpy()
        return items.assign(
            sequence_id=(np.int64(level) << 58) + (group << 24) + bins, offset=offsets, _back=back[bins], _gap=gap
        )

    return pack


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The written pieces of all documents: _id, _uid, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    return stored(
        docs.select(F.col(id_column).alias("_id"), whole(text_column).alias("_text")).mapInArrow(
            _pieces(tokenizer, end_id, capacity),
            f"_id {kind}, _uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint",
        ),
        "pack-pieces",
    )


def corpus_bound(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """Lower bound on the sequences of all pieces, from how many have each length."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    return lower_bound(counts, capacity)


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    group_pieces: int = GROUP_PIECES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows that repeat an id are packed as documents of their own.
    No rows give no rows.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_column, text_column)
    columns = [F.col("_id").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("_uid"), "offset": F.lit(0).cast("long")}
    )
    done = [full.select(columns)]
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    pool = rest.withColumn("_group", F.pmod(F.xxhash64("_uid"), F.lit(groups)))
    schema = ", ".join(f"{n} {t}" for n, t in pool.dtypes) + ", sequence_id bigint, offset bigint, _back boolean, _gap bigint"
    level = 0
    while True:
        level += 1
        last = groups == 1
        tried = stored(pool.groupBy("_group").applyInPandas(_pack(capacity, last, level), schema), f"pack-{level}")
        done.append(tried.where("not _back").select(columns))
        if last:
            break
        groups = -(-groups // fan_in)
        pool = tried.where("_back").withColumn("_group", F.floor(F.col("_group") / fan_in)).select(pool.columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
