"""Suffix-array dedup: bytes covered by a 200-byte string that also starts anywhere else.

Which strings can be equal is found first, so that only those meet in a suffix array. The position of the
smallest 32-byte hash among the 169 that lie inside a 200-byte string (the leftmost, on ties) depends on the
string alone: equal strings have equal anchors at equal places. Every string has one anchor, and an anchor
owns a run of consecutive strings; its context is the bytes that they cover. Anchors with a hash of their
own have no equal string anywhere. The others' contexts, one of each kind with its number, go to shards by
anchor hash.

A shard cuts its contexts to the part whose strings have hashes met in other contexts (the rest cannot be
equal to anything), sorts their suffixes by prefix doubling that only refines groups still equal
(Larsson and Sadakane), takes common prefixes of neighbours (Kasai), and so finds which strings start more
than once. Equal strings have equal anchor hashes, so shards of different hashes need no merge. A hash whose
contexts exceed a shard is split into parts: each has a suffix array of its own, and strings common to two
parts are found by binary search of the one's strings among the other's sorted suffixes. The strings found
repeated are mapped back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes import mix, odd_numbers, steps, text_bytes
from .common import ship, stored, stored_by, whole

LENGTH = 200
SEED_BYTES = 32


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` (a power of two) bytes from each position on; the last size - 1 positions have none."""
    out, factor = mix(data.astype(np.uint64) + np.uint64(1)), odd_numbers(1, 21)[0]
    width = 1
    while width < size:
        out = out[:-width] * factor + out[width:]
        factor = np.uint64(int(factor) ** 2 % 2**64)
        width *= 2
    return mix(out)


def anchors(data: np.ndarray, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchor position and hash, first and last string start that it owns."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = window_hashes(data, seed)
    window = length - seed + 1
    # leftmost minimum of every window by doubling: keep the place of the smaller, the left one on ties
    best, least = np.arange(len(hashes), dtype=np.int32 if len(hashes) < 1 << 31 else np.int64), hashes
    width = 1
    while width * 2 <= window:
        best = np.where(least[width:] < least[:-width], best[width:], best[:-width])
        least = np.minimum(least[width:], least[:-width])
        width *= 2
    ahead = window - width
    place = np.where(least[ahead : ahead + n] < least[:n], best[ahead : ahead + n], best[:n]).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return place[first], hashes[place[first]], first, last


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(data: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `most` bytes or more, and each one's rank (equal ranks: not told apart).

    Starts from the order of 8-byte prefixes; each round doubles the compared length, but only sorts
    suffixes whose group is not yet a single one. Zeros stand for what follows the end of the data.
    """
    n = len(data)
    key = eight_bytes(data)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    width = 8
    while width < most:
        alone = np.concatenate([heads[1:] != heads[:-1], [True]]) & (heads == np.arange(n))
        open_at = np.flatnonzero(~alone)  # places in the order whose group has several suffixes
        if not len(open_at):
            break
        who = order[open_at]
        ahead = np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        key = heads[open_at] * (n + 1) + ahead  # group, then rank of what follows
        by = np.argsort(key)
        order[open_at] = who[by]
        key = key[by]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        heads[open_at] = open_at[np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))]
        rank[order[open_at]] = heads[open_at]
        width *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, at most `most`, of each suffix in order with the one before it.

    By Kasai's rule the value at a text position is at least that of the position before, less one. Values
    are compared out at every 16th position, eight bytes at a time and then singly, and carried from there,
    all positions of a residue at a time.
    """
    n = len(data)
    eight = eight_bytes(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.where(rank > 0, order[np.maximum(rank - 1, 0)], -1)
    known = np.zeros(n, np.int64)
    for residue in range(16):
        at = np.arange(residue, n, 16)
        if residue:
            known[at] = np.maximum(known[at - 1] - 1, 0)
        ready = at[before[at] >= 0]
        for stride, values in ((8, eight), (1, data)):
            live = ready
            while len(live):
                a, b = live + known[live], before[live] + known[live]
                ok = (known[live] < most) & (a + stride <= n) & (b + stride <= n)
                ok[ok] = values[a[ok]] == values[b[ok]]
                live = live[ok]
                known[live] += stride
    return np.minimum(known, most)[order]


def shared_ranges(contexts: list[bytes], weights: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of each context the first and last string start whose hash other contexts have too, one that occurs
    once among them; -1 where there is none. Other strings need no sorting: a string of a context that
    occurs several times is known to repeat, and equal strings have equal hashes."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[owner] + inner
    hashes = _range_hashes(data, at, at + length, at)
    order = np.argsort(hashes)
    sorted_hashes = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]))
    several = (np.diff(np.append(heads, len(order))) > 1) & (np.minimum.reduceat(weights[owner[order]], heads) == 1)
    wanted = order[np.repeat(several, np.diff(np.append(heads, len(order))))]
    first, last = np.full(len(contexts), np.iinfo(np.int64).max), np.full(len(contexts), -1)
    np.minimum.at(first, owner[wanted], inner[wanted])
    np.maximum.at(last, owner[wanted], inner[wanted])
    return np.where(last < 0, -1, first), last


def sorted_strings(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts' bytes, where each begins (one more for the end), the context of each byte, the starts of
    all whole strings in the order of the suffix array, and for each of these the number of its kind of string."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(contexts)), sizes)
    room = begin[owner + 1] - np.arange(len(data))  # bytes up to the end of the context
    order, _ = suffix_array(data, length)
    shared = common_prefixes(data, order, length)
    whole_at = np.flatnonzero(room[order] >= length)
    alike = np.minimum.reduceat(shared[: whole_at[-1] + 1], np.concatenate([[0], whole_at[:-1] + 1])) >= length
    alike[0] = False
    return data, begin, owner, order[whole_at], np.cumsum(~alike) - 1


def _by_context(flags: np.ndarray, begin: np.ndarray, length: int) -> list[np.ndarray]:
    return [flags[x : y - length + 1] for x, y in zip(begin[:-1], begin[1:], strict=True)]


def repeated_starts(contexts: list[bytes], weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its strings start more than once, counting each context `weights` times."""
    data, begin, owner, starts, group = sorted_strings(contexts, length)
    total = np.bincount(group, weights[owner[starts]])
    flags = np.zeros(len(data), bool)
    flags[starts] = total[group] > 1
    return _by_context(flags, begin, length)


def find_strings(data: np.ndarray, at: np.ndarray, other: np.ndarray, heads: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the strings of `data` at `at` among those of `other` at `heads`, which are distinct and
    in order: the place of the first that is not smaller, and whether it is the same string."""
    mine, theirs = eight_bytes(data), eight_bytes(other)
    offsets = sorted({*range(0, length - 7, 8), length - 8})

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the string at b is smaller than, the same as or greater than the one at a."""
        sign, live = np.zeros(len(a), np.int8), np.arange(len(a))
        for k in offsets:
            x, y = mine[a[live] + k], theirs[b[live] + k]
            sign[live] = (y > x).astype(np.int8) - (y < x)
            live = live[x == y]
            if not len(live):
                break
        return sign

    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(heads))
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        smaller = compare(at[live], heads[middle]) < 0
        low[live] = np.where(smaller, middle + 1, low[live])
        high[live] = np.where(smaller, high[live], middle)
    same = low < len(heads)
    same[same] = compare(at[same], heads[low[same]]) == 0
    return low, same


def common_starts(ours: list[bytes], theirs: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context of either side, which of its strings occur on the other side too."""
    other, their_begin, _, starts, group = sorted_strings(theirs, length)
    heads = starts[np.flatnonzero(np.diff(group, prepend=-1))]
    data = np.frombuffer(b"".join(ours), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in ours])])
    at = np.concatenate([np.arange(x, y - length + 1) for x, y in zip(begin[:-1], begin[1:], strict=True)])
    place, same = find_strings(data, at, other, heads, length)
    flags, their_flags, met = np.zeros(len(data), bool), np.zeros(len(other), bool), np.zeros(len(heads), bool)
    flags[at] = same
    met[place[same]] = True
    their_flags[starts] = met[group]
    return _by_context(flags, begin, length), _by_context(their_flags, their_begin, length)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _anchor_rows(length: int):
    """Batches of (_doc, _text) -> per anchor: hash, hash of the context, document, strings owned."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("_text"))
            docs = batch.column("_doc").to_numpy()
            for start, stop in steps(ends):
                parts = []
                for i in range(start, stop):
                    text = data[ends[i] : ends[i + 1]]
                    place, h, first, last = anchors(text, length)
                    if len(place):
                        context = _range_hashes(text, first, last + length, place)
                        parts.append((h, context, np.full(len(place), docs[i]), first, last))
                if parts:
                    h, context, doc, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                        ["_h", "_context", "_doc", "_first", "_last"],
                    )

    return rows


def _range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop] and of where the anchor lies in it; of nothing else, so not of len(data)."""
    base = odd_numbers(1, 22)[0]
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(data), base, np.uint64), dtype=np.uint64)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(data.astype(np.uint64) + np.uint64(7)) * powers[:-1], dtype=np.uint64)])
    # an odd base has an inverse modulo 2^64: its powers bring bytes at any place down to place 0
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(start.max(initial=0)), inverse, np.uint64), dtype=np.uint64)])
    return mix((sums[stop] - sums[start]) * down[start]) ^ mix(((stop - start) << 20).astype(np.uint64) + (place - start).astype(np.uint64))


def _shard(length: int):
    """Repeated strings of a shard's contexts; of two parts of a split hash, the strings that they share."""

    def find(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["_part", "_h", "_context"])
        first, last = shared_ranges(list(items["_bytes"]), items["_n"].to_numpy(), length)
        items = items.assign(_first=first, _last=last)[last >= 0]
        merge = (items["_i"] != items["_j"]).any()
        ours = int((items["_part"] == items["_i"]).sum())
        out = []
        if len(items) and not (merge and ours in (0, len(items))):
            cut = [c[a : b + length] for c, a, b in zip(items["_bytes"], items["_first"], items["_last"], strict=True)]
            if merge:
                found = sum(common_starts(cut[:ours], cut[ours:], length), [])
            else:
                found = repeated_starts(cut, items["_n"].to_numpy(), length)
            for h, context, skip, flags in zip(items["_h"], items["_context"], items["_first"], found, strict=True):
                out += [(h, context, skip + a, skip + b) for a, b in zip(*runs(flags), strict=True)]
        return pd.DataFrame(out, columns=["_h", "_context", "_from", "_to"]).astype("int64")

    return find


def _dealt(contexts: DataFrame, sizes: DataFrame, shards: int, shard_bytes: int) -> DataFrame:
    """Contexts with their shard: _shard, _split, _i, _j. sizes: _h, _size.

    Hashes of up to shard_bytes go whole to a shard. The contexts of a larger one are dealt to parts; each part
    is a shard (_i = _j) and each two parts are one, where the strings common to both are found.
    """
    large = sizes.where(F.col("_size") > shard_bytes).select("_h", F.ceil(F.col("_size") / shard_bytes).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("_context"), F.col("_parts")).cast("int")
    # fewer rows than shards: bytes / shard_bytes at most
    placed = contexts.join(F.broadcast(large), "_h", "left").withColumn("_part", F.coalesce(part, F.lit(0)))
    others = F.transform(
        F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1),
        lambda q: F.struct(F.least("_part", q).alias("_i"), F.greatest("_part", q).alias("_j")),
    )
    split = F.col("_parts").isNotNull()
    return placed.select(
        "_h", "_context", "_n", "_bytes", "_part",
        F.when(split, -1).otherwise(F.pmod(F.xxhash64("_h"), F.lit(shards))).alias("_shard"),
        F.when(split, F.col("_h")).otherwise(0).alias("_split"),
        F.inline(others),
    )


def _cut(length: int):
    """Batches of (_doc, _text, _n, _marks) -> what is removed of each text and what stays."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("_text"))
            copies = batch.column("_n").to_pylist()
            rows = []
            for i, marks in enumerate(batch.column("_marks")):
                text = data[ends[i] : ends[i + 1]]
                gone = np.zeros(len(text) + 1, np.int64)
                if copies[i] > 1 and len(text) >= length:
                    gone[0], gone[-1] = 1, -1
                elif marks.is_valid:
                    for m in marks.as_py():
                        gone[m["_a"]] += 1
                        gone[m["_b"] + length] -= 1
                removed = np.cumsum(gone)[:-1] > 0
                kept = text[~removed].tobytes()
                rows.append((len(text), int(removed.sum()), len(runs(removed)[0]), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return cut


#: Context bytes of a shard.
SHARD_BYTES = 1 << 20
#: Of the stage tables, which hold the texts once.
CODEC = "zstd"


def _texts(docs: DataFrame, text_column: str) -> DataFrame:
    """Distinct texts: _doc (64-bit hash), _text, _n (rows), stored in buckets of _doc.

    Grouped by the hash alone, so that later joins find the texts where they lie; a second hash tells
    different texts of the same one, which end the job.
    """
    text = whole(text_column)
    one = F.when(F.col("_least") == F.col("_most"), F.col("_text")).otherwise(F.raise_error(F.lit("two texts have the same 64-bit hash")))
    grouped = (
        docs.select(F.xxhash64(text).alias("_doc"), text.alias("_text"), F.xxhash64(F.lit(1), text).alias("_other"))
        .groupBy("_doc")
        .agg(F.first("_text").alias("_text"), F.count("*").alias("_n"), F.min("_other").alias("_least"), F.max("_other").alias("_most"))
    )
    return stored_by(grouped.select("_doc", one.alias("_text"), "_n"), "_doc", "substring-texts", CODEC)


def repeated_bytes(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Null counts as empty; texts shorter than `length` bytes lose nothing. Rows that repeat a text repeat all
    its strings. Texts are known by a 64-bit hash. No rows give no rows. The texts are cut where the result is read.
    """
    ship(docs.sparkSession)
    texts = _texts(docs, text_column)
    anchored = stored(
        texts.select("_doc", "_text").mapInArrow(
            _anchor_rows(length), "_h bigint, _context bigint, _doc bigint, _first int, _last int"
        ),
        "substring-anchors",
        codec=CODEC,
    )
    # few anchors have a hash that others have too; only these are looked at again. Stored, so that Spark can split a hot hash
    several = stored(
        anchored.groupBy("_h")
        .agg(F.count("*").alias("_all"), (F.min("_context") != F.max("_context")).alias("_met"))
        .where("_all > 1")
        .select("_h", "_met"),
        "substring-hashes",
        codec=CODEC,
    )
    rows = stored(anchored.join(several, "_h"), "substring-rows", codec=CODEC)
    shared = stored(
        rows.groupBy("_h", "_context", "_met").agg(F.count("*").alias("_n"), F.min(F.struct("_doc", "_first", "_last")).alias("_one"))
        .select("_h", "_context", "_met", "_n", "_one.*"),
        "substring-kinds",
        codec=CODEC,
    )
    met = shared.where("_met")
    part = F.expr(f"substring(cast(_text as binary), _first + 1, _last - _first + {length})")
    contexts = met.join(texts.select("_doc", "_text"), "_doc").select("_h", "_context", "_n", part.alias("_bytes"))
    sizes = met.groupBy("_h").agg(F.sum(F.col("_last") - F.col("_first") + length).alias("_size"))
    n_bytes, n_split = sizes.agg(F.sum("_size"), F.count_if(F.col("_size") > shard_bytes)).first()
    shards = max(1, -(-(n_bytes or 0) // shard_bytes))
    found = (
        _dealt(contexts, sizes, shards, shard_bytes)
        .groupBy("_shard", "_split", "_i", "_j")
        .applyInPandas(_shard(length), "_h bigint, _context bigint, _from bigint, _to bigint")
    )
    if n_split:
        found = found.distinct()  # several parts may find the same strings of a context
    single = shared.where("_n = 1 and _met").select("_h", "_context")
    whole_runs = shared.where("_n > 1").select(
        "_h", "_context", F.lit(0).cast("long").alias("_from"), (F.col("_last") - F.col("_first")).cast("long").alias("_to")
    )
    spans = stored(whole_runs.unionByName(found.join(single, ["_h", "_context"], "left_semi")), "substring-runs", codec=CODEC)
    marks = (
        rows.join(spans, ["_h", "_context"])
        .groupBy("_doc")
        .agg(F.collect_list(F.struct((F.col("_first") + F.col("_from")).alias("_a"), (F.col("_first") + F.col("_to")).alias("_b"))).alias("_marks"))
    )
    results = texts.join(marks, "_doc", "left").select("_doc", "_text", "_n", "_marks").mapInArrow(
        _cut(length), "_doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    return docs.select(F.col(id_column), F.xxhash64(whole(text_column)).alias("_doc")).join(results, "_doc").select(
        id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"
    )
