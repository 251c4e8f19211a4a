"""Vector code compression: product codebooks by Lloyd rounds over cover trees.

Every vector becomes integers floor(scale * x) and is cut into equal parts; each part position has a codebook.
A block of rows of one partition holds, for each part, a cover tree over its points, written once to a shared
table. The points of a node lie side by side, so cumulative sums give a node's sum and count. A round starts at
the roots: where the nearest entry is nearer than any other by more than twice the node's radius, the triangle
inequality gives that entry to the whole subtree; only other nodes are followed down, and only points of leaves
that stay ambiguous are compared one by one. All distances that decide are integers, so ties are exact.

Rows without a vector, with a null or non-finite component, or with a component of 2^16 or more (its distances
would not fit a long) are dropped, as are vectors of another length than the one with the smallest id. Lengths
that the number of parts does not divide are filled up with zeros, which change no distance. Null ids come last;
equal ids are ordered by their vectors. Fewer rows than entries give fewer entries; no row gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import ship, stored

#: Components below this keep all sums of squares inside a long.
MAX_COMPONENT = 1 << 16
#: Components held by one block of rows.
BLOCK_COMPONENTS = 1 << 20
BLOCK_ROWS = 16384
#: Nodes with fewer points are leaves.
LEAF = 12
#: Below so many labels their sums are sent to every task.
SMALL_LABELS = 100_000

NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    return (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)[None, :]


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): the points in tree order, and the nodes level by level, children side by side.

    A node's centre is its first point. Children of a node of scale s are a net of its points: each point lies
    within s / 2 of its child's centre, and the centres of siblings are further apart than that. All nodes of a
    level are split together; one step gives each node that has uncovered points one more child.
    """
    n = len(points)
    order = np.arange(n)
    far = np.sqrt(((points - points[0]) ** 2).sum(1).max()) if n else 0.0
    scale = far
    lo, hi = np.array([0]), np.array([n])
    made, levels = 0, []
    while len(lo):
        sizes = hi - lo
        owner = np.repeat(np.arange(len(lo)), sizes)
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        away = ((points[order[place]] - points[order[lo]][owner]) ** 2).sum(1)
        radius = np.sqrt(np.maximum.reduceat(away, np.concatenate([[0], np.cumsum(sizes)[:-1]])))
        level = np.zeros(len(lo), NODE)
        level["lo"], level["hi"], level["radius"] = lo, hi, radius
        levels.append(level)
        made += len(lo)
        scale = scale / 2
        split = (radius > 0) & (sizes > LEAF)
        if not split.any():
            break
        # The points of nodes to split, each with its node and, once covered, its child's number there.
        left = np.flatnonzero(split[owner])
        child = np.zeros(len(place), np.int64)
        step = np.zeros(len(lo), np.int64)
        while len(left):
            mine = owner[left]
            first = np.concatenate([[True], mine[1:] != mine[:-1]])
            centre = order[place[left[first]]]
            rank = np.cumsum(first) - 1
            covered = ((points[order[place[left]]] - points[centre][rank]) ** 2).sum(1) <= scale * scale
            covered |= first
            taken = left[covered]
            child[taken] = step[owner[taken]]
            step[mine[first]] += 1
            left = left[~covered]
        inside = np.flatnonzero(split[owner])
        by_child = inside[np.lexsort((np.arange(len(inside)), child[inside], owner[inside]))]
        order[place[inside]] = order[place[by_child]]
        counts = np.bincount(owner[by_child] * (step.max() + 1) + child[by_child], minlength=len(lo) * (step.max() + 1))
        counts = counts.reshape(len(lo), -1)
        parent, _ = np.nonzero(counts)
        sizes = counts[counts > 0]
        children = (counts > 0).sum(1)
        level["children"] = children
        level["child"] = np.where(children > 0, made + np.concatenate([[0], np.cumsum(children)[:-1]]), 0)
        ends = np.cumsum(sizes)
        begin = np.concatenate([[0], np.cumsum(counts.sum(1))[:-1]])
        lo = lo[parent] + (ends - sizes) - begin[parent]
        hi = lo + sizes
    return order, np.concatenate(levels)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sizes = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def decided(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lo, hi, entry) of subtrees given as a whole, (place, entry) of points compared one by one."""
    whole_lo, whole_hi, whole_entry, rest = [], [], [], []
    frontier = np.array([0]) if len(points) else np.zeros(0, np.int64)
    while len(frontier):
        level = nodes[frontier]
        d = squares(points[level["lo"]], entries)
        best = d.argmin(1)
        nearest = d[np.arange(len(d)), best]
        d[np.arange(len(d)), best] = np.iinfo(np.int64).max
        # A margin far above the error of the roots; what falls into it is followed down.
        sure = (level["radius"] == 0) | (
            np.sqrt(nearest) + 2 * level["radius"] < np.sqrt(d.min(1).astype(float)) * (1 - 1e-9) - 1e-6
        )
        whole_lo.append(level["lo"][sure])
        whole_hi.append(level["hi"][sure])
        whole_entry.append(best[sure])
        leaf = ~sure & (level["children"] == 0)
        rest.append(_ranges(level["lo"][leaf].astype(np.int64), level["hi"][leaf].astype(np.int64)))
        down = level[~sure & (level["children"] > 0)]
        frontier = _ranges(down["child"].astype(np.int64), (down["child"] + down["children"]).astype(np.int64))
    place = np.concatenate(rest) if rest else np.zeros(0, np.int64)
    exact = squares(points[place], entries).argmin(1)
    join = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (whole_lo, whole_hi, whole_entry)]
    return *join, place, exact


def _build(batches: Iterator[pa.RecordBatch], width: int, parts: int, scale: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per block of rows: ids, labels, and for each part the points in tree order, their places, the nodes."""
    size = -(-width // parts) if width else 0
    rows = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(1, width)))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        flat = np.floor(t["_vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
        whole = np.zeros((len(t), size * parts), np.int64)
        whole[:, :width] = flat.reshape(len(t), width).astype(np.int64)
        out = {"points": [], "places": [], "nodes": []}
        for p in range(parts):
            part = np.ascontiguousarray(whole[:, p * size : (p + 1) * size])
            order, nodes = cover_tree(part)
            out["points"].append(part[order].astype("<i4").tobytes())
            out["places"].append(order.astype("<i4").tobytes())
            out["nodes"].append(nodes.tobytes())
        one = [[t[c].combine_chunks().to_pylist()] for c in ("_id", "_label")] + [[out[c]] for c in out]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(one, schema)], schema=schema)

    held, n = [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            piece = batch.slice(start, rows - n)
            held.append(piece)
            n += piece.num_rows
            start += piece.num_rows
            if n == rows:
                yield block(held)
                held, n = [], 0
    if n:
        yield block(held)


def _block_parts(batch: pa.RecordBatch, row: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    points, places, nodes = (batch.column(c)[row].as_py() for c in ("points", "places", "nodes"))
    for p, (a, b, c) in enumerate(zip(points, places, nodes)):
        place = np.frombuffer(b, "<i4")
        yield p, np.frombuffer(a, "<i4").astype(np.int64).reshape(len(place), size), place, np.frombuffer(c, NODE)


def _totals(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's sums and counts of every entry of every codebook."""
    parts, entries, size = books.shape
    sums, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            for p, points, _, nodes in _block_parts(batch, row, size):
                lo, hi, entry, place, exact = decided(points, nodes, books[p])
                running = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(points, 0)])
                np.add.at(sums[p], entry, running[hi] - running[lo])
                np.add.at(counts[p], entry, hi - lo)
                np.add.at(sums[p], exact, points[place])
                np.add.at(counts[p], exact, 1)
    p, e = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict(
        {"part": p, "entry": e, "n": counts[p, e], "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64()))}
    )


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, id_type: pa.DataType, label_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    size = books.shape[2]
    for batch in batches:
        for row in range(batch.num_rows):
            ids, labels = (batch.column(c)[row].values for c in ("_id", "_label"))
            code, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
            for p, points, place, nodes in _block_parts(batch, row, size):
                lo, hi, entry, alone, exact = decided(points, nodes, books[p])
                given = np.zeros(len(place), np.int64)
                given[_ranges(lo, hi)] = np.repeat(entry, hi - lo)
                given[alone] = exact
                code[place, p] = given
                error[place] += ((points - books[p][given]) ** 2).sum(1)
            text = code.tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(id_type),
                    labels.cast(label_type),
                    pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                    pa.array(error),
                ],
                names=["_id", "_label", "code", "error"],
            )


def _usable(vector: Column) -> Column:
    def good(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce(~F.isnan(x) & (F.abs(x) < MAX_COMPONENT), F.lit(False))

    return F.coalesce(F.forall(vector, good), F.lit(False))


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector.

    Codebooks start as the parts of the `entries` smallest ids. Each round gives every part to its nearest entry
    (ties to the lower index) and moves each used entry to the floor of its parts' mean. Every task sends one row
    per used entry; only the codebooks reach the driver.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    named = vectors.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"), F.col(f"`{vector_col}`").alias("_vector")
    ).where(_usable(F.col("_vector")))
    by_id = [F.col("_id").asc_nulls_last(), F.col("_vector").asc()]
    first = named.orderBy(*by_id).limit(1).collect()
    width = len(first[0]._vector) if first else 0
    kept = named.where(F.size("_vector") == width)
    smallest = kept.orderBy(*by_id).limit(entries).collect()
    seeds = np.array([r._vector for r in smallest], float).reshape(len(smallest), width)
    size = -(-width // parts)
    start = np.zeros((len(seeds), size * parts), np.int64)
    start[:, :width] = np.floor(seeds * scale).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(seeds), parts, size).transpose(1, 0, 2))

    id_type, label_type = named.schema["_id"].dataType, named.schema["_label"].dataType
    binaries = [StructField(c, ArrayType(BinaryType())) for c in ("points", "places", "nodes")]
    schema = StructType([StructField("_id", ArrayType(id_type)), StructField("_label", ArrayType(label_type)), *binaries])
    from pyspark.sql.pandas.types import to_arrow_schema

    build = partial(_build, width=width, parts=parts, scale=scale, schema=to_arrow_schema(schema))
    blocks = stored(kept.mapInArrow(build, schema), "vector-trees")
    for _ in range(rounds if len(seeds) else 0):
        task = blocks.select("points", "places", "nodes").mapInArrow(
            partial(_totals, books=books), "part long, entry long, n long, sums array<long>"
        )
        summed = (
            task.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "v"))
            .groupBy("part", "entry", "at")
            .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        )
        books = books.copy()
        for r in summed.collect():  # one row per component of the codebooks
            if r.at is not None:
                books[r.part, r.entry, r.at] = int(r.v) // r.n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    arrow = to_arrow_schema(StructType([StructField("i", id_type), StructField("l", label_type)]))
    result = StructType(
        [StructField("_id", id_type), StructField("_label", label_type), StructField("code", StringType()), StructField("error", LongType())]
    )
    coded = stored(
        blocks.mapInArrow(partial(_codes, books=books, id_type=arrow.field("i").type, label_type=arrow.field("l").type), result),
        "vector-codes",
    )
    sums = stored(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(sums) if sums.count() <= SMALL_LABELS else sums
    return coded.join(side, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
