"""MinHash near-dedup with tensored banding.

Every distinct shingle set gets `collections` keys, each made of `rows` minhashes. A table is a pair of
collections, and a document's key there is the pair of its two collection keys: c collections serve
c * (c - 1) / 2 tables of 2 * rows minhashes, where plain banding would compute that many for each table.
Two sets are candidates when at least two collections agree. With 20 collections of 3 rows a pair of
similarity 0.8 is missed with probability 1.3e-5, a closer one with less. Candidates of too different sizes
go, and those whose 768 lowest minhash bits differ in more places than 3.9 standard deviations allow at the
threshold (one pair in 20,000 at 0.8, fewer above); the others are confirmed on full shingle sets. No bucket
is turned into all its pairs:
1. each bucket links its members to its centre, the member that shares most collection keys;
2. members that are not in the centre's component after that meet the bucket's members of other components
   in their own and the neighbouring size classes, each pair only in the first table that it shares.
Within a component nothing is left to compare, so a large group of copies costs one link per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import mix, odd_numbers, shingles, steps, text_bytes, word_hashes
from .common import packed_row, ship, stored, whole
from .components import connected_components

COLLECTIONS = 20
ROWS = 3
BITS = 768
DEVIATIONS = 3.9
PERCENT = 80


def _sketch(size: int, collections: int, rows: int):
    """Batches of (_id, _hash, _text) -> per row the set's size, digest, collection keys and minhash bits."""
    functions = max(BITS, collections * rows)
    factors, shifts = odd_numbers(functions, 11), odd_numbers(functions, 12)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("_text"))
            for start, stop in steps(ends):
                own = ends[start : stop + 1] - ends[start]
                hashes, begin = shingles(*word_hashes(data[ends[start] : ends[stop]], own), size)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                keys = np.zeros((stop - start, collections), np.uint64)
                digest, bits = np.zeros((stop - start, 2), np.uint64), np.zeros((stop - start, BITS // 64), np.uint64)
                if len(full):
                    at = begin[:-1][full]
                    digest[full, 0] = np.add.reduceat(mix(hashes + np.uint64(1)), at)
                    digest[full, 1] = np.bitwise_xor.reduceat(mix(hashes ^ factors[0]), at)
                    for k in range(functions):
                        least = np.minimum.reduceat((hashes * factors[k] + shifts[k]) >> np.uint64(24), at)
                        if (c := k // rows) < collections:
                            keys[full, c] = mix((keys[full, c] + np.uint64(c + 1)) * factors[0] + least)
                        if k < BITS:
                            bits[full, k // 64] |= (least & np.uint64(1)) << np.uint64(k % 64)
                sets = pa.array([d.tobytes() for d in digest], pa.binary())
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))
                    for x in (keys, bits)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in ("_id", "_hash")), pa.array(n), sets, *lists],
                    ["_id", "_hash", "_n", "_set", "_keys", "_bits"],
                )

    return sketch


def _sets(size: int):
    """Batches of (_set, _text) -> the set's sorted shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("_text"))
            for start, stop in steps(ends):
                own = ends[start : stop + 1] - ends[start]
                hashes, begin = shingles(*word_hashes(data[ends[start] : ends[stop]], own), size)
                flat = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("_set").slice(start, stop - start), flat], ["_set", "_hashes"])

    return sets


def _tables(sketches: DataFrame, collections: int) -> DataFrame:
    """(_set, _score, _table, _key) of distinct sets, without keys that only one set has.

    A collection key that no other set has can be in no shared table; dropping those first leaves few
    tables of most sets. The score is the number of sets met over all collections.
    """
    one = sketches.where("_n > 0").groupBy("_set").agg(F.first("_keys").alias("_keys"))
    keys = one.select("_set", F.posexplode("_keys").alias("_c", "_k"))
    shared = keys.groupBy("_c", "_k").agg(F.count("*").alias("_m")).where("_m > 1")
    own = (
        keys.join(shared, ["_c", "_k"])
        .groupBy("_set")
        .agg(F.array_sort(F.collect_list(F.struct("_c", "_k"))).alias("_own"), F.sum("_m").alias("_score"))
        .where(F.size("_own") > 1)
    )
    pairs = F.flatten(
        F.transform(
            "_own",
            lambda x: F.transform(
                F.filter("_own", lambda y: y["_c"] > x["_c"]),
                lambda y: F.struct(
                    (x["_c"] * collections + y["_c"]).alias("_table"), F.xxhash64(x["_k"], y["_k"]).alias("_key")
                ),
            ),
        )
    )
    return own.select("_set", "_score", F.inline(pairs))


def _alike(x: str, y: str, percent: int) -> Column:
    """Sizes and minhash bits allow the similarity; x and y are suffixes of the two sides' columns."""
    n, m = F.col(f"_n{x}"), F.col(f"_n{y}")
    differ = (1 - percent / 100) / 2
    most = int(BITS * differ + DEVIATIONS * (BITS * differ * (1 - differ)) ** 0.5)
    apart = sum(F.bit_count(F.get(f"_bits{x}", F.lit(i)).bitwiseXOR(F.get(f"_bits{y}", F.lit(i)))) for i in range(BITS // 64))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= most)


def _first_shared(collections: int) -> Column:
    """This table is the pair of the first two collections whose whole keys agree."""
    return F.expr(
        f"slice(filter(sequence(0, {collections - 1}), i -> get(_keys_x, i) = get(_keys, i)), 1, 2)"
        f" = array(cast(_table div {collections} as int), cast(_table % {collections} as int))"
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets share enough: 100 * intersection >= percent * union."""
    left = sets.select(F.col("_set").alias("a"), F.col("_hashes").alias("_x"))
    right = sets.select(F.col("_set").alias("b"), F.col("_hashes").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.where(100 * shared >= percent * (F.size("_x") + F.size("_y") - shared)).select("a", "b")


def _candidate_sets(docs: DataFrame, members: DataFrame, sketches: DataFrame, size: int, text: Column, ids: Column) -> DataFrame:
    """(_set, _hashes) of the sets in some bucket, from one text each."""
    one = sketches.where("_n > 0").groupBy("_set").agg(F.min(F.struct("_id", "_hash")).alias("_one"))
    chosen = members.join(one, "_set").select(
        "_set", F.col("_one._id").alias("_oid"), F.col("_one._hash").alias("_ohash")
    )
    rows = docs.select(ids.alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    texts = rows.join(chosen, (rows["_hash"] == chosen["_ohash"]) & rows["_id"].eqNullSafe(chosen["_oid"]))
    texts = texts.dropDuplicates(["_set"])  # rows may be repeated
    return texts.select("_set", "_text").mapInArrow(_sets(size), "_set binary, _hashes array<bigint>")


def _links(buckets: DataFrame, traits: DataFrame, sets: DataFrame, percent: int, collections: int) -> DataFrame:
    """Confirmed links (a, b) that span every component. traits: _set, _n, _bits, _keys."""
    to_centre = stored(
        buckets.where("_set <> _centre").select(F.col("_set").alias("a"), F.col("_centre").alias("b")).distinct(),
        "near-to-centre",
    )
    side = lambda name, x: traits.select(F.col("_set").alias(name), *[F.col(c).alias(f"{c}_{x}") for c in ("_n", "_bits")])
    likely = to_centre.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_alike("_x", "_y", percent)).select("a", "b")
    first = stored(_confirmed(likely, sets, percent), "near-links")
    found = stored(connected_components(first), "near-components")
    of = found.select(F.col("v").alias("_set"), F.col("component").alias("_of"))
    of_centre = found.select(F.col("v").alias("_centre"), F.col("component").alias("_main"))
    placed = stored(
        buckets.join(of, "_set", "left")
        .join(of_centre, "_centre", "left")
        .select("_table", "_key", "_set", F.coalesce("_of", "_set").alias("_of"), F.coalesce("_main", "_centre").alias("_main")),
        "near-placed",
    )
    apart = placed.where("_of <> _main")
    # buckets that are whole components have nothing left to compare
    open_buckets = placed.join(apart.select("_table", "_key").distinct(), ["_table", "_key"], "left_semi")
    sized = open_buckets.join(traits, "_set").withColumn(
        "_class", F.floor(F.log(F.col("_n").cast("double")) / F.log(F.lit(100.0 / percent)))
    )
    # a pair at the threshold lies in one size class or in neighbouring ones; one more guards against rounding
    near_classes = F.explode(F.array(*[F.col("_class") + i for i in (-2, -1, 0, 1, 2)]))
    outside = sized.where("_of <> _main").select(
        "_table", "_key", near_classes.alias("_class"), *[F.col(c).alias(f"{c}_x") for c in ("_of", "_set", "_n", "_bits", "_keys")]
    )
    cross = (
        outside.join(sized, ["_table", "_key", "_class"])
        .where(
            (F.col("_of_x") != F.col("_of"))
            & ((F.col("_set_x") < F.col("_set")) | (F.col("_of") == F.col("_main")))
            & _alike("_x", "", percent)
            & _first_shared(collections)
        )
        .select(F.least("_set", "_set_x").alias("a"), F.greatest("_set", "_set_x").alias("b"))
        .distinct()
    )
    tried = to_centre.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(cross.join(tried, ["a", "b"], "left_anti"), "near-cross")
    return first.unionByName(_confirmed(rest, sets, percent)).distinct()


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = PERCENT,
    collections: int = COLLECTIONS,
    rows: int = ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Links join sets with 100 * intersection >= percent * union. Texts of fewer than `size` words are one
    shingle; null, empty and blank texts have none and stand alone. Rows with equal sets are linked, rows
    that repeat the smallest id are all marked kept; a null id takes its component's smallest id, null if
    there is none. No rows give no rows.
    """
    ship(docs.sparkSession)
    text, ids = whole(text_column), F.col(f"`{id_column}`")
    kind = docs.schema[id_column].dataType.simpleString()
    sketches = stored(
        docs.select(ids.alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text")).mapInArrow(
            _sketch(size, collections, rows),
            f"_id {kind}, _hash bigint, _n bigint, _set binary, _keys array<bigint>, _bits array<bigint>",
        ),
        "near-sketches",
    )
    tables = stored(_tables(sketches, collections), "near-tables")
    centres = (
        tables.groupBy("_table", "_key")
        .agg(F.count("*").alias("_m"), F.max(F.struct("_score", "_set")).alias("_top"))
        .where("_m > 1")
        .select("_table", "_key", F.col("_top._set").alias("_centre"))
    )
    buckets = stored(tables.join(centres, ["_table", "_key"]).drop("_score"), "near-buckets")
    sets = stored(
        _candidate_sets(docs, buckets.select("_set").distinct(), sketches, size, text, ids), "near-sets"
    )
    traits = stored(
        buckets.select("_set").distinct().join(sketches.select("_set", "_n", "_bits", "_keys"), "_set").dropDuplicates(["_set"]),
        "near-traits",
    )
    links = stored(_links(buckets, traits, sets, percent, collections), "near-confirmed")
    components = connected_components(links).select(F.col("v").alias("_set"), F.col("component").alias("_of"))
    smallest = sketches.where("_n > 0").groupBy("_set").agg(F.min("_id").alias("_least"))
    placed = smallest.join(components, "_set", "left").select("_set", "_least", F.coalesce("_of", "_set").alias("_of"))
    of_all = placed.groupBy("_of").agg(F.min("_least").alias("_first"))
    named = stored(placed.join(of_all, "_of").select("_set", "_first"), "near-names")
    component = F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("_first"))
    return (
        sketches.select("_id", "_n", F.when(F.col("_n") > 0, F.col("_set")).alias("_set"))
        .join(named, "_set", "left")
        .select(
            F.col("_id").alias(id_column),
            F.col("_n").alias("n_shingles"),
            component.alias("component_id"),
            F.col("_id").eqNullSafe(component).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Of rows that repeat that id one stays; documents without words or without an id all stay.
    """
    kept = near_duplicates(docs, id_column=id_column, text_column=text_column, **options).where("kept")
    names = docs.columns
    rows = docs.select(packed_row(names), F.col(f"`{id_column}`").alias("_id"))
    wanted = kept.select(F.col(f"`{id_column}`").alias("_kid")).where("_kid is not null").distinct()
    alone = rows.where("_id is null")
    one = rows.join(wanted, rows["_id"] == wanted["_kid"]).dropDuplicates(["_id"])
    return one.select("_row").unionByName(alone.select("_row")).select(
        *[F.col("_row").getField(c).alias(c) for c in names]
    )
