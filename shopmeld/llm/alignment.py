"""Cross-tokenizer alignment: groups of tokens of two tokenizers between byte offsets where both end.

A: a byte-level tokenizer file applied to a space and the text. B: a SentencePiece model, which adds that space
itself. Intervals are divided at common ends: the ends of A from the middle of an interval outwards are looked up
among the ends of B by bisection, the first common one cuts the interval in two, and both halves go on; an
interval without a common end is a group. All intervals of a step are divided side by side in numpy.

Neither tokenizer merges across a space or line break between two visible Latin characters, so texts are cut
there first: each distinct piece is encoded and divided once per worker, and a document's groups are those of its
pieces. Pieces with other white space or other characters are encoded alone, with what they hold, however long.

Links are the overlapping pairs of token occurrences. Blocks of documents keep their distinct id pairs with the
number of documents that hold each; these are summed over the corpus and brought back to the blocks. Only the
highest count of each A id, at most one row per vocabulary entry, is sent to all tasks.

Null and empty texts, and texts whose bytes the tokens do not give back (those with U+2581), have no tokens:
zeros and an empty digest. Equal rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import ship, stored, whole
from .packed_ints import pack, unpack
from .tokens import VISIBLE, strings

#: A place to cut: a visible Latin character, then a space or line break that another one follows.
CUT = re.compile(f"(?<=[{VISIBLE}])(?=[ \n][{VISIBLE}])")
#: Where white space is not simply one such space or line break.
UNUSUAL = f"(?:\\A|[^{VISIBLE}])[ \n]|[ \n](?:[^{VISIBLE}]|\\z)|\x01"
#: Pieces that can be encoded side by side in one text.
PLAIN = re.compile(f"[ \n][{VISIBLE}]+")
META = "▁"
#: An id pair is a * PAIR + b.
PAIR = 1 << 20
#: What a worker keeps at most before it starts anew with the next block.
CACHED_PIECES = 500_000
CACHED_LINKS = 1 << 23
CACHED_CHARS = 64
JOINED_CHARS = 4096
BLOCK_CHARS = 1 << 23
STEP_CHARS = 1 << 20


def pieces_of(text: str) -> list[str]:
    """A space and the text, cut where neither tokenizer merges."""
    return CUT.split(" " + text)


def cut(texts: pa.Array) -> pa.Array:
    """The pieces of each text, as a list, by Arrow where white space allows it; empty texts have none."""
    space, none = pa.scalar(" ", texts.type), pa.scalar("", texts.type)
    marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n"), " ", "\x01 ")
    lists = pc.split_pattern(pc.binary_join_element_wise(space, marked, none), "\x01")
    unusual = pc.or_(pc.match_substring_regex(texts, UNUSUAL), pc.equal(texts, none))
    odd = np.flatnonzero(unusual.to_numpy(zero_copy_only=False))
    if not len(odd):
        return lists
    found = pa.array([pieces_of(t) if t else [] for t in strings(texts.take(pa.array(odd)))], lists.type)
    at = np.arange(len(texts))
    at[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([lists, found]).take(pa.array(at))


def distinct(values: np.ndarray) -> np.ndarray:
    """The values without repeats, ascending. Sorting takes a small part of the time of np.unique's hash table."""
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sizes = hi - lo
    return np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def divide(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the groups, as token numbers of A and of B, first and last ones included.

    a, b: borders of intervals that are known already (both tokenizers end there), as token numbers.
    """
    todo = np.stack([a[:-1], a[1:], b[:-1], b[1:]])
    leaves = []
    while todo.shape[1]:
        small = (todo[1] - todo[0] < 2) | (todo[3] - todo[2] < 2)
        leaves.append(todo[:, small])
        todo = todo[:, ~small]
        lo, hi = todo[0], todo[1]
        middle = (lo + hi - 2) // 2
        cut_a, cut_b = np.full(len(lo), -1), np.zeros(len(lo), np.int64)
        left, step = np.arange(len(lo)), 0
        while len(left):
            away = (step + 1) // 2 * (1 if step % 2 else -1)  # middle, one after, one before, two after, ...
            at = middle[left] + away
            inside = (at >= lo[left]) & (at < hi[left] - 1)
            probe, at = left[inside], at[inside]
            place = np.searchsorted(ends_b, ends_a[at])
            common = ends_b[place] == ends_a[at]
            cut_a[probe[common]] = at[common] + 1
            cut_b[probe[common]] = place[common] + 1
            step += 1
            left = left[(cut_a[left] < 0) & (step <= hi[left] - lo[left])]
        found = cut_a >= 0
        leaves.append(todo[:, ~found])
        x, y, z, w = todo[:, found]
        cut_a, cut_b = cut_a[found], cut_b[found]
        todo = np.concatenate([np.stack([x, cut_a, z, cut_b]), np.stack([cut_a, y, cut_b, w])], 1)
    all_leaves = np.concatenate(leaves, 1) if leaves else todo
    order = np.argsort(all_leaves[0], kind="stable")
    return np.concatenate([all_leaves[0, order], a[-1:]]), np.concatenate([all_leaves[2, order], b[-1:]])


class Tokenizer:
    """Ids and byte strings of both tokenizers."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer as Byte

        self.a = Byte.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(map(chr, plain), plain)) | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a = [bytes(shown[c] for c in t) for t, _ in names]
        size = self.b.get_piece_size()
        self.bytes_b = [
            bytes([int(t[3:-1], 16)]) if self.b.is_byte(i) else t.replace(META, " ").encode()
            for i, t in enumerate(map(self.b.id_to_piece, range(size)))
        ]
        self.first_b = self.b.piece_to_id(META)
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """The model puts a space before each text: taken from those that have one, its token from the others."""
        spaced = [t.startswith(" ") for t in texts]
        found = self.b.encode([t[1:] if s else t for t, s in zip(texts, spaced)], num_threads=1)
        for s, ids in zip(spaced, found):
            if not s:
                assert ids[0] == self.first_b, "no piece of the model starts before a line break"
        return [ids if s else ids[1:] for s, ids in zip(spaced, found)]


def joined(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts of some length that hold the pieces one after the other, and how many pieces each holds."""
    run = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) // JOINED_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(pieces)] if pieces else [0]
    return ["".join(pieces[i:j]) for i, j in zip(cuts, cuts[1:])], np.diff(cuts)


class Aligner:
    """Aligned pieces, kept for the next texts: numbers of a piece are places in the arrays here."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.tokenizer = Tokenizer(path_a, path_b)
        n_a, n_b = len(self.tokenizer.bytes_a), len(self.tokenizer.bytes_b)
        self.inner = np.array([f"{i}," for i in range(max(n_a, n_b))], object)
        self.last_a = np.array([f"{i}|" for i in range(n_a)], object)
        self.last_b = np.array([f"{i};" for i in range(n_b)], object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        #: n_a, n_b, n_groups and whether the bytes are given back
        self.counts = np.zeros((4, 0), np.int64)
        self.links = np.zeros(0, np.int64)
        self.link_ends = np.zeros(1, np.int64)

    def learn(self, pieces: list[str]) -> None:
        t = self.tokenizer
        plain = [bool(PLAIN.fullmatch(p)) for p in pieces]
        alone = [p for p, x in zip(pieces, plain) if not x]
        pieces = [*alone, *(p for p, x in zip(pieces, plain) if x)]
        texts, _ = joined(pieces[len(alone) :])
        encoded_a, encoded_b = t.ids_a([*alone, *texts]), t.ids_b([*alone, *texts])
        raw = list(map(str.encode, pieces))
        # Pieces that do not come back are left out of the division: one token of each stands for them.
        same = np.ones(len(pieces), bool)
        for i, p in enumerate(raw[: len(alone)]):
            same[i] = all(b"".join(map(x.__getitem__, y[i])) == p for x, y in ((t.bytes_a, encoded_a), (t.bytes_b, encoded_b)))
            if not same[i]:
                encoded_a[i], encoded_b[i], raw[i] = [0], [0], b"?"
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (encoded_a, encoded_b))
        sizes_a, sizes_b = t.sizes_a[a], t.sizes_b[b]
        for i in np.flatnonzero(~same):
            sizes_a[sum(map(len, encoded_a[:i]))] = sizes_b[sum(map(len, encoded_b[:i]))] = 1
        ends_a, ends_b, borders = np.cumsum(sizes_a), np.cumsum(sizes_b), np.concatenate([[0], np.cumsum(sizes)])
        at_a = np.searchsorted(ends_a, borders[1:]) + 1
        at_b = np.searchsorted(ends_b, borders[1:]) + 1
        assert (ends_a[at_a - 1] == borders[1:]).all() and (ends_b[at_b - 1] == borders[1:]).all(), "a cut inside a token"
        at_a, at_b = np.concatenate([[0], at_a]), np.concatenate([[0], at_b])
        group_a, group_b = divide(ends_a, ends_b, at_a, at_b)

        # Every stretch between neighbouring ends of either kind is one overlapping pair.
        stretch = distinct(np.concatenate([ends_a, ends_b]))
        links = a[np.searchsorted(ends_a, stretch)] * PAIR + b[np.searchsorted(ends_b, stretch)]
        at_link = np.searchsorted(stretch, borders[1:]) + 1

        # Groups as text: the tokens of A and then of B, group after group.
        text = np.empty(len(a) + len(b), object)
        sizes_a, sizes_b = np.diff(group_a), np.diff(group_b)
        word_a, word_b = self.inner[a], self.inner[b]
        word_a[group_a[1:] - 1] = self.last_a[a[group_a[1:] - 1]]
        word_b[group_b[1:] - 1] = self.last_b[b[group_b[1:] - 1]]
        text[np.arange(len(a)) + np.repeat(group_b[:-1], sizes_a)] = word_a
        text[np.arange(len(b)) + np.repeat(group_a[1:], sizes_b)] = word_b
        words, cuts = text.tolist(), (at_a + at_b).tolist()
        self.known.update(zip(pieces, range(len(self.said), len(self.said) + len(pieces))))
        self.said += ["".join(words[i:j]) for i, j in zip(cuts, cuts[1:])]
        n_groups = np.diff(np.searchsorted(group_a, at_a))
        self.counts = np.concatenate([self.counts, np.stack([np.diff(at_a), np.diff(at_b), n_groups, same])], 1)
        self.links = np.concatenate([self.links, links])
        self.link_ends = np.concatenate([self.link_ends, self.link_ends[-1] + at_link])

    def align(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has; none where the bytes do not come back."""
        split = cut(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()))
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        pieces = strings(coded.dictionary)
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            fresh = [pieces[i] for i in missing.tolist()]
            self.learn(fresh)
            number[missing] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
            for p in fresh:
                if len(p) > CACHED_CHARS:
                    del self.known[p]
        places = number[coded.indices.to_numpy()]
        good = self.counts[3, places].astype(bool)
        if not good.all():
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.zeros(len(sizes), bool)
            bad[row[~good]] = True
            places, sizes = places[~bad[row]], np.where(bad, 0, sizes)
        return places, sizes


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner for two files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def groups_text(aligned: Aligner, places: np.ndarray) -> str:
    """`a1,a2|b1;a3|b2,b3` of a text by the numbers of its pieces."""
    return "".join(map(aligned.said.__getitem__, places.tolist()))[:-1]


def _totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values over runs of the given sizes; runs may be empty."""
    running, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return running[ends] - running[ends - sizes]


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per block: what is known of its documents, their pieces, and its id pairs with numbers of documents."""
    made, a = TaskContext.get().partitionId() << 32, aligner(path_a, path_b)
    ids, places, sizes, digests, chars = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        nonlocal made
        all_places, n = np.concatenate(places), np.concatenate(sizes)
        counts = a.counts[:3, all_places]
        often = np.bincount(all_places, minlength=len(a.said))
        used = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]  # small numbers for frequent pieces
        place = np.empty(len(often), np.int64)
        place[used] = np.arange(len(used))
        local = place[all_places]
        n_links = a.link_ends[used + 1] - a.link_ends[used]
        codes, pair = np.unique(a.links[_ranges(a.link_ends[used], a.link_ends[used + 1])], return_inverse=True)
        # Documents that hold a pair: distinct pieces of each, then the distinct pairs of those.
        doc = np.repeat(np.arange(len(n)), n)
        held = distinct(doc * max(1, len(used)) + local)
        doc, piece = held // max(1, len(used)), held % max(1, len(used))
        ends = np.cumsum(n_links)
        keys = np.repeat(doc, n_links[piece]) * max(1, len(codes)) + pair[_ranges(ends[piece] - n_links[piece], ends[piece])]
        docs = np.bincount(distinct(keys) % max(1, len(codes)), minlength=len(codes))
        row = {
            "_block": [made],
            "_id": [pa.chunked_array(ids).combine_chunks().to_pylist()],
            "n_a": [_totals(counts[0], n)],
            "n_b": [_totals(counts[1], n)],
            "n_groups": [_totals(counts[2], n)],
            "n_links": [_totals((a.link_ends[1:] - a.link_ends[:-1])[all_places], n)],
            "digest": [digests],
            "sizes": [pack(n)],
            "pieces": [pack(local)],
            "link_sizes": [pack(n_links)],
            "links": [pack(pair)],
            "codes": [codes],
            "docs": [docs],
        }
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in schema], schema=schema)

    for batch in batches:
        texts, start = batch.column("_text"), 0
        chars_of = pc.utf8_length(texts).to_pylist()
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < STEP_CHARS):
                size += chars_of[stop]
                stop += 1
            if not ids and (len(a.said) > CACHED_PIECES or len(a.links) > CACHED_LINKS):
                a.forget()
            found, n = a.align(texts.slice(start, stop - start))
            places.append(found)
            sizes.append(n)
            ends = np.cumsum(n)
            for lo, hi in zip((ends - n).tolist(), ends.tolist()):
                digests.append(hashlib.sha256(groups_text(a, found[lo:hi]).encode()).hexdigest() if hi > lo else "")
            ids.append(batch.column("_id").slice(start, stop - start))
            chars, start = chars + size, stop
            if chars >= BLOCK_CHARS:
                yield block()
                ids, places, sizes, digests, chars = [], [], [], [], 0
    if ids:
        yield block()


def _counted(key: tuple, block: pa.Table, pairs: pa.Table, schema: pa.Schema) -> pa.Table:
    """A block's documents with the counts of their links."""
    if not len(block):
        return schema.empty_table()
    n, pieces, n_links, links = (unpack(block[c][0].as_py()) for c in ("sizes", "pieces", "link_sizes", "links"))
    count, best = np.zeros((2, links.max(initial=-1) + 1), np.int64)
    local = pairs["local"].to_numpy()
    count[local], best[local] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    row = {c: block[c].combine_chunks().values for c in ("_id", "n_a", "n_b", "n_groups", "n_links", "digest")}
    for name, value in (("n_best", best), ("count_sum", count)):
        row[name] = _totals(_totals(value[links], n_links)[pieces], n)
    arrays = [row[f.name] if isinstance(row[f.name], pa.Array) else pa.array(row[f.name], f.type) for f in schema]
    return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(text_col).alias("_text"))
    id_type = named.schema["_id"].dataType
    longs = ["n_a", "n_b", "n_groups", "n_links"]
    schema = StructType(
        [StructField("_block", LongType()), StructField("_id", ArrayType(id_type))]
        + [StructField(c, ArrayType(LongType())) for c in longs]
        + [StructField("digest", ArrayType(StringType()))]
        + [StructField(c, BinaryType()) for c in ("sizes", "pieces", "link_sizes", "links")]
        + [StructField(c, ArrayType(LongType())) for c in ("codes", "docs")]
    )
    build = partial(_blocks, path_a=path_a, path_b=path_b, schema=to_arrow_schema(schema))
    blocks = stored(named.mapInArrow(build, schema), "alignment-blocks")
    counts = stored(
        blocks.select(F.inline(F.arrays_zip("codes", "docs")).alias("code", "docs")).groupBy("code").agg(F.sum("docs").alias("count")),
        "alignment-pairs",
    ).withColumn("a", F.floor(F.col("code") / PAIR))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # at most one row per id of A
    marked = counts.join(F.broadcast(highest), "a").select(
        "code", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")
    )
    pairs = blocks.select(F.col("_block").alias("_of"), F.posexplode("codes").alias("local", "code"))
    result = StructType(
        [StructField("_id", id_type)]
        + [StructField(c, LongType()) for c in (*longs, "n_best", "count_sum")]
        + [StructField("digest", StringType())]
    )
    arrow = to_arrow_schema(result)

    def counted(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
        return _counted(key, block, found, arrow)

    known = pairs.join(marked, "code").select("_of", "local", "count", "best")
    rows = blocks.drop("codes", "docs").groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(counted, result)
    return rows.select(F.col("_id").alias(id_col), *longs, "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
