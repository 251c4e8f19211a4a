"""Language-model scores of a hidden Markov model with latent states.

Text: A-Z lower-cased, words between white space, then one end token. A state emits a word class and the class
emits a word: P(words) = sum over state paths of prod A(s', s) B(s, class) x prod P(word | class). Classes are
the CRC-32 of a word in CLASSES buckets, so the parameters have a fixed size at every corpus size, and one more
for words not seen in training; P(word | class) comes from the counts of all training words, with one added to
each.

Each partition turns its documents into blocks, one row each, with a vocabulary of their own. The counts of all
words are summed by word and brought back to the blocks that hold the word. Every Baum-Welch round runs the scaled
forward and backward recursions inside the blocks and sums the expected counts of all tasks; only classes, times
states, reach the driver. A state's emissions keep MIXED of the base model, so no text has probability zero.

Documents whose crc32(id as text) mod folds is `held` are scored, never learnt from; a row without id is learnt
from. Null and empty texts hold the end token only. Equal rows are scored row by row. Time for a document grows
with its length; memory does not, since long ones are taken in segments and the forward recursion is repeated
from the states at their starts. Sums of doubles depend on the order of tasks in their last digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from .common import ship, stored
from .packed_ints import pack, unpack

#: Buckets of words; one more class stands for unknown words.
CLASSES = 1 << 16
#: Share of the base model in every state's emissions.
MIXED = 0.01
#: Tokens of a block, and of what the recursions hold at a time.
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 19
#: No word holds white space.
END = b"\n"
START_NOISE, START_STAY, SEED = 1.2, 0.98, 7


class Model(NamedTuple):
    start: np.ndarray  # of each state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # class, state


def tokens(text: str | None) -> list[bytes]:
    """The words, lower-cased in A-Z, and the end."""
    return [*(text or "").encode().lower().split(), END]


def first_model(mass: np.ndarray, states: int) -> Model:
    """States that like to stay, with emissions slightly apart in a fixed pattern."""
    emit = mass[:, None] * np.exp(np.random.default_rng(SEED).normal(0, START_NOISE, (len(mass), states)))
    away = (1 - START_STAY) / max(1, states - 1)
    move = np.where(np.eye(states, dtype=bool), START_STAY if states > 1 else 1.0, away)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def next_model(mass: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """The model of expected counts; a state without counts takes the base model.

    The last class, unknown words, has no counts and keeps its share of the base model in every state.
    """
    n = emit.sum(0)
    seen = np.where(n > 0, (1 - mass[-1]) * emit / np.where(n > 0, n, 1), mass[:, None])
    seen[-1] = mass[-1]
    mixed = (1 - MIXED) * seen + MIXED * mass[:, None]
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), mixed)


def _runs(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Documents by falling length, in runs of bounded tokens (one at least)."""
    order = np.argsort(-lens, kind="stable")
    run = np.cumsum(lens[order]) // STEP_TOKENS
    yield from np.split(order, np.flatnonzero(np.diff(run)) + 1) if len(order) else ()


class Segment:
    """Steps t0 to t1 of a run; at each step the documents that still go on, side by side."""

    def __init__(self, classes: np.ndarray, starts: np.ndarray, lens: np.ndarray, t0: int, t1: int) -> None:
        self.first = t0 == 0
        self.active = np.searchsorted(-lens, -np.arange(t0, t1), side="left")
        self.off = np.concatenate([[0], np.cumsum(self.active)])
        self.classes = np.empty(self.off[-1], classes.dtype)
        for t in range(t0, t1):
            a, b = self.off[t - t0], self.off[t - t0 + 1]
            self.classes[a:b] = classes[starts[: b - a] + t]

    def forward(self, model: Model, before: np.ndarray | None, kind: type) -> tuple[np.ndarray, ...]:
        """Scaled states, scales and emissions of every step, and the states after the last one."""
        emit = np.ascontiguousarray(model.emit.astype(kind)[self.classes].T)
        state = np.empty_like(emit)
        scale = np.empty(emit.shape[1], kind)
        onward, x = np.ascontiguousarray(model.move.T.astype(kind)), before
        for i, n in enumerate(self.active):
            a, b = self.off[i], self.off[i + 1]
            x = (model.start[:, None].astype(kind) if x is None else onward @ x[:, :n]) * emit[:, a:b]
            z = x.sum(0)
            x /= z
            state[:, a:b], scale[a:b] = x, z
        return state, scale, emit, x


def _segments(classes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[tuple[int, int]]:
    """A run of many documents is one segment; a long document alone is cut."""
    step = max(1, STEP_TOKENS // len(lens)) if lens.sum() > 2 * STEP_TOKENS else int(lens[0])
    return [(t, min(t + step, int(lens[0]))) for t in range(0, int(lens[0]), step)]


def log_likelihoods(classes: np.ndarray, lens: np.ndarray, model: Model) -> np.ndarray:
    """Natural logarithm of each document's probability as a sequence of classes."""
    starts, found = np.cumsum(lens) - lens, np.zeros(len(lens))
    for run in _runs(lens):
        x = None
        for t0, t1 in _segments(classes, starts[run], lens[run]):
            part = Segment(classes, starts[run], lens[run], t0, t1)
            _, scale, _, x = part.forward(model, x, float)
            logs = np.log(scale)
            for i, n in enumerate(part.active):
                found[run[:n]] += logs[part.off[i] : part.off[i + 1]]
    return found


def expected_counts(classes: np.ndarray, lens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected first states, moves and emissions of all documents."""
    kind, n_states = np.float32, len(model.start)
    starts = np.cumsum(lens) - lens
    start, move, emit = np.zeros(n_states), np.zeros((n_states, n_states)), np.zeros((len(model.emit), n_states))
    for run in _runs(lens):
        cuts = _segments(classes, starts[run], lens[run])
        parts = [None] * len(cuts)
        entering, x = [], None
        for i, (t0, t1) in enumerate(cuts):
            entering.append(x)
            if i < len(cuts) - 1:  # the last one is held, the others are run again
                x = Segment(classes, starts[run], lens[run], t0, t1).forward(model, x, kind)[3]
        after = np.ones((n_states, 0), kind)
        back = model.move.astype(kind)
        for (t0, t1), before in zip(reversed(cuts), reversed(entering)):
            part = Segment(classes, starts[run], lens[run], t0, t1)
            state, scale, seen, _ = part.forward(model, before, kind)
            seen /= scale
            for i in range(t1 - t0 - 1, -1, -1):
                a, b = part.off[i], part.off[i + 1]
                if after.shape[1] < b - a:  # documents that end here
                    after = np.concatenate([after, np.ones((n_states, b - a - after.shape[1]), kind)], 1)
                state[:, a:b] *= after
                if t0 + i == 0:
                    start += state[:, a:b].sum(1)
                    break
                ahead = seen[:, a:b] * after
                earlier = state[:, part.off[i - 1] : part.off[i - 1] + b - a] if i else before[:, : b - a]
                move += earlier @ ahead.T
                after = back @ ahead
            for s in range(n_states):
                emit[:, s] += np.bincount(part.classes, state[s], len(emit))
        del parts
    return start, move * model.move, emit


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of documents as numbers of a vocabulary of their own."""
    made = TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        nonlocal made
        ids = pa.chunked_array(held_ids).combine_chunks()
        flags, sizes, text = np.concatenate(held_flags), np.array(lens, np.int32), np.concatenate(numbers)
        # Small numbers for frequent words.
        order = np.argsort(-np.bincount(text, minlength=len(known)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        text = place[text]
        counts = np.bincount(text[~np.repeat(flags, sizes)], minlength=len(known))
        row = {
            "_block": [made],
            "_id": [ids.to_pylist()],
            "held": [flags.tobytes()],
            "lens": [pack(sizes)],
            "tokens": [pack(text)],
            "counts": [counts],
        }
        words = pa.array(list(known), pa.binary()).cast(pa.string()).take(pa.array(order))
        made += 1
        listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), words)
        arrays = [listed.cast(f.type) if f.name == "words" else pa.array(row[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def reset() -> None:
        nonlocal held_ids, held_flags, lens, numbers, known, n
        held_ids, held_flags, lens, numbers, known, n = [], [], [], [], {END: 0}, 0

    held_ids, held_flags, lens, numbers, known, n = [], [], [], [], {END: 0}, 0
    for batch in batches:
        texts, flags, start = batch.column("_text").to_pylist(), batch.column("_held").to_numpy(zero_copy_only=False), 0
        while start < len(texts):
            stop, split, size = start, [], 0
            while stop < len(texts) and (not size or size < STEP_TOKENS) and n + size < BLOCK_TOKENS:
                split.append(tokens(texts[stop]))
                size += len(split[-1])
                stop += 1
            for w in chain.from_iterable(split):
                if w not in known:
                    known[w] = len(known)
            numbers.append(np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int32, size))
            lens += map(len, split)
            held_ids.append(batch.column("_id").slice(start, stop - start))
            held_flags.append(flags[start:stop].astype(bool))
            n, start = n + size, stop
            if n >= BLOCK_TOKENS:
                yield block()
                reset()
    if lens:
        yield block()


def _counted(key: tuple, block: pa.Table, words: pa.Table, schema: pa.Schema, seen: int, distinct: int, mass: np.ndarray) -> pa.Table:
    """A block with the classes of its words, and what the counts alone say of each document."""
    if not len(block):
        return schema.empty_table()
    lens, text = (unpack(block[c][0].as_py()) for c in ("lens", "tokens"))
    local = words["local"].to_numpy()
    count, group = np.zeros(len(local), np.int64), np.zeros(len(local), np.int32)
    count[local] = words["count"].to_numpy()
    group[local] = words["group"].to_numpy()
    group[count == 0] = len(mass) - 1
    base = np.log10((count + 1) / (seen + distinct + 1))
    first = np.cumsum(lens) - lens
    row = {
        "n_known": [np.add.reduceat((count > 0)[text].astype(np.int64), first)],
        "base": [np.add.reduceat(base[text], first)],
        "inside": [np.add.reduceat((base - np.log10(mass[group]))[text], first)],
        "classes": [pack(group)],
    }
    same = {c: block[c].combine_chunks() for c in ("_id", "held", "lens", "tokens")}
    arrays = [same[f.name].cast(f.type) if f.name in same else pa.array(row[f.name], f.type) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema)


def _read(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which documents are held out, their lengths, and the classes of all tokens."""
    held, lens, tokens, classes = (batch.column(c)[row].as_py() for c in ("held", "lens", "tokens", "classes"))
    return np.frombuffer(held, bool), unpack(lens).astype(np.int64), unpack(classes)[unpack(tokens)]


def _expected(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """This task's expected counts: a row per class that it met, then per state that is left, then the first states."""
    states, total = len(model.start), None
    for batch in batches:
        for row in range(batch.num_rows):
            held, lens, classes = _read(batch, row)
            found = expected_counts(classes[~np.repeat(held, lens)], lens[~held], model)
            total = found if total is None else tuple(a + b for a, b in zip(total, found))
    if total is not None:
        start, move, emit = total
        met = np.flatnonzero(emit.any(1))
        rows = np.concatenate([emit[met], move, start[None, :]])
        keys = np.concatenate([met, -1 - np.arange(states + 1)])
        columns = {"_row": keys} | {f"s{i}": rows[:, i] for i in range(states)}
        yield pa.RecordBatch.from_pydict(columns)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            held, lens, classes = _read(batch, row)
            known, base, inside = (batch.column(c)[row].values for c in ("n_known", "base", "inside"))
            score = log_likelihoods(classes, lens, model) / np.log(10) + inside.to_numpy()
            columns = [batch.column("_id")[row].values, held, lens, known, base, score]
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def hmm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 6, rounds: int = 3, folds: int = 7, held: int = 2
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, log10 probabilities."""
    spark = docs.sparkSession
    ship(spark)
    number = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    named = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{text_col}`").alias("_text"),
        F.coalesce(number % folds == held, F.lit(False)).alias("_held"),
    )
    id_type = named.schema["_id"].dataType
    head = [StructField("_id", ArrayType(id_type)), StructField("held", BinaryType()), StructField("lens", BinaryType())]
    schema = StructType(
        [
            StructField("_block", LongType()),
            *head,
            StructField("tokens", BinaryType()),
            StructField("words", ArrayType(StringType())),
            StructField("counts", ArrayType(LongType())),
        ]
    )
    blocks = stored(named.mapInArrow(partial(_blocks, schema=to_arrow_schema(schema)), schema), "hmm-blocks")

    counts = stored(
        blocks.select(F.inline(F.arrays_zip("words", "counts")).alias("word", "n"))
        .where("n > 0")
        .groupBy("word")
        .agg(F.sum("n").alias("count"))
        .withColumn("group", F.crc32(F.col("word").cast("binary")) % CLASSES),
        "hmm-words",
    )
    by_class = counts.groupBy("group").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    seen, distinct = sum(r.n for r in by_class), sum(r.words for r in by_class)
    mass = np.zeros(CLASSES + 1)
    for r in by_class:
        mass[r.group] = (r.n + r.words) / (seen + distinct + 1)
    mass[CLASSES] = 1 / (seen + distinct + 1)

    counted = StructType(
        [
            *head,
            StructField("tokens", BinaryType()),
            StructField("classes", BinaryType()),
            StructField("n_known", ArrayType(LongType())),
            StructField("base", ArrayType(DoubleType())),
            StructField("inside", ArrayType(DoubleType())),
        ]
    )
    arrow = to_arrow_schema(counted)

    def joined(key: tuple, block: pa.Table, words: pa.Table) -> pa.Table:
        return _counted(key, block, words, arrow, seen, distinct, mass)

    words = blocks.select(F.col("_block").alias("_of"), F.posexplode("words").alias("local", "word"))
    known = words.join(counts, "word", "left").select(
        "_of", "local", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("group", F.lit(CLASSES)).alias("group")
    )
    texts = stored(
        blocks.select("_block", "_id", "held", "lens", "tokens").groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(joined, counted),
        "hmm-classes",
    )

    model = first_model(mass, states)
    columns = [f"s{i}" for i in range(states)]
    fields = ", ".join(f"{c} double" for c in columns)
    for _ in range(rounds):
        task = texts.select("held", "lens", "tokens", "classes").mapInArrow(partial(_expected, model=model), f"_row long, {fields}")
        total = np.zeros((CLASSES + 1 + states + 1, states))  # negative rows count from the end
        for r in task.groupBy("_row").agg(*(F.sum(c).alias(c) for c in columns)).collect():
            total[r._row] = r[1:]
        model = next_model(mass, total[-1 - states], total[-1 : -1 - states : -1], total[: CLASSES + 1])

    result = StructType(
        [
            StructField("_id", id_type),
            StructField("held_out", BooleanType()),
            StructField("n_tokens", LongType()),
            StructField("n_known", LongType()),
            StructField("base_score", DoubleType()),
            StructField("score", DoubleType()),
        ]
    )
    scores = texts.mapInArrow(partial(_scored, model=model, schema=to_arrow_schema(result)), result)
    return scores.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(seen).cast("long").alias("train_tokens"), "base_score", "score"
    )
