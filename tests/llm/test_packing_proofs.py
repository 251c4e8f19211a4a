"""Packing against the tokenizer, exact optima of small tables and the certified bounds."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shopmeld.llm.packing import best_fit_decreasing, lower_bound, packed
from shopmeld.llm.tokens import public_file

PATH = public_file("word_bpe_49k.json")


def optimum(lengths, capacity):
    """Fewest bins, by trying every way to fill the bin of the longest item that is left."""

    @lru_cache(maxsize=None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for chosen in range(1 << len(rest)):
            taken = [x for i, x in enumerate(rest) if chosen >> i & 1]
            if first + sum(taken) <= capacity:
                best = min(best, 1 + least(tuple(x for i, x in enumerate(rest) if not chosen >> i & 1)))
        return best

    return least(tuple(sorted(lengths, reverse=True)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bounds_and_bins_around_the_optimum(lengths):
    capacity = 12
    bins, _ = best_fit_decreasing(np.array(lengths), capacity)
    best = optimum(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    assert bound <= best <= bins.max() + 1 <= (11 * best + 6) // 9
    assert max(np.bincount(bins, weights=lengths)) <= capacity


@pytest.mark.parametrize("group", [40_000, 5])
def test_pieces_against_the_tokenizer(spark, group):
    rng = np.random.default_rng(4)
    words = "the river runs by a House, and 12 birds sing; über café it's".split()
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 60, 40)] + [None, "", "x " * 200]
    rows = [*enumerate(texts), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, piece string").repartition(3)
    capacity = 48
    got = packed(docs, PATH, 1, capacity=capacity, group_pieces=group).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want, total = [], 0
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((i, p, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    bound = lower_bound(np.bincount([w[3] for w in want], minlength=capacity + 1), capacity)
    assert bound <= len(by_sequence) <= bound + 1 + (group == 5)
