"""The hidden Markov model against enumeration of all state paths, and the whole query against plain Python."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from shopmeld.llm import hmm_scores as module
from shopmeld.llm.hmm_scores import CLASSES, Model, expected_counts, first_model, hmm_scores, log_likelihoods, next_model, tokens


def small_model(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((classes, states))
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(model, text):
    """Every state path with its joint probability."""
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, c in zip(path, path[1:], text[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        yield path, p


TEXTS = [[0, 1, 2, 3, 4, 4], [2], [4, 4, 1], [0, 0, 0, 0, 0], [3, 1], [2]]


@pytest.mark.parametrize("step", [1 << 19, 1])  # whole runs; long documents cut into segments
def test_recursions_against_all_paths(monkeypatch, step):
    monkeypatch.setattr(module, "STEP_TOKENS", step)
    model = small_model()
    classes, lens = np.array(sum(TEXTS, [])), np.array([len(t) for t in TEXTS])
    want = [math.log(sum(p for _, p in paths(model, t))) for t in TEXTS]
    assert log_likelihoods(classes, lens, model) == pytest.approx(want)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in TEXTS:
        whole = sum(p for _, p in paths(model, t))
        for path, p in paths(model, t):
            start[path[0]] += p / whole
            for c, s in zip(t, path):
                emit[c, s] += p / whole
            for a, b in zip(path, path[1:]):
                move[a, b] += p / whole
    for got, true in zip(expected_counts(classes, lens, model), (start, move, emit)):
        assert got == pytest.approx(true, rel=1e-4)


def test_probabilities_of_all_texts_add_up():
    model = small_model()
    every = list(itertools.product(range(5), repeat=3))
    logs = log_likelihoods(np.array(every).ravel(), np.full(len(every), 3), model)
    assert np.exp(logs).sum() == pytest.approx(1)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(1)
    lens = rng.integers(1, 60, 80)
    kinds = rng.integers(0, 2, 80)
    classes = np.concatenate([rng.integers(0, 6, n) + 6 * k for n, k in zip(lens, kinds)])
    mass = np.bincount(classes, minlength=13) + 1.0
    mass /= mass.sum()
    model, seen = first_model(mass, 2), []
    for _ in range(12):
        seen.append(log_likelihoods(classes, lens, model).sum())
        model = next_model(mass, *expected_counts(classes, lens, model))
    assert all(b > a - 1 for a, b in zip(seen, seen[1:]))
    assert seen[-1] > np.log(mass[classes]).sum() + 0.5 * len(classes)  # the two kinds of text are told apart


ROWS = [
    (0, "The cat sat on the mat"),
    (1, "THE CAT\tsat\non the\x0bhat É é"),
    (2, None),
    (3, ""),
    (4, " \n "),
    (5, "le chat est sur le tapis"),
    (5, "le chat est sur le tapis"),
    (None, "unnamed row"),
    *[(i, f"word{i % 3} cat w{i} the " * (i % 5)) for i in range(6, 40)],
    (40, "long " * 3000 + "x" * 5000),
]


def plain(rows, states, rounds):
    split = [tokens(t) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for t, h in zip(split, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    base = {w: (counts[w] + 1) / (n + v + 1) for t in split for w in t}
    group = {w: zlib.crc32(w) % CLASSES if counts[w] else CLASSES for w in base}
    mass = np.zeros(CLASSES + 1)
    for w in counts:
        mass[group[w]] += base[w]
    mass[CLASSES] = 1 / (n + v + 1)
    model = first_model(mass, states)
    for _ in range(rounds):
        train = [t for t, h in zip(split, held) if not h]
        classes = np.array([group[w] for t in train for w in t])
        model = next_model(mass, *expected_counts(classes, np.array([len(t) for t in train]), model))
    out = []
    for (i, _), t, h in zip(rows, split, held):
        x, log = None, 0.0
        for w in t:
            x = (model.start if x is None else x @ model.move) * model.emit[group[w]]
            log += math.log10(x.sum()) + math.log10(base[w] / mass[group[w]])
            x = x / x.sum()
        out.append((i, h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10(base[w]) for w in t), log))
    return out


def test_against_plain_python(spark):
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in ROWS], "doc_id long, text string, _id int, score double").repartition(4)
    got = hmm_scores(frame, states=3, rounds=2)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, want = (sorted(map(tuple, x), key=repr) for x in (got.collect(), plain(ROWS, 3, 2)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.array([g[5:] for g in got]) == pytest.approx(np.array([w[5:] for w in want]), rel=1e-4)


def test_single_state_is_near_the_base_model_and_empty_tables(spark):
    frame = spark.createDataFrame(ROWS, "`doc id` long, `a.text` string")
    for r in hmm_scores(frame, id_col="doc id", text_col="a.text", states=1, rounds=1).collect():
        assert r.score == pytest.approx(r.base_score, rel=0.1)
    assert hmm_scores(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    only = hmm_scores(spark.createDataFrame([(None, None)], "doc_id string, text string")).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.held_out) == (1, 1, 1, False)
