"""Vector codes against plain Lloyd rounds; cover-tree invariants; odd rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from shopmeld.llm import vector_codes as module
from shopmeld.llm.vector_codes import _ranges, cover_tree, decided, squares, vector_codes


def plain(rows, parts, entries, rounds, width):
    """What the contract says, one vector after the other. rows: (id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and np.isfinite(x) and abs(x) < 1 << 16 for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-width // parts)
    ints = [np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (size * parts - width)).reshape(parts, size) for _, v, _ in kept]
    books = np.array(ints[:entries]).transpose(1, 0, 2).copy()

    def nearest():
        return [[int(((books[p] - v[p]) ** 2).sum(1).argmin()) for p in range(parts)] for v in ints]

    for _ in range(rounds):
        given = nearest()
        moved = books.copy()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, g in zip(ints, given) if g[p] == e]
                if mine:
                    moved[p, e] = np.array(mine).sum(0) // len(mine)
        books = moved
    given = nearest()
    error = [sum(int(((books[p][g[p]] - v[p]) ** 2).sum()) for p in range(parts)) for v, g in zip(ints, given)]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return [
        (r[0], "".join(f"{e:02x}" for e in g), e, by_label[r[2]], digest) for r, g, e in zip(kept, given, error)
    ]


def rows(n, width, seed):
    rng = np.random.default_rng(seed)
    out = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, width)], int(rng.integers(0, 3))) for i in range(n)]
    out[5] = (5, out[4][1], None)
    out[6] = (6, None, 1)
    out[7] = (7, [None, *out[8][1][1:]], 1)
    out[9] = (9, [float("nan"), *out[8][1][1:]], 1)
    out[10] = (10, [float("inf"), *out[8][1][1:]], 1)
    out[11] = (11, out[8][1][1:], 1)
    out[12] = (12, [70000.0, *out[8][1][1:]], 1)
    return [*out, out[3], out[3], (None, out[2][1], None)]


@pytest.mark.parametrize(("n", "width", "parts", "entries"), [(300, 8, 4, 16), (60, 10, 4, 64), (200, 3, 1, 2)])
def test_against_plain_rounds(spark, monkeypatch, n, width, parts, entries):
    monkeypatch.setattr(module, "BLOCK_ROWS", 64)  # several trees a partition
    given = rows(n, width, n)
    frame = spark.createDataFrame([(i, v, k, 1, "x") for i, v, k in given], "vec_id long, embedding array<float>, label int, code int, _id string")
    got = vector_codes(frame.repartition(3), parts=parts, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = plain(given, parts, entries, 2, width)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_and_other_types(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes(none).count() == 0
    assert vector_codes(spark.createDataFrame([(1, None, 1)], none.schema)).count() == 0
    one = spark.createDataFrame([("a", [0.5] * 16, "x"), ("b", [0.5] * 16, None)], "`vec id` string, embedding array<double>, `the.label` string")
    got = vector_codes(one, id_col="vec id", label_col="the.label").collect()
    assert [(r.code, r.error, r.label_error) for r in got] == [("00" * 16, 0, 0)] * 2
    flat = spark.createDataFrame([(1, [], 1)], none.schema)
    assert vector_codes(flat).first().error == 0


def test_cover_tree():
    rng = np.random.default_rng(2)
    points = rng.integers(-90, 90, (3000, 3))
    points[40:400] = points[7]
    order, nodes = cover_tree(points)
    assert sorted(order) == list(range(3000))
    at = points[order]
    for node in nodes:
        away = np.sqrt(((at[node["lo"] : node["hi"]] - at[node["lo"]]) ** 2).sum(1))
        assert away.max() == pytest.approx(node["radius"])
        below = nodes[node["child"] : node["child"] + node["children"]]
        if len(below):
            assert below["lo"][0] == node["lo"] and below["hi"][-1] == node["hi"]
            assert (below["lo"][1:] == below["hi"][:-1]).all()
            apart = np.sqrt(squares(at[below["lo"]], at[below["lo"]]))
            assert (apart + np.eye(len(below)) * 1e9).min() > below["radius"].max() * (1 - 1e-9)
    entries = points[:20]
    lo, hi, entry, place, exact = decided(at, nodes, entries)
    given = np.full(3000, -1)
    given[_ranges(lo, hi)] = np.repeat(entry, hi - lo)
    given[place] = exact
    assert (given == squares(at, entries).argmin(1)).all()
    assert (hi - lo).max() >= 360  # repeated points go as a whole
