"""Alignment of two tokenizers against whole texts encoded by the libraries, token by token."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopmeld.llm import alignment
from shopmeld.llm.alignment import Aligner, aligned_documents, divide, groups_text, pieces_of
from shopmeld.llm.tokens import public_file

PATHS = public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")
LATIN = "abc XYZ éß\n'.,;-\t09 "
TEXTS = [
    None,
    "",
    " ",
    "\n",
    "hello world",
    " leading",
    "trailing ",
    "two  spaces and   three",
    "line\nbreak\n\ntwo\r\n tab\tx \n y",
    "naïve café ① Å ﬁ x y",
    "日本語のテキスト and 中文 mixed 한국어\n日本",
    "a▁b has the mark",
    "<s> x </s> <|endoftext|> <0x41> <unk>",
    "it's don't we'll 'tis 's",
    "emoji 😀😀 é zero​width",
    "nul\x00 \x01 \x7f",
    "x" * 3000,
    "the quick brown fox " * 400,
    "the quick brown fox " * 400,
    "unbelievablyinventedwords thonre sttible athawh " * 30,
]


@pytest.fixture(scope="module")
def aligned():
    return Aligner(*PATHS)


def plain(aligned, text):
    """(groups as text, id pairs of all links, n_a, n_b, n_groups) by whole-text encoding; None without tokens."""
    if not text:
        return None
    t = aligned.tokenizer
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text, num_threads=1)
    if any(b"".join(map(x.__getitem__, y)) != (" " + text).encode() for x, y in ((t.bytes_a, a), (t.bytes_b, b))):
        return None
    spans = []
    for ids, sizes in ((a, t.sizes_a), (b, t.sizes_b)):
        ends = np.cumsum(sizes[ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids)))
    shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = []
    for lo, hi in zip([0, *shared], shared):
        groups.append("|".join(",".join(str(i) for s, e, i in x if lo <= s and e <= hi) for x in spans))
    links = [(i, j) for s, e, i in spans[0] for x, y, j in spans[1] if s < y and x < e]
    return ";".join(groups), links, len(a), len(b), len(groups)


def check(aligned, text):
    places, sizes = aligned.align([text])
    want = plain(aligned, text)
    if want is None:
        assert sizes.tolist() == [0]
        return
    assert "".join(pieces_of(text)) == " " + text
    assert groups_text(aligned, places) == want[0]
    assert aligned.counts[:3, places].sum(1).tolist() == list(want[2:])


@pytest.mark.parametrize("text", TEXTS[1:16])
def test_text_against_libraries(aligned, text):
    check(aligned, text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.sampled_from(LATIN), max_size=60), st.text(max_size=40)))
def test_any_text_against_libraries(aligned, text):
    check(aligned, text.encode("utf-8", "ignore").decode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=60))
def test_division_finds_all_common_ends(marks):
    marks = [*(m for m in marks if any(m)), (True, True)]
    ends_a = np.array([i + 1 for i, m in enumerate(marks) if m[0]])
    ends_b = np.array([i + 1 for i, m in enumerate(marks) if m[1]])
    a, b = divide(ends_a, ends_b, np.array([0, len(ends_a)]), np.array([0, len(ends_b)]))
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert ends_a[a[1:] - 1].tolist() == common and ends_b[b[1:] - 1].tolist() == common and a[0] == b[0] == 0


def test_documents_against_plain_python(spark, aligned):
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id here")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _block int, codes string").repartition(3)
    got = aligned_documents(frame, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = [plain(aligned, t) for _, t in rows]
    docs = Counter(pair for f in found if f for pair in set(f[1]))
    top = {}
    for (i, _), n in docs.items():
        top[i] = max(top.get(i, 0), n)
    want = []
    for (i, _), f in zip(rows, found):
        if f is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(docs[p] == top[p[0]] for p in f[1])
        digest = hashlib.sha256(f[0].encode()).hexdigest()
        want.append((i, *f[2:], len(f[1]), best, sum(docs[p] for p in f[1]), digest))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables_and_names(spark):
    assert aligned_documents(spark.createDataFrame([], "doc_id string, text string"), *PATHS).count() == 0
    odd = spark.createDataFrame([("x", "hello world"), (None, None)], "`doc.id` string, `a b` string")
    got = {r["doc.id"]: r for r in aligned_documents(odd, *PATHS, id_col="doc.id", text_col="a b").collect()}
    assert got["x"].n_groups == 2 and got[None].groups_sha256 == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from(LATIN + "\x01é"), max_size=30), st.text(max_size=20)), min_size=1, max_size=8))
def test_columns_are_cut_like_single_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    column = pa.array(["left out", *texts], pa.large_string()).slice(1)
    assert alignment.cut(column).to_pylist() == [pieces_of(t) if t else [] for t in texts]


def test_usual_texts_are_not_cut_one_by_one(aligned, monkeypatch):
    texts = ["the quick brown fox\njumps over", "the lazy dog, naïve.", "x"]
    want = [groups_text(aligned, aligned.align([t])[0]) for t in texts]
    monkeypatch.setattr(alignment, "pieces_of", None)
    places, sizes = aligned.align(texts)
    ends = np.cumsum(sizes)
    assert [groups_text(aligned, places[e - n : e]) for n, e in zip(sizes, ends)] == want


def test_distinct_values():
    values = np.array([5, 3, 3, -1, 5, 2**40])
    assert alignment.distinct(values).tolist() == [-1, 3, 5, 2**40] and alignment.distinct(values[:0]).tolist() == []
