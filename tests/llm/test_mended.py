"""Odd pages, odd rows and odd column names; the pipeline against brute force on a small table."""

from __future__ import annotations

import itertools
import math
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shopmeld.llm import exact_dedup, near_dedup, token_files
from shopmeld.llm.decontamination import contamination, decontaminate
from shopmeld.llm.html_text import labelled_pages, parse, tokens_of, trained
from shopmeld.llm.warc import warc_round_trip
from shopmeld.llm.language import known_language, language_id

LONG = "word " * 70


@pytest.fixture(scope="module")
def model():
    return trained()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=it's>One don't two three.</p>", "One don't two three."),
        ("<article><p title=it's>One don't</p><p>two three.</p></article>", "One don't\ntwo three."),
        ("<article><a title='a>b' href=x>One</a> <b class=\"x>y\">two</b></article>", "One two"),
        ("<!--><p>a b c</p>", "a b c"),
        ("<!-- a --!><p>after it</p><!-- open", "after it"),
        ("<!-- a > b --><p>after it</p><!doctype html><?x y><p>and more</p></>", "after it\nand more"),
        ("<noscript><p>one two", "one two"),
        ("<template><p>one two", "one two"),
        ("<article><noscript><p>no</p></noscript><p>one two</p><template>no</template></article>", "one two"),
        ("<html><head><title>x<body><p>text here</p>", "text here"),
        ("<p>5 < 6 and 7 > 3 &amp; more</p>", "5 < 6 and 7 > 3 & more"),
        ("<article><script>if (a < b) '</p>'</script><p>one</p><style>p</style ><textarea><p>no</textarea><p>two</p></article>", "one\ntwo"),
        ("<h1>Head line</h1><p>first one here</p><p>second one</p>", "Head line\nfirst one here\nsecond one"),
        (f"<html><body><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></body></html>", f"T\n{LONG.strip()}\n{LONG.strip()}"),
        ("plain text without markup", "plain text without markup"),
        ("<div><p>only here</p><nav><ul><li><a href=/>home</a></li></ul></nav></div>", "only here"),
        ("", ""),
    ],
)
def test_pages(model, page, text):
    assert model.text(page) == text


@pytest.mark.parametrize(
    "part", ["<a '\"' ", '<a href="x\' ', "<", "<!--", "<title>", "<a =", "</", "<p a=b ", "<p><b>", "'\"", "<select>", "&amp"]
)
def test_long_pages_take_linear_time(part):
    page = part * ((1 << 20) // len(part))
    began = time.process_time()
    tokens_of(page)
    assert time.process_time() - began < 8


def test_marginals_against_all_labelings(model):
    for page in ["<article><p>a b</p></article><nav><a>x</a></nav>", "<p>one</p><div><p>two</p><ul><li>x</li></ul></div>", *labelled_pages(40)]:
        tree = parse(page)
        n = len(tree.parents)
        if n > 11:
            continue
        pair, total, content = model.pair[tree.bare], 0.0, [0.0] * n
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(model.weights.get(f, 0.0) for v in range(n) if labels[v] for f in tree.features[v])
            score += sum(pair[labels[tree.parents[v]]][labels[v]] for v in range(1, n))
            total += math.exp(score)
            for v in range(n):
                content[v] += labels[v] * math.exp(score)
        assert model.marginals(tree)[0] == pytest.approx([c / total for c in content], abs=1e-9)


def test_repeated_rows_stay_linear(spark):
    words = [f"w{i}" for i in range(60)]
    pair = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"]))]
    rows = spark.createDataFrame(pair, "doc_id long, text string").crossJoin(spark.range(1500).select(F.lit(1).alias("k")))
    began = time.time()
    got = near_dedup.near_duplicates(rows, size=4).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, True, 1500), (2, 1, False, 1500)]
    assert time.time() - began < 120


NAMES = "`doc id` long, `the.text` string, `lang x` string, `a b` string, _row int, _id string"


def test_names_with_blanks_and_dots(spark):
    text = "the house is on the hill and the river runs by it every day of the year " * 3
    rows = [(1, text, "en", "x", 1, "y"), (2, text, "en", "x", 2, "y"), (None, text + "more", None, None, 3, None), (4, None, "en", "", 4, "")]
    docs = spark.createDataFrame(rows, NAMES)
    columns = {"id_column": "doc id", "text_column": "the.text"}
    assert {r["doc id"] for r in exact_dedup.keep_one(docs, **columns).collect()} == {2, None, 4}
    assert near_dedup.keep_one(docs, **columns).columns == docs.columns
    bench = spark.createDataFrame([(1, "river runs by it every day of the year the house is on")], "`item.id` long, `t x` string")
    item = {"item_column": "item.id", "item_text_column": "t x"}
    marks = contamination(docs, bench, **columns, **item)
    assert marks.columns[0] == "doc id" and marks.where("contaminated").count() == 3
    assert {r["doc id"] for r in decontaminate(docs, bench, **columns, **item).collect()} == {4}
    assert language_id(docs, lang_column="lang x", **columns).count() == 4
    assert known_language(docs, lang_column="lang x", **columns).columns == docs.columns


def test_null_and_empty_ids_are_apart(spark):
    docs = spark.createDataFrame([("", "same"), (None, "same"), (None, "other"), ("", "third")], "doc_id string, text string")
    assert sorted((r.doc_id is None, r.text) for r in exact_dedup.keep_one(docs).collect()) == [(False, "same"), (False, "third"), (True, "other")]


def test_equal_rows_come_back_as_often(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "x y"), (None, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "b c"), (8, "nothing of it")], "item_id long, text string")
    for limit in (1 << 20, 100):
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in contamination(docs, bench, max_broadcast_bytes=limit).collect())
        assert got == [(0, 2, 0, 0), (0, 2, 0, 0), (1, 2, 0, 0), (1, 4, 2, 1), (1, 4, 2, 1), (2, 0, 0, 0)]


def test_dictionary_sample_is_bounded_and_the_same_everywhere(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 10)
    docs = spark.range(400).select(F.col("id").alias("_id"), F.repeat(F.lit("ab "), 3000).alias("_text"))
    again = docs.unionByName(docs.where("_id < 300"))  # repeated rows count once
    few = [sorted(r._text for r in token_files.sample(d.repartition(n)).collect()) for d, n in ((docs, 1), (docs, 7))]
    assert few[0] == few[1] and len(few[0]) == 10 and max(map(len, few[0])) <= token_files.SAMPLE_IDS
    assert token_files.sample(again).count() <= 10 and token_files.sample(docs.limit(0)).count() == 0


EN = "the house stands on a hill near the river and the children play there all day with the dog "
FR = "la maison est sur une colline près de la rivière et les enfants y jouent toute la journée avec le chien "
CLEAN = [EN * 2 + f"story number {w} tells of {w} things about {w} and {w} more of them {w}" for w in "stone water glass paper cloud horse bread light music ship".split()]


def test_pipeline_against_brute_force(spark, tmp_path):
    bench = "what is the tallest mountain of the whole wide world and how high does it rise above the sea"
    texts = [
        *CLEAN,
        *[FR * 2 + f"histoire de {w} et encore de {w} avec {w}" for w in "pierre eau verre papier nuage cheval".split()],
        None,
        "",
        "12345 !!! ...",
        CLEAN[0],
        CLEAN[0],
        CLEAN[1] + " x",
        EN + bench,
    ]
    rows = [(i, t, "fr" if t and t.startswith("la") else "en", "s", len(t or ""), 1.0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `odd. name` double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q1", bench)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        held[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns, name
    everything = set(range(len(texts)))
    letters = everything - {16, 17, 18}
    assert held["language_id"] == letters
    by_text = {}
    for i in sorted(letters):
        by_text[texts[i]] = i
    assert held["exact_dedup"] == set(by_text.values())

    def shingles(i):
        w = texts[i].lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    left = sorted(held["exact_dedup"])
    of = {i: i for i in left}
    for a, b in itertools.combinations(left, 2):
        x, y = shingles(a), shingles(b)
        if 100 * len(x & y) >= 80 * len(x | y):
            old, new = max(of[a], of[b]), min(of[a], of[b])
            of = {i: new if c == old else c for i, c in of.items()}
    assert held["near_dedup"] == {i for i, c in of.items() if i == c}
    assert held["decontamination"] == held["near_dedup"] - {22}
    assert held["packing"] == held["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == held["packing"]


def test_warc_keeps_any_id(spark):
    ids = ["None", "", "a\r\nWARC-Type: x", "<b> %41 ä", "same", None, "None2"]
    rows = [(i, None if k % 2 else "http://x/\n", "same text" if i in ("same", "None2") else f"p{k}", "c") for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "`page id` string, url string, `h.t` string, archive string").repartition(2)
    got = {r.page_id: r for r in warc_round_trip(pages, id_column="page id", html_column="h.t").collect()}
    assert set(got) == set(ids) and got["same"].refers_to == "None2" and got["None"].record_type == "response"
