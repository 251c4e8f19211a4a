"""Edge cases and brute-force comparisons of the training-data operators on small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopmeld.llm import exact_dedup, near_dedup, substring_dedup, token_files
from shopmeld.llm.common import scratch
from shopmeld.llm.decontamination import contamination, decontaminate
from shopmeld.llm.html_text import labelled_pages, main_text, parse, trained
from shopmeld.llm.language import known_language, language_id
from shopmeld.llm.licenses import license_scan
from shopmeld.llm.packing import best_fit_decreasing, lower_bound, packed
from shopmeld.llm.substring_dedup import _anchor_rows, common_prefixes, common_starts, repeated_bytes, repeated_starts, shared_ranges, suffix_array
from shopmeld.llm.token_files import Shard, token_round_trip, write_tokens
from shopmeld.llm.tokens import Encoder, public_file
from shopmeld.llm.warc import byte_ranges, read_warc, warc_round_trip, write_warc

LONG = " ".join(f"word{i % 977}x{i}" for i in range(4000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away today", "en", "a", 1, 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away today", "en", "a", 2, 2),
    (3, "", "en", None, None, 3),
    (4, None, None, "b", 4, 4),
    (5, LONG, "en", "b", 5, 5),
    (6, LONG + " one more", "en", "b", 6, 6),
    (7, "!!! ... 123", "en", "c", 7, 7),
    (8, "le chat est dans la maison avec les enfants qui jouent", "fr", "c", 8, 8),
    (8, "le chat est dans la maison avec les enfants qui jouent", "fr", "c", 8, 8),
    (None, "no id here", "en", "c", 9, 9),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, _key bigint, kept bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_groups_and_empty(docs, none):
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert (1, 2, 2, False) in got and (2, 2, 2, True) in got
    assert (3, 4, 2, False) in got and (4, 4, 2, True) in got  # null counts as empty
    assert got.count((8, 8, 2, True)) == 2 and (-1, None, 1, True) in got
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7


def test_exact_dedup_directory_splits(spark):
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    index, slots, depth = exact_dedup.build_index(many, bucket_entries=20)
    assert depth >= 5 and index.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 20
    assert exact_dedup.exact_dedup(many, bucket_entries=20).where("kept").count() == 500


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(
        [(1, "THE quick brown fox jumps over the lazy dog and runs far away"), (2, "chat est"), (3, None), (None, "maison")],
        "item_id bigint, text string",
    )
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (14, 13, 1, True)
    assert (got[8].n_hit, got[8].n_items) == (3, 1) and got[8].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert (got[4].n_words, got[4].n_hit, got[4].contaminated) == (0, 0, False)
    blocks = {r.doc_id: r for r in contamination(docs, bench, max_broadcast_bytes=200).collect()}
    assert blocks == got
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 7, None}
    cut = {r.doc_id: r.text for r in decontaminate(docs, bench, "spans").collect()}
    assert cut[1] == "today" and cut[5] == LONG and cut[4] is None


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, size=4).collect()}
    assert got[2].component_id == 1 and not got[2].kept and got[6].component_id == 5
    assert (got[3].n_shingles, got[3].component_id, got[3].kept) == (0, 3, True) and got[4].component_id == 4
    assert got[7].n_shingles == 1 and got[None].component_id is None and got[None].kept
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 7, 8]


def test_repeated_bytes_against_brute_force(spark, docs, none):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(300)]
    line = " ".join(rng.choice(words, 60))
    texts = [" ".join(rng.choice(words, 80)) + line[i : i + 230] + "é" * i for i in range(12)] + ["a" * 900, "ab" * 300, None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for r in repeated_bytes(table).collect():
        b = raw[r.doc_id]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, r.kept) == (len(b), gone.sum(), kept)
    assert repeated_bytes(none).count() == 0 and repeated_bytes(docs).count() == len(ROWS)


def test_repeated_bytes_keeps_and_moves_texts_once(spark, monkeypatch, capsys):
    """Disk of op5: one stage table holds the texts, and they are shuffled for their grouping only."""
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = letters(400)
    texts = [letters(3000) + passage[k % 7 :] + letters(50) for k in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), spark.sparkContext.applicationId)
    before, dealt = set(base.glob("substring-*")), []
    monkeypatch.setattr(substring_dedup, "_dealt", lambda contexts, *a, f=substring_dedup._dealt: dealt.append(contexts) or f(contexts, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = repeated_bytes(table).drop("kept")
        plans = []
        for df in (*dealt, result):
            df.explain(mode="formatted")
            plans.append(capsys.readouterr().out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert result.count() == len(texts) and result.where("n_removed >= 394").count() == len(texts)
    written = sum(p.stat().st_size for d in set(base.glob("substring-*")) - before for p in d.rglob("*.parquet"))
    assert 0.5 < written / sum(map(len, texts)) < 1.1  # letters take 0.6 of their bytes
    assert len(plans) == 2
    for plan in plans:
        exchanges = [x for x in plan.split("\n\n") if ") Exchange\n" in x]
        assert exchanges and not any("_text#" in x for x in exchanges)
    assert not [t.name for t in spark.catalog.listTables("spark_catalog.default") if t.name.startswith("substring_")]


def test_texts_of_one_hash_end_the_job(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else F.lit(7).cast("long"))
    same = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    assert repeated_bytes(same).count() == 2
    with pytest.raises(Exception, match="same 64-bit hash"):
        repeated_bytes(same.unionByName(same.withColumn("text", F.lit("b")))).count()


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    order, _ = suffix_array(data, 32)
    text = data.tobytes()
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    shared = common_prefixes(data, order, 32)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [2, 13])
def test_repeated_starts_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    for _ in range(8):
        base = rng.integers(97, 97 + letters, 400).astype(np.uint8).tobytes()
        contexts = []
        for start in rng.integers(0, 180, 12):
            part = bytearray(base[start : start + 200 + rng.integers(0, 20)])
            if rng.random() < 0.5:
                part[rng.integers(0, len(part))] = 125
            contexts.append(bytes(part))
        weights = rng.integers(1, 3, 12)
        seen = Counter()
        for c, n in zip(contexts, weights, strict=True):
            for i in range(len(c) - 199):
                seen[c[i : i + 200]] += n
        found, (first, last) = repeated_starts(contexts, weights), shared_ranges(contexts, weights)
        for k, (c, flags) in enumerate(zip(contexts, found, strict=True)):
            assert flags.tolist() == [seen[c[i : i + 200]] > 1 for i in range(len(c) - 199)]
            at = np.flatnonzero(flags)
            assert weights[k] > 1 or not len(at) or (first[k] <= at[0] and at[-1] <= last[k])


def test_context_hash_is_the_same_in_texts_of_any_length():
    rng = np.random.default_rng(5)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    passage = letters(700)
    texts = [letters(a) + passage + letters(b) for a, b in ((0, 0), (40, 3), (3, 900), (1200, 77))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.decode() for t in texts])], ["_doc", "_text"])
    values = {}
    for r in pa.Table.from_batches(_anchor_rows(200)(iter([batch]))).to_pylist():
        part = texts[r["_doc"]][r["_first"] : r["_last"] + 200]
        values.setdefault((r["_h"], part), []).append(r["_context"])
    assert max(map(len, values.values())) == len(texts)
    assert all(len(set(v)) == 1 for v in values.values())
    assert len({v[0] for v in values.values()}) == len(values)


@pytest.mark.parametrize("letters", [2, 13])
def test_common_starts_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    for length in (200, 203):
        base = rng.integers(97, 97 + letters, 500).astype(np.uint8).tobytes()
        sides = []
        for _ in range(2):
            parts = [bytearray(base[x : x + length + rng.integers(0, 20)]) for x in rng.integers(0, 270, 9)]
            for part in parts[:6]:
                part[rng.integers(0, len(part))] = rng.integers(0, 256)
            sides.append([bytes(x) for x in parts])
        own = [{c[i : i + length] for c in side for i in range(len(c) - length + 1)} for side in sides]
        for side, met, flags in zip(sides, own[::-1], common_starts(*sides, length), strict=True):
            assert [f.tolist() for f in flags] == [[c[i : i + length] in met for i in range(len(c) - length + 1)] for c in side]


def test_contexts_of_a_frequent_seed_are_split(spark, monkeypatch):
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line, near = letters(60), [letters(150) for _ in range(8)]
    texts = [near[rng.integers(8)] + line + near[rng.integers(8)] + letters(rng.integers(0, 90)) for _ in range(120)]
    texts += [letters(300) + line + letters(300) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    dealt = []
    monkeypatch.setattr(substring_dedup, "_dealt", lambda *a, f=substring_dedup._dealt: dealt.append(f(*a)) or dealt[-1])
    got = {r.doc_id: r for r in repeated_bytes(table, shard_bytes=4000).collect()}
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        assert (got[k].n_removed, got[k].kept) == (gone.sum(), np.frombuffer(t.encode(), np.uint8)[~gone].tobytes())
    # no shard holds many times shard_bytes although all texts have the seed
    groups = dealt[0].groupBy("_shard", "_split", "_i", "_j").agg(F.sum(F.length("_bytes")).alias("n"))
    assert groups.where("_i < _j").count() > 0 and groups.agg(F.max("n")).first()[0] < 4 * 4000


def test_encoder_equals_library():
    tricky = ["a \n b", " x", "\n\nfoo\n bar\n", "a\n\n b  c\tq", "", "  ", "don't\nDo  9", "中文 中\n <|endoftext|> a\r\nb \x1c c \x01 d", LONG]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = Encoder(public_file(name))
        ids, begin = own.encode(tricky)
        for i, text in enumerate(tricky):
            assert list(ids[begin[i] : begin[i + 1]]) == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, none):
    path = public_file("byte_bpe_50k.json")
    own = Encoder(path).tokenizer
    rows, start = sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in ROWS), 0
    got = sorted(token_round_trip(docs, path).collect(), key=lambda r: r.start)
    for (key, text), r in zip(rows, got, strict=True):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_round_trip(none, path).count() == 0
    folder = scratch(spark, "tokens-test")
    manifest, dictionary = write_tokens(docs, folder, path)
    first = manifest.orderBy("shard").first()
    shard = Shard(f"{folder}/{first['name']}", dictionary)
    assert shard.document(len(shard) - 1)[-1] == 0
    with pytest.raises(ValueError, match="another dictionary"):
        Shard(f"{folder}/{first['name']}", dictionary + b"x")


def test_dictionary_sees_later_parts_of_long_texts(spark, monkeypatch):
    rows = spark.range(300).select(
        F.col("id").alias("_id"), F.concat(F.repeat(F.lit("a "), 3000), F.repeat(F.lit("later words "), 1000)).alias("_text")
    )
    path = public_file("byte_bpe_50k.json")
    later = np.array(Encoder(path).tokenizer.encode(" later words later", add_special_tokens=False).ids, "<u4").tobytes()
    assert later in token_files.fit_dictionary(rows, path, 0, "<u4")
    every = [r._text for r in token_files.sample(rows).collect()]
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 40)
    assert [r._text for r in token_files.sample(rows.repartition(7)).collect()] == every[:40]


def test_packing(docs, none):
    rows = packed(docs, public_file("word_bpe_49k.json"), 1, group_pieces=3, fan_in=2).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) - 1  # id 8 comes twice
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packed(none, public_file("word_bpe_49k.json"), 1).count() == 0


def test_bounds():
    lengths = np.array([6, 6, 6, 5, 5, 4, 4, 4, 3, 2, 2])
    bins, offsets = best_fit_decreasing(lengths, 10)
    opened = bins.max() + 1
    assert lower_bound(np.bincount(lengths, minlength=11), 10) <= opened
    assert lower_bound(np.bincount([6] * 5, minlength=11), 10) == 5
    assert max(np.bincount(bins, lengths)) <= 10


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/", None), (4, "http://c/", ""), (5, "u\r\nX: 1", "é" * 5000)],
        "page_id bigint, url string, html string",
    )
    got = {r.page_id: r for r in warc_round_trip(pages).collect()}
    assert (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 1, 10)
    assert (got[4].record_type, got[4].refers_to, got[4].payload_bytes) == ("revisit", 3, 0)
    assert got[5].payload_bytes == 10000 and got[1].payload_digest == got[2].payload_digest
    assert warc_round_trip(pages.limit(0)).count() == 0
    folder = scratch(spark, "warc-test")
    index = write_warc(pages.coalesce(1), folder)
    assert read_warc(index, folder, F.col("page_id") == 5).first().payload == ("é" * 5000).encode()
    assert byte_ranges(index).count() == 1 and byte_ranges(index, gap=-1).count() == 5


def test_licenses(spark, none):
    table = spark.createDataFrame(
        [
            (1, "Released under the MIT license, under the mit license."),
            (2, "x " * 300 + "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with it"),
            (3, None),
            (4, "nothing to see"),
        ],
        "doc_id bigint, text string",
    )
    got = {r.doc_id: r for r in license_scan(table).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (2, 1, 5, "mit", 1.0)
    assert got[2].base_labels == "apache-2" and got[2].n_words == 319
    assert (got[3].n_words, got[3].labels, got[3].first_word, got[3].score) == (0, "", None, 0.0) and got[4].labels == ""
    assert license_scan(none).count() == 0


def test_languages(spark, docs, none):
    en, fr = "the cat and the dog with that house and those children ", "le chat et le chien avec cette maison et les enfants "
    table = spark.createDataFrame([(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr") for i in range(40)], "doc_id bigint, text string, lang string")
    got = language_id(table).where("held_out").collect()
    assert got and all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") and r.score > 0.9 for r in got)
    odd = {r.doc_id: r for r in language_id(docs).collect()}
    assert odd[4].lang_pred == "und" and odd[7].lang_pred == "und" and odd[3].score == 0
    assert language_id(none).count() == 0
    assert known_language(docs).columns == docs.columns


def test_known_language_keeps_mixtures_and_rejects_other_scripts(spark):
    said = {
        "en": "the cat and the dog with that house and those children who were there ",
        "fr": "le chat et le chien avec cette maison et les enfants qui jouent dehors ",
        "de": "die katze und der hund mit diesem haus und den kindern die draussen spielen ",
        "es": "el gato y el perro con aquella casa y los hijos que juegan afuera siempre ",
    }
    rows = [(i, said[x] * 8, x) for i in range(60) for x in [list(said)[i % 4]]]
    other = {
        1000: "кошка и собака живут в этом доме вместе с детьми которые играют во дворе " * 5,
        1001: "η γάτα και ο σκύλος ζουν σε αυτό το σπίτι μαζί με τα παιδιά " * 5,
        1002: "猫和狗与孩子们一起住在这所房子里他们在院子里玩耍" * 8,
        1003: "12, 34. - 56: кошка и собака (78) 90, живут! " * 8,
    }
    mixed = {2000: said["en"] * 3 + said["fr"] * 3 + said["de"] * 3, 2001: "".join(said.values()) * 3}
    table = spark.createDataFrame([*rows, *((k, v, None) for k, v in (other | mixed).items())], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in known_language(table).collect()} == {r[0] for r in rows} | set(mixed)


def test_html(spark):
    model = trained(60)
    page = "<html><body><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>One <b>two\n three<br><p>four</p></article><footer>f</footer></body></html>"
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<p")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in main_text(table, model).collect()}
    assert got[1].text == "T & U\nOne two three\nfour" and got[1].n_chars == 24 and got[2].text == "" and got[2].n_chars == 0
    tree = parse(labelled_pages(1)[0])
    content, edges = model.marginals(tree)
    assert all(0 <= p <= 1 for p in content)
    for v in range(1, len(content)):
        assert abs(edges[v][0][1] + edges[v][1][1] - content[v]) < 1e-9
    assert main_text(table.limit(0), model).count() == 0


ARTICLE = "<article><h1>Title of it</h1><p>One two three.</p>{}<p>Four five six.</p></article>"


def test_html_with_an_omitted_end_of_head():
    want = "Title of it\nOne two three.\nFour five six."
    model = trained(60)
    for head in ("<head><title>T</title>", "<head><meta a=b><title>T</title><style>x</style></head>", "<HEAD><script>1</script><title>T</title>\n"):
        for body in ("<body>", ""):
            assert model.text(f"<html>{head}{body}{ARTICLE.format('')}<footer>f</footer>") == want


@pytest.mark.parametrize("name", ["select", "object", "canvas", "svg", "iframe"])
def test_html_with_unclosed_elements(name):
    model = trained(60)
    inside = "<option>Aa<option>Bb" if name == "select" else ""
    want = model.text(f"<html><body>{ARTICLE.format('')}<footer>f</footer></body></html>")
    for part in (f"<{name} id=x>{inside}", f"<{name}>{inside}No text</{name}>", f"<{name}>a<{name}>b</{name}>c</{name}>"):
        assert model.text(f"<html><body>{ARTICLE.format(part)}<footer>f</footer></body></html>") == want
    again = f"<html><body>{ARTICLE.format(f'<{name}>')}<form><{name}>no</{name}></form><footer>f</footer></{name}></body></html>"
    assert model.text(again) == want
    assert parse(f"<p>One <{name}>no</{name}>two").blocks[-1][1] == "One two"
