"""License scan: phrases, and templates found by an exact set-similarity join.

A text is cut into blocks of `2 * L` words that start every `L` words, L being the longest template's
words, so any run of L words lies whole in a block. A template is found when a block holds at least
`percent` of its distinct words. Words are ordered by how many blocks of the whole corpus hold them,
rarest first; only template words need a place, as others cannot add to an overlap.

For an overlap of `a` words the rarest |T| - a + 1 template words must share a word with the block
(prefix filter); the block must hold `a` template words at all (length filter); and a first match that
has too few template or block words after it is dropped (positional filter). What is left is counted
exactly. The templates are a parameter, held in every task: their number does not grow with the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, ship, whole

LOWER = str.maketrans(UPPER, UPPER.lower())
PERCENT = 80
MAX_TEMPLATE_WORDS = 100_000

#: Phrases and labels that a scan must report.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening statements of public licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public License",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced without written permission of the publisher",
}


def split_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(LOWER))


def template_sets(templates: Mapping[str, str]) -> dict[str, frozenset[str]]:
    sets = {label: frozenset(split_words(text)) for label, text in templates.items()}
    if sum(map(len, sets.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words do not fit into every task")
    return {label: words for label, words in sets.items() if words}


def block_starts(n_words: int, step: int) -> range:
    """Starts of the blocks: every `step` words, up to the first block that reaches the end."""
    return range(0, max(1, n_words - step), step)


def _marked(words: list[str], known: frozenset[str]) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(words) if w in known]


def _block_words(marked: list[tuple[int, str]], n_words: int, step: int) -> Iterator[set[str]]:
    """Distinct template words of each block that has any."""
    if not marked:
        return
    places = [i for i, _ in marked]
    for start in block_starts(n_words, step):
        a, b = bisect_left(places, start), bisect_left(places, start + 2 * step)
        if b > a:
            yield {w for _, w in marked[a:b]}


def _frequencies(known: frozenset[str], step: int):
    """Batches of texts -> (word, blocks), counted per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("_text"):
                words = split_words(text.as_py())
                for block in _block_words(_marked(words, known), len(words), step):
                    found.update(block)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return count


class TemplateIndex:
    """Prefix index of the templates over words in global order."""

    def __init__(self, sets: Mapping[str, frozenset[str]], frequency: Mapping[str, int], percent: int) -> None:
        ordered = sorted(frozenset().union(*sets.values()) if sets else (), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(ordered)}
        self.templates = {label: sorted(self.rank[w] for w in words) for label, words in sets.items()}
        self.need = {label: -(-percent * len(t) // 100) for label, t in self.templates.items()}
        self.prefixes: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for label, t in self.templates.items():
            for i, r in enumerate(t[: len(t) - self.need[label] + 1]):
                self.prefixes[r].append((label, i))
        self.sets = {label: frozenset(t) for label, t in self.templates.items()}

    def matches(self, block: set[str]) -> dict[str, float]:
        """Containment of every template that the block holds enough of."""
        ranks = sorted(self.rank[w] for w in block)
        tried, found = set(), {}
        for at, r in enumerate(ranks):
            for label, i in self.prefixes.get(r, ()):
                need = self.need[label]
                if label in tried or len(ranks) < need:  # length filter
                    continue
                tried.add(label)
                # words before the first common one are not shared
                if min(len(self.templates[label]) - i, len(ranks) - at) < need:  # positional filter
                    continue
                shared = len(self.sets[label].intersection(ranks))
                if shared >= need:
                    found[label] = shared / len(self.templates[label])
        return found


def _scan(sets: Mapping[str, frozenset[str]], frequency: Mapping[str, int], percent: int, phrases: Mapping[str, str], step: int):
    known = frozenset().union(*sets.values()) if sets else frozenset()
    split = [(phrase.split(" "), label) for phrase, label in phrases.items()]

    def places(words: list[str], phrase: list[str]) -> list[int]:
        first, n, out, at = phrase[0], len(phrase), [], -1
        try:
            while True:
                at = words.index(first, at + 1)
                if words[at : at + n] == phrase:
                    out.append(at)
        except ValueError:
            return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(sets, frequency, percent)
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                text = text.as_py()
                words = split_words(text)
                starts, base = [], set()
                for phrase, label in split:
                    if phrase[-1] in words and (own := places(words, phrase)):
                        starts += own
                        base.add(label)
                best: dict[str, float] = {}
                for block in _block_words(_marked(words, known), len(words), step):
                    for label, value in index.matches(block).items():
                        best[label] = max(best.get(label, 0.0), value)
                out.append(
                    (
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | best.keys())),
                        1.0 if base else max(best.values(), default=0.0),
                    )
                )
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_id", *names]
            )

    return scan


def license_scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a phrase, else the largest share of a found template's words, 0 without any. Null and
    empty texts have no words and no labels. Rows that repeat an id stay rows of their own.
    """
    ship(docs.sparkSession)
    sets = template_sets(templates)
    step = max((len(split_words(t)) for t in templates.values()), default=1) or 1
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("_id"), whole(text_column).alias("_text"))
    known = frozenset().union(*sets.values()) if sets else frozenset()
    counted = texts.select("_text").mapInArrow(_frequencies(known, step), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {r["word"]: r["n"] for r in counted.collect()}  # a row per template word
    return texts.mapInArrow(
        _scan(sets, frequency, percent, phrases, step),
        f"_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    ).withColumnRenamed("_id", id_column)
