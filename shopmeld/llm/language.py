"""Language identification as inference over mixtures of languages.

Each language is a distribution over byte trigrams of the lower-cased text, learnt from labelled rows: Spark
sums trigram counts per language over all of them. A text is a mixture: expectation-maximisation estimates
each language's share from the trigrams' likelihoods. The set of languages is chosen by penalised
likelihood: starting from all, the language with the smallest share is dropped as long as that lowers
-2 * log-likelihood + (languages - 1) * log(trigrams).

Shares are of the learnt languages only. How much of a text is in them at all is a second mixture: the chosen
languages, in their shares, against a background where every place is equally likely. Trigrams that no learnt
language has are likelier there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytes import lower_ascii, steps, text_bytes
from .common import packed_row, ship, whole

#: Trigrams are hashed to this many places, so a language takes 512 KB in every task.
PLACES = 1 << 16
SMOOTHING = 0.05
ROUNDS = 12
#: Languages that a model may have; labels beyond are an error, not dropped.
MAX_LANGUAGES = 256
UNKNOWN = "und"


def _places(data: np.ndarray) -> np.ndarray:
    """The place of every byte trigram."""
    low = lower_ascii(data).astype(np.uint32)
    low[(low < 97) | ((low > 122) & (low < 128))] = 32  # what is no letter only separates
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


#: The place of a trigram without a letter.
BLANK = int(_places(np.full(3, 32, np.uint8))[0])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (_lang, _text) -> (_lang, _place, _n), summed per task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        data, ends = text_bytes(batch.column("_text"))
        langs = batch.column("_lang").to_pylist()
        for i, lang in enumerate(langs):
            if lang not in sums:
                sums[lang] = np.zeros(PLACES, np.int64)
            if ends[i + 1] - ends[i] > 2:
                sums[lang] += np.bincount(_places(data[ends[i] : ends[i + 1]]), minlength=PLACES)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["_lang", "_place", "_n"]
        )


class LanguageModel:
    """Trigram distributions of the learnt languages, in the order of their names."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        table = np.array([counts[x] for x in self.languages], float).reshape(len(counts), PLACES) + SMOOTHING
        self.table = (table / table.sum(1, keepdims=True)).astype(np.float32)

    def mixture(self, data: np.ndarray) -> dict[str, float]:
        """Shares of the chosen languages in a text's bytes; empty without trigrams or languages."""
        if len(data) < 3 or not self.languages:
            return {}
        places, n = np.unique(_places(data), return_counts=True)
        n = n.astype(np.float64)
        total = n.sum()
        chosen = np.arange(len(self.languages))
        best = None
        while True:
            likely = self.table[np.ix_(chosen, places)].astype(np.float64)
            shares = np.full(len(chosen), 1 / len(chosen))
            for _ in range(ROUNDS if len(chosen) > 1 else 0):
                parts = shares[:, None] * likely
                shares = (parts / parts.sum(0)) @ n / total
            cost = -2 * (n @ np.log(shares @ likely)) + (len(chosen) - 1) * np.log(total)
            if best is not None and cost > best[0]:
                break
            best = (cost, chosen, shares)
            if len(chosen) == 1:
                break
            chosen = np.delete(chosen, np.argmin(shares))
        return {self.languages[c]: float(s) for c, s in zip(best[1], best[2], strict=True)}

    def known(self, data: np.ndarray, shares: dict[str, float]) -> float:
        """Share of a text's trigrams that comes from the mixture of languages, not from the background.

        Trigrams without a letter are left out; without others the share is 0.
        """
        if len(data) < 3 or not shares:
            return 0.0
        places, n = np.unique(_places(data), return_counts=True)
        n = np.where(places == BLANK, 0, n).astype(np.float64)
        if not (total := n.sum()):
            return 0.0
        rows = [self.languages.index(x) for x in shares]
        likely = np.array(list(shares.values())) @ self.table[np.ix_(rows, places)].astype(np.float64)
        share = 0.5
        for _ in range(ROUNDS):
            own = share * likely
            share = float(own / (own + (1 - share) / PLACES) @ n / total)
        return share


def fit(labelled: DataFrame, lang_column: str = "lang", text_column: str = "text") -> LanguageModel:
    """A model from every row with a text and a language; other rows teach nothing."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(f"`{lang_column}`").isNotNull() & F.col(f"`{text_column}`").isNotNull()).select(
        F.col(f"`{lang_column}`").cast("string").alias("_lang"), F.col(f"`{text_column}`").alias("_text")
    )
    summed = (
        rows.mapInArrow(_counts, "_lang string, _place int, _n bigint")
        .groupBy("_lang", "_place")
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_lang")
        .agg(F.collect_list(F.struct("_place", "_n")).alias("_counts"))  # at most PLACES
    )
    counts = {}
    for row in summed.limit(MAX_LANGUAGES + 1).collect():
        own = counts[row["_lang"]] = np.zeros(PLACES, np.int64)
        own[[c["_place"] for c in row["_counts"]]] = [c["_n"] for c in row["_counts"]]
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; their tables do not fit into every task")
    return LanguageModel(counts)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(shared, known: bool):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        for batch in batches:
            column = batch.column("_text")
            data, ends = text_bytes(column)
            found, score, second, learnt = [], [], [], []
            for start, stop in steps(ends):
                for i in range(start, stop):
                    shares = model.mixture(data[ends[i] : ends[i + 1]]) if _has_letter(column[i].as_py()) else {}
                    if not shares and model.languages and _has_letter(column[i].as_py()):
                        shares = {model.languages[0]: 1 / len(model.languages)}  # too short for a trigram
                    if known:
                        learnt.append(model.known(data[ends[i] : ends[i + 1]], shares))
                    order = sorted(shares, key=lambda x: (-shares[x], x))
                    found.append(order[0] if order else UNKNOWN)
                    score.append(min(1.0, shares[order[0]]) if order else 0.0)
                    second.append(",".join(order))
            columns = [batch.column("_row"), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string())]
            names = ["_row", "_pred", "_score", "_langs"]
            if known:
                columns, names = [*columns, pa.array(learnt, pa.float64())], [*names, "_known"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return predict


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text", known: bool = False) -> DataFrame:
    """Per row: _row (the whole row), _pred, _score (share of _pred in the text), _langs (chosen, by share);
    if asked for, _known (share of the text in learnt languages).

    Null texts and texts without a letter are `und` with score 0. A text with letters but no trigram gets the
    first language at 1 / languages. Without any learnt language every text is `und`.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_LANGUAGES tables
    rows = docs.select(packed_row(docs.columns), F.col(f"`{text_column}`").alias("_text"))
    found = StructType([rows.schema["_row"]]).add("_pred", "string").add("_score", "double").add("_langs", "string")
    return rows.mapInArrow(_predict(shared, known), found.add("_known", "double") if known else found)


def held_out(id_column: str | Column = "doc_id") -> Column:
    """Rows kept out of learning: crc32 of the id as text is 2 modulo 4. A null id counts as empty text."""
    column = F.col(f"`{id_column}`") if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, langs; learnt from the rows that are not held out."""
    model = fit(docs.where(~held_out(id_column)), lang_column, text_column)
    narrow = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    row = F.col("_row").getField
    return predict(narrow, model, text_column).select(
        row(id_column).alias(id_column),
        held_out(row(id_column)).alias("held_out"),
        F.col("_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
        F.col("_langs").alias("langs"),
    )


def known_language(
    docs: DataFrame, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """The documents in learnt languages, one or a mixture of several, with all their columns: not `und`, and
    learnt languages together fill at least `least` of the text. Texts too short for a trigram show none."""
    model = fit(docs.where(~held_out(id_column)), lang_column, text_column)
    kept = predict(docs, model, text_column, known=True).where((F.col("_pred") != UNKNOWN) & (F.col("_known") >= least))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
