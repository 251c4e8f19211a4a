"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import aligned_documents
from .common import table
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .hmm_scores import hmm_scores
from .html_text import main_text
from .language import language_id
from .licenses import license_scan
from .near_dedup import near_duplicates
from .packing import packed
from .substring_dedup import repeated_bytes
from .token_files import token_round_trip
from .tokens import public_file
from .vector_codes import vector_codes
from .warc import warc_round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"), end_id=1)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_license_scan": op2_license_scan,
        "op3_token_files": op3_token_files,
        "op4_decontamination": op4_decontamination,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_language_id": op7_language_id,
        "op8_html_text": op8_html_text,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_hmm_scores": op12_hmm_scores,
        "op13_token_alignment": op13_token_alignment,
    }
