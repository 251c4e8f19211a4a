"""Every registered query against DuckDB on the same files, exactly."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = entry.SMOKE_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return con


#: Trained models and tokenizers, which SQL cannot express; their tests are in tests/llm.
WITHOUT_SQL = {
    "op3_token_files",
    "op5_suffix_array_dedup",
    "op7_language_id",
    "op8_html_text",
    "op10_best_fit_packing",
    "op12_hmm_scores",
    "op13_token_alignment",
    "pipeline",
}


def test_every_query_has_sql():
    found = set(entry.queries())
    assert set(entry.oracle_sql()) == found - WITHOUT_SQL
    assert entry.corpus_pipeline is None or WITHOUT_SQL <= found


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted((tuple(row[n] for n in sorted(names)) for row in df.collect()), key=repr)
    theirs = (dict(zip(names, row)) for row in result.fetchall())
    assert ours == sorted((tuple(row[n] for n in sorted(names)) for row in theirs), key=repr)


def test_entry_is_lazy_and_typed(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "order_date"
    assert df.count() > 0
