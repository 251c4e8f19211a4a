from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shopmeld.schemas import RAW_SCHEMAS  # noqa: E402
from shopmeld.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_rows(spark):
    """Build a raw table from dicts; columns left out are NULL."""

    def build(table: str, *rows: dict):
        schema = spark.createDataFrame([], RAW_SCHEMAS[table]).schema
        unknown = {k for row in rows for k in row} - set(schema.names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(row.get(n) for n in schema.names) for row in rows], schema)

    return build


@pytest.fixture(scope="session")
def orders_frame(spark):
    """Canonical orders from short tuples, for the marts."""

    def build(*rows: dict):
        schema = """order_id string, platform string, customer_id string, order_date date,
            order_month date, total_amount decimal(12,2), total_amount_usd decimal(19,8),
            discount_amount decimal(12,2), item_count int, is_paid boolean, is_fulfilled boolean,
            is_cancelled boolean"""
        filled = []
        for row in rows:
            date = row.get("date")
            amount = Decimal(str(row.get("usd", 10)))
            filled.append(
                (
                    row.get("id"),
                    row.get("platform", "shopify"),
                    row.get("customer", "c"),
                    date,
                    date.replace(day=1) if date else None,
                    amount,
                    amount,
                    Decimal(str(row.get("discount", 0))),
                    row.get("items", 1),
                    row.get("paid", False),
                    row.get("fulfilled", False),
                    row.get("cancelled", False),
                )
            )
        return spark.createDataFrame(filled, schema)

    return build


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)
