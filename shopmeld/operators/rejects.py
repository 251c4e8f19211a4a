"""Payloads that staging cannot read: which row, which column, why; and the raw tables without them.

A broken JSON text or an amount that is no number stops a strict cast, and a lenient one loses it silently. Here
such a payload goes to a reject table, and the rest of its row is staged with the payload missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeld.operators.staging import MONEY, STAGING
from shopmeld.schemas import RAW_KEYS

UNREADABLE = "unreadable"
NO_NUMBER = "no number"
_BAD = "_bad"


@dataclass(frozen=True)
class Payload:
    """A JSON column, the fields staging takes out of it, and the type of those that are numbers."""

    column: str
    fields: Sequence[str]
    numbers: Mapping[str, str] = field(default_factory=dict)
    listed: bool = False  # an array, of which the first element counts

    def _parsed(self) -> Column:
        names = ", ".join(f"{name} string" for name in self.fields)
        if self.listed:
            return F.from_json(self.column, f"array<struct<{', '.join(f'{name}: string' for name in self.fields)}>>")
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
        return F.from_json(self.column, f"{names}, {_BAD} string", options)

    def reason(self) -> Column:
        """Why the payload is rejected; NULL where it can be read. A missing payload and a JSON null are no rejects."""
        value, parsed = F.col(self.column), self._parsed()
        there = value.isNotNull() & (F.trim(value) != "null")
        broken = parsed.isNull() if self.listed else parsed.isNull() | parsed[_BAD].isNotNull()
        row = F.get(parsed, F.lit(0)) if self.listed else parsed
        found = F.when(there & broken, UNREADABLE)
        for name, kind in self.numbers.items():
            found = found.when(row[name].isNotNull() & row[name].try_cast(kind).isNull(), f"{NO_NUMBER}: {name}")
        return found


#: raw table -> its payloads
PAYLOADS: dict[str, tuple[Payload, ...]] = {
    "shopify_products": (
        Payload(
            "variants",
            ("price", "compare_at_price", "inventory_quantity"),
            {"price": MONEY, "compare_at_price": MONEY, "inventory_quantity": "int"},
            listed=True,
        ),
        Payload("images", ("src",), listed=True),
    ),
    "shopify_customers": (Payload("default_address", ("city", "country")),),
    "amazon_orders": (Payload("order_total", ("Amount", "CurrencyCode"), {"Amount": MONEY}),),
    "amazon_order_items": (
        Payload("item_price", ("Amount",), {"Amount": MONEY}),
        Payload("promotion_discount", ("Amount",), {"Amount": MONEY}),
    ),
}


def rejects(raw: Mapping[str, DataFrame], model: str) -> DataFrame:
    """Rejected payloads of a staging model: (model, row_key, column_name, reason, payload). One scan."""
    table = STAGING[model][0]
    found = F.array(
        *(
            F.struct(F.lit(p.column).alias("column_name"), p.reason().alias("reason"), F.col(p.column).alias("payload"))
            for p in PAYLOADS[table]
        )
    )
    rows = raw[table].select(F.col(RAW_KEYS[table][0]).cast("string").alias("row_key"), F.inline(found))
    return rows.filter("reason IS NOT NULL").select(F.lit(model).alias("model"), "row_key", "column_name", "reason", "payload")


def reject_models() -> list[str]:
    """Staging models that read payloads."""
    return [model for model, (table, _) in STAGING.items() if table in PAYLOADS]


def reject_report(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Rows like those of the quality suite: (model, column_name, test, failures), one per payload and 0 where all
    can be read."""

    def counted(model: str) -> DataFrame:
        table = STAGING[model][0]
        counts = [F.count(p.reason()).alias(p.column) for p in PAYLOADS[table]]
        rows = [
            F.struct(F.lit(model).alias("model"), F.lit(p.column).alias("column_name"), F.lit("readable").alias("test"), F.col(p.column).alias("failures"))
            for p in PAYLOADS[table]
        ]
        return raw[table].agg(*counts).select(F.inline(F.array(*rows)))

    return reduce(DataFrame.unionByName, map(counted, reject_models()))


class ReadableRaw(Mapping[str, DataFrame]):
    """Raw tables in which rejected payloads are missing, so that every model can be staged."""

    def __init__(self, raw: Mapping[str, DataFrame]) -> None:
        self._raw = raw

    def __getitem__(self, table: str) -> DataFrame:
        payloads = PAYLOADS.get(table, ())
        return self._raw[table].withColumns({p.column: F.when(p.reason().isNull(), F.col(p.column)) for p in payloads})

    def __iter__(self) -> Iterator[str]:
        return iter(self._raw)

    def __len__(self) -> int:
        return len(self._raw)
