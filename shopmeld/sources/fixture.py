"""Raw tables derived from the driver's TPC-H-like tables.

The expressions run unchanged in Spark SQL and in DuckDB; EPOCH(x) is replaced per engine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from shopmeld.schemas import RAW_SCHEMAS

# raw table -> (driver table, row filter, {column: expression})
DERIVED: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "shopify_customers": (
        "customer",
        None,
        {
            "id": "c_custkey",
            "email": "concat('c', cast(c_custkey as varchar(20)), '@shop.example')",
            "phone": "cast(null as varchar(20))",
            "first_name": "case when c_custkey % 11 = 0 then null else c_name end",
            "last_name": "c_mktsegment",
            "default_address": (
                "case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then "
                "'{\"city\":\"City3\"}' else concat('{\"city\":\"City', cast(c_custkey % 10 as "
                "varchar(20)), '\",\"province\":\"P\",\"country\":\"N', cast(c_nationkey as "
                "varchar(20)), '\",\"country_code\":\"N', cast(c_nationkey as varchar(20)), "
                "'\"}') end"
            ),
            "orders_count": "cast(c_custkey % 7 as int)",
            "total_spent": (
                "cast(cast(case when c_acctbal > 0 then c_acctbal else 0 end as "
                "decimal(12,2)) * 0.2 as decimal(12,2))"
            ),
            "state": "'enabled'",
            "verified_email": "true",
            "accepts_marketing": "c_custkey % 2 = 0",
            "tags": "''",
            "created_at": (
                "timestamp '1999-01-01 00:00:00' + interval '1' day * cast(c_custkey % "
                "927 as int)"
            ),
            "updated_at": "timestamp '2001-07-15 00:00:00'",
        },
    ),
    "shopify_products": (
        "part",
        None,
        {
            "id": "p_partkey",
            "title": "p_name",
            "handle": "lower(p_name)",
            "product_type": "case when p_partkey % 9 = 0 then null else p_type end",
            "vendor": "case when p_partkey % 10 = 0 then null else p_brand end",
            "variants": (
                "case when p_partkey % 23 = 0 then '[]' else concat('[{\"price\":\"', "
                "cast(cast(p_retailprice as decimal(12,2)) as varchar(20)), "
                "'\",\"compare_at_price\":\"', cast(cast(cast(p_retailprice as "
                "decimal(12,2)) * 1.2 as decimal(12,2)) as varchar(20)), "
                "'\",\"sku\":\"SKU-', cast(p_partkey as varchar(20)), "
                "'\",\"inventory_quantity\":', cast(p_size as varchar(20)), '}]') end"
            ),
            "status": "'active'",
            "published_at": (
                "timestamp '2000-01-01 00:00:00' + interval '1' day * cast(p_partkey % "
                "365 as int)"
            ),
            "body_html": "'Desc'",
            "tags": "p_type",
            "images": (
                "concat('[{\"src\":\"https://ex.example/', cast(p_partkey as varchar(20)), "
                "'.jpg\"}]')"
            ),
            "created_at": "timestamp '2000-01-01 00:00:00'",
            "updated_at": "timestamp '2001-07-15 00:00:00'",
        },
    ),
    "shopify_orders": (
        "orders",
        "o_orderkey % 4 = 0",
        {
            "id": "o_orderkey",
            "created_at": "o_orderdate + interval '1' hour * cast(o_orderkey % 24 as int)",
            "updated_at": "o_orderdate + interval '1' day",
            "processed_at": "o_orderdate",
            "cancelled_at": (
                "case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then "
                "o_orderdate end"
            ),
            "closed_at": "case when o_orderstatus = 'F' then o_orderdate + interval '3' day end",
            "customer_id": "o_custkey",
            "email": "concat('c', cast(o_custkey as varchar(20)), '@shop.example')",
            "total_price": "cast(o_totalprice as decimal(12,2))",
            "subtotal_price": "cast(cast(o_totalprice as decimal(12,2)) * 0.92 as decimal(12,2))",
            "total_tax": "cast(cast(o_totalprice as decimal(12,2)) * 0.08 as decimal(12,2))",
            "total_discounts": "cast(cast(o_totalprice as decimal(12,2)) * 0.05 as decimal(12,2))",
            "currency": "'USD'",
            "financial_status": (
                "case o_orderstatus when 'F' then 'paid' when 'O' then 'pending' else "
                "'refunded' end"
            ),
            "fulfillment_status": "case when o_orderstatus = 'F' then 'fulfilled' end",
            "cancel_reason": "cast(null as varchar(20))",
            "line_items_count": (
                "case when o_orderkey % 16 = 0 then null else cast(1 + o_orderkey % 5 as "
                "int) end"
            ),
            "source_name": "'web'",
            "tags": "''",
            "note": "cast(null as varchar(20))",
        },
    ),
    "shopify_order_line_items": (
        "lineitem",
        "l_orderkey % 4 = 0",
        {
            "id": "l_orderkey * 10 + l_linenumber",
            "order_id": "l_orderkey",
            "product_id": "l_partkey",
            "variant_id": "l_partkey",
            "title": "concat('Item ', cast(l_partkey as varchar(20)))",
            "variant_title": "cast(null as varchar(20))",
            "sku": "concat('SKU-', cast(l_partkey as varchar(20)))",
            "quantity": "cast(l_quantity as int)",
            "price": "cast(cast(l_extendedprice as decimal(12,2)) * 0.02 as decimal(12,2))",
            "total_discount": (
                "case when l_linenumber = 1 then null else cast(cast(l_extendedprice as "
                "decimal(12,2)) * cast(l_discount as decimal(4,2)) as decimal(12,2)) end"
            ),
            "fulfillment_status": "case when l_linestatus = 'F' then 'fulfilled' end",
            "fulfillable_quantity": "0",
            "gift_card": "false",
            "taxable": "true",
            "requires_shipping": "true",
        },
    ),
    "amazon_orders": (
        "orders",
        "o_orderkey % 4 = 1",
        {
            "amazon_order_id": "concat('AMZ-', cast(o_orderkey as varchar(20)))",
            "purchase_date": "o_orderdate",
            "last_update_date": "o_orderdate + interval '1' day",
            "buyer_email": "concat('b', cast(o_custkey as varchar(20)), '@amz.example')",
            "order_total": (
                "concat('{\"Amount\":\"', cast(cast(o_totalprice as decimal(12,2)) as "
                "varchar(20)), '\",\"CurrencyCode\":\"USD\"}')"
            ),
            "payment_method": "case when o_orderpriority = '1-URGENT' then 'paid' else 'Card' end",
            "order_status": (
                "case o_orderstatus when 'F' then 'Shipped' when 'O' then 'Pending' else "
                "'Canceled' end"
            ),
            "shipping_address": (
                "case when o_orderkey % 13 = 0 then null else concat('{\"City\":\"City', "
                "cast(o_custkey % 10 as varchar(20)), '\",\"CountryCode\":\"C', "
                "cast(o_custkey % 5 as varchar(20)), '\"}') end"
            ),
            "number_of_items_shipped": (
                "case when o_orderstatus = 'F' then cast(1 + o_orderkey % 4 as int) else "
                "0 end"
            ),
            "number_of_items_unshipped": (
                "case when o_orderstatus = 'F' then 0 else cast(1 + o_orderkey % 4 as "
                "int) end"
            ),
            "sales_channel": "'Amazon.com'",
        },
    ),
    "amazon_order_items": (
        "lineitem",
        "l_orderkey % 4 = 1",
        {
            "order_item_id": (
                "concat('AMZ-', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber "
                "as varchar(20)))"
            ),
            "amazon_order_id": "concat('AMZ-', cast(l_orderkey as varchar(20)))",
            "asin": "concat('ASIN', cast(l_partkey as varchar(20)))",
            "title": "concat('Item ', cast(l_partkey as varchar(20)))",
            "seller_sku": "concat('SKU-', cast(l_partkey as varchar(20)))",
            "quantity_ordered": "case when l_partkey % 50 = 0 then 0 else cast(l_quantity as int) end",
            "quantity_shipped": (
                "case when l_linestatus = 'F' and l_partkey % 50 <> 0 then "
                "cast(l_quantity as int) else 0 end"
            ),
            "item_price": (
                "concat('{\"Amount\":\"', cast(cast(l_extendedprice as decimal(12,2)) as "
                "varchar(20)), '\"}')"
            ),
            "promotion_discount": "case when l_linenumber = 1 then null else '{\"Amount\":\"1.50\"}' end",
        },
    ),
    "lazada_orders": (
        "orders",
        "o_orderkey % 4 = 2",
        {
            "order_id": "o_orderkey",
            "created_at": "o_orderdate + interval '1' hour * cast(o_orderkey % 24 as int)",
            "updated_at": "o_orderdate + interval '1' day",
            "customer_id": "o_custkey",
            "buyer_email": "concat('b', cast(o_custkey as varchar(20)), '@lzd.example')",
            "price": "cast(o_totalprice as decimal(12,2))",
            "items_count": "cast(1 + o_orderkey % 4 as int)",
            "voucher": (
                "case when o_orderkey % 12 = 2 then null else cast(o_orderkey % 50 as "
                "decimal(12,2)) end"
            ),
            "payment_method": "case when o_orderpriority = '2-HIGH' then 'paid' else 'COD' end",
            "statuses": (
                "case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' "
                "else 'canceled' end"
            ),
            "remarks": "cast(null as varchar(20))",
        },
    ),
    "lazada_order_items": (
        "lineitem",
        "l_orderkey % 4 = 2",
        {
            "order_item_id": "l_orderkey * 10 + l_linenumber",
            "order_id": "l_orderkey",
            "product_id": "l_partkey",
            "name": "concat('Item ', cast(l_partkey as varchar(20)))",
            "variation": "cast(null as varchar(20))",
            "sku": "concat('SKU-', cast(l_partkey as varchar(20)))",
            "paid_price": "cast(l_extendedprice as decimal(12,2))",
            "voucher_amount": "case when l_linenumber = 1 then null else cast(2 as decimal(12,2)) end",
            "status": "case when l_linestatus = 'F' then 'delivered' else 'pending' end",
        },
    ),
    "shopee_orders": (
        "orders",
        "o_orderkey % 4 = 3",
        {
            "order_sn": "concat('SHP', cast(o_orderkey as varchar(20)))",
            "create_time": "EPOCH(o_orderdate)",
            "update_time": "EPOCH(o_orderdate) + 86400",
            "pay_time": "case when o_orderstatus = 'P' then null else EPOCH(o_orderdate) + 60 end",
            "buyer_user_id": "o_custkey",
            "buyer_username": "concat('buyer', cast(o_custkey as varchar(20)))",
            "total_amount": "cast(o_totalprice as decimal(12,2))",
            "estimated_shipping_fee": "case when o_orderkey % 7 = 0 then null else cast(50 as decimal(12,2)) end",
            "voucher_absorbed": (
                "case when o_orderkey % 9 = 0 then null else cast(o_orderkey % 100 as "
                "decimal(12,2)) end"
            ),
            "currency": (
                "case o_custkey % 5 when 0 then 'PHP' when 1 then 'MYR' when 2 then "
                "'SGD' when 3 then 'IDR' else 'EUR' end"
            ),
            "order_status": (
                "case o_orderpriority when '1-URGENT' then 'COMPLETED' when '2-HIGH' "
                "then 'SHIPPED' when '3-MEDIUM' then 'READY_TO_SHIP' when '4-NOT "
                "SPECIFIED' then 'UNPAID' else 'CANCELLED' end"
            ),
            "cancel_reason": "case when o_orderpriority = '5-LOW' then 'changed their mind' end",
            "message_to_seller": "cast(null as varchar(20))",
        },
    ),
    "shopee_order_items": (
        "lineitem",
        "l_orderkey % 4 = 3",
        {
            "order_sn": "concat('SHP', cast(l_orderkey as varchar(20)))",
            "item_id": "l_partkey",
            "item_name": "concat('Item ', cast(l_partkey as varchar(20)))",
            "model_id": "l_partkey * 10",
            "model_name": "'Default'",
            "model_sku": "concat('SKU-', cast(l_partkey as varchar(20)))",
            "model_quantity_purchased": "cast(l_quantity as int)",
            "model_original_price": "cast(cast(l_extendedprice as decimal(12,2)) * 0.022 as decimal(12,2))",
            "model_discounted_price": "cast(cast(l_extendedprice as decimal(12,2)) * 0.02 as decimal(12,2))",
        },
    ),
}

# Schemas of the driver tables the expressions read.
SOURCE_SCHEMAS = {
    "customer": """c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,
        c_mktsegment STRING""",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
        p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
        l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
}

_EPOCH = re.compile(r"EPOCH\((\w+)\)")


class DerivedRawTables(Mapping[str, DataFrame]):
    """The raw tables as projections over the driver's parquet files, in the raw schemas.

    With `streaming` they are streams over the same files.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False):
        self._spark, self._sf_dir, self._streaming = spark, sf_dir, streaming
        self._opened: dict[str, DataFrame] = {}

    def _scan(self, source: str) -> DataFrame:
        schema = SOURCE_SCHEMAS[source]
        if self._streaming:
            # A pattern, because a file stream takes a plain path for a directory.
            pattern = f"{self._sf_dir}/{{{source}.parquet}}"
            return self._spark.readStream.schema(schema).parquet(pattern)
        return self._spark.read.schema(schema).parquet(f"{self._sf_dir}/{source}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            source, condition, columns = DERIVED[name]
            df = self._scan(source)
            if condition:
                df = df.filter(condition)
            self._opened[name] = df.selectExpr(*_typed(name, columns))
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(DERIVED)

    def __len__(self) -> int:
        return len(DERIVED)


def _typed(table: str, columns: Mapping[str, str]) -> Iterator[str]:
    """The expressions as Spark SQL, cast to the raw schema's types."""
    types = dict(re.findall(r"(\w+) (\w+(?:\(\d+,\d+\))?)", RAW_SCHEMAS[table]))
    seconds = r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', \1)"
    for column, text in columns.items():
        spark_text = _EPOCH.sub(seconds, text).replace("timestamp '", "timestamp_ntz '")
        yield f"cast({spark_text} as {types[column]}) as {column}"


def derived_sql(name: str) -> str:
    """The same projection as DuckDB SQL."""
    source, condition, columns = DERIVED[name]
    body = ", ".join(
        f"{_EPOCH.sub(r'cast(epoch(\1) as bigint)', text)} AS {column}"
        for column, text in columns.items()
    )
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT {body} FROM {source}{where}"
