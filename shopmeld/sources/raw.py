"""Scans of the raw tables: parquet, JDBC and CSV, always with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from shopmeld import config
from shopmeld.schemas import PLATFORM_INFO_SCHEMA, RAW_SCHEMAS


def raw_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Scan one raw table below `base`; only the columns a query touches are read."""
    return spark.read.format(fmt).schema(RAW_SCHEMAS[name]).load(f"{base}/{name}")


class RawTables(Mapping[str, DataFrame]):
    """The 13 raw tables below a directory, opened on first use."""

    def __init__(self, spark: SparkSession, base: str, fmt: str = "parquet"):
        self._spark, self._base, self._fmt = spark, base, fmt
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = raw_table(self._spark, self._base, name, self._fmt)
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(RAW_SCHEMAS)

    def __len__(self) -> int:
        return len(RAW_SCHEMAS)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int = 64,
    fetch_size: int = 10_000,
    **connection: str,
) -> dict[str, str]:
    """Options of a partitioned warehouse read: `partitions` ranges over the partition column."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        **connection,
    }


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, **options) -> DataFrame:
    """Read a warehouse table in parallel; needs the database's JDBC driver on the class path."""
    return (
        spark.read.format("jdbc")
        .options(**jdbc_options(url, table, partition_column, **options))
        .load()
    )


def csv_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scan a static lookup file with a header line."""
    return spark.read.schema(schema).option("header", True).csv(path)


def platform_mappings(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Display name, default currency and region per platform, from a CSV file if one is given."""
    if path:
        return csv_seed(spark, path, PLATFORM_INFO_SCHEMA)
    # As SQL literals Spark knows the size and never shuffles the other side of a join with them;
    # rows handed over from Python would have no known size.
    rows = ", ".join(str(row) for row in config.PLATFORM_INFO)
    names = [field.split()[0] for field in PLATFORM_INFO_SCHEMA.split(", ")]
    return spark.sql(f"SELECT * FROM VALUES {rows} AS info({', '.join(names)})")
