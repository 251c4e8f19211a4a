"""Helpers of the operators: shared scratch tables, code for the executors, words.

Names that start with an underscore are added by the operators and never reach a result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of ASCII letters and digits and of everything outside ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Folders of one application lie together and can be removed when it has ended. Where the setting
    is missing a temporary folder serves local sessions; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="shopmeld-llm-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = f"file://{_LOCAL[app]}"
    return f"{base.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, folder: str | None = None, codec: str | None = None) -> DataFrame:
    """The rows written to a shared table and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = folder or scratch(spark, name)
    df.write.parquet(folder, compression=codec)
    return spark.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, key: str, name: str, codec: str) -> DataFrame:
    """The rows of a DataFrame grouped by `key`, stored in buckets of it, so that joins by `key` need not shuffle them.

    Spark knows buckets of catalog tables only; the entry is dropped at once, which leaves files at a given path.
    """
    spark = df.sparkSession
    entry = f"spark_catalog.default.{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    # as many as the grouping has partitions, so one file for each bucket
    buckets = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions")
    writer = df.write.format("parquet").option("path", scratch(spark, name)).option("compression", codec)
    writer.bucketBy(int(buckets), key).saveAsTable(entry)
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return found


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers on every executor; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shopmeld-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/shopmeld_llm_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("shopmeld/__init__.py", "")
        for path in sorted(package.glob("*.py")):
            z.write(path, f"shopmeld/{package.name}/{path.name}")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit(""))


def packed_row(names: list[str]) -> Column:
    """All columns in one struct, `_row`; names may hold blanks and dots."""
    return F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row")


def lowered(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 32 << 20) -> int:
    """Partitions of about `each` bytes, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-n_bytes // each))
