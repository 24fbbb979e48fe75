"""Shared helpers: the scratch folder, stored steps, size-checked broadcasts, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import work_dir

#: A side is broadcast only when its measured size is below this; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

#: White space of the word contract: blank and U+0009 to U+000D.
SPACES = "[ \\t-\\r]"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster."""
    app = spark.sparkContext.applicationId
    return f"{work_dir(spark)}/wordloom/{app}/llm/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python that stay small when texts are long; a session setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs run within give their shuffle files back as they end, not when the driver's memory is cleaned.
    For chains of stored steps, of which none reads the shuffles of another."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows sum to at most ``limit`` bytes, else as it is.

    ``df`` should be stored (``keep``), as one aggregate job measures it.
    """
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    total = df.agg(F.sum(size.cast("long")).alias("b")).first()["b"] or 0
    return F.broadcast(df) if total <= limit else df


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
