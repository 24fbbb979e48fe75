"""Top-k per key without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rk") -> DataFrame:
    """Rows ranked 1..k. A salted first round cuts each key to ``k`` rows per salt, so the second
    round ranks at most ``k * SALTS`` rows of any key."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    part = salted.withColumn("_rk", F.row_number().over(first)).where(F.col("_rk") <= k)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        part.withColumn(rank, F.row_number().over(second))
        .where(F.col(rank) <= k)
        .drop("_salt", "_rk")
    )
