"""Top rows of a metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_by_metric(metrics: DataFrame, metric: str, limit: int, tie: str) -> DataFrame:
    """Best ``limit`` rows by a metric with their rank. The limit comes first (a per-partition
    top-k), so the ranking window sees only those rows."""
    top = metrics.orderBy(F.col(metric).desc(), tie).limit(limit)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.col(metric).desc())).cast("long"))
