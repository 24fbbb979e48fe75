"""Computing a deep intermediate table once.

An operator that reads its input more than once would run everything upstream that often, and
chains of such operators multiply. ``settle`` writes a deep input to the shared folder as
Parquet and reads it back: later branches scan (and prune) that, and lost executors cost a
re-read. Inputs that are plain scans, or a single shuffle away from one, are left alone.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from wordloom.session import work_dir

_SHUFFLING = re.compile(r"^[\s:+-]*(?:Window|Join|Aggregate|Generate|Distinct|Deduplicate)\b", re.M)
DEEP = 3


def settle(df: DataFrame, deep: int = DEEP) -> DataFrame:
    plan = df._jdf.queryExecution().analyzed().toString()
    if len(_SHUFFLING.findall(plan)) < deep:
        return df
    spark = df.sparkSession
    path = f"{work_dir(spark)}/wordloom/{spark.sparkContext.applicationId}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
