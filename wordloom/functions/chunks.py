"""Texts cut into messages of bounded length at line ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("chunk", T.StringType())])


class _Chunks:
    def eval(self, text: str, limit: int):
        start, n = 0, 0
        while len(text) - start > limit:
            line_end = text.rfind("\n", start, start + limit)
            stop = line_end if line_end > start else start + limit
            yield n, text[start:stop].rstrip()
            n, start = n + 1, stop
            while start < len(text) and text[start] == "\n":
                start += 1
        if start < len(text) or n == 0:
            yield n, text[start:]


def chunked(texts: DataFrame, column: str, limit: int = 4000) -> DataFrame:
    """One row per message of at most ``limit`` characters, cut at the last line end that fits."""
    split = F.udtf(_Chunks, returnType=_ROW)
    return texts.lateralJoin(split(F.col(column).outer(), F.lit(limit))).drop(column)
