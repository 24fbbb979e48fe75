"""Connected components by alternating large-star and small-star.

A large star links each node's larger neighbours to the least node of its neighbourhood (itself
included); a small star links a node and its smaller neighbours to the least of them. Alternated until
the edges no longer change, they leave one star per component, centred on its least node; a round
about halves the depth. Least neighbours are combining aggregates and joins on the node, which Spark
splits when a centre is hot. Every round is written to the shared folder, so lineage stays short and
a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    turned = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(hash(u, v))").alias("h")
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to (node, component): the least node each node can reach; centres left out.

    A node without an edge, and a component's least node, do not appear.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        now = keep(_small_star(_large_star(now)), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
