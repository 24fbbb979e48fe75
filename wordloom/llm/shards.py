"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A document descends the tree. At each node every child draws ``ln(u) / weight`` from a hash of
(doc_id, level, child); the largest draw wins, so a child gets a share in proportion to its weight
and a change of one weight moves documents only into or out of that child's subtree. Shard ``s`` sits
in rack ``s // rack_size`` of region ``s // (rack_size * racks)``; a node's weight is the sum of the
weights of its shards. A shard added to a full tree opens a region of its own: documents then move
only into it. (Added to a rack that is not full, it changes the weights of that rack and region, and
movement is confined to them.)

``slots`` numbers each shard's documents without gaps. A shard is split into blocks by a hash of the
id; only one count per (shard, block) takes part in the running sums, so no task holds a shard.

Defined results: a null doc_id draws as an empty id; rows with equal doc_id share a shard and get
different slots; a null text has 0 bytes of its own and the CRC of nothing. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACK_SIZE = 4
RACKS = 2
#: Rows that one (shard, block) group of the numbering holds on average.
BLOCK_ROWS = 5_000


def _draw(doc: Column, level: str, child: Column, weight: Column) -> Column:
    key = F.concat_ws("/", F.coalesce(doc.cast("string"), F.lit("")), F.lit(level), child.cast("string"))
    first = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return F.log((first + 0.5) / F.lit(4294967296.0)) / weight


def _winner(doc: Column, level: str, children: Sequence[Column], weights: Sequence[Column]) -> Column:
    """The child of the largest draw; the larger number on a tie; children of weight 0 never win."""
    draws = [
        F.when(w > 0, F.struct(_draw(doc, level, c, w).alias("d"), c.alias("c")))
        for c, w in zip(children, weights, strict=True)
    ]
    return F.array_max(F.array(*draws))["c"]


def assign(doc: Column, weights: Sequence[float], rack_size: int = RACK_SIZE, racks: int = RACKS) -> Column:
    """The shard (int) of a document in a tree with these shard weights."""
    n = len(weights)
    per_region = rack_size * racks
    regions = -(-n // per_region)

    def total(lo: int, hi: int) -> float:
        return float(sum(weights[lo:hi]))

    def table(values: Sequence[float], at: Column) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), at.cast("int"))

    region = _winner(
        doc,
        "region",
        [F.lit(r) for r in range(regions)],
        [F.lit(total(r * per_region, (r + 1) * per_region)) for r in range(regions)],
    )
    rack_weight = [total(k * rack_size, (k + 1) * rack_size) for k in range(regions * racks)]

    def rack_of(r: Column) -> Column:
        ids = [(r * racks + j).cast("int") for j in range(racks)]
        return _winner(doc, "rack", ids, [table(rack_weight, i) for i in ids])

    padded = list(weights) + [0.0] * (regions * per_region - n)

    def shard_of(k: Column) -> Column:
        ids = [(k * rack_size + j).cast("int") for j in range(rack_size)]
        return _winner(doc, "shard", ids, [table(padded, i) for i in ids])

    def then(col: Column, fn) -> Column:  # binds the value once
        return F.element_at(F.transform(F.array(col), fn), 1)

    return then(then(region, rack_of), shard_of).cast("int")


def place(
    docs: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (null without ``grown``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        assign(F.col(id_col), weights).alias("shard"),
        (assign(F.col(id_col), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )


def slots(placed: DataFrame, id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``placed`` with ``slot``: 0, 1, ... within each shard, in order of (block, id, CRC)."""
    per_shard = placed.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 0
    blocks = max(1, -(-per_shard // block_rows))
    blocked = placed.withColumn(
        "_block", F.pmod(F.xxhash64(F.lit("slot"), F.col(id_col)), F.lit(blocks)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("shard", "_block")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("shard", "_block").orderBy(id_col, "text_crc32")
    return (
        blocked.withColumn("_row", F.row_number().over(inside))
        .join(offsets, ["shard", "_block"])
        .withColumn("slot", (F.col("_base") + F.col("_row") - 1).cast("long"))
        .drop("_block", "_base", "_row")
    )
