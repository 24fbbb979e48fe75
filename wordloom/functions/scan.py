"""Ordered per-key operators that never put a whole key into one task.

A plain ``Window.partitionBy(clip).orderBy(pos)`` sorts every row of a clip in one task, so a
clip holding a third of a corpus would run as a single straggler. Here each key is split into
blocks of consecutive order values. Window functions run inside ``(key, block)``; what a block
needs from the blocks around it travels in a summary of one row per block, which is joined back
on ``(key, block)``.

``neighbours`` serves dense integer positions (0, 1, 2, ...): the few rows next to a block edge
are copied into the next block, so offset lookups need one shuffle and no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.settle import settle

DEFAULT_BLOCK_ROWS = 65_536
DEFAULT_BLOCK_MS = 600_000


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.wordloom.block.rows", str(DEFAULT_BLOCK_ROWS)))


def block_ms(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.wordloom.block.ms", str(DEFAULT_BLOCK_MS)))


@dataclass(frozen=True)
class Op:
    kind: str
    expr: Column
    inclusive: bool = False


def lag(expr) -> Op:
    """Value of the row before this one."""
    return Op("lag", _c(expr))


def lead(expr) -> Op:
    """Value of the row after this one."""
    return Op("lead", _c(expr))


def last(expr, inclusive: bool = True) -> Op:
    """Latest non-null value up to this row."""
    return Op("last", _c(expr), inclusive)


def following(expr, inclusive: bool = True) -> Op:
    """Earliest non-null value from this row on."""
    return Op("next", _c(expr), inclusive)


def running_sum(expr, inclusive: bool = True) -> Op:
    return Op("sum", _c(expr), inclusive)


def running_max(expr, inclusive: bool = True) -> Op:
    return Op("max", _c(expr), inclusive)


def suffix_min(expr, inclusive: bool = True) -> Op:
    return Op("suffix_min", _c(expr), inclusive)


def total(how: str, expr) -> Op:
    """sum, max or min over the whole key."""
    return Op("total_" + how, _c(expr))


def _c(expr) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


_PREFIX = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ops: dict[str, Op],
    block: Column | None = None,
) -> DataFrame:
    """Add one column per op, computed over ``keys`` in ``order``.

    The input is read twice (rows and block summaries), so a deep one is settled first.
    ``block`` must not decrease along ``order``; by default it is ``order[0]`` div block rows.
    """
    if block is None:
        block = F.floor(F.col(order[0]) / block_rows(df.sparkSession))
    df = settle(df)
    tagged = df.withColumn("_blk", block)
    part = Window.partitionBy(*keys, "_blk")
    asc = part.orderBy(*order)
    desc = part.orderBy(*[F.col(o).desc() for o in order])
    over_blocks = Window.partitionBy(*keys).orderBy("_blk")
    whole = Window.partitionBy(*keys)
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])

    local, summary, carry, final = [], [], [], []
    for name, op in ops.items():
        ln, sn, cn = f"_l_{name}", f"_s_{name}", f"_c_{name}"
        frame_end = 0 if op.inclusive else -1
        up = asc.rowsBetween(Window.unboundedPreceding, frame_end)
        down = desc.rowsBetween(Window.unboundedPreceding, frame_end)
        e = op.expr
        if op.kind in ("sum", "max"):
            fn = _PREFIX[op.kind]
            local.append(fn(e).over(up).alias(ln))
            summary.append(fn(e).alias(sn))
            carry.append(fn(sn).over(before).alias(cn))
            if op.kind == "sum":
                merged = F.coalesce(F.col(ln), F.lit(0)) + F.coalesce(F.col(cn), F.lit(0))
            else:
                merged = F.greatest(ln, cn)
        elif op.kind == "suffix_min":
            local.append(F.min(e).over(down).alias(ln))
            summary.append(F.min(e).alias(sn))
            carry.append(F.min(sn).over(after).alias(cn))
            merged = F.least(ln, cn)
        elif op.kind == "last":
            local.append(F.last(e, ignorenulls=True).over(up).alias(ln))
            summary.append(F.max_by(e, F.when(e.isNotNull(), rank)).alias(sn))
            carry.append(F.last(sn, ignorenulls=True).over(before).alias(cn))
            merged = F.coalesce(ln, cn)
        elif op.kind == "next":
            local.append(F.last(e, ignorenulls=True).over(down).alias(ln))
            summary.append(F.min_by(e, F.when(e.isNotNull(), rank)).alias(sn))
            carry.append(F.last(sn, ignorenulls=True).over(after).alias(cn))
            merged = F.coalesce(ln, cn)
        elif op.kind in ("lag", "lead"):
            shift = F.lag if op.kind == "lag" else F.lead
            edge = F.max_by if op.kind == "lag" else F.min_by
            boxed = F.struct(e.alias("v"))
            local.append(shift(boxed).over(asc).alias(ln))
            summary.append(edge(boxed, rank).alias(sn))
            carry.append(shift(F.col(sn)).over(over_blocks).alias(cn))
            merged = F.coalesce(ln, cn)["v"]
        else:
            fn = _PREFIX[op.kind.removeprefix("total_")]
            summary.append(fn(e).alias(sn))
            carry.append(fn(sn).over(whole).alias(cn))
            merged = F.col(cn)
        final.append(merged.alias(name))

    carried = (
        tagged.groupBy(*keys, "_blk").agg(*summary).select(*keys, "_blk", *carry)
    )
    windowed = tagged.select("*", *local) if local else tagged
    return windowed.join(carried, [*keys, "_blk"], "left").select(
        *[F.col(c) for c in df.columns if c not in ops], *final
    )


def neighbours(
    df: DataFrame, keys: list[str], pos: str, shifts: dict[str, tuple[Column | str, int]]
) -> DataFrame:
    """Add columns holding the value ``offset`` rows away (negative = earlier).

    ``pos`` must be dense within ``keys``. Rows within reach of a block edge are copied into the
    adjoining block and dropped again after the window.
    """
    size = block_rows(df.sparkSession)
    reach_up = max([o for _, o in shifts.values() if o > 0], default=0)
    reach_down = max([-o for _, o in shifts.values() if o < 0], default=0)
    size = max(size, reach_up + reach_down + 1)
    p = F.col(pos)
    home = F.floor(p / size)
    blocks = F.array(home)
    slot = p % size
    copies = F.when(
        (slot < reach_up) & (home > 0), F.array(home, home - 1)
    ).when(slot >= size - reach_down, F.array(home, home + 1)).otherwise(blocks)
    if 2 * max(reach_up, reach_down) >= size:
        copies = F.array_distinct(F.array(home, F.greatest(home - 1, F.lit(0)), home + 1))
    tagged = df.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    added = [
        (F.lead(_c(e), o) if o > 0 else F.lag(_c(e), -o)).over(w).alias(n)
        for n, (e, o) in shifts.items()
    ]
    return tagged.select("*", *added).where("_blk = _home").drop("_blk", "_home")
