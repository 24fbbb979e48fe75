"""Interval algebra over ``clip_id, start_ms, end_ms`` (half-open) and cut lists
``clip_id, start_ms, end_ms, keep, reason``.

Interval rows are ordered by start. Blocks are stretches of time; before any ordered step the
rows that share a start are reduced to one, so a block holds at most one row per millisecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.settle import settle
from wordloom.functions.scan import (
    block_ms,
    lag,
    last,
    lead,
    running_max,
    running_sum,
    scan,
    suffix_min,
    total,
)

CLIP = ["clip_id"]
BUCKET_MS = 10_000


def _time_block(df: DataFrame, col: str = "start_ms") -> Column:
    return F.floor(F.col(col) / block_ms(df.sparkSession))


# -- building blocks ---------------------------------------------------------------------


def coalesce_spans(spans: DataFrame, touch_ms: int = 1, keys: list[str] = CLIP) -> DataFrame:
    """Merge spans whose start is at most ``touch_ms`` past the furthest end so far.

    A span is shuffled once, to its block, and merged there. Only the last run of a block, and the runs that an
    earlier block reaches, can go on elsewhere; these few meet again. Spans without a key or a start are left out.
    """
    block = [*keys, "_blk"]
    dealt = spans.select(*keys, "start_ms", "end_ms", _time_block(spans).alias("_blk"))
    # dealt as the steps below need it; rows and block summaries share it, as long as joins filter nothing more below it
    dealt = dealt.where(" and ".join(f"{c} is not null" for c in block)).repartition(*block)
    one = dealt.groupBy(*block, "start_ms").agg(F.max("end_ms").alias("end_ms"))
    w = Window.partitionBy(*block).orderBy("start_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = one.withColumn("_open", F.coalesce(F.col("start_ms") > reach + touch_ms, F.lit(True)).cast("long"))
    r = r.withColumn("_run", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = r.groupBy(*block, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))

    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = runs.groupBy(*block).agg(F.max("end_ms").alias("_end"), F.max("start_ms").alias("_tail"))
    blocks = blocks.withColumn("_reach", F.max("_end").over(before))
    opens = F.coalesce(F.col("start_ms") > F.col("_reach") + touch_ms, F.lit(True))
    tail_opens = F.coalesce(F.col("_tail") > F.col("_reach") + touch_ms, F.lit(True))
    owner = F.last(F.when(tail_opens, F.col("_tail")), ignorenulls=True).over(before)
    each = runs.join(blocks.select(*block, "_tail", "_reach", owner.alias("_owner")), block)
    within = each.where(opens & (F.col("start_ms") < F.col("_tail"))).select(*keys, "start_ms", "end_ms")
    edges = each.where(~opens | (F.col("start_ms") == F.col("_tail")))
    edges = edges.withColumn("_owner", F.when(opens, F.col("start_ms")).otherwise(F.col("_owner")))
    joined = edges.groupBy(*keys, "_owner").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return within.unionByName(joined.drop("_owner"))


def merge_to_first_end(ranges: DataFrame, keys: list[str] = CLIP) -> DataFrame:
    """Merge overlapping ranges keeping the *smallest* end.

    Within one overlap run the result is a walk: a merged range starts at a member and ends at
    the least end among it and all later members, the next starts at the first member not
    before that end. The least end is a suffix minimum; the walk is folded per run.
    """
    one = ranges.groupBy(*keys, "start_ms").agg(F.min("end_ms").alias("end_ms"))
    r = scan(one, keys, ["start_ms"], {"stop": suffix_min("end_ms")}, _time_block(one))
    r = scan(r, keys, ["start_ms"], {"prev_stop": lag("stop")}, _time_block(r))
    opens = F.col("prev_stop").isNull() | (F.col("start_ms") >= F.col("prev_stop"))
    r = r.withColumn("_open", opens.cast("long"))
    r = scan(r, keys, ["start_ms"], {"run": running_sum("_open")}, _time_block(r))
    runs = r.groupBy(*keys, "run").agg(
        F.array_sort(F.collect_list(F.struct("start_ms", "stop"))).alias("rs")
    )
    kind = "array<struct<start_ms:bigint,stop:bigint>>"

    def step(acc, x):
        tail = F.element_at(acc, -1)
        return F.when(
            (F.size(acc) > 0) & (x["start_ms"] < tail["stop"]), acc
        ).otherwise(F.concat(acc, F.array(x)))

    walked = F.aggregate("rs", F.array().cast(kind), step)
    return runs.select(*keys, F.inline(walked)).withColumnRenamed("stop", "end_ms")


def uncovered(spans: DataFrame, totals: DataFrame, min_ms: int = 1000) -> DataFrame:
    """Stretches of ``[0, total_ms)`` at least ``min_ms`` long that no span covers."""
    one = spans.groupBy(*CLIP, "start_ms").agg(F.max("end_ms").alias("end_ms"))
    ends = totals.select("clip_id", F.col("total_ms").alias("start_ms")).withColumn(
        "end_ms", F.lit(None).cast("long")
    )
    both = one.withColumn("tail", F.lit(0)).unionByName(ends.withColumn("tail", F.lit(1)))
    r = scan(
        both, CLIP, ["start_ms", "tail"], {"reach": running_max("end_ms", False)}, _time_block(both)
    )
    a = F.coalesce("reach", F.lit(0).cast("long"))
    return r.where(F.col("start_ms") - a >= min_ms).select(
        "clip_id", a.alias("start_ms"), F.col("start_ms").alias("end_ms")
    )


def cut_spans(edl: DataFrame) -> DataFrame:
    """Cut entries with touching ones coalesced."""
    return coalesce_spans(edl.where("not keep").select("clip_id", "start_ms", "end_ms"))


def _span_buckets(spans: DataFrame) -> DataFrame:
    return spans.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("start_ms") / BUCKET_MS),
                F.floor(F.greatest(F.col("end_ms"), F.col("start_ms")) / BUCKET_MS),
            )
        ),
    )


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    at: Column,
    how: str,
    upper_slack_ms: int = 0,
    closed: bool = False,
) -> DataFrame:
    """Semi or anti join of points with spans of their clip: ``s <= at < e - slack`` (or
    ``<= e`` when closed). Spans are listed in every time bucket they touch, points in one."""
    s = _span_buckets(spans).select(
        F.col("clip_id").alias("_k"),
        F.col("bucket").alias("_b"),
        F.col("start_ms").alias("_s"),
        F.col("end_ms").alias("_e"),
    )
    p = points.withColumn("_at", at).withColumn("_pb", F.floor(F.col("_at") / BUCKET_MS))
    upper = (
        F.col("_at") <= F.col("_e") if closed else F.col("_at") < F.col("_e") - upper_slack_ms
    )
    cond = (
        (F.col("clip_id") == F.col("_k"))
        & (F.col("_pb") == F.col("_b"))
        & (F.col("_at") >= F.col("_s"))
        & upper
    )
    return p.join(s, cond, how).drop("_at", "_pb")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of a clip with ``l.start < r.end`` and ``l.end > r.start``; the right side's
    columns get the prefix ``r_``. A pair is produced in one bucket only, that of the later
    start."""
    lhs = _span_buckets(left)
    rhs = _span_buckets(right)
    rhs = rhs.select(*[F.col(c).alias("r_" + c) for c in rhs.columns])
    meet = F.floor(F.greatest("start_ms", "r_start_ms") / BUCKET_MS)
    return lhs.join(
        rhs,
        (F.col("clip_id") == F.col("r_clip_id"))
        & (F.col("bucket") == F.col("r_bucket"))
        & (F.col("start_ms") < F.col("r_end_ms"))
        & (F.col("end_ms") > F.col("r_start_ms"))
        & (F.col("bucket") == meet),
    ).drop("bucket", "r_bucket", "r_clip_id")


# -- cut lists ---------------------------------------------------------------------------


def split_at_spans(edl: DataFrame, spans: DataFrame, reason: str, cuts_too: bool = False) -> DataFrame:
    """Split entries at the spans' edges; pieces inside a span become cuts with ``reason``. Further columns stay.

    By default only keep entries are touched; ``cuts_too`` re-labels cut entries as well. Entries of a clip do
    not overlap, and spans are coalesced first, so one pass over entries and edges knows the entry and the span
    that each edge lies in.
    """
    edl = settle(edl)
    flat = settle(coalesce_spans(spans, 0), 0)
    cols = ["clip_id", "start_ms", "end_ms", "keep", "reason"]
    extra = [c for c in edl.columns if c not in cols]
    entry = F.struct("end_ms", "keep", "reason", *extra)
    none = F.lit(None).cast("long")
    entries = edl.select("clip_id", F.col("start_ms").alias("_t"), F.lit(2).alias("_kind"), none.alias("_to"), entry.alias("_e"))
    no_entry = F.lit(None).cast(entries.schema["_e"].dataType).alias("_e")
    edges = F.array(
        F.struct(F.col("end_ms").alias("_t"), F.lit(0).alias("_kind"), none.alias("_to")),
        F.struct(F.col("start_ms").alias("_t"), F.lit(1).alias("_kind"), F.col("end_ms").alias("_to")),
    )
    both = entries.unionByName(flat.select("clip_id", F.inline(edges)).withColumn("_e", no_entry))
    g = scan(
        both,
        CLIP,
        ["_t", "_kind"],
        {"e": last("_e"), "to": running_max("_to"), "next": lead("_t")},
        _time_block(both, "_t"),
    )
    hit = F.coalesce(F.col("_t") < F.col("to"), F.lit(False))
    split = F.lit(cuts_too) | F.col("e.keep")
    whole = (F.col("_kind") == 2) & (~split | ((F.col("e.end_ms") <= F.col("_t")) & ~hit))
    end = F.when(whole, F.col("e.end_ms")).otherwise(F.least("next", "e.end_ms"))
    inside = split & ~whole & hit
    return g.where(whole | (split & (F.col("_t") < end))).select(
        "clip_id",
        F.col("_t").alias("start_ms"),
        end.alias("end_ms"),
        (F.col("e.keep") & ~inside).alias("keep"),
        F.when(inside, reason).otherwise(F.col("e.reason")).alias("reason"),
        *[f"e.{c}" for c in extra],
    )


def apply_retakes(edl: DataFrame, ranges: DataFrame, words: DataFrame) -> DataFrame:
    """Cut the retake ranges out of the keeps. On clips that have ranges, keep fragments in which
    no word starts are cut too; ``wordless`` marks them."""
    ranges = settle(ranges)
    split = settle(split_at_spans(edl, ranges, "retake"))
    affected = ranges.select("clip_id").distinct()
    keeps = split.where("keep").join(affected, "clip_id", "left_semi")
    starts = words.select("clip_id", F.col("start_ms").alias("at"))
    b = _span_buckets(keeps)
    hits = (
        b.join(
            starts.select(
                F.col("clip_id").alias("_k"),
                F.floor(F.col("at") / BUCKET_MS).alias("_b"),
                "at",
            ),
            (F.col("clip_id") == F.col("_k"))
            & (F.col("bucket") == F.col("_b"))
            & (F.col("at") >= F.col("start_ms"))
            & (F.col("at") < F.col("end_ms")),
            "left_semi",
        )
        .select("clip_id", "start_ms", "end_ms")
        .distinct()
        .withColumn("_spoken", F.lit(True))
    )
    marked = split.join(hits, ["clip_id", "start_ms", "end_ms"], "left").join(
        affected.withColumn("_aff", F.lit(True)), "clip_id", "left"
    )
    wordless = F.coalesce(
        F.col("keep") & F.col("_aff") & F.col("_spoken").isNull(), F.lit(False)
    )
    return marked.select(
        "clip_id",
        "start_ms",
        "end_ms",
        (F.col("keep") & ~wordless).alias("keep"),
        F.when(wordless, "retake").otherwise(F.col("reason")).alias("reason"),
        wordless.alias("wordless"),
    )


def merge_cuts(edl: DataFrame) -> DataFrame:
    """Adjacent cuts become one; the first one's reason stays."""
    e = scan(
        edl,
        CLIP,
        ["start_ms", "end_ms"],
        {"prev_keep": lag("keep"), "prev_end": lag("end_ms")},
        _time_block(edl),
    )
    joined = ~F.col("keep") & ~F.col("prev_keep") & (F.col("start_ms") <= F.col("prev_end") + 1)
    e = e.withColumn("_open", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1).cast("long"))
    e = scan(e, CLIP, ["start_ms", "end_ms"], {"island": running_sum("_open")}, _time_block(e))
    return e.groupBy("clip_id", "island").agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", F.struct("start_ms", "end_ms")).alias("end_ms"),
        F.min_by("keep", F.struct("start_ms", "end_ms")).alias("keep"),
        F.min_by("reason", F.struct("start_ms", "end_ms")).alias("reason"),
    ).drop("island")


def tidy(edl: DataFrame, min_keep_ms: int) -> DataFrame:
    """Keeps shorter than ``min_keep_ms`` become noise cuts, then adjacent cuts merge."""
    short = F.col("keep") & (F.col("end_ms") - F.col("start_ms") < min_keep_ms)
    return merge_cuts(
        edl.select(
            "clip_id",
            "start_ms",
            "end_ms",
            (F.col("keep") & ~short).alias("keep"),
            F.when(short, "noise").otherwise(F.col("reason")).alias("reason"),
        )
    )


def absorb_slivers(edl: DataFrame, floor_ms: int, reason: str = "manual-cut") -> DataFrame:
    """Keeps under the floor become cuts if a cut with ``reason`` is next to them."""
    ours = ~F.col("keep") & (F.col("reason") == reason)
    e = scan(
        edl,
        CLIP,
        ["start_ms", "end_ms"],
        {"prev_ours": lag(ours), "next_ours": lead(ours)},
        _time_block(edl),
    )
    sliver = (
        F.col("keep")
        & (F.col("end_ms") - F.col("start_ms") < floor_ms)
        & (F.coalesce("prev_ours", F.lit(False)) | F.coalesce("next_ours", F.lit(False)))
    )
    return e.select(
        "clip_id",
        "start_ms",
        "end_ms",
        (F.col("keep") & ~sliver).alias("keep"),
        F.when(sliver, "sliver-absorbed").otherwise(F.col("reason")).alias("reason"),
    )


def bridge(ranges: DataFrame, gap_ms: int) -> DataFrame:
    return coalesce_spans(ranges, gap_ms)


def timeline_base(edl: DataFrame) -> DataFrame:
    """Per clip: first kept time and kept total."""
    return edl.groupBy("clip_id").agg(
        F.min(F.when(F.col("keep"), F.col("start_ms"))).alias("first_keep"),
        F.sum(F.when(F.col("keep"), F.col("end_ms") - F.col("start_ms")).otherwise(0)).alias(
            "kept_ms"
        ),
    )


def to_output_time(points: DataFrame, edl: DataFrame, at: str, out: str) -> DataFrame:
    """Source time to output time within the clip's own kept footage.

    Cuts that end by ``t`` are subtracted; a ``t`` inside a cut moves to the cut's start first.
    Both become a lookup of the latest cut starting at or before ``t``, with the removed total
    up to it, so the cost is one ordered pass over points and cuts together.
    """
    edl = settle(edl)
    asks = points.select(
        "clip_id",
        F.col(at).alias("_t"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(_CUT).alias("_cut"),
        F.struct(*points.columns).alias("_p"),
    )
    marks = edl.where("not keep").select(
        "clip_id",
        F.col("start_ms").alias("_t"),
        F.lit(0).alias("_kind"),
        F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).alias("_cut"),
        F.lit(None).cast(asks.schema["_p"].dataType).alias("_p"),
    )
    return on_output(marks.unionByName(asks), clip_facts(edl)).select("_p.*", F.col("_out").alias(out))


_CUT = "struct<s:bigint,e:bigint>"


def clip_facts(edl: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Per clip: ``first`` (first kept time) and ``lead`` (length of the cuts before it); with the columns of
    ``more``, one row per clip. Written once, since it is small and deep."""
    firsts = edl.groupBy("clip_id").agg(F.coalesce(F.min(F.when(F.col("keep"), F.col("start_ms"))), F.lit(0)).alias("first"))
    early = edl.where("not keep").join(firsts, "clip_id").where("start_ms < first")
    leads = early.groupBy("clip_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("lead"))
    facts = firsts.join(leads, "clip_id", "left").fillna(0, ["lead"])
    return settle(facts if more is None else facts.join(more, "clip_id", "full"), 0)


def on_output(rows: DataFrame, facts: DataFrame, more: dict | None = None) -> DataFrame:
    """``rows(clip_id, _t, _kind, _cut, _p)`` that hold a ``_p``, with ``_out``, the output time of ``_t``, and
    ``_f``, the clip's row of ``facts``. Cuts carry ``_cut``; ``more``: further ops of the same pass.

    What is known per clip rides along as one more row of the clip, so no row is joined by clip.
    """
    about = facts.select(
        "clip_id",
        F.lit(0).cast("long").alias("_t"),
        F.lit(-1).alias("_kind"),
        F.struct(*[c for c in facts.columns if c != "clip_id"]).alias("_f"),
    )
    cut = F.col("_cut")
    both = rows.unionByName(about, allowMissingColumns=True)
    ops = {
        "cut": last(F.when(cut.isNotNull(), cut)),
        "upto": running_sum(cut["e"] - cut["s"]),
        "_f": total("max", "_f"),
    }
    both = scan(both, CLIP, ["_t", "_kind"], ops | (more or {}), _time_block(both, "_t")).where("_p is not null")
    first = F.coalesce("_f.first", F.lit(0))
    inside = F.col("cut.s").isNotNull() & (F.col("_t") < F.col("cut.e"))
    t = F.when(inside, F.col("cut.s")).otherwise(F.col("_t"))
    gone = F.col("upto") - F.when(inside, F.col("cut.e") - F.col("cut.s")).otherwise(0) - F.coalesce("_f.lead", F.lit(0))
    value = F.greatest(F.lit(0).cast("long"), t - first - F.when(t >= first, gone).otherwise(0))
    return both.withColumn("_out", value)
