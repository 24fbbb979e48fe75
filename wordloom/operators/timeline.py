"""Output timeline: placing words, overlays and windows after cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.scan import block_ms, following, lag, last, lead, running_max, running_sum, scan, total
from wordloom.functions.settle import settle
from wordloom.operators.intervals import (
    BUCKET_MS,
    _CUT,
    CLIP,
    _span_buckets,
    _time_block,
    clip_facts,
    coalesce_spans,
    cut_spans,
    on_output,
    overlapping,
    points_in_spans,
    timeline_base,
    to_output_time,
)


def latest_mark(
    points: DataFrame, at: Column, marks: DataFrame, mark_at: str, out: str, strict: bool = False
) -> DataFrame:
    """Latest mark of the clip at or before ``at`` (before it when strict), else null."""
    p = points.select(
        "clip_id", at.alias("_t"), F.lit(0 if strict else 1).alias("_kind"),
        F.lit(None).cast("long").alias("_m"), F.struct(*points.columns).alias("_p"),
    )
    m = marks.select(
        "clip_id",
        F.col(mark_at).alias("_t"),
        F.lit(1 if strict else 0).alias("_kind"),
        F.col(mark_at).alias("_m"),
        F.lit(None).cast(p.schema["_p"].dataType).alias("_p"),
    )
    both = scan(
        p.unionByName(m), CLIP, ["_t", "_kind"], {"_last": running_max("_m")}, _time_block(p, "_t")
    )
    return both.where("_p is not null").select("_p.*", F.col("_last").alias(out))


def kept_words(words: DataFrame, edl: DataFrame) -> DataFrame:
    """Words that do not start inside a cut run (1 ms tolerance at a run's end)."""
    return points_in_spans(
        words, cut_spans(edl), F.col("start_ms"), "left_anti", upper_slack_ms=1
    )


def placed_kept(words: DataFrame, edl: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``kept_words`` with their output time, in one ordered pass over words and cuts: ``_p`` (the word),
    ``_out`` and ``_f`` (``clip_facts`` with ``more``). Cuts have a length.

    A word is in a cut run if an earlier cut reaches beyond it, or ends with it and the next one touches.
    """
    edl = settle(edl)
    asks = words.select(
        "clip_id", F.col("start_ms").alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast(_CUT).alias("_cut"), F.struct(*words.columns).alias("_p"),
    )
    marks = edl.where("not keep").select(
        "clip_id", F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"),
        F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).alias("_cut"),
        F.lit(None).cast(asks.schema["_p"].dataType).alias("_p"),
    )
    cut = F.col("_cut")
    ops = {"reach": running_max(cut["e"]), "ahead": following(F.when(cut.isNotNull(), cut))}
    r = on_output(marks.unionByName(asks), clip_facts(edl, more), ops)
    touches = (F.col("ahead.s") <= F.col("reach") + 1) & (F.col("ahead.e") > F.col("_t") + 1)
    inside = (F.col("_t") < F.col("reach") - 1) | ((F.col("_t") <= F.col("reach")) & touches)
    return r.where(~F.coalesce(inside, F.lit(False)))


def drop_covered(items: DataFrame, dropped: DataFrame) -> DataFrame:
    """Items that do not start inside a dropped interval; touching intervals act as one."""
    flat = coalesce_spans(dropped, 1)
    return points_in_spans(items, flat, F.col("start_ms"), "left_anti", upper_slack_ms=1)


def clip_bases(edl: DataFrame, clips: DataFrame) -> DataFrame:
    """Output time at which each clip of a document begins: kept time of the clips before it.
    ``clips(doc_id, clip_id, clip_no)``."""
    b = clips.join(timeline_base(edl), "clip_id", "left").withColumn(
        "kept_ms", F.coalesce("kept_ms", F.lit(0))
    )
    return scan(b, ["doc_id"], ["clip_no"], {"base_ms": running_sum("kept_ms", False)}).select(
        "doc_id", "clip_id", "base_ms"
    )


def retimed_words(words: DataFrame, edl: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Kept words on the output timeline; a word keeps its length."""
    r = placed_kept(words, edl).select("_p.*", F.col("_out").alias("out_ms"))
    if bases is not None:
        r = r.join(bases, "clip_id").withColumn("out_ms", F.col("out_ms") + F.col("base_ms"))
    return r.withColumn("out_end_ms", F.col("out_ms") + F.col("end_ms") - F.col("start_ms"))


def splice_times(edl: DataFrame) -> DataFrame:
    """Output time of every keep that follows a cut."""
    e = scan(
        edl.withColumn(
            "_kept", F.when(F.col("keep"), F.col("end_ms") - F.col("start_ms")).otherwise(0)
        ),
        CLIP,
        ["start_ms"],
        {"prev_keep": lag("keep"), "at_ms": running_sum("_kept", False)},
        _time_block(edl),
    )
    return e.where(F.col("keep") & ~F.col("prev_keep") & (F.col("at_ms") > 0)).select(
        "clip_id", "at_ms"
    )


def active_word(points: DataFrame, words: DataFrame, grace_ms: int) -> DataFrame:
    """Word on display at ``t_ms``: the latest started, hidden ``grace_ms`` after its end."""
    p = points.select(
        "clip_id", F.col("t_ms").alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast("struct<pos:bigint,end_ms:bigint>").alias("_w"),
    )
    w = words.select(
        "clip_id", F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"),
        F.struct("pos", "end_ms").alias("_w"),
    )
    both = scan(
        p.unionByName(w), CLIP, ["_t", "_kind"], {"w": last("_w")}, _time_block(p, "_t")
    ).where("_kind = 1")
    shown = F.col("_t") <= F.col("w.end_ms") + grace_ms
    return both.select("clip_id", F.col("_t").alias("t_ms"), F.when(shown, F.col("w.pos")).alias("pos"))


def caption_runs(lines: DataFrame, fps: int, grace_ms: int) -> DataFrame:
    """Frame runs: which word (and line) is highlighted from which frame to which.

    Frame ``f`` is at ``f / fps`` seconds. A word holds from the first frame at or after its start
    to the last frame before the next word's start, at most ``grace_ms`` past its end.
    """
    n = scan(
        lines, CLIP, ["pos"], {"next_start": lead("start_ms"), "stop_ms": total("max", "end_ms")}
    )
    first = F.ceil(F.col("start_ms") * fps / 1000)
    by_next = F.ceil(F.col("next_start") * fps / 1000) - 1
    by_grace = F.floor((F.col("end_ms") + grace_ms) * fps / 1000)
    by_clip = F.floor(F.col("stop_ms") * fps / 1000)
    return (
        n.select(
            "clip_id",
            "pos",
            "line",
            "slot",
            first.alias("first_frame"),
            F.least(by_next, by_grace, by_clip).alias("last_frame"),
        )
        .where("first_frame <= last_frame")
    )


def visible_overlay(cues: DataFrame) -> DataFrame:
    """The one overlay shown in each stretch between overlay edges: clip over still, anything
    over a logo, then the newest."""
    edges = (
        cues.select("clip_id", F.explode(F.array("start_ms", "end_ms")).alias("start_ms"))
        .distinct()
    )
    seg = scan(edges, CLIP, ["start_ms"], {"end_ms": lead("start_ms")}, _time_block(edges)).where(
        "end_ms is not null"
    )
    pairs = overlapping(
        seg.select("clip_id", "start_ms", "end_ms"),
        cues.select("clip_id", "pos", "kind", "start_ms", "end_ms"),
    )
    rank = F.struct(
        (F.col("r_kind") == "video").alias("a"),
        (F.col("r_kind") != "logo").alias("b"),
        F.col("r_start_ms").alias("c"),
        (-F.col("r_pos")).alias("d"),
    )
    return pairs.groupBy("clip_id", "start_ms", "end_ms").agg(
        F.max_by(F.struct("r_pos", "r_kind"), rank).alias("top")
    ).select(
        "clip_id", "start_ms", "end_ms", F.col("top.r_pos").alias("pos"), F.col("top.r_kind").alias("kind")
    )


def cut_run_summary(edl: DataFrame) -> DataFrame:
    """Consecutive cuts as one run: its edges, the sum of its pieces, distinct reasons in order."""
    e = scan(edl, CLIP, ["start_ms"], {"keeps_seen": running_sum(F.col("keep").cast("long"))}, _time_block(edl))
    runs = e.where("not keep")
    totals = runs.groupBy("clip_id", "keeps_seen").agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "start_ms").alias("end_ms"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("cut_ms"),
    )
    reasons = (
        runs.groupBy("clip_id", "keeps_seen", "reason")
        .agg(F.min("start_ms").alias("first_ms"))
        .groupBy("clip_id", "keeps_seen")
        .agg(F.array_sort(F.collect_list(F.struct("first_ms", "reason"))).alias("rs"))
    )
    return totals.join(reasons, ["clip_id", "keeps_seen"]).select(
        "clip_id",
        "start_ms",
        "end_ms",
        "cut_ms",
        F.array_join(F.transform("rs", lambda r: r["reason"]), "/").alias("reasons"),
    )


def widen_to_words(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """Cuts widened so that no edge lies inside a word."""
    key = ["clip_id", "start_ms", "end_ms"]
    edges = cuts.select(
        *key,
        F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("start_ms").alias("at")),
                          F.struct(F.lit("b").alias("side"), F.col("end_ms").alias("at")))).alias("e"),
    ).select(*key, "e.side", "e.at")
    w = _span_buckets(words.select("clip_id", "start_ms", "end_ms")).select(
        F.col("clip_id").alias("_k"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"),
        F.col("bucket").alias("_b"),
    )
    hit = edges.join(
        w,
        (F.col("clip_id") == F.col("_k"))
        & (F.floor(F.col("at") / BUCKET_MS) == F.col("_b"))
        & (F.col("_s") < F.col("at"))
        & (F.col("at") < F.col("_e")),
    )
    moved = hit.groupBy(*key).agg(
        F.min(F.when(F.col("side") == "a", F.col("_s"))).alias("to_start"),
        F.max(F.when(F.col("side") == "b", F.col("_e"))).alias("to_end"),
    )
    return cuts.join(moved, key, "left").select(
        "clip_id",
        F.col("start_ms").alias("asked_start_ms"),
        F.col("end_ms").alias("asked_end_ms"),
        F.coalesce("to_start", "start_ms").alias("start_ms"),
        F.coalesce("to_end", "end_ms").alias("end_ms"),
    )


def kept_inside(spans: DataFrame, edl: DataFrame) -> DataFrame:
    """Kept milliseconds inside each span."""
    key = ["clip_id", "start_ms", "end_ms"]
    hit = overlapping(spans.select(*key), edl.where("keep").select(*key)).groupBy(*key).agg(
        F.sum(F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")).alias("kept_ms")
    )
    return spans.select(*key).join(hit, key, "left").select(
        *key, F.coalesce("kept_ms", F.lit(0).cast("long")).alias("kept_ms")
    )


def stale_spans(spans: DataFrame, edl: DataFrame, tol_ms: int = 2) -> DataFrame:
    """Spans of which an edge no longer sits on a cut edge or a clip edge of the cut list.

    Edges of spans and of cut runs meet once, in order and by block of time: each edge of a span finds the latest
    run's edge up to its tolerance (those near a block's end stand in the next one too). Only edges that sit nowhere
    meet by span again.
    """
    keeps = edl.where("keep").groupBy("clip_id").agg(
        F.min("start_ms").alias("first_ms"), F.max_by("end_ms", "start_ms").alias("last_ms")
    )
    size, slack = block_ms(spans.sparkSession), tol_ms - 1

    def edges(df, start, end, own):
        """``_t`` and ``_kind`` of both edges: 0 and 1 where spans may start and end, 2 and 3 where they do, behind the slack."""
        kind, past = (2, slack) if own else (0, 0)
        length = F.col(end) - F.col(start)
        rows = F.array(*[
            F.struct((F.col(c) + past).alias("_t"), F.lit(kind + i).alias("_kind"), (length if own else F.lit(None).cast("long")).alias("_len"))
            for i, c in enumerate((start, end))
        ])
        return df.select("clip_id", F.inline(rows))

    # a span may start where a cut run ends and end where one starts
    marks = edges(cut_spans(edl), "end_ms", "start_ms", False).unionByName(edges(keeps, "first_ms", "last_ms", False))
    here, there = F.floor(F.col("_t") / size), F.floor((F.col("_t") + 2 * slack) / size)
    marks = marks.withColumn("_blk", F.explode(F.sequence(here, there)))
    both = marks.unionByName(edges(spans, "start_ms", "end_ms", True).withColumn("_blk", here))
    up_to = Window.partitionBy("clip_id", "_blk").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = [F.max(F.when(F.col("_kind") == k, F.col("_t"))).over(up_to) for k in (0, 1)]
    is_start, at = F.col("_kind") == 2, F.col("_t") - slack
    r = both.withColumns({"_a": found[0], "_b": found[1]}).where("_kind >= 2")
    sits = F.coalesce(F.col("_t") - F.when(is_start, F.col("_a")).otherwise(F.col("_b")) <= 2 * slack, F.lit(False))
    lost = r.where(~sits).select(
        "clip_id",
        F.when(is_start, at).otherwise(at - F.col("_len")).alias("start_ms"),
        F.when(is_start, at + F.col("_len")).otherwise(at).alias("end_ms"),
        is_start.cast("long").alias("_start"),
    )
    # a span may have lost both; equal spans are lost alike
    times = F.greatest(F.sum("_start"), F.sum(1 - F.col("_start"))).cast("int")
    n = lost.groupBy("clip_id", "start_ms", "end_ms").agg(times.alias("_n"))
    return n.select("clip_id", F.inline(F.array_repeat(F.struct("start_ms", "end_ms"), F.col("_n"))))


def clamp_to_hook(cues: DataFrame, hook_end: DataFrame) -> DataFrame:
    """Overlays that start inside the hook end with it; those under 50 ms go."""
    c = cues.join(hook_end, "clip_id")
    end = F.when(F.col("start_ms") < F.col("hook_end_ms"), F.least("end_ms", "hook_end_ms")).otherwise(
        F.col("end_ms")
    )
    return c.withColumn("end_ms", end).where(F.col("end_ms") - F.col("start_ms") >= 50).drop("hook_end_ms")


def shrink_report(cues: DataFrame, edl: DataFrame) -> DataFrame:
    """Overlays that lose a tenth or more of their length to cuts; 10 ms or less is dropped."""
    a = to_output_time(cues, edl, "start_ms", "out_start_ms")
    b = to_output_time(a, edl, "end_ms", "out_end_ms")
    was = F.col("end_ms") - F.col("start_ms")
    now = F.col("out_end_ms") - F.col("out_start_ms")
    return b.where(now * 10 < was * 9).select(
        "clip_id", "pos", was.alias("was_ms"), now.alias("now_ms"), (now <= 10).alias("dropped")
    )


def snap_windows(hooks: DataFrame, words: DataFrame, edl: DataFrame, max_lead_ms: int = 1000) -> DataFrame:
    """Hook edges moved back to the seam just before them, unless a word starts in between."""
    seams = to_output_time(
        edl.where("keep").select("clip_id", "start_ms"), edl, "start_ms", "seam_ms"
    )
    heard = to_output_time(words.select("clip_id", "start_ms"), edl, "start_ms", "word_ms")
    edges = hooks.select(
        "clip_id",
        "hook",
        F.explode(
            F.array(
                F.struct(F.lit("start").alias("side"), F.col("start_ms").alias("t")),
                F.struct(F.lit("end").alias("side"), F.col("end_ms").alias("t")),
            )
        ).alias("e"),
    ).select("clip_id", "hook", "e.side", "e.t")
    e = latest_mark(edges, F.col("t") + 1, seams, "seam_ms", "seam")
    e = latest_mark(e, F.col("t") - 1, heard, "word_ms", "heard", strict=True)
    usable = (F.col("seam") >= F.col("t") - max_lead_ms) & ~F.coalesce(
        F.col("heard") > F.col("seam") + 1, F.lit(False)
    )
    snapped = F.when(F.coalesce(usable, F.lit(False)), F.least("seam", "t")).otherwise(F.col("t"))
    return e.groupBy("clip_id", "hook").agg(
        F.max(F.when(F.col("side") == "start", snapped)).alias("start_ms"),
        F.max(F.when(F.col("side") == "end", snapped)).alias("end_ms"),
    )


def hook_facts(hooks: DataFrame) -> DataFrame:
    """Per clip: the hooks' ``starts``, where the body begins (``body_ms``) and their numbers (``targets``)."""
    return hooks.groupBy("clip_id").agg(
        F.sort_array(F.collect_set("start_ms")).alias("starts"),
        F.max_by("end_ms", "hook").alias("body_ms"),
        F.sort_array(F.collect_list("hook")).alias("targets"),
    )


def section_at(at: Column, starts: Column, body_ms: Column) -> Column:
    """The hook that an output time lies in, by its place among the ``starts``; -1 is the body."""
    inner = F.greatest(F.size(F.filter(starts, lambda s: s <= at)) - 1, F.lit(0))
    return F.when(at >= body_ms, -1).otherwise(inner).cast("long")


def hook_pieces(edl: DataFrame, hooks: DataFrame) -> DataFrame:
    """Entries with keeps split at hook edges and their section (-1 is the body, null a cut), and the clip's ``targets``.

    A clip has a handful of hooks, so their edges ride along as one short array per clip.
    """
    edl = settle(edl)
    span = F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    entry = F.struct("end_ms", "keep", "reason")
    rows = edl.select(
        "clip_id", F.col("start_ms").alias("_t"), F.col("keep").cast("int").alias("_kind"),
        F.when(~F.col("keep"), span).alias("_cut"), entry.alias("_p"),
    )
    k = on_output(rows, clip_facts(edl, hook_facts(hooks))).where("_f.body_ms is not null").select(
        "clip_id", F.col("_t").alias("start_ms"), "_p.*", F.col("_out").alias("o_start"), "_f.starts", "_f.body_ms", "_f.targets"
    )
    k = k.withColumn("o_end", F.col("o_start") + F.col("end_ms") - F.col("start_ms"))
    inner = F.filter(
        F.array_distinct(F.array_append("starts", F.col("body_ms"))),
        lambda b: F.col("keep") & (b > F.col("o_start") + 1) & (b < F.col("o_end") - 1),
    )
    cutpoints = F.concat(F.array("o_start"), F.array_sort(inner), F.array("o_end"))
    k = k.withColumn("_pts", cutpoints)
    pieces = k.select(
        "*",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("_pts") - 2),
                lambda i: F.struct(
                    F.get("_pts", i).alias("lo"), F.get("_pts", i + 1).alias("hi")
                ),
            )
        ).alias("p"),
    )
    shift = F.col("start_ms") - F.col("o_start")
    return pieces.select(
        "clip_id",
        (F.col("p.lo") + shift).alias("start_ms"),
        (F.col("p.hi") + shift).alias("end_ms"),
        "keep",
        "reason",
        F.when(F.col("keep"), section_at(F.col("p.lo"), F.col("starts"), F.col("body_ms"))).alias("section"),
        "targets",
    )


def hook_edl(edl: DataFrame, hooks: DataFrame) -> DataFrame:
    """One cut list per (clip, target hook): other hooks become ``outtake`` cuts."""
    pieces = hook_pieces(edl, hooks)
    p = pieces.withColumn("target", F.explode("targets"))
    out = F.col("keep") & (F.col("section") != -1) & (F.col("section") != F.col("target"))
    return p.select(
        "clip_id",
        "target",
        "start_ms",
        "end_ms",
        (F.col("keep") & ~out).alias("keep"),
        F.when(out, "outtake").otherwise(F.col("reason")).alias("reason"),
        "section",
    )


def trim_variants(edl: DataFrame, hooks: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut lists of (clip, target hook) as in ``hook_edl``, with ``spans(clip_id, start_ms, end_ms)`` flipped to ``trim``
    cuts in each.

    The variants share their pieces, so these are split once; an ``outtake`` is a cut and stays whole.
    """
    from wordloom.operators.intervals import split_at_spans

    pieces = settle(hook_pieces(edl, hooks), 0)
    own = F.filter("targets", lambda t: F.coalesce(F.col("section").isin(-1) | (F.col("section") == t), F.lit(True)))
    others = F.filter("targets", lambda t: t != F.col("section"))
    span = ["start_ms", "end_ms"]
    split = split_at_spans(pieces, spans, "trim").select("clip_id", F.explode(own).alias("target"), *span, "keep", "reason")
    outtakes = pieces.where("section <> -1").select(
        "clip_id", F.explode(others).alias("target"), *span, F.lit(False).alias("keep"), F.lit("outtake").alias("reason")
    )
    return split.unionByName(outtakes)


def gap_fates(gaps: DataFrame, words: DataFrame, edl: DataFrame, pause_ms: int, floor_ms: int, pad_ms: int) -> DataFrame:
    """Why each gap was cut or kept, read back from the cut list."""
    from wordloom.operators.words import sentence_boundaries

    g = gaps.join(
        sentence_boundaries(words, pause_ms).select("clip_id", "pos", "boundary_clause"),
        ["clip_id", "pos"],
    )
    spans = g.select(
        "clip_id", "pos", F.col("effective_start").alias("start_ms"), "end_ms"
    )
    hit = (
        overlapping(spans, edl.where("not keep").select("clip_id", "start_ms", "end_ms"))
        .groupBy("clip_id", "pos")
        .agg(F.min("r_start_ms").alias("cut_start"))
    )
    g = g.join(hit, ["clip_id", "pos"], "left")
    room = F.col("speech_onset") - pad_ms - F.col("speech_end")
    fate = (
        F.when(~F.col("cut"), F.concat(F.lit("kept: "), "skip_reason"))
        .when(
            F.col("cut_start").isNull()
            & ~(F.col("boundary_clause") | (F.col("duration_ms") >= floor_ms)),
            "kept: mid_sentence_floor",
        )
        .when(F.col("cut_start").isNull(), "kept: no_room")
        .when(F.abs(F.col("cut_start") - F.col("speech_end")) > 5, "cut: min_keep_floor")
        .otherwise("cut")
    )
    return g.select("clip_id", "pos", "gap_type", "duration_ms", fate.alias("fate"), room.alias("room_ms"))


def place_zooms(spans: DataFrame, ramp_in: int, ramp_out: int, min_ms: int = 500) -> DataFrame:
    """Placed spans one after another: each starts no earlier than the kept one before ended, those
    left under ``min_ms`` go, and ramps that do not fit share the length.

    Only spans that overlap a chain of earlier ones need the carried end, so the fold runs per
    overlap run.
    """
    r = scan(spans, CLIP, ["start_ms", "end_ms"], {"reach": running_max("end_ms", False)}, _time_block(spans))
    opens = F.col("reach").isNull() | (F.col("start_ms") >= F.col("reach"))
    r = r.withColumn("_open", opens.cast("long"))
    r = scan(r, CLIP, ["start_ms", "end_ms"], {"run": running_sum("_open")}, _time_block(r))
    packed = r.groupBy("clip_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("xs")
    )

    def step(acc, x):
        a = F.greatest(x["start_ms"], F.coalesce(F.try_element_at(acc, F.lit(-1))["end_ms"], x["start_ms"]))
        return F.when(x["end_ms"] - a < min_ms, acc).otherwise(
            F.concat(acc, F.array(F.struct(a.alias("start_ms"), x["end_ms"].alias("end_ms"))))
        )

    zero = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")
    placed = packed.select("clip_id", F.inline(F.aggregate("xs", zero, step)))
    length = F.col("end_ms") - F.col("start_ms")
    tight = length < ramp_in + ramp_out
    full = F.when(tight, F.floor(length * ramp_in / (ramp_in + ramp_out))).otherwise(ramp_in)
    release = F.when(tight, F.floor(length * ramp_in / (ramp_in + ramp_out))).otherwise(length - ramp_out)
    return placed.select(
        "clip_id",
        "start_ms",
        (F.col("start_ms") + full).cast("long").alias("full_ms"),
        (F.col("start_ms") + release).cast("long").alias("release_ms"),
        "end_ms",
    )
