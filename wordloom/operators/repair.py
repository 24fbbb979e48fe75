"""Transcript repair: suspicious windows, second-pass reconcile, spoken numbers, monotonic times."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import text as tx
from wordloom.functions.scan import (
    block_rows,
    following,
    last,
    neighbours,
    running_max,
    running_sum,
    scan,
    total,
)
from wordloom.functions.settle import settle
from wordloom.functions.strips import list_parts
from wordloom.operators.intervals import CLIP, _time_block
from wordloom.operators.timeline import latest_mark
from wordloom.operators.words import sentence_boundaries, with_next


def raw_windows(
    words: DataFrame, wide_ms: int, low: float, low_gap_ms: int, large_gap_ms: int, reach_gap_ms: int
) -> DataFrame:
    """Windows worth hearing again, with the words they start and end on: overlong words,
    low-confidence runs before a gap, large gaps inside a sentence, single low-confidence words
    (reaching back over a gap before them)."""
    w = with_next(words)
    w = neighbours(w, CLIP, "pos", {"prev_start": ("start_ms", -1), "prev_end": ("end_ms", -1)})
    w = w.withColumn("is_low", F.col("confidence") < low)
    w = settle(scan(w, CLIP, ["pos"], {"high_seen": running_sum((~F.col("is_low")).cast("long"))}), 0)

    def window(df, a, b, ap, ep, label):
        return df.select(
            "clip_id", a.alias("start_ms"), b.alias("end_ms"), ap.alias("first_pos"), ep.alias("last_pos"), F.lit(label).alias("label")
        )

    c = F.col
    wide = window(w.where(c("end_ms") - c("start_ms") >= wide_ms), c("start_ms"), c("end_ms"), c("pos"), c("pos"), "wide")
    runs = w.where("is_low").groupBy("clip_id", "high_seen").agg(
        F.min("pos").alias("a"), F.max("pos").alias("b"), F.min("start_ms").alias("s"),
        F.max_by("next_start", "pos").alias("e"), F.max_by("gap_ms", "pos").alias("g"),
    )
    low_runs = window(runs.where(c("g") >= low_gap_ms), c("s"), c("e"), c("a"), c("b"), "low_conf")
    mid = (c("gap_ms") >= large_gap_ms) & ~c("word").rlike(tx.TERMINAL)
    gaps = window(w.where(mid), c("end_ms"), c("next_start"), c("pos") + 1, c("pos"), "large_gap")
    back = F.coalesce(c("start_ms") - c("prev_end") >= reach_gap_ms, F.lit(False))
    single = window(
        w.where("is_low"), F.when(back, c("prev_start")).otherwise(c("start_ms")), c("end_ms"),
        F.when(back, c("pos") - 1).otherwise(c("pos")), c("pos"), "low_conf_word",
    )
    return wide.unionByName(low_runs).unionByName(gaps).unionByName(single)


def expand_to_sentences(windows: DataFrame, words: DataFrame, pause_ms: int, cap_ms: int = 20_000) -> DataFrame:
    """Windows grown to the enclosing sentence, at most ``cap_ms`` long and never ending inside a
    word when capped."""
    b = sentence_boundaries(words, pause_ms)
    b = neighbours(b, CLIP, "pos", {"prev_boundary": ("boundary", -1)})
    opens = tx.starts_upper(F.col("word")) & F.coalesce(F.col("prev_boundary"), F.col("pos") == 0)
    b = scan(
        b,
        CLIP,
        ["pos"],
        {
            "open_ms": last(F.when(opens, F.col("start_ms"))),
            "close": following(F.when(F.col("word").rlike(tx.TERMINAL), F.struct("pos", "start_ms", "end_ms"))),
            "tail_ms": total("max", "end_ms"),
        },
    )
    b = settle(b.select("clip_id", "pos", "start_ms", "end_ms", "open_ms", "close", "tail_ms"), 0)
    at_first = b.select("clip_id", F.col("pos").alias("first_pos"), F.coalesce("open_ms", "start_ms").alias("origin"))
    at_last = b.select("clip_id", F.col("pos").alias("last_pos"), F.col("start_ms").alias("anchor_ms"), "close", "tail_ms")
    w = windows.join(at_first, ["clip_id", "first_pos"]).join(at_last, ["clip_id", "last_pos"])
    # last word starting within the cap of the sentence's first word
    w = latest_mark(w, F.col("origin") + cap_ms, b, "start_ms", "within", strict=True)
    w = w.withColumn("within", F.greatest("within", "anchor_ms"))
    ends = b.select("clip_id", F.col("start_ms").alias("within"), F.col("end_ms").alias("within_end"))
    w = w.join(ends, ["clip_id", "within"])
    beyond = F.col("close").isNull() | (F.col("close.start_ms") > F.col("within"))
    next_word_splits = F.col("within_end") < F.col("tail_ms")
    # the word that reaches the cap may itself be terminal, which closes the sentence on it
    sent_end = F.when(~beyond, F.col("close.end_ms")).otherwise(
        F.when(next_word_splits, F.col("within_end")).otherwise(F.col("tail_ms"))
    )
    w = w.withColumn("a", F.least("origin", "start_ms")).withColumn("natural", F.greatest(sent_end, F.col("end_ms")))
    w = w.withColumn("capped", F.col("natural") > F.col("a") + cap_ms).withColumn("z", F.least(F.col("natural"), F.col("a") + cap_ms))
    w = latest_mark(w, F.col("z"), b, "end_ms", "fit")
    z = F.when(F.col("capped") & (F.col("fit") > F.col("a")), F.col("fit")).otherwise(F.col("z"))
    return w.select("clip_id", F.col("a").alias("start_ms"), z.alias("end_ms"), "label", "capped")


def merge_labelled(windows: DataFrame, gap_ms: int) -> DataFrame:
    """Windows at most ``gap_ms`` apart as one; labels joined by + in order of first appearance,
    unless already part of the text. Only a label's first appearance in a window can add to it, so
    the fold is over the few distinct labels."""
    order = ["start_ms", "end_ms", "label"]
    one = windows.groupBy("clip_id", *order).agg(F.count("*").alias("times"))
    r = scan(one, CLIP, order, {"reach": running_max("end_ms", False)}, _time_block(one))
    opens = F.col("reach").isNull() | (F.col("start_ms") > F.col("reach") + gap_ms)
    r = r.withColumn("_open", opens.cast("long"))
    r = settle(scan(r, CLIP, order, {"island": running_sum("_open")}, _time_block(r)), 0)
    spans = r.groupBy("clip_id", "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("times").alias("n")
    )
    firsts = r.groupBy("clip_id", "island", "label").agg(F.min(F.struct(*order)).alias("o"))
    labels = firsts.groupBy("clip_id", "island").agg(F.array_sort(F.collect_list("o")).alias("os"))
    text = F.aggregate(
        F.transform("os", lambda o: o["label"]),
        F.lit(""),
        lambda acc, l: F.when(acc == "", l).when(F.contains(acc, l), acc).otherwise(F.concat(acc, F.lit("+"), l)),
    )
    return spans.join(labels, ["clip_id", "island"]).select(
        "clip_id", "start_ms", "end_ms", text.alias("label"), F.col("n").alias("n")
    )


# -- second pass ------------------------------------------------------------------------------


def reconcile_second_pass(
    found: DataFrame, original: DataFrame, floor: float, rescue: float = 0.05, margin: float = 0.20, restore: float = 0.85
) -> DataFrame:
    """Second-pass words per window, kept, rescued, reverted or restored against the first pass.

    ``found`` and ``original``: clip_id, window, start_ms, end_ms, word, confidence; ``found`` also
    carries the window's end. Only the word alignment needs Python; windows are seconds long, so
    their words travel as short arrays, one row per window.
    """
    key = ["clip_id", "window"]
    o = original.withColumn("low_word", F.lower("word"))
    agreed = (
        o.where(F.col("confidence") >= rescue)
        .groupBy(*key, "low_word")
        .agg(F.max_by(F.struct("word", "confidence"), "start_ms").alias("orig"))
    )
    f = found.where(F.col("start_ms") < F.col("window_end")).withColumn("low_word", F.lower("word"))
    f = f.join(agreed, [*key, "low_word"], "left")
    strong = F.col("confidence") >= floor
    kept = f.where(strong | F.col("orig").isNotNull()).select(
        *key, "start_ms", "end_ms",
        F.when(strong, F.col("word")).otherwise(F.col("orig.word")).alias("word"),
        F.when(strong, F.col("confidence")).otherwise(F.col("orig.confidence")).alias("confidence"),
        F.when(strong, "kept").otherwise("rescued").alias("how"),
    )
    kept = settle(kept, 0)
    pair_cols = [*key, "start_ms", "end_ms", "word", "confidence"]

    def packed(df, name):
        extra = ["how"] if "how" in df.columns else []
        item = F.struct("start_ms", "end_ms", tx.strip_edges(F.col("word")).alias("core"), "word", "confidence", *extra)
        return df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias(name))

    def cores(name):
        return F.coalesce(F.transform(name, lambda w: w["core"]), F.array().cast("array<string>"))

    both = packed(kept, "k").join(packed(original, "o"), key, "left")
    both = both.withColumn("mates", word_mates(cores("k"), cores("o")))
    one = both.select(*key, "o", "mates", F.posexplode("k").alias("n", "w"))
    mate = F.get("o", F.get("mates", F.col("n")))
    drop = F.coalesce(mate["confidence"] - F.col("w.confidence") >= margin, F.lit(False))
    reverted = one.select(
        *key, "w.start_ms", "w.end_ms",
        F.when(drop, mate["word"]).otherwise(F.col("w.word")).alias("word"),
        F.when(drop, mate["confidence"]).otherwise(F.col("w.confidence")).alias("confidence"),
        F.when(drop, "reverted").otherwise(F.col("w.how")).alias("how"),
    )
    spans = kept.select(*key, F.col("start_ms").alias("ks"), F.col("end_ms").alias("ke"))
    ends = found.groupBy(*key).agg(F.max("window_end").alias("window_end"))
    sure = original.join(ends, key).where((F.col("confidence") >= restore) & (F.col("start_ms") < F.col("window_end")))
    back = sure.join(
        spans,
        (sure.clip_id == spans.clip_id) & (sure.window == spans.window) & (F.col("ks") < F.col("end_ms")) & (F.col("start_ms") < F.col("ke")),
        "left_anti",
    ).select(*pair_cols, F.lit("restored").alias("how"))
    return reverted.unionByName(back)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def word_mates(kept: pd.Series, first: pd.Series) -> pd.Series:
    """For each kept word the index of the first-pass word it lines up with, or null: equal runs
    pair off, a replaced run does when both sides are equally long."""
    out = []
    for a, b in zip(kept, first):
        mates: list[int | None] = [None] * len(a)
        for tag, a0, a1, b0, b1 in difflib.SequenceMatcher(a=list(a), b=list(b), autojunk=False).get_opcodes():
            if tag == "equal" or (tag == "replace" and a1 - a0 == b1 - b0):
                mates[a0:a1] = range(b0, b1)
        out.append(mates)
    return pd.Series(out)


# -- spoken numbers ------------------------------------------------------------------------------

# English number words.
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
    "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def _below_thousand(n: Column) -> Column:
    ones, tens = F.array(*[F.lit(x) for x in ONES]), F.array(*[F.lit(x) for x in TENS])
    h, r = F.floor(n / 100), n % 100
    small = F.when(r < 20, F.get(ones, r.cast("int"))).otherwise(
        F.concat_ws(" ", F.get(tens, F.floor(r / 10).cast("int")), F.when(r % 10 > 0, F.get(ones, (r % 10).cast("int"))))
    )
    return F.concat_ws(
        " ", F.when(h > 0, F.concat(F.get(ones, h.cast("int")), F.lit(" hundred"))), F.when((r > 0) | (n == 0), small)
    )


def spoken_tokens(word: Column) -> Column:
    """Tokens as spoken: numbers up to 999 999 in words, anything else unchanged."""
    core = F.rtrim(F.ltrim(F.trim(word), F.lit("-")), F.lit(".,!?;:\"'"))
    # without leading zeros, the length tells the size: a number may have any number of digits
    digits = F.when(core.rlike("^[0-9]+$"), F.regexp_replace(core, "^0+(?=.)", ""))
    n = F.when(F.char_length(digits) <= 6, digits.cast("long"))
    thousands, rest = F.floor(n / 1000), n % 1000
    # both halves through one lambda: the expression is large and is generated once
    halves = F.transform(F.array(thousands, rest), _below_thousand)
    text = F.when(
        n.isNotNull(),
        F.concat_ws(
            " ",
            F.when(thousands > 0, F.concat(F.get(halves, F.lit(0)), F.lit(" thousand"))),
            F.when((rest > 0) | (n == 0), F.get(halves, F.lit(1))),
        ),
    ).otherwise(digits)
    number = F.when(digits.isNotNull(), F.split(text, " ")).otherwise(F.array(word))
    return F.when(word.rlike("[0-9]"), number).otherwise(F.array(word))


def expand_spoken(words: DataFrame) -> DataFrame:
    """One row per spoken token; a number's time is shared out evenly."""
    t = words.withColumn("tokens", spoken_tokens(F.col("word"))).withColumn("n", F.size("tokens"))
    t = t.select("clip_id", "pos", "start_ms", "end_ms", "n", F.posexplode("tokens").alias("k", "token"))
    step = (F.col("end_ms") - F.col("start_ms")) / F.col("n")
    return t.select(
        "clip_id", "pos", F.col("k").cast("long").alias("k"), "token",
        F.floor(F.col("start_ms") + F.col("k") * step).alias("start_ms"),
        F.floor(F.col("start_ms") + (F.col("k") + 1) * step).alias("end_ms"),
    )


# -- monotonic times -------------------------------------------------------------------------------


def enforce_order(words: DataFrame) -> DataFrame:
    """Aligned words (``start_ms, end_ms``) that start before the one before ends fall back to their
    original times (``o_start, o_end``), and so do earlier ones still ahead of the fallback.

    A word whose aligned and original starts both lie past everything before it can neither be
    moved by earlier words nor reach back over them, so the walk runs between such words. Most
    stretches are a single word and skip it.
    """
    w = words.withColumn("_far", F.greatest("end_ms", "o_end"))
    w = scan(w, CLIP, ["pos"], {"reach": running_max("_far", False)})
    opens = F.col("reach").isNull() | (F.least("start_ms", "o_start") >= F.col("reach"))
    w = settle(scan(w.withColumn("_open", opens.cast("long")), CLIP, ["pos"], {"run": running_sum("_open")}), 0)
    packed = w.groupBy("clip_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "start_ms", "end_ms", "o_start", "o_end"))).alias("ws")
    )

    def item(pos, s, e, os, oe, fell):
        return F.struct(pos.alias("pos"), s.alias("s"), e.alias("e"), os.alias("os"), oe.alias("oe"), fell.alias("fell"))

    def step(acc, x):
        prev = F.try_element_at(acc, F.lit(-1))
        falls = F.coalesce(x["start_ms"] < prev["e"], F.lit(False))
        settled = F.array_position(F.transform(F.reverse(acc), lambda p: p["e"] <= x["o_start"]), True)
        back = F.when(settled > 0, settled - 1).otherwise(F.size(acc)).cast("int")
        keep = F.size(acc) - back
        reset = F.transform(
            F.slice(acc, keep + 1, back), lambda p: item(p["pos"], p["os"], p["oe"], p["os"], p["oe"], F.lit(True))
        )
        own = item(x["pos"], x["start_ms"], x["end_ms"], x["o_start"], x["o_end"], F.lit(False))
        fallen = item(x["pos"], x["o_start"], x["o_end"], x["o_start"], x["o_end"], F.lit(True))
        return F.when(falls, F.concat(F.slice(acc, F.lit(1), keep), reset, F.array(fallen))).otherwise(
            F.concat(acc, F.array(own))
        )

    kind = "array<struct<pos:bigint,s:bigint,e:bigint,os:bigint,oe:bigint,fell:boolean>>"
    out = packed.select("clip_id", F.inline(F.aggregate("ws", F.array().cast(kind), step)))
    return out.select("clip_id", "pos", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), F.col("fell").alias("reverted"))


# -- spoken tokens back to words ---------------------------------------------------------------------

_PLACES = 16  # tokens of a spoken number: nine at most


@F.pandas_udf(T.ArrayType(T.LongType()))
def _matched(tokens: pd.Series, heard: pd.Series) -> pd.Series:
    """For each of ``heard``, taken in order, the index of the first later token equal to it; ends at the first without one."""
    out = []
    for expected, said in zip(tokens, heard, strict=True):
        found: list[int] = []
        said = [] if said is None else list(said)
        for i, token in enumerate([] if expected is None else expected):
            if len(found) < len(said) and said[len(found)] == token:
                found.append(i)
        out.append(found)
    return pd.Series(out)


def _in_order(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("norm").alias("norm"))))
    return rows.groupBy(*keys).agg(packed.alias(name))


def _pairs(both: DataFrame, keys: list[str]) -> DataFrame:
    """The matched (i, j) of packed tokens ``es`` and heard tokens ``hs``, and which heard one ended a stretch."""
    found = both.withColumn("m", _matched(F.col("es.norm"), F.col("hs.norm")))
    return found.select(
        *keys,
        F.transform("m", lambda x, k: F.struct(F.get("es", x.cast("int"))["at"].alias("i"), F.get("hs", k)["at"].alias("j"))).alias("pairs"),
        F.get("hs", F.size("m"))["at"].alias("stopped"),
        F.element_at("hs", -1)["at"].alias("last_heard"),
    )


def match_heard(expected: DataFrame, heard: DataFrame) -> DataFrame:
    """(clip_id, i, j): ``heard`` (clip_id, j, norm) taken in order, each at the first equal token of ``expected``
    (clip_id, i, norm) behind the one before; from a heard token that has none on, nothing is matched.

    A heard token that occurs once in its clip can be matched there only, so the walk runs between such
    tokens, each stretch by itself. The first stretch that cannot place a token ends the matches: its
    own remaining tokens are looked for in what follows, and the next single token then has no place.
    A clip without single tokens is one stretch.
    """
    single = expected.groupBy("clip_id", "norm").agg(F.min("i").alias("i"), F.count("*").alias("n")).where("n = 1").drop("n")
    h = heard.join(single, ["clip_id", "norm"], "left").select("clip_id", "j", "norm", "i")
    h = scan(h, CLIP, ["j"], {"before": running_max("i", False)})
    h = scan(h.withColumn("_bad", F.when(F.col("i") <= F.col("before"), F.col("j"))), CLIP, ["j"], {"bad": total("min", "_bad")})
    h = h.where("bad is null or j < bad").withColumn("_one", F.col("i").isNotNull().cast("long"))
    h = settle(scan(h, CLIP, ["j"], {"part": running_sum("_one")}), 0)
    marks = h.where("i is not null").select("clip_id", "i", F.lit(1).cast("long").alias("_one"))
    e = expected.select("clip_id", "i", "norm").join(marks, ["clip_id", "i"], "left").fillna(0, ["_one"])
    e = settle(scan(e, CLIP, ["i"], {"part": running_sum("_one")}), 0)
    keys = ["clip_id", "part"]
    walked = settle(_pairs(_in_order(h, keys, "j", "hs").join(_in_order(e, keys, "i", "es"), keys, "left"), keys), 0)
    ended = walked.where("stopped is not null").groupBy("clip_id").agg(
        F.min_by(F.struct("part", "stopped", "last_heard"), "part").alias("x")
    ).select("clip_id", F.col("x.part").alias("end_part"), "x.stopped", "x.last_heard")
    kept = walked.join(ended.select("clip_id", "end_part"), "clip_id", "left").where("end_part is null or part <= end_part")
    # what the ended stretch still had to place, among the equal tokens of what follows
    rest = h.join(ended, "clip_id").where("part = end_part and j between stopped and last_heard").select("clip_id", "j", "norm")
    wanted = rest.select("clip_id", "norm").distinct()
    behind = e.join(ended.select("clip_id", "end_part"), "clip_id").where("part > end_part").join(wanted, ["clip_id", "norm"], "left_semi")
    later = _pairs(_in_order(rest, CLIP, "j", "hs").join(_in_order(behind, CLIP, "i", "es"), CLIP), CLIP)
    return kept.select("clip_id", F.inline("pairs")).union(later.select("clip_id", F.inline("pairs")))


_TIMES = T.StructType().add("s", "long").add("e", "long").add("c", "double")


@F.arrow_udf(T.ArrayType(_TIMES))
def _walked(words: pa.Array, said: pa.Array, starts: pa.Array, ends: pa.Array, confs: pa.Array) -> pa.Array:
    """Per clip, for each word (a list of tokens): start, end and mean confidence of the heard tokens matched to it by
    one pointer over ``said``, or null."""
    at, parts = list_parts(words)
    tokens_at, tokens = list_parts(parts)
    heard_at, heard = list_parts(said)
    codes = pa.concat_arrays([tokens, heard]).dictionary_encode().indices
    codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
    want = codes[: len(tokens)].tolist()
    got = np.where(codes < 0, -2, codes)[len(tokens) :].tolist()
    first, bounds = [], tokens_at.tolist()
    after = np.empty(len(words), np.int64)
    for row in range(len(words)):
        r, stop = int(heard_at[row]), int(heard_at[row + 1])
        for w in range(int(at[row]), int(at[row + 1])):
            first.append(r)
            for k in range(bounds[w], bounds[w + 1]):
                if r < stop and got[r] == want[k]:
                    r += 1
        after[row] = r
    begin = np.array(first, np.int64)
    upto = np.append(begin[1:], 0) if len(begin) else begin
    filled = np.diff(at) > 0
    upto[at[1:][filled] - 1] = after[filled]
    n = upto - begin
    hit = n > 0
    s, e, c = (list_parts(x)[1].to_numpy(zero_copy_only=False) for x in (starts, ends, confs))
    value = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n))
    if hit.any():
        value[0][hit], value[1][hit] = s[begin[hit]], e[upto[hit] - 1]
        # the matched tokens of a clip follow each other, so a word's are one stretch of them
        taken = np.concatenate([c[heard_at[i] : after[i]] for i in np.flatnonzero(filled)])
        value[2][hit] = np.add.reduceat(taken, np.cumsum(n[hit]) - n[hit]) / n[hit]
    found = pa.StructArray.from_arrays([pa.array(v) for v in value], _TIMES.names, mask=pa.array(~hit))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), found)


def _with_found(words: DataFrame, aligned: DataFrame, long: DataFrame | None) -> DataFrame:
    """``words`` with ``found``: start, end and mean confidence of the tokens matched to each.

    A clip within one block of words (and of ``_PLACES`` times as many heard tokens) is one row and one walk; longer
    ones are matched by stretches.
    """
    size = block_rows(words.sparkSession)
    w_in, a_in = F.col("pos").between(0, size - 1), F.col("j").between(0, _PLACES * size - 1)
    if long is None:
        long = words.where(~w_in).select("clip_id").union(aligned.where(~a_in).select("clip_id"))
    long = settle(long.distinct(), 0)
    some_long = not long.isEmpty()

    def short(df):
        return df.join(long, "clip_id", "left_anti") if some_long else df

    norms = F.transform(spoken_tokens(F.col("word")), tx.strip_tail)
    w = short(words.where(w_in)).groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word", "start_ms", "end_ms", "conf", norms.alias("norms")))).alias("ws")
    )
    a = short(aligned.where(a_in)).groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("j", tx.strip_tail(F.col("token")).alias("norm"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("conf").alias("c")))).alias("hs")
    )
    walk = _walked("ws.norms", "hs.norm", "hs.s", "hs.e", "hs.c")
    each = w.join(a, "clip_id", "left").select("clip_id", "ws", walk.alias("found"))
    cols = ["clip_id", "pos", "word", "start_ms", "end_ms", "conf", "found", "number"]
    each = each.select("clip_id", F.inline(F.arrays_zip("ws", "found"))).select("clip_id", "ws.*", "found")
    each = each.withColumn("number", F.size("norms") > 1).select(*cols)
    if not some_long:
        return each
    words, aligned = words.join(long, "clip_id", "left_semi"), aligned.join(long, "clip_id", "left_semi")
    tokens = words.select("clip_id", "pos", F.posexplode(spoken_tokens(F.col("word"))).alias("k", "token"))
    tokens = tokens.select("clip_id", (F.col("pos") * _PLACES + F.col("k")).alias("i"), tx.strip_tail(F.col("token")).alias("norm"))
    heard = aligned.select("clip_id", "j", tx.strip_tail(F.col("token")).alias("norm"))
    times = aligned.select("clip_id", "j", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("conf").alias("c"))
    found = (
        match_heard(tokens, heard)
        .join(times, ["clip_id", "j"])
        .groupBy("clip_id", F.floor(F.col("i") / _PLACES).alias("pos"))
        .agg(F.struct(F.min_by("s", "j").alias("s"), F.max_by("e", "j").alias("e"), F.avg("c").alias("c")).alias("found"))
    )
    rest = words.join(found, ["clip_id", "pos"], "left").withColumn("number", F.size(spoken_tokens(F.col("word"))) > 1)
    return each.unionByName(rest.select(*cols))


def collapse_spoken(words: DataFrame, aligned: DataFrame, min_conf: float = 0.0, long: DataFrame | None = None) -> DataFrame:
    """``words`` with the times of their ``aligned`` tokens (clip_id, j, token, start_ms, end_ms, conf).

    A word of one token takes the times and confidence of the token matched to it, unless that is under
    ``min_conf``; a number spans the tokens matched to it, with their mean confidence. Else a word stays.
    ``long(clip_id)``, if known without the rows, has at least every clip with a ``pos`` from ``block_rows`` or a ``j``
    from ``_PLACES`` times that on.
    """
    found = F.col("found")
    takes = F.coalesce(found["s"].isNotNull() & (F.col("number") | (found["c"] >= min_conf)), F.lit(False))
    return _with_found(words, aligned, long).select(
        "clip_id", "pos", "word",
        F.when(takes, found["s"]).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(takes, found["e"]).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(takes, found["c"]).otherwise(F.col("conf")).alias("conf"),
        takes.alias("aligned"),
    )
