"""Word-stream operators: gaps, sentences, takes, caption lines, token merges.

Input frames carry ``clip_id, pos, word, start_ms, end_ms, confidence`` with ``pos`` dense from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions.scan import lag, last, neighbours, running_sum, scan, total

CLIP = ["clip_id"]


def with_next(words: DataFrame) -> DataFrame:
    """next_word, next_start, next_end, next_conf and gap_ms (null on a clip's last word). Words that carry
    them already, as those of linked strips do, are returned as they are."""
    if "next_conf" in words.columns:
        return words
    return neighbours(
        words,
        CLIP,
        "pos",
        {
            "next_word": ("word", 1),
            "next_start": ("start_ms", 1),
            "next_end": ("end_ms", 1),
            "next_conf": ("confidence", 1),
        },
    ).withColumn("gap_ms", F.col("next_start") - F.col("end_ms"))


def adjacent_gaps(words: DataFrame) -> DataFrame:
    return with_next(words).where("gap_ms is not null").select("clip_id", "pos", "gap_ms")


def sentence_boundaries(words: DataFrame, pause_ms: int) -> DataFrame:
    """boundary (sentence) and boundary_clause (sentence or clause) after each word."""
    w, nw, g = F.col("word"), F.col("next_word"), F.col("gap_ms")
    return (
        with_next(words)
        .withColumn("boundary", tx.boundary_after(w, nw, g, pause_ms))
        .withColumn("boundary_clause", tx.boundary_after(w, nw, g, pause_ms, clause=True))
    )


def numbered_sentences(words: DataFrame, pause_ms: int) -> DataFrame:
    """Word rows with ``sentence``: how many sentence ends lie before the word."""
    b = sentence_boundaries(words, pause_ms)
    return scan(b, CLIP, ["pos"], {"sentence": running_sum(F.col("boundary").cast("long"), False)})


def sentences(words: DataFrame, pause_ms: int) -> DataFrame:
    """One row per sentence with the signal that closed it: punct, caps+pause or eos."""
    n = numbered_sentences(words, pause_ms)
    closing = F.col("next_word").isNull()
    via = (
        F.when(closing, "eos")
        .when(F.col("word").rlike(tx.TERMINAL), "punct")
        .otherwise("caps+pause")
    )
    return n.groupBy("clip_id", "sentence").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_words"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.max(F.when(F.col("boundary") | closing, via)).alias("via"),
    )


def mark_sentence_ends(words: DataFrame, pause_ms: int) -> DataFrame:
    """A period on words whose sentence closes by capital-after-pause only."""
    b = sentence_boundaries(words, pause_ms)
    soft = (
        F.col("boundary") & ~F.col("word").rlike(tx.TERMINAL) & F.col("next_word").isNotNull()
    )
    return b.select(
        "clip_id",
        "pos",
        F.when(soft, F.concat("word", F.lit("."))).otherwise(F.col("word")).alias("word"),
        "start_ms",
        "end_ms",
        "confidence",
        F.col("keep") if "keep" in words.columns else F.lit(True).alias("keep"),
    )


def take_starts(words: DataFrame, take_boundary_ms: int) -> DataFrame:
    """``take_start``: the word follows a take-long pause or a sentence end; never a clip's first."""
    p = neighbours(
        words, CLIP, "pos", {"prev_word": ("word", -1), "prev_end": ("end_ms", -1)}
    ).withColumn("prev_gap_ms", F.col("start_ms") - F.col("prev_end"))
    hit = (F.col("prev_gap_ms") >= take_boundary_ms) | tx.ends_sentence(F.col("prev_word"))
    return p.withColumn("take_start", F.coalesce(hit, F.lit(False)))


def numbered_takes(words: DataFrame, take_boundary_ms: int) -> DataFrame:
    return scan(
        take_starts(words, take_boundary_ms),
        CLIP,
        ["pos"],
        {"take": running_sum(F.col("take_start").cast("long"))},
    )


def sentence_openers(words: DataFrame, pause_ms: int, n: int = 3) -> DataFrame:
    """First ``n`` non-empty normalised tokens of each sentence; null when there are fewer."""
    ns = numbered_sentences(words, pause_ms)
    first = scan(ns, ["clip_id", "sentence"], ["pos"], {"p0": total("min", "pos")})
    token = F.lower(F.regexp_replace("word", r"[^\p{L}\p{N}_']", ""))
    heads = first.where(F.col("pos") - F.col("p0") < n).select(
        "clip_id", "sentence", "pos", "p0", "start_ms", token.alias("tok")
    )
    return heads.groupBy("clip_id", "sentence").agg(
        F.min("start_ms").alias("start_ms"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]
            ),
            " ",
        ).alias("joined"),
        F.sum((F.col("tok") != "").cast("int")).alias("n_tok"),
    ).select(
        "clip_id",
        "sentence",
        "start_ms",
        F.when(F.col("n_tok") >= n, F.col("joined")).alias("opener"),
    )


def duplicate_openers(words: DataFrame, pause_ms: int, n: int = 3) -> DataFrame:
    """Sentences that open with the same ``n`` tokens as the sentence before."""
    o = sentence_openers(words, pause_ms, n)
    return (
        neighbours(o, CLIP, "sentence", {"prev_opener": ("opener", -1)})
        .where("opener = prev_opener")
        .select("clip_id", "sentence", "start_ms", "opener")
    )


def caption_lines(
    words: DataFrame, per_line: int, grace_ms: int, pause_ms: int
) -> DataFrame:
    """Word rows with ``line`` (clip-wide number) and ``slot`` within the line.

    Forced breaks split the words into groups; a group is cut every ``per_line`` words.
    """
    b = sentence_boundaries(words, pause_ms)
    forced = F.coalesce((F.col("gap_ms") >= grace_ms) | F.col("boundary"), F.lit(False))
    b = b.withColumn("break_after", forced.cast("long"))
    g = scan(
        b,
        CLIP,
        ["pos"],
        {
            "after_break": lag("break_after"),
            "grp": running_sum("break_after", False),
        },
    )
    g = scan(
        g.withColumn(
            "grp_pos",
            F.when((F.col("pos") == 0) | (F.col("after_break") == 1), F.col("pos")),
        ),
        CLIP,
        ["pos"],
        {"g0": last("grp_pos")},
    )
    slot = (F.col("pos") - F.col("g0")) % per_line
    g = g.withColumn("slot", slot)
    return scan(
        g, CLIP, ["pos"], {"line": running_sum((F.col("slot") == 0).cast("long"))}
    ).withColumn("line", F.col("line") - 1)


def glue_islands(words: DataFrame, glued: Column) -> DataFrame:
    """``token``: running number that does not advance on glued words. A clip's first word
    always opens a token."""
    opens = F.when(glued & (F.col("pos") > 0), 0).otherwise(1).cast("long")
    return scan(words.withColumn("_open", opens), CLIP, ["pos"], {"token": running_sum("_open")})


def display_tokens(lines: DataFrame) -> DataFrame:
    """Continuation tokens (leading hyphen or apostrophe) joined to the word before on the
    same line."""
    glued = F.col("word").rlike("^[-'’]") & (F.col("slot") > 0)
    g = glue_islands(lines, glued)
    return g.groupBy("clip_id", "token").agg(
        F.min("pos").alias("pos"),
        F.min("line").alias("line"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]),
            "",
        ).alias("text"),
    ).select("clip_id", "pos", "line", "text")


def comma_merge(words: DataFrame) -> DataFrame:
    """Words opening with a comma are joined to the one before: least confidence, last end."""
    g = glue_islands(words, F.col("word").startswith(","))
    return g.groupBy("clip_id", "token").agg(
        F.min("pos").alias("pos"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]),
            "",
        ).alias("word"),
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"),
        F.min("confidence").alias("confidence"),
    ).drop("token")


def low_confidence_runs(words: DataFrame, threshold: float, gap_ms: int) -> DataFrame:
    """Runs of low-confidence words followed by a gap; the window reaches the next word."""
    n = with_next(words).withColumn("low", F.col("confidence") < threshold)
    n = scan(n, CLIP, ["pos"], {"high_seen": running_sum((~F.col("low")).cast("long"))})
    runs = n.where("low").groupBy("clip_id", "high_seen").agg(
        F.min("pos").alias("first_pos"),
        F.min("start_ms").alias("start_ms"),
        F.max_by("next_start", "pos").alias("end_ms"),
        F.max_by("gap_ms", "pos").alias("gap_ms"),
    )
    return runs.where(F.col("gap_ms") >= gap_ms).select(
        "clip_id", "first_pos", "start_ms", "end_ms", "gap_ms"
    )


def abandoned_asides(
    words: DataFrame, pause_ms: int, min_silence_ms: int, low: float, max_words: int = 15
) -> DataFrame:
    """Short sentences with two or more weak words that run straight into the next one."""
    s = numbered_sentences(words, pause_ms).groupBy("clip_id", "sentence").agg(
        F.count("*").alias("n_words"),
        F.sum((F.col("confidence") < low).cast("long")).alias("n_low"),
        F.min("start_ms").alias("start_ms"),
        F.max_by("gap_ms", "pos").alias("gap_ms"),
    )
    return s.where(
        (F.col("n_words") <= max_words) & (F.col("n_low") >= 2) & (F.col("gap_ms") < min_silence_ms)
    ).select("clip_id", "sentence", "start_ms", "n_words", "n_low", "gap_ms")


def alignment_chunks(words: DataFrame) -> DataFrame:
    """Chunks for alignment: close at terminal punctuation; a capital from 10 s or any word from
    20 s on splits; chunks under three words run on.

    The rule carries state, so it is folded, but only between points where the state is known
    to be fresh: after a sentence of three or more words that ends less than 10 s after the
    word two before it, a chunk always closes.
    """
    p = neighbours(
        words,
        CLIP,
        "pos",
        {"after_terminal": (F.col("word").rlike(tx.TERMINAL), -1)},
    ).withColumn("terminal", F.col("word").rlike(tx.TERMINAL))
    p = scan(
        p,
        CLIP,
        ["pos"],
        {"sent0": last(F.when((F.col("pos") == 0) | F.col("after_terminal"), F.col("pos")))},
    )
    lead_in = p.select(
        "clip_id", F.col("pos").alias("lead_pos"), F.col("start_ms").alias("lead_ms")
    )
    ends = p.where("terminal").withColumn("lead_pos", F.greatest(F.col("sent0") - 2, F.lit(0)))
    fresh = (
        ends.join(lead_in, ["clip_id", "lead_pos"])
        .where((F.col("pos") - F.col("sent0") >= 2) & (F.col("start_ms") - F.col("lead_ms") < 10000))
        .select("clip_id", (F.col("pos") + 1).alias("pos"), F.lit(1).alias("fresh"))
    )
    seg = scan(
        words.join(fresh, ["clip_id", "pos"], "left"),
        CLIP,
        ["pos"],
        {"segment": running_sum("fresh")},
    )
    packed = seg.groupBy("clip_id", "segment").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos",
                    "start_ms",
                    "end_ms",
                    F.col("word").rlike(tx.TERMINAL).alias("terminal"),
                    tx.starts_upper(F.col("word")).alias("upper"),
                )
            )
        ).alias("ws")
    )
    # c0, t0: the open chunk's first word; from0: where its scan last restarted; held: the word
    # before closed a chunk; starts: chunk starts so far.
    def step(a, w):
        held = a["held"]
        elapsed = w["start_ms"] - a["t0"]
        split = ~w["terminal"] & (w["pos"] > a["from0"]) & (
            ((elapsed >= 10000) & w["upper"]) | (elapsed >= 20000)
        )
        long_before = w["pos"] - a["c0"] >= 3
        opened = split & long_before
        c0 = F.when(held | opened, w["pos"]).otherwise(a["c0"])
        t0 = F.when(held | opened, w["start_ms"]).otherwise(a["t0"])
        from0 = F.when(held | split, w["pos"]).otherwise(a["from0"])
        closes = w["terminal"] & (w["pos"] - c0 + 1 >= 3)
        rescan = w["terminal"] & ~closes
        return F.struct(
            c0.alias("c0"),
            t0.alias("t0"),
            F.when(rescan, w["pos"] + 1).otherwise(from0).alias("from0"),
            closes.alias("held"),
            F.when(held | opened, F.concat(a["starts"], F.array(w["pos"])))
            .otherwise(a["starts"])
            .alias("starts"),
        )

    first = F.col("ws")[0]
    zero = F.struct(
        first["pos"].alias("c0"),
        first["start_ms"].alias("t0"),
        first["pos"].alias("from0"),
        F.lit(False).alias("held"),
        F.array(first["pos"]).alias("starts"),
    )
    starts = packed.select(
        "clip_id", F.explode(F.aggregate("ws", zero, step)["starts"]).alias("pos")
    ).withColumn("chunk_start", F.lit(1))
    marked = scan(
        words.join(starts, ["clip_id", "pos"], "left"),
        CLIP,
        ["pos"],
        {"chunk": running_sum("chunk_start")},
    )
    return marked.groupBy("clip_id", "chunk").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_words"),
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"),
    )
