"""Queries over timed words: gaps, sentences, takes, lines, and the base cut list."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import gaps as gp
from wordloom.operators import words as wd
from wordloom.params import SHIPPED
from wordloom.plans.oracle_views import view
from wordloom.plans.registry import query

PAUSE = SHIPPED.sentence_pause_ms


@query("a01_edl_summary", """
SELECT clip_id,
  CAST(count(*) FILTER (keep) AS BIGINT) AS keep_segments,
  CAST(count(*) FILTER (NOT keep) AS BIGINT) AS cut_segments,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (keep), 0) AS BIGINT) AS keep_ms,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (NOT keep), 0) AS BIGINT) AS cut_ms,
  count(*) FILTER (NOT keep AND reason = 'silence') AS cuts_silence,
  count(*) FILTER (NOT keep AND reason = 'breath') AS cuts_breath,
  count(*) FILTER (NOT keep AND reason = 'noise') AS cuts_noise,
  count(*) FILTER (NOT keep AND reason = 'outtake') AS cuts_outtake,
  count(*) FILTER (NOT keep AND reason = 'retake') AS cuts_retake
FROM edl GROUP BY clip_id
""")
def edl_summary(ws):
    return gp.summarize(ws.edl())


@query("w01_adjacent_gap", "SELECT clip_id, pos, gap_ms FROM nexts WHERE gap_ms IS NOT NULL")
def adjacent_gap(ws):
    return wd.adjacent_gaps(ws.words())


@query("w02_sentence_boundary", "SELECT clip_id, pos, boundary, boundary_clause FROM bounded")
def sentence_boundary(ws):
    return wd.sentence_boundaries(ws.words(), PAUSE).select(
        "clip_id", "pos", "boundary", "boundary_clause"
    )


@query("w03_sentences", r"""
SELECT clip_id, sentence, min(pos) AS first_pos, count(*) AS n_words, min(start_ms) AS start_ms,
       max(end_ms) AS end_ms,
       CASE WHEN bool_or(next_word IS NULL) THEN 'eos'
            WHEN bool_or(boundary AND regexp_matches(word, '[.!?]$')) THEN 'punct'
            ELSE 'caps+pause' END AS via
FROM sented GROUP BY clip_id, sentence
""")
def sentences(ws):
    return wd.sentences(ws.words(), PAUSE)


@query("w04_marked_sentence_ends", r"""
SELECT clip_id, pos, CASE WHEN boundary AND next_word IS NOT NULL AND NOT regexp_matches(word, '[.!?]$')
       THEN word || '.' ELSE word END AS word FROM bounded
""")
def marked(ws):
    return wd.mark_sentence_ends(ws.words(), PAUSE).select("clip_id", "pos", "word")


@query("w05_takes", r"""
SELECT clip_id, take, min(pos) AS first_pos, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms
FROM (SELECT *, CAST(sum(CASE WHEN start_ms - pe >= 2000 OR (regexp_matches(pw, '[.!?]$') AND NOT pw LIKE '%...')
                     THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos) AS BIGINT) AS take
      FROM (SELECT *, lag(word) OVER w AS pw, lag(end_ms) OVER w AS pe FROM words
            WINDOW w AS (PARTITION BY clip_id ORDER BY pos)))
GROUP BY clip_id, take
""")
def takes(ws):
    t = wd.numbered_takes(ws.words(), SHIPPED.take_boundary_ms)
    return t.groupBy("clip_id", "take").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_words"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
    )


@query("w06_alignment_chunks", r"""
SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY first_pos) AS chunk,
       first_pos, n_words, start_ms, end_ms
FROM (
  SELECT clip_id, c0 AS first_pos, count(*) AS n_words, min(start_ms) AS start_ms,
         arg_max(end_ms, pos) AS end_ms
  FROM (SELECT t.clip_id, t.pos, t.c0, w.start_ms, w.end_ms FROM trace t JOIN words w USING (clip_id, pos))
  GROUP BY clip_id, c0)
""".replace("SELECT clip_id, row_number()", r"""WITH RECURSIVE flags AS MATERIALIZED (
  SELECT clip_id, pos, start_ms, regexp_matches(word, '[.!?]$') AS term,
         regexp_matches(word, '^\p{Lu}') AS up FROM words),
trace AS (
  SELECT clip_id, pos, pos AS c0, start_ms AS t0,
         CASE WHEN term THEN pos + 1 ELSE pos END AS from0, false AS held
  FROM flags WHERE pos = 0
  UNION ALL
  SELECT clip_id, pos, n0, CASE WHEN n0 = pos THEN start_ms ELSE t0 END,
         CASE WHEN term AND NOT (pos - n0 >= 2) THEN pos + 1
              WHEN held OR split THEN pos ELSE from0 END,
         term AND pos - n0 >= 2
  FROM (SELECT *, CASE WHEN held OR (split AND pos - c0 >= 3) THEN pos ELSE c0 END AS n0
        FROM (SELECT f.clip_id, f.pos, f.start_ms, f.term, t.c0, t.t0, t.from0, t.held,
                     NOT t.held AND NOT f.term AND f.pos > t.from0
                       AND ((f.start_ms - t.t0 >= 10000 AND f.up) OR f.start_ms - t.t0 >= 20000) AS split
              FROM trace t JOIN flags f ON f.clip_id = t.clip_id AND f.pos = t.pos + 1)))
SELECT clip_id, row_number()""", 1))
def chunks(ws):
    return wd.alignment_chunks(ws.words())


@query("w07_duplicate_opener", r"""
SELECT clip_id, sentence, start_ms, opener FROM (
  SELECT *, lag(opener) OVER (PARTITION BY clip_id ORDER BY sentence) AS po FROM (
    SELECT clip_id, sentence, min(start_ms) AS start_ms,
           CASE WHEN count(*) FILTER (tok <> '') >= 1 THEN string_agg(tok, ' ' ORDER BY pos) END AS opener
    FROM (SELECT *, lower(regexp_replace(word, '[^\p{L}\p{N}_'']', '', 'g')) AS tok,
                 row_number() OVER (PARTITION BY clip_id, sentence ORDER BY pos) AS rn FROM sented)
    WHERE rn <= 1 GROUP BY clip_id, sentence))
WHERE opener = po
""")
def openers(ws):
    return wd.duplicate_openers(ws.words(), PAUSE, 1)


LINES_SQL = """
SELECT clip_id, pos, word, start_ms, end_ms,
       CAST(sum(CASE WHEN slot = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS BIGINT) AS line,
       slot
FROM (
  SELECT *, (row_number() OVER (PARTITION BY clip_id, grp ORDER BY pos) - 1) % 4 AS slot
  FROM (SELECT *, coalesce(sum(CASE WHEN gap_ms >= 500 OR boundary THEN 1 ELSE 0 END) OVER (
          PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
        FROM bounded))
"""


view("line_words", LINES_SQL)


def lines_of(ws):
    return wd.caption_lines(ws.words(), per_line=4, grace_ms=500, pause_ms=PAUSE)


@query("w08_caption_lines", f"SELECT clip_id, pos, line, slot FROM ({LINES_SQL})")
def lines(ws):
    return lines_of(ws).select("clip_id", "pos", "line", "slot")


@query("w09_display_tokens", f"""
SELECT clip_id, min(pos) AS pos, min(line) AS line, string_agg(word, '' ORDER BY pos) AS text
FROM (SELECT *, sum(CASE WHEN regexp_matches(word, '^[-''’]') AND slot > 0 THEN 0 ELSE 1 END)
                OVER (PARTITION BY clip_id ORDER BY pos) AS tk FROM ({LINES_SQL}))
GROUP BY clip_id, tk
""")
def tokens(ws):
    return wd.display_tokens(lines_of(ws))


@query("w10_comma_merge", """
SELECT clip_id, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, min(start_ms) AS start_ms,
       max(end_ms) AS end_ms, min(confidence) AS confidence
FROM (SELECT *, sum(CASE WHEN word LIKE ',%' AND pos > 0 THEN 0 ELSE 1 END)
                OVER (PARTITION BY clip_id ORDER BY pos) AS tk
      FROM (SELECT clip_id, pos, CASE WHEN pos % 17 = 3 THEN ',' || word ELSE word END AS word,
                   start_ms, end_ms, confidence FROM words))
GROUP BY clip_id, tk
""")
def commas(ws):
    w = ws.words()
    split = F.when(F.col("pos") % 17 == 3, F.concat(F.lit(","), "word")).otherwise(F.col("word"))
    return wd.comma_merge(w.withColumn("word", split))


@query("w11_low_confidence_runs", """
SELECT clip_id, first_pos, start_ms, end_ms, gap_ms FROM (
  SELECT clip_id, min(pos) AS first_pos, min(start_ms) AS start_ms, arg_max(next_start, pos) AS end_ms,
         arg_max(gap_ms, pos) AS gap_ms, max(pos) AS lp, arg_max(next_word IS NULL, pos) AS at_end
  FROM (SELECT *, sum(CASE WHEN confidence < 0.35 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY pos) AS hs FROM nexts)
  WHERE confidence < 0.35 GROUP BY clip_id, hs)
WHERE NOT at_end AND gap_ms >= 300
""")
def low_runs(ws):
    return wd.low_confidence_runs(ws.words(), 0.35, 300)


@query("w12_abandoned_asides", """
SELECT clip_id, sentence, start_ms, n_words, n_low, gap_ms FROM (
  SELECT clip_id, sentence, min(start_ms) AS start_ms, count(*) AS n_words,
         count(*) FILTER (confidence < 0.55) AS n_low,
         max(gap_ms) FILTER (last_of) AS gap_ms
  FROM (SELECT *, pos = max(pos) OVER (PARTITION BY clip_id, sentence) AS last_of FROM sented)
  GROUP BY clip_id, sentence)
WHERE n_words <= 15 AND n_low >= 2 AND gap_ms < 750
""")
def asides(ws):
    return wd.abandoned_asides(ws.words(), PAUSE, 750, 0.55)


@query("d05_gap_table", """
SELECT clip_id, pos, start_ms, end_ms, duration_ms, gap_type, cut, skip_reason FROM gaps
""")
def gap_rows(ws):
    return ws.gaps().select(
        "clip_id", "pos", "start_ms", "end_ms", "duration_ms", "gap_type", "cut", "skip_reason"
    )


@query("d15_cut_list", "SELECT clip_id, start_ms, end_ms, keep, reason FROM edl")
def cut_rows(ws):
    return ws.edl().select("clip_id", "start_ms", "end_ms", "keep", "reason")


@query("j08_gap_of_pair", """
SELECT n.clip_id, n.pos, n.word, n.next_word, g.duration_ms, g.cut
FROM nexts n JOIN gaps g ON g.clip_id = n.clip_id AND g.start_ms = n.end_ms AND g.end_ms = n.next_start
""")
def gap_of_pair(ws):
    n = wd.with_next(ws.words()).select("clip_id", "pos", "word", "next_word")
    return n.join(ws.gaps().select("clip_id", "pos", "duration_ms", "cut"), ["clip_id", "pos"])


@query("p14_wide_words", """
SELECT clip_id, pos, word, end_ms - start_ms AS span_ms FROM words_docs WHERE end_ms - start_ms >= 1500
""")
def wide(ws):
    span = F.col("end_ms") - F.col("start_ms")
    return ws.words("documents").where(span >= 1500).select("clip_id", "pos", "word", span.alias("span_ms"))


@query("a14_sentence_sanity", """
SELECT clip_id, boundaries, n_words, boundaries BETWEEN 5 AND n_words / 3.0 AS sane
FROM (SELECT clip_id, count(*) FILTER (boundary) AS boundaries, count(*) AS n_words FROM bounded GROUP BY 1)
""")
def sanity(ws):
    b = wd.sentence_boundaries(ws.words(), PAUSE)
    c = b.groupBy("clip_id").agg(
        F.sum(F.col("boundary").cast("long")).alias("boundaries"), F.count("*").alias("n_words")
    )
    sane = (F.col("boundaries") >= 5) & (F.col("boundaries") * 3 <= F.col("n_words"))
    return c.withColumn("sane", sane)


@query("o05_weakest_words", """
SELECT clip_id, pos, word, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY confidence, pos) AS rk FROM words WHERE confidence < 0.55)
WHERE rk <= 8
""")
def weakest(ws):
    from wordloom.functions.topk import top_per_key

    return top_per_key(
        ws.words().where("confidence < 0.55"), ["clip_id"], ["confidence", "pos"], 8
    ).select("clip_id", "pos", "word", "confidence")


@query("f21_clock_text", """
SELECT clip_id, pos, CASE WHEN start_ms >= 60000
   THEN CAST(start_ms // 60000 AS VARCHAR) || ':' || lpad(CAST((start_ms % 60000) // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0')
   ELSE CAST(start_ms // 1000 AS VARCHAR) || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || 's' END AS at_text
FROM words
""")
def clock_text(ws):
    return ws.words().select("clip_id", "pos", tx.clock(F.col("start_ms")).alias("at_text"))


@query("f01_normalised_tokens", """
SELECT clip_id, pos, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS token FROM words
""")
def norm_tokens(ws):
    return ws.words().select("clip_id", "pos", tx.norm_token(F.col("word")).alias("token"))


@query("f02_phrase_forms", """
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS collapsed,
  trim(regexp_replace(replace(lower(text), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS hyphen_split,
  trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS stripped
FROM documents
""")
def phrase_forms(ws):
    t = F.col("text")
    return ws.table("documents").select(
        "doc_id",
        tx.norm_phrase(t).alias("collapsed"),
        tx.norm_phrase_hyphen(t).alias("hyphen_split"),
        tx.norm_phrase_strip(t).alias("stripped"),
    )


@query("f03_edge_strip", """
SELECT clip_id, pos, lower(trim(word, '.,!?;:…"''')) AS core, rtrim(lower(trim(word)), '.,!?;:''"') AS tail FROM words
""")
def edge_strip(ws):
    w = F.col("word")
    return ws.words().select(
        "clip_id", "pos", tx.strip_edges(w).alias("core"), tx.strip_tail(w).alias("tail")
    )


@query("f04_sentence_end_tests", r"""
SELECT clip_id, pos, regexp_matches(word, '[.!?]$') AND NOT word LIKE '%...' AS ends,
       word LIKE '%...' OR word LIKE '%…' AS trails FROM words
""")
def end_tests(ws):
    w = F.col("word")
    return ws.words().select(
        "clip_id", "pos", tx.ends_sentence(w).alias("ends"), tx.trails_off(w).alias("trails")
    )
