"""Queries over transcript repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions.scan import block_rows
from wordloom.operators import repair as rp
from wordloom.operators import words as wd
from wordloom.plans.oracle_views import view
from wordloom.plans.registry import query

view("raw_windows", r"""
SELECT clip_id, start_ms, end_ms, 'wide' AS label FROM words WHERE end_ms - start_ms >= 700
UNION ALL
SELECT clip_id, min(start_ms), arg_max(next_start, pos), 'low_conf' FROM (
  SELECT *, sum(CASE WHEN confidence < 0.35 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY pos) AS hs FROM nexts)
WHERE confidence < 0.35 GROUP BY clip_id, hs HAVING NOT bool_or(next_word IS NULL) AND arg_max(gap_ms, pos) >= 300
UNION ALL SELECT clip_id, end_ms, next_start, 'large_gap' FROM nexts WHERE gap_ms >= 600 AND NOT regexp_matches(word, '[.!?]$')
UNION ALL SELECT clip_id, CASE WHEN start_ms - lag(end_ms) OVER w >= 100 THEN lag(start_ms) OVER w ELSE start_ms END, end_ms, 'low_conf_word'
FROM words WINDOW w AS (PARTITION BY clip_id ORDER BY pos) QUALIFY confidence < 0.35
""")


def windows(ws):
    return rp.raw_windows(ws.words(), 700, 0.35, 300, 600, 100)


@query("u02_window_triggers", "SELECT clip_id, start_ms, end_ms, label FROM raw_windows")
def triggers(ws):
    return windows(ws).select("clip_id", "start_ms", "end_ms", "label")


@query("v13_merged_windows", """
WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms, label) AS rn FROM raw_windows),
f AS (SELECT clip_id, rn, start_ms AS s, end_ms AS e, label, 1 AS n FROM o WHERE rn = 1
  UNION ALL SELECT o.clip_id, o.rn, CASE WHEN o.start_ms <= f.e + 100 THEN f.s ELSE o.start_ms END, CASE WHEN o.start_ms <= f.e + 100 THEN greatest(f.e, o.end_ms) ELSE o.end_ms END,
    CASE WHEN o.start_ms > f.e + 100 THEN o.label WHEN contains(f.label, o.label) THEN f.label ELSE f.label || '+' || o.label END,
    CASE WHEN o.start_ms <= f.e + 100 THEN f.n + 1 ELSE 1 END
  FROM f JOIN o ON o.clip_id = f.clip_id AND o.rn = f.rn + 1)
SELECT clip_id, s AS start_ms, max(e) AS end_ms, arg_max(label, rn) AS label, CAST(max(n) AS BIGINT) AS n FROM f GROUP BY clip_id, s
""")
def merged(ws):
    return rp.merge_labelled(windows(ws), 100)


@query("d06_suspicious_windows")
def suspicious(ws):
    grown = rp.expand_to_sentences(windows(ws), ws.words(), 600)
    return rp.merge_labelled(grown, 1000)


def second_pass(ws):
    s = wd.numbered_sentences(ws.words(), 600).select(
        "clip_id", F.col("sentence").alias("window"), "pos", "start_ms", "end_ms", "word", "confidence"
    )
    ends = s.groupBy("clip_id", "window").agg(F.max("end_ms").alias("window_end"))
    heard = s.where("pos % 11 <> 4").select(
        "clip_id", "window", "start_ms", "end_ms",
        F.when(F.col("pos") % 7 == 2, F.concat("word", F.lit("x"))).otherwise(F.col("word")).alias("word"),
        F.when(F.col("pos") % 5 == 1, F.col("confidence") / 4).otherwise(F.col("confidence")).alias("confidence"),
    )
    return heard.join(ends, ["clip_id", "window"]), s.drop("pos")


@query("d07_second_pass_reconcile")
def reconcile(ws):
    found, original = second_pass(ws)
    return rp.reconcile_second_pass(found, original, 0.10)


view("number_words", "SELECT clip_id, pos, start_ms, end_ms, CASE WHEN pos % 11 = 0 THEN (pos * 7919) % 1200000 || ',' WHEN pos % 13 = 5 THEN '-' || pos % 21 WHEN pos % 17 = 3 THEN '000' || pos || repeat('7', pos % 30) || '.' ELSE word END AS word FROM words")


def number_words(ws):
    w = ws.words()
    word = (
        F.when(F.col("pos") % 11 == 0, F.concat((F.col("pos") * 7919 % 1200000).cast("string"), F.lit(",")))
        .when(F.col("pos") % 13 == 5, F.concat(F.lit("-"), (F.col("pos") % 21).cast("string")))
        .when(F.col("pos") % 17 == 3, F.concat(F.lit("000"), F.col("pos").cast("string"), F.expr("repeat('7', CAST(pos % 30 AS INT))"), F.lit(".")))
        .otherwise(F.col("word"))
    )
    return w.withColumn("word", word)


def _below(n):
    ones = "['" + "','".join(rp.ONES) + "']"
    tens = "['" + "','".join(rp.TENS) + "']"
    small = f"CASE WHEN {n} % 100 < 20 THEN {ones}[{n} % 100 + 1] ELSE {tens}[{n} % 100 // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN ' ' || {ones}[{n} % 10 + 1] ELSE '' END END"
    return f"concat_ws(' ', CASE WHEN {n} >= 100 THEN {ones}[{n} // 100 + 1] || ' hundred' END, CASE WHEN {n} % 100 > 0 OR {n} = 0 THEN {small} END)"


SPOKEN = f"""
SELECT clip_id, pos, start_ms, end_ms, CASE WHEN dg IS NULL THEN word WHEN v IS NULL THEN dg WHEN v < 1000 THEN {_below('v')}
  ELSE concat_ws(' ', {_below('t')}, 'thousand', CASE WHEN r > 0 THEN {_below('r')} END) END AS spoken, v
FROM (SELECT *, v // 1000 AS t, v % 1000 AS r FROM (SELECT *, CASE WHEN length(dg) <= 6 THEN CAST(dg AS BIGINT) END AS v
  FROM (SELECT *, CASE WHEN regexp_full_match(c, '[0-9]+') THEN CASE WHEN ltrim(c, '0') = '' THEN '0' ELSE ltrim(c, '0') END END AS dg
  FROM (SELECT *, rtrim(ltrim(trim(word), '-'), '.,!?;:"''') AS c FROM number_words))))
"""


@query("f15_spoken_numbers", f"SELECT clip_id, pos, spoken FROM ({SPOKEN})")
def spoken(ws):
    return number_words(ws).select("clip_id", "pos", F.array_join(rp.spoken_tokens(F.col("word")), " ").alias("spoken"))


@query("d08_spoken_expand", f"""
SELECT clip_id, pos, k, tok[k + 1] AS token, CAST(floor(start_ms + k * (CAST(end_ms - start_ms AS DOUBLE) / len(tok))) AS BIGINT) AS start_ms,
  CAST(floor(start_ms + (k + 1) * (CAST(end_ms - start_ms AS DOUBLE) / len(tok))) AS BIGINT) AS end_ms
FROM (SELECT *, CASE WHEN v IS NULL THEN [spoken] ELSE string_split(spoken, ' ') END AS tok FROM ({SPOKEN})), LATERAL (SELECT unnest(range(len(tok))) AS k)
""")
def expand(ws):
    return rp.expand_spoken(number_words(ws))


view("expanded_tokens", f"""
SELECT clip_id, pos, k, pos * 16 + k AS i, rtrim(lower(trim(tok[k + 1])), '.,!?;:''"') AS norm, start_ms, end_ms, len(tok) AS n
FROM (SELECT *, CASE WHEN v IS NULL THEN [spoken] ELSE string_split(spoken, ' ') END AS tok FROM ({SPOKEN})), LATERAL (SELECT unnest(range(len(tok))) AS k)
""")
view("heard_tokens", """
SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS r, norm, start_ms + 40 + 5 * k AS s, start_ms + 60 + 5 * k AS e, CASE WHEN pos % 7 = 2 THEN 0.125 ELSE 0.75 END AS c
FROM expanded_tokens WHERE (pos * 5 + k * 3) % 9 <> 4
""")


@query("d08_spoken_collapse", """
WITH RECURSIVE walk AS (
  SELECT DISTINCT clip_id, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS i FROM heard_tokens
  UNION ALL
  SELECT w.clip_id, w.r + 1, min(t.i) FROM walk w JOIN heard_tokens h ON h.clip_id = w.clip_id AND h.r = w.r + 1
  JOIN expanded_tokens t ON t.clip_id = h.clip_id AND t.norm = h.norm AND t.i > w.i GROUP BY w.clip_id, w.r
), found AS (
  SELECT clip_id, w.i // 16 AS pos, min_by(s, r) AS s, max_by(e, r) AS e, avg(c) AS c FROM walk w JOIN heard_tokens h USING (clip_id, r) GROUP BY ALL
), taken AS (
  SELECT n.*, f.s, f.e, f.c, f.s IS NOT NULL AND (x.n > 1 OR f.c >= 0.25) AS aligned FROM number_words n
  JOIN (SELECT clip_id, pos, n FROM expanded_tokens WHERE k = 0) x USING (clip_id, pos) LEFT JOIN found f USING (clip_id, pos)
)
SELECT clip_id, pos, word, CASE WHEN aligned THEN s ELSE start_ms END AS start_ms, CASE WHEN aligned THEN e ELSE end_ms END AS end_ms,
  CASE WHEN aligned THEN CAST(c AS DOUBLE) ELSE 0.5 END AS conf, aligned FROM taken
""")
def collapse(ws):
    words = number_words(ws)
    tokens = words.select("clip_id", "pos", F.col("start_ms").alias("from_ms"), F.posexplode(rp.spoken_tokens(F.col("word"))).alias("k", "token"))
    heard = tokens.where((F.col("pos") * 5 + F.col("k") * 3) % 9 != 4)
    start = F.col("from_ms") + 5 * F.col("k")
    heard = heard.select(
        "clip_id", (F.col("pos") * 16 + F.col("k")).alias("j"), "token", (start + 40).alias("start_ms"), (start + 60).alias("end_ms"),
        F.when(F.col("pos") % 7 == 2, 0.125).otherwise(0.75).alias("conf"),
    )
    # a text has fewer words than characters
    long = ws.strips().where(F.col("pos0") + F.char_length("text") >= block_rows(ws.spark)).select("clip_id")
    return rp.collapse_spoken(words.withColumn("conf", F.lit(0.5)), heard, 0.25, long)


@query("d09_monotonic_repair")
def monotonic(ws):
    w = ws.words()
    late = F.when(F.col("pos") % 9 == 4, 900).when(F.col("pos") % 14 == 3, -700).otherwise(0)
    return rp.enforce_order(
        w.select(
            "clip_id", "pos", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"),
            F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"),
        )
    )
