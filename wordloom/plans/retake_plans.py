"""Queries over repeated takes in the documents corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import retakes as rt
from wordloom.params import SHIPPED
from wordloom.plans.oracle_views import view
from wordloom.plans.registry import query

view("toks", r"""
SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS tok, lag(end_ms) OVER w AS pe, lag(word) OVER w AS pw,
  regexp_matches(word, '[.?!]$') AND NOT word LIKE '%...' AS ends, word LIKE '%...' OR word LIKE '%…' AS trails
FROM words_stutter WINDOW w AS (PARTITION BY clip_id ORDER BY pos)
""")
view("tagged_toks", """
SELECT *, tok <> '' AND tok NOT IN ('the','a','an','and','or','but','it','its','was','were','is','are','am','be','been','to','of','in','on','at','so','that','this','these','those','with','as','for','i') AS content,
  coalesce(start_ms - pe >= 2000 OR (regexp_matches(pw, '[.?!]$') AND NOT pw LIKE '%...'), false) AS edge FROM toks
""")


@query("a03_sentence_content_words", """
SELECT clip_id, sent, tok, count(*) AS c FROM (
  SELECT *, CAST(coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent FROM tagged_toks)
WHERE content GROUP BY 1, 2, 3
""")
def content_words(ws):
    return rt.sentence_tokens(ws.stuttered_strips())


view("ngram_keys", """
SELECT DISTINCT clip_id, pos, unnest([tok || ' ' || t1 || ' ' || t2, t1 || ' ' || tok || ' ' || t2, tok || ' ' || t2 || ' ' || t1]) AS key
FROM (SELECT clip_id, pos, tok, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS t2 FROM tagged_toks WINDOW w AS (PARTITION BY clip_id ORDER BY pos))
WHERE tok <> '' AND t1 <> '' AND t2 <> ''
""")
view("seeds", """
SELECT DISTINCT clip_id, i, j FROM (
  SELECT clip_id, pos AS i, unnest([np, lp]) AS j FROM (
    SELECT *, lead(pos) OVER (PARTITION BY clip_id, key ORDER BY pos) AS np, max(pos) OVER (PARTITION BY clip_id, key) AS lp FROM ngram_keys)
  WHERE np IS NOT NULL) WHERE j >= i + 3
""")


@query("j13_ngram_seed_pairs", "SELECT clip_id, i, j FROM seeds")
def seeds(ws):
    return rt.strip_pairs(ws.stuttered_strips(), SHIPPED, judged=False)


@query("f14_swap_variants", """
SELECT clip_id, pos, key FROM ngram_keys
""")
def swaps(ws):
    g = rt.token_rows(ws.stuttered_strips(), 2).where("tok <> '' and t1 <> '' and t2 <> ''")
    keys = F.array_distinct(rt.swap_variants(F.array("tok", "t1", "t2"), 3))
    return g.select("clip_id", "pos", F.explode(keys).alias("key"))


view("clip_toks", "SELECT clip_id, list(tok ORDER BY pos) AS t, max(pos) + 1 AS n FROM tagged_toks GROUP BY 1")
view("grown", """
SELECT clip_id, i, j, 3 + fm + bm AS match_len, i - back AS ci, j - back AS cj FROM (
  SELECT *, length(replace(b, '0', '')) AS bm, length(rtrim(b, '0')) AS back FROM (
    SELECT *, CASE WHEN strpos(bs, '00') > 0 THEN left(bs, strpos(bs, '00')) ELSE bs END AS b FROM (
      SELECT *, array_to_string([CASE WHEN t[i - k] = t[j - k] THEN '1' ELSE '0' END FOR k IN range(0,
          CASE WHEN blank > 0 THEN least(room, blank - 1) ELSE room END)], '') AS bs FROM (
        SELECT *, coalesce(list_position([t[i - k] FOR k IN range(0, room)], ''), 0) AS blank FROM (
          SELECT *, greatest(least(i, j - i - 3 - length(f)), 0) AS room, length(replace(f, '0', '')) AS fm FROM (
            SELECT *, CASE WHEN strpos(fs, '00') > 0 THEN left(fs, strpos(fs, '00')) ELSE fs END AS f FROM (
              SELECT s.*, c.t, c.n, array_to_string([CASE WHEN c.t[s.i + 4 + k] = c.t[s.j + 4 + k] THEN '1' ELSE '0' END FOR k IN range(0, c.n - s.j - 3)], '') AS fs
              FROM seeds s JOIN clip_toks c USING (clip_id))))))))
""")
view("facts", """
SELECT *, max(CASE WHEN edge OR pos = 0 THEN pos END) OVER (PARTITION BY clip_id ORDER BY pos) AS take0,
  sum(CASE WHEN start_ms - pe >= 450 OR (regexp_matches(pw, '[.?!]$') AND NOT pw LIKE '%...') THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos) AS stops,
  coalesce(sum(CASE WHEN trails THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trail_n
FROM tagged_toks
""")


view("judged", """
SELECT clip_id, i, j, j - i AS cut_len, match_len, ci, cj, reason = '' AS kept, reason AS skip_reason FROM (
  SELECT g.*, CASE
    WHEN g.match_len <= 0.5 * (g.j - g.i) THEN 'ratio'
    WHEN b.stops = a.stops AND b.trail_n = a.trail_n AND g.match_len < 0.75 * (g.j - g.i) THEN 'no_pause'
    WHEN b.take0 > g.ci AND len(head) > 0 AND NOT list_has_any(head, coalesce(before, [])) THEN 'parallel_item' ELSE '' END AS reason
  FROM (SELECT g.*, b.take0,
          (SELECT coalesce(list(x.tok), []) FROM tagged_toks x WHERE x.clip_id = g.clip_id AND x.content AND x.pos >= b.take0 AND x.pos < g.cj) AS head,
          (SELECT list(x.tok) FROM tagged_toks x WHERE x.clip_id = g.clip_id AND x.content AND x.pos >= a.take0 AND x.pos < b.take0) AS before
        FROM grown g JOIN facts a ON a.clip_id = g.clip_id AND a.pos = g.ci JOIN facts b ON b.clip_id = g.clip_id AND b.pos = g.cj
        WHERE b.start_ms - b.pe <= 12000) g
  JOIN facts a ON a.clip_id = g.clip_id AND a.pos = g.ci JOIN facts b ON b.clip_id = g.clip_id AND b.pos = g.cj)
""")


@query("d11_literal_repeats", "SELECT * FROM judged")
def literal(ws):
    return ws.retake_pairs().select(
        "clip_id", "i", "j", "cut_len", "match_len", "ci", "cj", "kept", "skip_reason"
    )


view("spoken_sents", """
SELECT clip_id, sent, min(start_ms) AS s, max(end_ms) AS e, coalesce(max(nx), max(end_ms)) AS nxt, count(*) FILTER (content) AS nc FROM (
  SELECT *, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY pos) AS nx, CAST(coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent FROM tagged_toks)
GROUP BY 1, 2
""")
REWORDED = """
SELECT DISTINCT a.clip_id, a.s AS start_ms, a.nxt AS end_ms FROM (
  SELECT x.clip_id, x.sent AS s1, y.sent AS s2, sum(least(x.c, y.c)) AS inter FROM cw x JOIN cw y ON x.clip_id = y.clip_id AND x.tok = y.tok AND y.sent > x.sent GROUP BY 1, 2, 3) p
JOIN spoken_sents a ON a.clip_id = p.clip_id AND a.sent = p.s1 JOIN spoken_sents b ON b.clip_id = p.clip_id AND b.sent = p.s2
WHERE a.nc >= 3 AND b.nc >= 3 AND b.s - a.e <= 12000 AND p.inter >= 0.6 * a.nc AND p.inter >= 0.6 * b.nc
"""
view("cw", """
SELECT clip_id, sent, tok, count(*) AS c FROM (
  SELECT *, CAST(coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent FROM tagged_toks)
WHERE content GROUP BY 1, 2, 3
""")


@query("d12_reworded_takes", REWORDED)
def reworded(ws):
    return rt.overlapping_strip_sentences(ws.stuttered_strips(), SHIPPED).select("clip_id", "start_ms", "end_ms").distinct()


@query("j14_sentence_overlap", """
SELECT a.clip_id, p.s1, p.s2, CAST(p.inter AS BIGINT) AS inter FROM (
  SELECT x.clip_id, x.sent AS s1, y.sent AS s2, sum(least(x.c, y.c)) AS inter FROM cw x JOIN cw y ON x.clip_id = y.clip_id AND x.tok = y.tok AND y.sent > x.sent GROUP BY 1, 2, 3) p
JOIN spoken_sents a ON a.clip_id = p.clip_id AND a.sent = p.s1 JOIN spoken_sents b ON b.clip_id = p.clip_id AND b.sent = p.s2
WHERE a.nc >= 3 AND b.nc >= 3 AND b.s - a.e <= 12000 AND p.inter >= 0.6 * a.nc AND p.inter >= 0.6 * b.nc
""")
def sentence_overlap(ws):
    return rt.overlapping_strip_sentences(ws.stuttered_strips(), SHIPPED).select("clip_id", F.col("sent").alias("s1"), F.col("sent2").alias("s2"), "inter")


view("aborted_openers", """
SELECT clip_id, CASE hl WHEN 2 THEN s1 ELSE s2 END AS start_ms, r_ms AS end_ms FROM (
  SELECT *, pos - take0 + 1 AS hl, lag(tok) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(start_ms) OVER w AS s1, lag(start_ms, 2) OVER w AS s2,
    lead(tok) OVER w AS r1, lead(tok, 2) OVER w AS r2, lead(tok, 3) OVER w AS r3, lead(start_ms) OVER w AS r_ms, end_ms AS e_ms
  FROM facts WINDOW w AS (PARTITION BY clip_id ORDER BY pos))
WHERE trails AND r_ms - e_ms <= 12000 AND (
  (hl = 2 AND p1 <> '' AND p1 = r1 AND tok <> '' AND tok = r2)
  OR (hl = 3 AND p2 <> '' AND p2 = r1 AND p1 <> '' AND p1 = r2 AND NOT coalesce(tok <> '' AND tok = r3, false)))
""")


@query("d13_aborted_restarts", "SELECT * FROM aborted_openers")
def aborted(ws):
    return rt.aborted_strip_restarts(ws.stuttered_strips(), SHIPPED)


@query("d14_retake_ranges")
def ranges(ws):
    return ws.retakes()


@query("u03_retake_passes", f"""
SELECT j.clip_id, a.start_ms, b.start_ms AS end_ms, 'literal' AS pass FROM judged j
  JOIN words_stutter a ON a.clip_id = j.clip_id AND a.pos = j.ci JOIN words_stutter b ON b.clip_id = j.clip_id AND b.pos = j.cj WHERE j.kept
UNION ALL SELECT clip_id, start_ms, end_ms, 'reworded' FROM ({REWORDED})
UNION ALL SELECT clip_id, start_ms, end_ms, 'aborted' FROM aborted_openers
""")
def passes(ws):
    lit = ws.retake_pairs().where("kept").select(
        "clip_id", F.col("cut_start_ms").alias("start_ms"), F.col("cut_end_ms").alias("end_ms"), F.lit("literal").alias("pass")
    )
    rew = rt.overlapping_strip_sentences(ws.stuttered_strips(), SHIPPED).select("clip_id", "start_ms", "end_ms").distinct()
    rew = rew.withColumn("pass", F.lit("reworded"))
    abo = rt.aborted_strip_restarts(ws.stuttered_strips(), SHIPPED).withColumn("pass", F.lit("aborted"))
    return lit.unionByName(rew).unionByName(abo)


@query("a11_retake_totals", """
SELECT j.clip_id, count(*) AS candidates, count(*) FILTER (kept) AS cut, count(*) FILTER (NOT kept) AS skipped,
  CAST(coalesce(sum(b.start_ms - a.start_ms) FILTER (kept), 0) AS BIGINT) AS cut_ms
FROM judged j JOIN words_stutter a ON a.clip_id = j.clip_id AND a.pos = j.ci JOIN words_stutter b ON b.clip_id = j.clip_id AND b.pos = j.cj GROUP BY 1
""")
def totals(ws):
    p = ws.retake_pairs()
    return p.groupBy("clip_id").agg(
        F.count("*").alias("candidates"),
        F.sum(F.col("kept").cast("long")).alias("cut"),
        F.sum((~F.col("kept")).cast("long")).alias("skipped"),
        F.sum(F.when(F.col("kept"), F.col("cut_end_ms") - F.col("cut_start_ms")).otherwise(0)).alias("cut_ms"),
    )
