"""Queries over cut lists, overlays and hook windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import gaps as gp
from wordloom.operators import intervals as iv
from wordloom.operators import timeline as tl
from wordloom.params import SHIPPED
from wordloom.plans.oracle_views import islands, merged_cuts, remap, split_edl, view
from wordloom.plans.registry import query

EDL_COLS = ["clip_id", "start_ms", "end_ms", "keep", "reason"]

view("drop_runs", islands("SELECT clip_id, start_ms, end_ms FROM drops", 1))
view("kept_words", """
SELECT w.* FROM words w WHERE NOT EXISTS (SELECT 1 FROM cut_runs c WHERE c.clip_id = w.clip_id
  AND c.start_ms <= w.start_ms AND w.start_ms < c.end_ms - 1)
""")
view("seams", f"SELECT clip_id, out_ms AS seam_ms FROM ({remap('(SELECT clip_id, start_ms FROM edl WHERE keep)', 'start_ms')})")
view("heard", f"SELECT clip_id, out_ms AS word_ms FROM ({remap('(SELECT clip_id, start_ms FROM words)', 'start_ms')})")
view("retimed", f"SELECT clip_id, pos, word, start_ms, end_ms, out_ms, out_ms + end_ms - start_ms AS out_end_ms FROM ({remap('kept_words', 'start_ms')})")


@query("v01_coalesce_spans", islands("SELECT clip_id, start_ms, end_ms FROM marks", 1))
def coalesce(ws):
    return iv.coalesce_spans(ws.marks(), 1)


@query("v02_retake_split", "SELECT * FROM (" + split_edl("SELECT * FROM edl", "SELECT * FROM drops", "retake") + ")")
def retake_split(ws):
    return iv.split_at_spans(ws.edl(), ws.drops(), "retake").select(*EDL_COLS)


view("retake_edl", split_edl("SELECT * FROM edl", "SELECT * FROM drops", "retake"))


@query("v03_wordless_fragments", """
SELECT e.clip_id, e.start_ms, e.end_ms, e.keep AND NOT wordless AS keep,
       CASE WHEN wordless THEN 'retake' ELSE reason END AS reason, wordless
FROM (SELECT r.*, r.keep AND r.clip_id IN (SELECT clip_id FROM drops) AND NOT EXISTS (
        SELECT 1 FROM words w WHERE w.clip_id = r.clip_id AND w.start_ms >= r.start_ms AND w.start_ms < r.end_ms) AS wordless
      FROM retake_edl r) e
""")
def wordless(ws):
    return iv.apply_retakes(ws.edl(), ws.drops(), ws.words())


@query("v04_manual_cut_split", "SELECT * FROM (" + split_edl("SELECT * FROM edl", "SELECT * FROM manual", "manual-cut", True) + ")")
def manual_split(ws):
    return iv.split_at_spans(ws.edl(), ws.manual(), "manual-cut", cuts_too=True).select(*EDL_COLS)


UNCOVERED = """
SELECT clip_id, a AS start_ms, b AS end_ms FROM (
  SELECT clip_id, greatest(coalesce(max(end_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, tail
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS a, start_ms AS b
  FROM (SELECT clip_id, start_ms, end_ms, 0 AS tail FROM cues
        UNION ALL SELECT clip_id, total_ms, NULL, 1 FROM clips))
WHERE b - a >= {min}
"""


@query("v05_uncovered", UNCOVERED.format(min=1000))
def uncovered(ws):
    return iv.uncovered(ws.cues(), ws.clips(), 1000)


@query("a05_overlay_coverage", f"""
SELECT c.clip_id, CAST(coalesce(sum(u.end_ms - u.start_ms), 0) AS BIGINT) AS bare_ms,
       count(*) FILTER (u.end_ms - u.start_ms >= 1000) AS gaps,
       100 * (max(c.total_ms) - CAST(coalesce(sum(u.end_ms - u.start_ms), 0) AS BIGINT)) // max(c.total_ms) AS pct
FROM clips c LEFT JOIN ({UNCOVERED.format(min=1)}) u ON u.clip_id = c.clip_id GROUP BY c.clip_id
""")
def coverage(ws):
    bare = iv.uncovered(ws.cues(), ws.clips(), 1)
    length = F.col("end_ms") - F.col("start_ms")
    per = bare.groupBy("clip_id").agg(
        F.sum(length).alias("bare_ms"), F.sum((length >= 1000).cast("long")).alias("gaps")
    )
    zero = F.lit(0).cast("long")
    return ws.clips().join(per, "clip_id", "left").select(
        "clip_id",
        F.coalesce("bare_ms", zero).alias("bare_ms"),
        F.coalesce("gaps", zero).alias("gaps"),
        F.floor(100 * (F.col("total_ms") - F.coalesce("bare_ms", zero)) / F.col("total_ms")).alias("pct"),
    )


@query("v06_output_time", f"SELECT clip_id, pos, start_ms, out_ms FROM ({remap('words', 'start_ms')})")
def output_time(ws):
    w = ws.words().select("clip_id", "pos", "start_ms")
    return iv.to_output_time(w, ws.edl(), "start_ms", "out_ms")


@query("v07_retimed_words", """
SELECT r.clip_id, r.pos, r.out_ms + b.base_ms AS out_ms, r.out_end_ms + b.base_ms AS out_end_ms
FROM retimed r JOIN (
  SELECT clip_id, CAST(coalesce(sum(kept_ms) OVER (PARTITION BY CAST(clip_id AS BIGINT) // 5 ORDER BY CAST(clip_id AS BIGINT)
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_ms FROM edl_base) b USING (clip_id)
""")
def retimed(ws):
    no = F.col("clip_id").cast("long")
    clips = ws.clips().select(F.floor(no / 5).alias("doc_id"), "clip_id", no.alias("clip_no"))
    bases = tl.clip_bases(ws.edl(), clips).drop("doc_id")
    return tl.retimed_words(ws.words(), ws.edl(), bases).select(
        "clip_id", "pos", "out_ms", (F.col("out_end_ms")).alias("out_end_ms")
    )


@query("v08_tidy", merged_cuts("""SELECT clip_id, start_ms, end_ms, keep AND end_ms - start_ms >= 1500 AS keep,
  CASE WHEN keep AND end_ms - start_ms < 1500 THEN 'noise' ELSE reason END AS reason FROM raw_edl"""))
def tidy(ws):
    return iv.tidy(gp.raw_cut_list(ws.words(), ws.gaps(), SHIPPED), 1500)


HOOK_PIECES = f"""
SELECT clip_id, start_ms + lo - o AS start_ms, start_ms + hi - o AS end_ms, keep, reason,
       CASE WHEN lo >= 12000 THEN -1 WHEN lo >= 8000 THEN 2 WHEN lo >= 4000 THEN 1 ELSE 0 END AS section
FROM (
  SELECT *, pt AS lo, lead(pt) OVER (PARTITION BY clip_id, start_ms ORDER BY pt) AS hi FROM (
    SELECT *, unnest(list_distinct(list_concat([o, o + end_ms - start_ms],
             [b FOR b IN [0, 4000, 8000, 12000] IF b > o + 1 AND b < o + end_ms - start_ms - 1]))) AS pt
    FROM (SELECT * EXCLUDE (out_ms), out_ms AS o FROM ({remap('(SELECT * FROM edl WHERE keep)', 'start_ms')}))))
WHERE hi IS NOT NULL
UNION ALL SELECT clip_id, start_ms, end_ms, keep, reason, NULL FROM edl WHERE NOT keep
"""
view("hook_cuts", f"""
SELECT p.clip_id, h.hook AS target, p.start_ms, p.end_ms,
       p.keep AND coalesce(p.section IN (-1, h.hook), false) AS keep,
       CASE WHEN p.keep AND p.section NOT IN (-1, h.hook) THEN 'outtake' ELSE p.reason END AS reason,
       CAST(p.section AS BIGINT) AS section
FROM ({HOOK_PIECES}) p JOIN hooks h USING (clip_id)
""")


@query("v09_hook_cut_lists", "SELECT * REPLACE (coalesce(section, -2) AS section) FROM hook_cuts")
def hook_cuts(ws):
    h = tl.hook_edl(ws.edl(), ws.hooks())
    return h.withColumn("section", F.coalesce("section", F.lit(-2).cast("long")))


@query("v09_hook_durations", """
SELECT clip_id, target, CAST(coalesce(sum(end_ms - start_ms) FILTER (keep AND section = target), 0) AS BIGINT) AS hook_ms
FROM hook_cuts GROUP BY clip_id, target
""")
def hook_durations(ws):
    h = tl.hook_edl(ws.edl(), ws.hooks())
    mine = F.col("keep") & (F.col("section") == F.col("target"))
    return h.groupBy("clip_id", "target").agg(
        F.coalesce(
            F.sum(F.when(mine, F.col("end_ms") - F.col("start_ms"))), F.lit(0).cast("long")
        ).alias("hook_ms")
    )


@query("v10_first_end_merge", """
WITH RECURSIVE numbered AS MATERIALIZED (
  SELECT clip_id, start_ms, min(end_ms) AS end_ms, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms) AS rn
  FROM marks GROUP BY clip_id, start_ms),
fold AS (
  SELECT clip_id, rn, start_ms AS s, end_ms AS e FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.clip_id, n.rn, CASE WHEN n.start_ms < f.e THEN f.s ELSE n.start_ms END,
         CASE WHEN n.start_ms < f.e THEN least(f.e, n.end_ms) ELSE n.end_ms END
  FROM fold f JOIN numbered n ON n.clip_id = f.clip_id AND n.rn = f.rn + 1)
SELECT clip_id, s AS start_ms, arg_max(e, rn) AS end_ms FROM fold GROUP BY clip_id, s
""")
def first_end(ws):
    return iv.merge_to_first_end(ws.marks())


@query("v11_bridge", islands("SELECT clip_id, start_ms, end_ms FROM drops", 1000))
def bridged(ws):
    return iv.bridge(ws.drops(), 1000)


view("manual_edl", split_edl("SELECT * FROM edl", "SELECT * FROM manual", "manual-cut", True))
view("absorbed_edl", """
SELECT clip_id, start_ms, end_ms, keep AND NOT sliver AS keep,
       CASE WHEN sliver THEN 'sliver-absorbed' ELSE reason END AS reason
FROM (SELECT *, keep AND end_ms - start_ms < 900 AND (coalesce(lag(ours) OVER w, false) OR coalesce(lead(ours) OVER w, false)) AS sliver
      FROM (SELECT *, NOT keep AND reason = 'manual-cut' AS ours FROM manual_edl)
      WINDOW w AS (PARTITION BY clip_id ORDER BY start_ms, end_ms))
""")


@query("v12_absorb_slivers", "SELECT * FROM absorbed_edl")
def slivers(ws):
    return iv.absorb_slivers(
        iv.split_at_spans(ws.edl(), ws.manual(), "manual-cut", cuts_too=True), 900
    )


@query("v14_visible_overlay", """
SELECT s.clip_id, s.start_ms, s.end_ms, c.pos, c.kind FROM (
  SELECT clip_id, pt AS start_ms, lead(pt) OVER (PARTITION BY clip_id ORDER BY pt) AS end_ms
  FROM (SELECT DISTINCT clip_id, unnest([start_ms, end_ms]) AS pt FROM cues)) s
JOIN cues c ON c.clip_id = s.clip_id AND c.start_ms < s.end_ms AND c.end_ms > s.start_ms
QUALIFY row_number() OVER (PARTITION BY s.clip_id, s.start_ms ORDER BY c.kind = 'video' DESC, c.kind <> 'logo' DESC, c.start_ms DESC, c.pos) = 1
""")
def visible(ws):
    return tl.visible_overlay(ws.cues())


@query("v15_widen_cut", """
SELECT m.clip_id, m.start_ms AS asked_start_ms, m.end_ms AS asked_end_ms,
  coalesce((SELECT min(w.start_ms) FROM words w WHERE w.clip_id = m.clip_id AND w.start_ms < m.start_ms AND m.start_ms < w.end_ms), m.start_ms) AS start_ms,
  coalesce((SELECT max(w.end_ms) FROM words w WHERE w.clip_id = m.clip_id AND w.start_ms < m.end_ms AND m.end_ms < w.end_ms), m.end_ms) AS end_ms
FROM manual m
""")
def widen(ws):
    return tl.widen_to_words(ws.manual(), ws.words())


view("keep_spans", """
SELECT clip_id, start_ms + CASE WHEN start_ms % 3 = 0 THEN 5 ELSE start_ms % 2 END AS start_ms, end_ms
FROM edl WHERE keep
""")


def keep_spans(ws):
    nudge = F.when(F.col("start_ms") % 3 == 0, 5).otherwise(F.col("start_ms") % 2)
    return ws.edl().where("keep").select(
        "clip_id", (F.col("start_ms") + nudge).alias("start_ms"), "end_ms"
    )


@query("v16_stale_spans", """
SELECT k.clip_id, k.start_ms, k.end_ms FROM keep_spans k
WHERE NOT (EXISTS (SELECT 1 FROM (SELECT clip_id, end_ms AS pt FROM cut_runs UNION ALL SELECT clip_id, min(start_ms) FROM edl WHERE keep GROUP BY 1) s
             WHERE s.clip_id = k.clip_id AND abs(s.pt - k.start_ms) < 2)
       AND EXISTS (SELECT 1 FROM (SELECT clip_id, start_ms AS pt FROM cut_runs UNION ALL SELECT clip_id, arg_max(end_ms, start_ms) FROM edl WHERE keep GROUP BY 1) s
             WHERE s.clip_id = k.clip_id AND abs(s.pt - k.end_ms) < 2))
""")
def stale(ws):
    return tl.stale_spans(keep_spans(ws), ws.edl())


@query("v17_kept_inside", """
SELECT m.clip_id, m.start_ms, m.end_ms, CAST(coalesce(sum(least(m.end_ms, e.end_ms) - greatest(m.start_ms, e.start_ms)), 0) AS BIGINT) AS kept_ms
FROM marks m LEFT JOIN edl e ON e.keep AND e.clip_id = m.clip_id AND e.start_ms < m.end_ms AND e.end_ms > m.start_ms
GROUP BY 1, 2, 3
""")
def kept_inside(ws):
    return tl.kept_inside(ws.marks(), ws.edl())


@query("v18_placed_spans", """
WITH RECURSIVE numbered AS MATERIALIZED (
  SELECT clip_id, start_ms, end_ms, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms) AS rn FROM marks),
fold AS (
  SELECT clip_id, rn, start_ms AS a, end_ms AS d, end_ms - start_ms >= 500 AS ok,
         CASE WHEN end_ms - start_ms >= 500 THEN end_ms ELSE -1 END AS free FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.clip_id, n.rn, greatest(n.start_ms, f.free), n.end_ms, n.end_ms - greatest(n.start_ms, f.free) >= 500,
         CASE WHEN n.end_ms - greatest(n.start_ms, f.free) >= 500 THEN n.end_ms ELSE f.free END
  FROM fold f JOIN numbered n ON n.clip_id = f.clip_id AND n.rn = f.rn + 1)
SELECT clip_id, a AS start_ms, CAST(a + CASE WHEN d - a < 900 THEN (d - a) * 400 // 900 ELSE 400 END AS BIGINT) AS full_ms,
       CAST(a + CASE WHEN d - a < 900 THEN (d - a) * 400 // 900 ELSE d - a - 500 END AS BIGINT) AS release_ms, d AS end_ms
FROM fold WHERE ok
""")
def placed(ws):
    return tl.place_zooms(ws.marks().select("clip_id", "start_ms", "end_ms"), 400, 500)


@query("v19_clamp_to_hook", """
SELECT clip_id, pos, start_ms, e AS end_ms FROM (
  SELECT *, CASE WHEN start_ms < 12000 THEN least(end_ms, 12000) ELSE end_ms END AS e FROM cues)
WHERE e - start_ms >= 50
""")
def clamp(ws):
    ends = ws.hooks().groupBy("clip_id").agg(F.max("end_ms").alias("hook_end_ms"))
    return tl.clamp_to_hook(ws.cues().select("clip_id", "pos", "start_ms", "end_ms"), ends)


@query("v20_apply_trims", "SELECT split_part(k, '#', 1) AS clip_id, CAST(split_part(k, '#', 2) AS BIGINT) AS target, start_ms, end_ms, keep, reason FROM (SELECT clip_id AS k, start_ms, end_ms, keep, reason FROM ("
       + split_edl("SELECT clip_id || '#' || target AS clip_id, start_ms, end_ms, keep, reason FROM hook_cuts",
                   "SELECT d.clip_id || '#' || h.hook AS clip_id, d.start_ms, d.end_ms FROM drops d JOIN hooks h USING (clip_id)", "trim") + "))")
def trims(ws):
    """The cut list of every (clip, hook), with the spans cut out."""
    return tl.trim_variants(ws.edl(), ws.hooks(), ws.drops()).select("clip_id", "target", *EDL_COLS[1:])


@query("v21_overlay_shrink", f"""
SELECT clip_id, pos, end_ms - start_ms AS was_ms, b - a AS now_ms, b - a <= 10 AS dropped FROM (
  SELECT * EXCLUDE (out_ms), out_ms AS b FROM ({remap('(SELECT * EXCLUDE (out_ms), out_ms AS a FROM (' + remap('cues', 'start_ms') + '))', 'end_ms')}))
WHERE (b - a) * 10 < (end_ms - start_ms) * 9
""")
def shrink(ws):
    return tl.shrink_report(ws.cues(), ws.edl())


@query("j04_words_outside_cuts", "SELECT clip_id, pos FROM words w WHERE NOT EXISTS (SELECT 1 FROM ("
       + islands("SELECT clip_id, start_ms, end_ms FROM retake_edl WHERE NOT keep", 1)
       + ") c WHERE c.clip_id = w.clip_id AND c.start_ms <= w.start_ms AND w.start_ms < c.end_ms - 1)")
def outside(ws):
    edl = iv.split_at_spans(ws.edl(), ws.drops(), "retake")
    return tl.kept_words(ws.words().select("clip_id", "pos", "start_ms"), edl).select("clip_id", "pos")


@query("j05_drop_covered", """
SELECT c.clip_id, c.pos FROM cues c WHERE NOT EXISTS (SELECT 1 FROM drop_runs d WHERE d.clip_id = c.clip_id
  AND d.start_ms <= c.start_ms AND c.start_ms < d.end_ms - 1)
""")
def dropped(ws):
    return tl.drop_covered(ws.cues(), ws.drops()).select("clip_id", "pos")


@query("j07_words_in_ranges", """
SELECT DISTINCT w.clip_id, w.pos FROM words w JOIN drops d ON d.clip_id = w.clip_id
WHERE (w.start_ms + w.end_ms) / 2.0 BETWEEN d.start_ms AND d.end_ms
""")
def in_ranges(ws):
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    return iv.points_in_spans(ws.words(), ws.drops(), mid, "left_semi", closed=True).select("clip_id", "pos")


@query("j09_active_word", """
SELECT t.clip_id, t.t_ms, coalesce(CASE WHEN t.t_ms <= w.end_ms + 300 THEN w.pos END, -1) AS pos FROM (
  SELECT clip_id, CAST(unnest(range(0, total_ms, 1000)) AS BIGINT) AS t_ms FROM clips) t
ASOF LEFT JOIN words w ON w.clip_id = t.clip_id AND w.start_ms <= t.t_ms
""")
def active(ws):
    t = ws.clips().select(
        "clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_ms") - 1, F.lit(1000).cast("long"))).alias("t_ms")
    )
    a = tl.active_word(t, ws.words(), 300)
    return a.withColumn("pos", F.coalesce("pos", F.lit(-1).cast("long")))


@query("j16_overlays_on_cuts", """
SELECT c.clip_id, c.pos, m.start_ms AS cut_ms, CASE WHEN c.start_ms >= m.start_ms - 50 THEN 'vanishes' ELSE 'crossing' END AS fate
FROM cues c JOIN manual m ON m.clip_id = c.clip_id AND c.start_ms < m.end_ms AND c.end_ms > m.start_ms
""")
def on_cuts(ws):
    p = iv.overlapping(ws.cues(), ws.manual())
    fate = F.when(F.col("start_ms") >= F.col("r_start_ms") - 50, "vanishes").otherwise("crossing")
    return p.select("clip_id", "pos", F.col("r_start_ms").alias("cut_ms"), fate.alias("fate"))


@query("j18_snap_windows", """
WITH e AS (SELECT clip_id, hook, start_ms AS t, 'a' AS side FROM hooks UNION ALL SELECT clip_id, hook, end_ms, 'b' FROM hooks),
s AS (SELECT e.*, (SELECT max(seam_ms) FROM seams WHERE seams.clip_id = e.clip_id AND seam_ms BETWEEN t - 1000 AND t + 1) AS seam FROM e),
r AS (SELECT s.*, CASE WHEN seam IS NULL THEN t
  WHEN EXISTS (SELECT 1 FROM heard h WHERE h.clip_id = s.clip_id AND h.word_ms > seam + 1 AND h.word_ms < t - 1) THEN t
  ELSE least(seam, t) END AS v FROM s)
SELECT clip_id, hook, max(v) FILTER (side = 'a') AS start_ms, max(v) FILTER (side = 'b') AS end_ms FROM r GROUP BY 1, 2
""")
def snap(ws):
    return tl.snap_windows(ws.hooks(), ws.words(), ws.edl())


@query("j21_gap_fates", """
SELECT g.clip_id, g.pos, g.gap_type, g.duration_ms, CASE
  WHEN NOT g.cut THEN 'kept: ' || g.skip_reason
  WHEN c.cs IS NULL AND NOT (b.boundary_clause OR g.duration_ms >= 1000) THEN 'kept: mid_sentence_floor'
  WHEN c.cs IS NULL THEN 'kept: no_room'
  WHEN abs(c.cs - g.speech_end) > 5 THEN 'cut: min_keep_floor' ELSE 'cut' END AS fate,
  g.speech_onset - 150 - g.speech_end AS room_ms
FROM gaps g JOIN bounded b USING (clip_id, pos)
LEFT JOIN (SELECT g.clip_id, g.pos, min(e.start_ms) AS cs FROM gaps g JOIN edl e ON NOT e.keep AND e.clip_id = g.clip_id
           AND e.start_ms < g.end_ms AND e.end_ms > g.effective_start GROUP BY 1, 2) c USING (clip_id, pos)
""")
def fates(ws):
    return tl.gap_fates(ws.gaps(), ws.words(), ws.edl(), 600, 1000, 150)


@query("j24_anchor_in_keep", """
SELECT clip_id, pos FROM cues c WHERE EXISTS (SELECT 1 FROM edl e WHERE e.keep AND e.clip_id = c.clip_id
  AND e.start_ms <= c.start_ms AND c.start_ms < e.end_ms)
""")
def anchors(ws):
    keeps = ws.edl().where("keep").select("clip_id", "start_ms", "end_ms")
    return iv.points_in_spans(ws.cues(), keeps, F.col("start_ms"), "left_semi").select("clip_id", "pos")


@query("j23_text_in_uncovered", f"""
SELECT u.clip_id, u.start_ms, u.end_ms, count(w.pos) AS n_words, coalesce(string_agg(w.word, ' ' ORDER BY w.pos), '') AS said
FROM ({UNCOVERED.format(min=1000)}) u LEFT JOIN words w ON w.clip_id = u.clip_id AND w.start_ms >= u.start_ms AND w.start_ms < u.end_ms
GROUP BY 1, 2, 3
""")
def spoken_in_gaps(ws):
    from wordloom.operators.quality import text_in_spans

    return text_in_spans(iv.uncovered(ws.cues(), ws.clips(), 1000), ws.words())


@query("w13_splice_times", """
SELECT clip_id, at_ms FROM (
  SELECT clip_id, keep, lag(keep) OVER w AS pk, CAST(coalesce(sum(CASE WHEN keep THEN end_ms - start_ms ELSE 0 END) OVER (
    w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ms FROM edl WINDOW w AS (PARTITION BY clip_id ORDER BY start_ms))
WHERE keep AND NOT pk AND at_ms > 0
""")
def splices(ws):
    return tl.splice_times(ws.edl())


@query("a02_edit_durations", """
SELECT a.clip_id, a.k AS keep_before, a.c AS cut_before, b.k AS keep_after, b.c AS cut_after FROM
 (SELECT clip_id, CAST(sum(CASE WHEN keep THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS k, CAST(sum(CASE WHEN keep THEN 0 ELSE end_ms - start_ms END) AS BIGINT) AS c FROM edl GROUP BY 1) a
JOIN (SELECT clip_id, CAST(sum(CASE WHEN keep THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS k, CAST(sum(CASE WHEN keep THEN 0 ELSE end_ms - start_ms END) AS BIGINT) AS c FROM absorbed_edl GROUP BY 1) b USING (clip_id)
""")
def edit_durations(ws):
    def per(edl, tag):
        n = F.col("end_ms") - F.col("start_ms")
        return edl.groupBy("clip_id").agg(
            F.sum(F.when(F.col("keep"), n).otherwise(0)).alias("keep_" + tag),
            F.sum(F.when(F.col("keep"), 0).otherwise(n)).alias("cut_" + tag),
        )

    after = iv.absorb_slivers(iv.split_at_spans(ws.edl(), ws.manual(), "manual-cut", cuts_too=True), 900)
    return per(ws.edl(), "before").join(per(after, "after"), "clip_id")


@query("a06_cut_runs", """
SELECT clip_id, min(start_ms) AS start_ms, arg_max(end_ms, start_ms) AS end_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS cut_ms,
  (SELECT string_agg(reason, '/' ORDER BY f) FROM (SELECT reason, min(s) AS f FROM (SELECT unnest(list(r.reason)) AS reason, unnest(list(r.start_ms)) AS s) GROUP BY 1)) AS reasons
FROM (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start_ms) AS ks FROM retake_edl) r
WHERE NOT keep GROUP BY clip_id, ks
""".replace("(SELECT string_agg(reason, '/' ORDER BY f) FROM (SELECT reason, min(s) AS f FROM (SELECT unnest(list(r.reason)) AS reason, unnest(list(r.start_ms)) AS s) GROUP BY 1)) AS reasons",
            "string_agg(reason, '/' ORDER BY start_ms) FILTER (first_of) AS reasons")
 .replace("FROM (SELECT *, sum(", "FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, ks, reason ORDER BY start_ms) = 1 AS first_of FROM (SELECT *, sum(")
 .replace("FROM retake_edl) r\nWHERE NOT keep GROUP", "FROM retake_edl) WHERE NOT keep) r\nGROUP"))
def cut_runs(ws):
    return tl.cut_run_summary(iv.split_at_spans(ws.edl(), ws.drops(), "retake"))


@query("d32_caption_frames", """
SELECT clip_id, pos, line, slot, f AS first_frame, l AS last_frame FROM (
  SELECT clip_id, pos, line, slot, CAST(ceil(start_ms * 30 / 1000.0) AS BIGINT) AS f,
         least(CAST(ceil(nx * 30 / 1000.0) AS BIGINT) - 1, CAST(floor((end_ms + 300) * 30 / 1000.0) AS BIGINT), CAST(floor(stop * 30 / 1000.0) AS BIGINT)) AS l
  FROM (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY pos) AS nx, max(end_ms) OVER (PARTITION BY clip_id) AS stop FROM line_words))
WHERE f <= l
""")
def frames(ws):
    from wordloom.plans.word_plans import lines_of

    return tl.caption_runs(lines_of(ws).select("clip_id", "pos", "line", "slot", "start_ms", "end_ms"), 30, 300)


@query("d27_manual_edit", merged_cuts("SELECT * FROM absorbed_wide"))
def manual_edit(ws):
    from wordloom.operators.variants import manual_edit as edit

    return edit(ws.edl(), ws.words(), ws.manual(), floor_ms=900)


view("wide_manual", """
SELECT m.clip_id,
  coalesce((SELECT min(w.start_ms) FROM words w WHERE w.clip_id = m.clip_id AND w.start_ms < m.start_ms AND m.start_ms < w.end_ms), m.start_ms) AS start_ms,
  coalesce((SELECT max(w.end_ms) FROM words w WHERE w.clip_id = m.clip_id AND w.start_ms < m.end_ms AND m.end_ms < w.end_ms), m.end_ms) AS end_ms
FROM manual m
""")
view("wide_edl", split_edl("SELECT * FROM edl", "SELECT * FROM wide_manual", "manual-cut", True))
view("absorbed_wide", """
SELECT clip_id, start_ms, end_ms, keep AND NOT sliver AS keep,
       CASE WHEN sliver THEN 'sliver-absorbed' ELSE reason END AS reason
FROM (SELECT *, keep AND end_ms - start_ms < 900 AND (coalesce(lag(ours) OVER w, false) OR coalesce(lead(ours) OVER w, false)) AS sliver
      FROM (SELECT *, NOT keep AND reason = 'manual-cut' AS ours FROM wide_edl)
      WINDOW w AS (PARTITION BY clip_id ORDER BY start_ms, end_ms))
""")
