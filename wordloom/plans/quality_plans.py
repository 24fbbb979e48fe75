"""Queries over reports, evidence, cues, sounds and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import fuzzy
from wordloom.operators import cues as cu
from wordloom.operators import ideas as idl
from wordloom.operators import intervals as iv
from wordloom.operators import quality as ql
from wordloom.operators import repair as rp
from wordloom.operators import retakes as rt
from wordloom.operators import timeline as tl
from wordloom.operators import variants as va
from wordloom.operators import words as wd
from wordloom.params import SHIPPED
from wordloom.plans.oracle_views import view
from wordloom.plans.registry import query


def retake_edl(ws):
    return ws.stored("retake_edl", lambda: iv.split_at_spans(ws.edl(), ws.drops(), "retake"))


def script_lines(ws):
    """Every sentence of a clip, slightly reworded, and every fifth one of the next clip's."""
    s = ws.sentence_words()
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("pos") % 9 != 4, F.col("word")).otherwise("see")))),
            lambda x: x["col2"],
        ),
        " ",
    )
    t = s.groupBy("clip_id", "sentence").agg(text.alias("text"))
    own = t.select("clip_id", (F.col("sentence") * 2).alias("line_id"), "text")
    after = (F.col("clip_id").cast("long") + 1).cast("string")
    other = t.where("sentence % 5 = 0").select(after.alias("clip_id"), (F.col("sentence") * 2 + 1).alias("line_id"), "text")
    return own.unionByName(other)


@query("j15_best_line_windows")
def line_windows(ws):
    w = ws.words().withColumn("idx", F.col("pos"))
    b = fuzzy.best_windows(script_lines(ws), w)
    return b.select("clip_id", "line_id", F.round("ratio", 4).alias("ratio"), "first_idx", "size")


@query("d16_script_coverage")
def coverage(ws):
    return ws.stored(
        "coverage",
        lambda: ql.script_coverage(script_lines(ws), ws.words(), tl.kept_words(ws.words(), retake_edl(ws))),
    )


def shots(ws):
    words = F.split("text", " ")
    return script_lines(ws).select(
        "clip_id", "line_id", "text", F.get(words, F.lit(1)).alias("show"), F.coalesce(F.get(words, F.lit(3)), F.lit("")).alias("go")
    )


@query("d26_evidence_reconcile")
def evidence(ws):
    return ws.stored("evidence", lambda: ql.reconcile_evidence(shots(ws), ws.words()))


@query("d26_unsupported_claims")
def unsupported(ws):
    r = ql.reconcile_evidence(shots(ws), ws.words(), found_only=True)
    w = ws.words().withColumn("word", F.when(F.col("pos") % 37 == 1, F.concat("word", F.lit("5%"))).otherwise(F.col("word")))
    return ql.unsupported_claims(r, w)


def detected_retakes(ws):
    """Judged candidates and cut ranges of the conversations, the corpus that d17 reviews."""
    takes = ws.stored("takes_conversations", lambda: rt.take_facts(ws.words(), SHIPPED))
    pairs = ws.stored("retake_pairs_conversations", lambda: rt.judged_pairs(takes, SHIPPED))
    return pairs, ws.stored("retakes_conversations", lambda: rt.combined_ranges(takes, pairs, SHIPPED))


@query("d17_review_flags")
def flags(ws):
    pairs, ranges = detected_retakes(ws)
    edl = ws.stored("detected_edl", lambda: iv.split_at_spans(ws.edl(), ranges, "retake"))
    cov = ws.stored("detected_coverage", lambda: ql.script_coverage(script_lines(ws), ws.words(), tl.kept_words(ws.words(), edl), fates_only=True))
    capped = rp.expand_to_sentences(rp.raw_windows(ws.words(), 700, 0.35, 300, 600, 100), ws.words(), 600)
    return ql.review_flags(ws.words(), edl, ws.gaps(), pairs, ranges, 600, 750, 200, cov, capped)


@query("o06_flag_order", """
SELECT clip_id, priority, at_ms, kind, detail FROM (
  SELECT clip_id, CAST(4 AS BIGINT) AS priority, start_ms AS at_ms, 'micro keep' AS kind, CAST(end_ms - start_ms AS VARCHAR) AS detail FROM edl WHERE keep AND end_ms - start_ms < 900
  UNION ALL SELECT clip_id, 5, start_ms, 'large kept gap', gap_type || ': ' || skip_reason FROM gaps WHERE NOT cut AND duration_ms > 60
  UNION ALL SELECT clip_id, 1, start_ms, 'long retake', CAST(end_ms - start_ms AS VARCHAR) FROM drops WHERE end_ms - start_ms >= 8000)
ORDER BY priority, at_ms
""")
def flag_order(ws):
    n = F.col("end_ms") - F.col("start_ms")

    def flag(df, p, kind, detail):
        return df.select("clip_id", F.lit(p).cast("long").alias("priority"), F.col("start_ms").alias("at_ms"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))

    a = flag(ws.edl().where(F.col("keep") & (n < 900)), 4, "micro keep", n)
    b = flag(ws.gaps().where(~F.col("cut") & (F.col("duration_ms") > 60)), 5, "large kept gap", F.concat("gap_type", F.lit(": "), "skip_reason"))
    c = flag(ws.drops().where(n >= 8000), 1, "long retake", n)
    return a.unionByName(b).unionByName(c).orderBy("priority", "at_ms")


@query("w16_final_transcript", """
WITH k AS (SELECT w.* FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs c WHERE c.clip_id = w.clip_id AND c.start_ms <= w.start_ms AND w.start_ms < c.end_ms - 1)),
m AS (SELECT clip_id, min(start_ms) AS at_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS cut_ms, string_agg(reason, '/' ORDER BY start_ms) FILTER (f) AS reasons FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id, ks, reason ORDER BY start_ms) = 1 AS f FROM (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start_ms) AS ks FROM retake_edl) WHERE NOT keep) GROUP BY clip_id, ks),
t AS (SELECT clip_id, start_ms AS at_ms, 1 AS side, 'word' AS kind, CASE WHEN confidence < 0.55 THEN '‹' || word || '›?' ELSE word END AS text, regexp_matches(rtrim(word, '''"”’)'), '[.!?]$') AS closes FROM k
  UNION ALL SELECT clip_id, at_ms, 0, 'cut', cut_ms || 'ms ' || reasons, true FROM m WHERE cut_ms >= 200 OR regexp_matches(reasons, '(^|/)(silence|retake)(/|$)'))
SELECT clip_id, at_ms, kind, text, CAST(sum(CASE WHEN coalesce(b, true) OR kind = 'cut' THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY at_ms, side) AS BIGINT) AS line
FROM (SELECT *, lag(closes) OVER (PARTITION BY clip_id ORDER BY at_ms, side) AS b FROM t)
""")
def transcript(ws):
    return ql.final_transcript(ws.strips(), retake_edl(ws), 200, 0.55)


from wordloom.plans.oracle_views import islands  # noqa: E402

view("runs", islands("SELECT clip_id, start_ms, end_ms FROM retake_edl WHERE NOT keep", 1))


@query("w17_timeline", """
SELECT clip_id, pos, 'WORD' AS kind, start_ms AS at_ms, word AS content FROM words
UNION ALL
SELECT g.clip_id, g.pos, upper(g.gap_type), g.effective_start, CASE
  WHEN NOT g.cut THEN 'kept: ' || g.skip_reason
  WHEN c.cs IS NULL AND NOT (b.boundary_clause OR g.duration_ms >= 1000) THEN 'kept: mid_sentence_floor'
  WHEN c.cs IS NULL THEN 'kept: no_room' WHEN abs(c.cs - g.speech_end) > 5 THEN 'cut: min_keep_floor' ELSE 'cut' END
FROM gaps g JOIN bounded b USING (clip_id, pos)
LEFT JOIN (SELECT g.clip_id, g.pos, min(e.start_ms) AS cs FROM gaps g JOIN edl e ON NOT e.keep AND e.clip_id = g.clip_id
           AND e.start_ms < g.end_ms AND e.end_ms > g.effective_start GROUP BY 1, 2) c USING (clip_id, pos)
""")
def timeline(ws):
    fates = tl.gap_fates(ws.gaps(), ws.words(), ws.edl(), 600, 1000, 150)
    return ql.timeline(ws.words(), fates, ws.gaps())


@query("w18_reset_sections", """
SELECT c.clip_id, c.pos, (SELECT count(*) FROM (SELECT DISTINCT clip_id, t FROM (SELECT clip_id, unnest([start_ms, end_ms]) AS t FROM hooks) WHERE t > 0) e WHERE e.clip_id = c.clip_id AND e.t <= c.start_ms) AS section FROM cues c
""")
def sections(ws):
    e = ws.hooks().select("clip_id", F.explode(F.array("start_ms", "end_ms")).alias("at_ms"))
    return cu.section_of(ws.cues().select("clip_id", "pos", "start_ms"), e).select("clip_id", "pos", "section")


@query("f12_censored_words", r"""
SELECT clip_id, pos, CASE WHEN starts_with(c, 'th') OR starts_with(c, 'sch') THEN regexp_replace(word, '^(.*?[A-Za-z])[aeiouAEIOU](.*)$', '\1*\2', 's') ELSE word END AS word
FROM (SELECT *, regexp_replace(lower(word), '[^a-z]', '', 'g') AS c FROM words)
""")
def censored(ws):
    return ws.words().select("clip_id", "pos", cu.censored(F.col("word"), ["th", "sch"]).alias("word"))


@query("f13_entity_slugs", r"""
SELECT clip_id, pos, array_to_string(list_distinct_ordered, '|') AS slugs FROM (
  SELECT clip_id, pos, [v[i] FOR i IN range(1, len(v) + 1) IF list_position(v, v[i]) = i] AS list_distinct_ordered FROM (
    SELECT clip_id, pos, list_concat(b, [x FOR x IN [CASE s WHEN 'the' THEN 'maker-the' WHEN 'ti' THEN 'alias-ti' END FOR s IN b] IF x IS NOT NULL]) AS v FROM (
      SELECT clip_id, pos, [x FOR x IN [raw, bare, CASE WHEN raw LIKE '%s' AND length(raw) > 3 THEN left(raw, -1) END, CASE WHEN bare LIKE '%s' AND length(bare) > 3 THEN left(bare, -1) END] IF x IS NOT NULL AND x <> ''] AS b FROM (
        SELECT clip_id, pos, trim(regexp_replace(regexp_replace(lower(word), '[ _]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-') AS raw,
          trim(regexp_replace(regexp_replace(lower(regexp_replace(word, '[''’]s$|s[''’]$|[''’]$', '', 'i')), '[ _]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-') AS bare FROM words))))
""")
def slugs(ws):
    v = cu.slug_variants(F.col("word"), {"ti": "alias-ti"}, {"the": "maker-the"})
    return ws.words().select("clip_id", "pos", F.array_join(v, "|").alias("slugs"))


@query("f16_stable_draws", """
SELECT clip_id, pos, CAST(list_reduce(list_concat([0], [CAST(instr('0123456789abcdef', substr(h, i, 1)) - 1 AS BIGINT) FOR i IN range(1, 41)]), lambda a, d: (a * 16 + d) % 1000) AS DOUBLE) / 1000 AS draw
FROM (SELECT clip_id, pos, sha1(word || ':crop') AS h FROM words)
""")
def draws(ws):
    return ws.words().select("clip_id", "pos", cu.stable_draw(F.col("word"), "crop").alias("draw"))


@query("f22_gains", """
SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN value / 10 + coalesce(CASE WHEN event_id % 5 <> 0 THEN -14.0 END, -16.0) + 6 - (value - 20)
  WHEN event_id % 5 = 0 THEN value / 10 - 18 ELSE value / 10 - 14.0 - 18 - value END, 6) AS gain FROM events
""")
def gains(ws):
    v, i = F.col("value"), F.col("event_id")
    voice = F.when(i % 5 != 0, F.lit(-14.0))
    peak = F.when(i % 2 == 0, v - 20)
    g = cu.final_gain(v / 10, voice, v, 18.0, peak, 6.0)
    return ws.table("events").select("event_id", F.round(g, 6).alias("gain"))


@query("j19_nearest_sentence_start", """
SELECT d.clip_id, d.due_ms, coalesce(arg_min(s.at_ms, abs(s.at_ms - d.due_ms) * 100000000 + s.at_ms), d.due_ms) AS at_ms
FROM (SELECT clip_id, CAST(unnest(range(5000, total_ms, 5000)) AS BIGINT) AS due_ms FROM clips) d
LEFT JOIN (SELECT clip_id, min(start_ms) AS at_ms FROM sented GROUP BY clip_id, sentence) s ON s.clip_id = d.clip_id AND abs(s.at_ms - d.due_ms) <= 800 GROUP BY 1, 2
""")
def nearest(ws):
    step = F.sequence(F.lit(5000).cast("long"), F.col("total_ms") - 1, F.lit(5000).cast("long"))
    due = ws.clips().where("total_ms > 5000").select("clip_id", F.explode(step).alias("due_ms"))
    starts = ws.sentence_words().groupBy("clip_id", "sentence").agg(F.min("start_ms").alias("at_ms"))
    return cu.nearest_start(due, starts, 800)


view("placed_sounds", "SELECT clip_id, pos, start_ms + pos % 90 AS at_ms, ['whoosh', 'click'][pos % 2 + 1] AS sound FROM words WHERE length(word) >= 8")
view("moments", "SELECT clip_id, start_ms AS at_ms FROM cues UNION ALL SELECT clip_id, start_ms FROM edl WHERE NOT keep")


def placed_sounds(ws):
    return ws.words().where(F.char_length("word") >= 8).select(
        "clip_id", "pos", (F.col("start_ms") + F.col("pos") % 90).alias("at_ms"), F.when(F.col("pos") % 2 == 0, "whoosh").otherwise("click").alias("sound")
    )


def moments(ws):
    return ws.cues().select("clip_id", F.col("start_ms").alias("at_ms")).unionByName(
        ws.edl().where("not keep").select("clip_id", F.col("start_ms").alias("at_ms"))
    )


@query("j20_sounds_on_moments", """
SELECT p.clip_id, p.pos, EXISTS (SELECT 1 FROM moments m WHERE m.clip_id = p.clip_id AND abs(m.at_ms - p.at_ms) <= 50) AS lands FROM placed_sounds p
""")
def on_moments(ws):
    p, m = placed_sounds(ws), moments(ws)
    good = cu.near_moments(p, m, 50, "left_semi").select("clip_id", "pos", F.lit(True).alias("lands"))
    bad = cu.near_moments(p, m, 50, "left_anti").select("clip_id", "pos", F.lit(False).alias("lands"))
    return good.unionByName(bad)


@query("d21_sound_plan")
def sound_plan(ws):
    names = {"video": ["riser"], "logo": ["pop", "tick"], "image": ["thud", "snap", "clack"], "card": ["key"]}
    rows = [(k, n, v, k == "card") for n, (k, v) in enumerate(names.items())]
    rules = ws.spark.createDataFrame(rows, "kind string, rank int, sounds array<string>, rapid boolean")
    ev = ws.cues().select("clip_id", F.col("start_ms").alias("at_ms"), "kind", F.lit(0).cast("long").alias("idx"))
    placed = cu.near_moments(placed_sounds(ws), moments(ws), 50, "left_semi").select("clip_id", "at_ms", "sound")
    return cu.plan_sounds(ev, placed, rules, ws.clips(), 800)


view("sound_library", "SELECT * FROM (VALUES ('whoosh', 2600, -3.5, 4000), ('click', 15, -9.0, 120)) t(sound, peak_ms, peak_db, length_ms)")
view("played_sounds", "SELECT clip_id, pos, at_ms, CASE WHEN pos % 5 = 0 THEN 'gone' || pos % 3 ELSE sound END AS sound, CAST(pos % 4 AS DOUBLE) AS gain_db FROM placed_sounds")


def aligned_sounds(ws):
    p = F.col("pos")
    played = placed_sounds(ws).withColumn("sound", F.when(p % 5 == 0, F.concat(F.lit("gone"), (p % 3).cast("string"))).otherwise(F.col("sound")))
    library = ws.spark.createDataFrame([("whoosh", 2600, -3.5, 4000), ("click", 15, -9.0, 120)], "sound string, peak_ms bigint, peak_db double, length_ms bigint")
    return cu.align_peaks(played.withColumn("gain_db", (p % 4).cast("double")), library, ws.clips())


@query("d21_peak_aligned", """
SELECT clip_id, at_ms, sound, CAST(CASE WHEN at_ms < peak_ms THEN peak_ms - at_ms ELSE 0 END AS BIGINT) AS source_start_ms,
  CAST(CASE WHEN at_ms > peak_ms THEN at_ms - peak_ms ELSE 0 END AS BIGINT) AS start_ms,
  CAST(CASE WHEN at_ms - peak_ms + length_ms < total_ms THEN at_ms - peak_ms + length_ms ELSE total_ms END AS BIGINT) AS end_ms,
  gain_db, CAST(peak_db AS DOUBLE) AS peak_db FROM played_sounds JOIN sound_library USING (sound) JOIN clips USING (clip_id)
""")
def peak_aligned(ws):
    return aligned_sounds(ws)[0]


@query("d21_unknown_sounds", "SELECT DISTINCT clip_id, sound FROM played_sounds WHERE sound NOT IN (SELECT sound FROM sound_library)")
def unknown_sounds(ws):
    return aligned_sounds(ws)[1]


@query("d20_entity_cues")
def entity(ws):
    common = ws.words().groupBy(cu.entity_slug(F.col("word")).alias("slug")).agg(F.count("*").alias("n")).where("n >= 60 and slug <> ''")
    edges = ws.hooks().select("clip_id", F.explode(F.array("start_ms", "end_ms")).alias("at_ms"))
    return cu.entity_cues(ws.words(), common, edges, ["the"], ["of"], {"ti": "alias-ti"}, {}, 2000)


view("track_specs", """
SELECT clip_id, CASE pos % 3 WHEN 0 THEN 'calm' WHEN 1 THEN 'drive' ELSE 'gone' END AS track, start_ms, CASE WHEN pos % 2 = 0 THEN -1 ELSE end_ms END AS end_ms, CAST(pos % 5 AS DOUBLE) AS gain_db
FROM words WHERE length(word) >= 12
""")


def track_specs(ws):
    p = F.col("pos")
    return ws.words().where(F.char_length("word") >= 12).select(
        "clip_id", F.when(p % 3 == 0, "calm").when(p % 3 == 1, "drive").otherwise("gone").alias("track"), "start_ms",
        F.when(p % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("end_ms")).alias("end_ms"), (p % 5).cast("double").alias("gain_db"),
    )


@query("j25_tracks", """
SELECT c.clip_id, s.track, s.start_ms, CASE WHEN s.end_ms >= 0 THEN s.end_ms ELSE c.total_ms END AS end_ms, s.gain_db + CASE s.track WHEN 'calm' THEN -2.0 ELSE 0.5 END AS gain_db
FROM clips c JOIN (SELECT * FROM track_specs UNION ALL SELECT clip_id, 'calm', 0, -1, 0.0 FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM track_specs)) s USING (clip_id) WHERE s.track <> 'gone'
""")
def tracks(ws):
    lib = ws.spark.createDataFrame([("calm", -2.0), ("drive", 0.5)], "track string, gain_db double")
    return cu.resolve_tracks(ws.clips(), track_specs(ws), lib, "calm")[0]


@query("j25_unknown_tracks", "SELECT clip_id, track FROM track_specs WHERE track = 'gone'")
def unknown_tracks(ws):
    lib = ws.spark.createDataFrame([("calm", -2.0), ("drive", 0.5)], "track string, gain_db double")
    return cu.resolve_tracks(ws.clips(), track_specs(ws), lib, "calm")[1]


@query("u04_lost_words", """
SELECT o.clip_id, h.hook AS target, o.pos, NOT EXISTS (SELECT 1 FROM hook_cuts c WHERE c.clip_id = o.clip_id AND c.target = h.hook AND NOT c.keep AND c.start_ms <= o.start_ms AND o.start_ms < c.end_ms - 1) AS alive
FROM (SELECT *, CASE WHEN out_ms >= 12000 THEN -1 WHEN out_ms >= 8000 THEN 2 WHEN out_ms >= 4000 THEN 1 ELSE 0 END AS section FROM retimed) o JOIN hooks h USING (clip_id) WHERE o.section IN (-1, h.hook)
""")
def lost(ws):
    return va.survival(ws.words().select("clip_id", "pos", "start_ms"), ws.edl(), ws.hooks()).select("clip_id", "target", "pos", "alive")


@query("d25_hook_transcripts", """
SELECT o.clip_id, h.hook AS target, count(*) AS n_words, CAST(sum(o.end_ms - o.start_ms) AS BIGINT) AS spoken_ms
FROM (SELECT *, CASE WHEN out_ms >= 12000 THEN -1 WHEN out_ms >= 8000 THEN 2 WHEN out_ms >= 4000 THEN 1 ELSE 0 END AS section FROM retimed) o JOIN hooks h USING (clip_id)
WHERE o.section IN (-1, h.hook) AND NOT EXISTS (SELECT 1 FROM hook_cuts c WHERE c.clip_id = o.clip_id AND c.target = h.hook AND NOT c.keep AND c.start_ms <= o.start_ms AND o.start_ms < c.end_ms - 1) GROUP BY 1, 2
""")
def hook_transcripts(ws):
    w = va.survival(ws.words().select("clip_id", "start_ms", "end_ms"), ws.edl(), ws.hooks()).where("alive")
    return w.groupBy("clip_id", "target").agg(F.count("*").alias("n_words"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"))


@query("a10_plan_lengths", """
SELECT h.clip_id, h.hook AS target, CAST(c AS BIGINT) AS copy, CAST(l.len AS BIGINT) AS length_ms, c = 2 AS repeated FROM hooks h, (SELECT unnest(range(3)) AS c)
JOIN (SELECT clip_id, target, sum(end_ms - start_ms) AS len FROM hook_cuts WHERE keep GROUP BY 1, 2) l ON l.clip_id = h.clip_id AND l.target = h.hook
""")
def plan_lengths(ws):
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
    plan = ws.hooks().select("clip_id", F.col("hook").alias("target"), k.alias("copy")).select(
        "clip_id", "target", "copy", (F.col("copy") % 2 == 1).alias("flip"), F.lit("1,2").alias("trims")
    )
    return va.plan_lengths(ws.edl(), ws.hooks(), plan)


@query("d23_variant_plan")
def variant_plan(ws):
    d = ws.table("documents")
    sets = d.groupBy((F.floor(F.col("doc_id") / 6)).cast("string").alias("slug")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", (F.col("n_chars") % 3 + 1).alias("n")))), lambda x: x["n"]).alias("counts"),
        F.array_sort(F.array_distinct(F.collect_list(F.col("n_chars") % 5))).alias("units"),
    )
    return va.variant_plan(sets, "alternate", True).withColumn("trims", F.array_join(F.transform("trims", lambda t: t.cast("string")), ","))


@query("d24_recorded_plan", """
SELECT slug, base, copy, base || '-' || (copy + 1) AS id, coalesce(f, copy % 2 = 1) AS flip FROM (
  SELECT source AS slug, 'v' || doc_id AS base, CAST(unnest(range(3)) AS BIGINT) AS copy, doc_id, NULL::BOOLEAN AS f FROM documents) WHERE copy >= 1 + doc_id % 2
UNION ALL SELECT source, 'v' || doc_id, k, 'v' || doc_id || CASE WHEN k = 0 THEN '' ELSE '-x' END, CASE WHEN doc_id % 3 = 0 THEN true ELSE k % 2 = 1 END
FROM (SELECT *, CAST(unnest(range(1 + doc_id % 2)) AS BIGINT) AS k FROM documents)
""")
def recorded_plan(ws):
    i = F.col("doc_id")
    d = ws.table("documents").select(F.col("source").alias("slug"), F.concat(F.lit("v"), i.cast("string")).alias("base"), "doc_id")
    v = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), i % 2)))
    videos = v.select(
        "slug", "base", "copy", F.when(F.col("copy") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-x"))).alias("id"),
        F.when(i % 3 == 0, True).alias("flip"), F.lit(None).cast("array<bigint>").alias("trim"),
    )
    plan = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).select(
        "slug", "base", "copy", (F.col("copy") % 2 == 1).alias("flip"), F.array(F.col("copy")).alias("trim")
    )
    return idl.fill_plan(videos, plan, 3).select("slug", "base", "copy", "id", "flip")
