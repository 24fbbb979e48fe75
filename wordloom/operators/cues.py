"""Entity cues, sounds and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions.scan import lag, running_sum, scan
from wordloom.functions.settle import settle
from wordloom.operators.intervals import BUCKET_MS, CLIP, _time_block


def entity_slug(word: Column) -> Column:
    """Lower case, blanks and underscores to hyphens, anything else dropped."""
    s = F.regexp_replace(F.regexp_replace(F.lower(word), "[ _]", "-"), "[^a-z0-9-]", "")
    return F.btrim(s, F.lit("-"))


def slug_variants(word: Column, aliases: dict[str, str], makers: dict[str, str]) -> Column:
    """Slugs to try, most specific first: as written, without possessive, without plural s, then
    aliases and makers of those."""
    raw = entity_slug(word)
    bare = entity_slug(F.regexp_replace(word, r"(?i)['’]s$|s['’]$|['’]$", ""))

    def singular(s):
        return F.when(s.endswith("s") & (F.char_length(s) > 3), F.left(s, F.char_length(s) - 1))

    base = F.array_distinct(F.filter(F.array_compact(F.array(raw, bare, singular(raw), singular(bare))), lambda s: s != ""))

    def lookup(table):
        if not table:
            return F.array().cast("array<string>")
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        known = F.create_map(*pairs)
        return F.transform(base, lambda s: F.try_element_at(known, s))

    extra = F.flatten(F.transform(F.arrays_zip(lookup(aliases).alias("a"), lookup(makers).alias("m")), lambda z: F.array(z["a"], z["m"])))
    return F.array_distinct(F.concat(base, F.array_compact(extra)))


def most_variants(aliases: dict[str, str], makers: dict[str, str]) -> int:
    """The largest size that ``slug_variants`` can have: four spellings, each with alias and maker."""
    return 4 * (1 + bool(aliases) + bool(makers))


def censored(word: Column, stems: list[str]) -> Column:
    """First vowel after a letter starred when the word starts with a listed stem."""
    core = F.regexp_replace(F.lower(word), "[^a-z]", "")
    hit = F.exists(F.array(*[F.lit(s) for s in stems]), lambda s: F.startswith(core, s))
    starred = F.regexp_replace(word, r"(?s)^(.*?[A-Za-z])[aeiouAEIOU](.*)$", "$1*$2")
    return F.when(hit, starred).otherwise(word)


def stable_draw(name: Column, salt: str) -> Column:
    """Draw in [0, 1) from SHA-1 of name and salt: the digest modulo 1000."""
    digits = F.split(F.sha1(F.concat(name, F.lit(":" + salt))), "")
    value = F.aggregate(
        digits, F.lit(0), lambda acc, d: (acc * 16 + F.when(d == "", 0).otherwise(F.coalesce(F.conv(d, 16, 10).cast("int"), F.lit(0)))) % 1000
    )
    return value / 1000


def section_of(items: DataFrame, edges: DataFrame) -> DataFrame:
    """``section``: how many reset edges of the clip lie at or before the item's start."""
    i = items.select("clip_id", F.col("start_ms").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_e"), F.struct(*items.columns).alias("_p"))
    e = edges.select("clip_id", F.col("at_ms").alias("_t")).distinct().where("_t > 0").select(
        "clip_id", "_t", F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_e"), F.lit(None).cast(i.schema["_p"].dataType).alias("_p")
    )
    both = i.unionByName(e)
    r = scan(both, CLIP, ["_t", "_kind"], {"section": running_sum("_e")}, _time_block(both, "_t"))
    return r.where("_kind = 1").select("_p.*", "section")


def entity_cues(
    words: DataFrame, dictionary: DataFrame, edges: DataFrame, explicit: list[str], exclude: list[str],
    aliases: dict[str, str], makers: dict[str, str], show_ms: int,
) -> DataFrame:
    """First mention per section of each known entity. A word fires its first variant that is known
    and not yet shown in the section.

    A word form can fire at most once per variant, so only that many of its mentions per section
    go into the ordered fold; its input is bounded by the dictionary, not by the clip.
    """
    v = words.select("clip_id", "pos", "word", "start_ms", slug_variants(F.col("word"), aliases, makers).alias("vs"))
    spoken = F.exists("vs", lambda s: s.isin(explicit)) if explicit else F.lit(False)
    v = v.where(tx.starts_upper(F.col("word")) | spoken)
    each = v.select("clip_id", "pos", "start_ms", F.posexplode("vs").alias("n", "slug"))
    known = each.join(dictionary.select("slug").distinct(), "slug", "left_semi")
    if exclude:
        known = known.where(~F.col("slug").isin(exclude))
    cand = known.groupBy("clip_id", "pos", "start_ms").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "slug"))), lambda x: x["slug"]).alias("vs")
    )
    cand = section_of(cand, edges).withColumn("form", F.array_join("vs", " "))
    # rows beyond the largest size of a form cannot fire; Spark cuts them before the shuffle too
    first = Window.partitionBy("clip_id", "section", "form").orderBy("pos")
    most = most_variants(aliases, makers)
    early = cand.withColumn("rk", F.row_number().over(first)).where(F.col("rk") <= most).where(F.col("rk") <= F.size("vs"))
    packed = early.groupBy("clip_id", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "start_ms", "vs"))).alias("ws"))
    kind = "array<struct<pos:bigint,start_ms:bigint,slug:string>>"

    def step(acc, w):
        seen = F.transform(acc, lambda a: a["slug"])
        slug = F.get(F.filter(w["vs"], lambda s: ~F.array_contains(seen, s)), F.lit(0))
        fired = F.struct(w["pos"].alias("pos"), w["start_ms"].alias("start_ms"), slug.alias("slug"))
        return F.when(slug.isNull(), acc).otherwise(F.concat(acc, F.array(fired)))

    cues = packed.select("clip_id", "section", F.inline(F.aggregate("ws", F.array().cast(kind), step)))
    return cues.withColumn("end_ms", F.col("start_ms") + show_ms)


# -- sounds -------------------------------------------------------------------------------------


def near_moments(placed: DataFrame, moments: DataFrame, tol_ms: int, how: str) -> DataFrame:
    """Placed sounds within the tolerance of a moment (semi) or of none (anti)."""
    m = moments.select(
        F.col("clip_id").alias("_k"), F.col("at_ms").alias("_m"),
        F.explode(F.sequence(F.floor((F.col("at_ms") - tol_ms) / BUCKET_MS), F.floor((F.col("at_ms") + tol_ms) / BUCKET_MS))).alias("_b"),
    )
    cond = (
        (F.col("clip_id") == F.col("_k"))
        & (F.floor(F.col("at_ms") / BUCKET_MS) == F.col("_b"))
        & (F.abs(F.col("at_ms") - F.col("_m")) <= tol_ms)
    )
    return placed.join(m, cond, how)


def plan_sounds(events: DataFrame, placed: DataFrame, rules: DataFrame, totals: DataFrame, min_gap_ms: int) -> DataFrame:
    """Sounds to play. ``events(clip_id, at_ms, kind, idx)`` in rule order, ``placed(clip_id, at_ms,
    sound)`` first on ties; one that follows the last played too closely is dropped unless its rule
    is rapid; names rotate per kind, beats play by index.

    Rapid sounds neither wait nor hold others back, so only the others are folded, and only
    within runs in which each starts too soon after the one before.
    """
    r = rules.select("kind", F.col("rank").alias("rule_rank"), "sounds", "rapid").where(F.size("sounds") > 0)
    ev = events.join(r, "kind")
    items = ev.select("clip_id", "at_ms", "rule_rank", "kind", "idx", "sounds", "rapid").unionByName(
        placed.select(
            "clip_id", "at_ms", F.lit(-1).alias("rule_rank"), F.lit("placed").alias("kind"), F.lit(0).cast("long").alias("idx"),
            F.array("sound").alias("sounds"), F.lit(False).alias("rapid"),
        )
    )
    items = settle(items.join(totals, "clip_id").where(F.col("at_ms") < F.col("total_ms")).drop("total_ms"), 0)
    order = ["at_ms", "rule_rank", "idx"]
    slow = items.where("not rapid")
    s = scan(slow, CLIP, order, {"prev": lag("at_ms")}, _time_block(slow, "at_ms"))
    opens = F.col("prev").isNull() | (F.col("at_ms") - F.col("prev") >= min_gap_ms)
    s = scan(s.withColumn("_open", opens.cast("long")), CLIP, order, {"run": running_sum("_open")}, _time_block(s, "at_ms"))
    packed = s.groupBy("clip_id", "run").agg(F.array_sort(F.collect_list(F.struct("at_ms", "rule_rank", "idx", "kind", "sounds"))).alias("xs"))
    kind = "array<struct<at_ms:bigint,rule_rank:int,idx:bigint,kind:string,sounds:array<string>>>"

    def step(acc, x):
        lastly = F.try_element_at(acc, F.lit(-1))["at_ms"]
        return F.when(F.coalesce(x["at_ms"] - lastly < min_gap_ms, F.lit(False)), acc).otherwise(F.concat(acc, F.array(x)))

    played = packed.select("clip_id", F.inline(F.aggregate("xs", F.array().cast(kind), step)))
    cols = ["clip_id", "at_ms", "rule_rank", "idx", "kind", "sounds"]
    every = settle(played.select(*cols).unionByName(items.where("rapid").select(*cols)), 0).withColumn("_one", F.lit(1).cast("long"))
    n = scan(every, ["clip_id", "kind"], ["at_ms", "idx"], {"turn": running_sum("_one", False)}, _time_block(every, "at_ms"))
    slot = F.when(F.col("kind") == "beat", F.least(F.col("idx"), F.size("sounds") - 1)).otherwise(F.col("turn") % F.size("sounds"))
    return n.select("clip_id", "at_ms", "kind", "idx", F.get("sounds", slot.cast("int")).alias("sound"))


def align_peaks(played: DataFrame, library: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``played(clip_id, at_ms, sound, gain_db)`` with the loudest sample of each sound on its moment, and the played
    sounds that ``library(sound, peak_ms, peak_db, length_ms)`` lacks.

    A peak that lies further in than the moment starts the sound at 0, that much into its file; a sound
    ends with the clip (``totals(clip_id, total_ms)``) at the latest.
    """
    start = F.col("at_ms") - F.col("peak_ms")
    t = played.join(library, "sound").join(totals.select("clip_id", "total_ms"), "clip_id")
    t = t.withColumn("source_start_ms", F.greatest(F.lit(0), -start)).withColumn("begin_ms", F.greatest(F.lit(0), start))
    placed = t.select(
        "clip_id", "at_ms", "sound", F.col("source_start_ms").cast("bigint").alias("source_start_ms"),
        F.col("begin_ms").cast("bigint").alias("start_ms"),
        F.least("total_ms", F.col("begin_ms") + F.col("length_ms") - F.col("source_start_ms")).alias("end_ms"), "gain_db", "peak_db",
    )
    return placed, played.join(library, "sound", "left_anti").select("clip_id", "sound").distinct()


def resolve_tracks(clips: DataFrame, specs: DataFrame, library: DataFrame, default: str) -> tuple[DataFrame, DataFrame]:
    """Tracks per clip (the default one for clips without a spec, open ends closed at the clip's
    length) and the specs that name unknown tracks."""
    bare = clips.join(specs.select("clip_id"), "clip_id", "left_anti").select(
        "clip_id", F.lit(default).alias("track"), F.lit(0).cast("long").alias("start_ms"), F.lit(-1).cast("long").alias("end_ms"), F.lit(0.0).alias("gain_db")
    )
    every = specs.select("clip_id", "track", "start_ms", "end_ms", "gain_db").unionByName(bare)
    lib = library.select("track", F.col("gain_db").alias("base_db"))
    unknown = every.join(lib, "track", "left_anti").select("clip_id", "track")
    found = every.join(lib, "track").join(clips.select("clip_id", "total_ms"), "clip_id")
    return found.select(
        "clip_id", "track", "start_ms",
        F.when(F.col("end_ms") >= 0, F.col("end_ms")).otherwise(F.col("total_ms")).alias("end_ms"),
        (F.col("base_db") + F.col("gain_db")).alias("gain_db"),
    ), unknown


def final_gain(manual: Column, voice: Column, music: Column, duck: float, peak: Column, level: float) -> Column:
    """Effects: peak ``level`` above the voice (-16 when unknown). Music: ``duck`` below the voice, or
    a fixed attenuation when either cannot be measured."""
    effect = manual + F.coalesce(voice, F.lit(-16.0)) + level - peak
    bed = F.when(voice.isNull() | music.isNull(), manual - duck).otherwise(manual + voice - duck - music)
    return F.when(peak.isNotNull(), effect).otherwise(bed)


def nearest_start(due: DataFrame, starts: DataFrame, reach_ms: int) -> DataFrame:
    """Due times moved to the nearest start within reach, else left."""
    s = starts.select(
        F.col("clip_id").alias("_k"), F.col("at_ms").alias("_s"),
        F.explode(F.sequence(F.floor((F.col("at_ms") - reach_ms) / BUCKET_MS), F.floor((F.col("at_ms") + reach_ms) / BUCKET_MS))).alias("_b"),
    )
    near = due.join(
        s, (F.col("clip_id") == F.col("_k")) & (F.floor(F.col("due_ms") / BUCKET_MS) == F.col("_b")) & (F.abs(F.col("due_ms") - F.col("_s")) <= reach_ms), "left"
    )
    return near.groupBy("clip_id", "due_ms").agg(
        F.min_by("_s", F.struct(F.abs(F.col("_s") - F.col("due_ms")), "_s")).alias("s")
    ).select("clip_id", "due_ms", F.coalesce("s", "due_ms").alias("at_ms"))
