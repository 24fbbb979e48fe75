"""Idea batches, approvals, delivery, and the publishing calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.scan import running_sum, scan, total
from wordloom.operators.articles import first_per_key

# What each rule reports.
SLUG_SHAPE = "^[a-z0-9-]+$"


def nest_sources(ideas: DataFrame, sources: DataFrame) -> DataFrame:
    """Each idea with its sources in order, as an array. Ideas without any keep an empty one."""
    packed = sources.groupBy("idea_id").agg(
        F.array_sort(F.collect_list(F.struct("source_no", "url"))).alias("sources")
    )
    empty = F.array().cast("array<struct<source_no:bigint,url:string>>")
    return ideas.join(packed, "idea_id", "left").withColumn(
        "sources", F.coalesce("sources", empty)
    )


def idea_violations(ideas: DataFrame, known_series: list[str]) -> DataFrame:
    """One row per broken rule of an idea."""
    def blank(c):
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    rules = F.array(
        F.when(blank("hook"), "hook_empty"),
        F.when(blank("angle"), "angle_empty"),
        F.when(blank("slug"), "slug_empty").when(~F.col("slug").rlike(SLUG_SHAPE), "slug_charset"),
        F.when(~F.col("series").isin(known_series), "series_unknown"),
    )
    return ideas.select("idea_id", F.explode(F.array_compact(rules)).alias("rule"))


def respond(ideas: DataFrame, responses: DataFrame) -> DataFrame:
    """Final status of each idea: a delete is final, any keep before it counts as viewed."""
    r = responses.groupBy("idea_id").agg(
        F.min(F.when(F.col("action") == "delete", F.col("arrival"))).alias("deleted_at"),
        F.min(F.when(F.col("action") == "keep", F.col("arrival"))).alias("kept_at"),
    )
    status = (
        F.when(F.col("deleted_at").isNotNull(), "rejected")
        .when(F.col("kept_at").isNotNull(), "viewed")
        .otherwise("new")
    )
    return ideas.join(r, "idea_id", "left").withColumn("status", status)


def refused(responses: DataFrame) -> DataFrame:
    """Keeps that came after the idea was deleted."""
    first = responses.where("action = 'delete'").groupBy("idea_id").agg(
        F.min("arrival").alias("deleted_at")
    )
    return responses.where("action = 'keep'").join(first, "idea_id").where("arrival > deleted_at")


def viewed_articles(responded: DataFrame, sources: DataFrame, series: list[str]) -> DataFrame:
    """URLs whose article rows become viewed: sources of ideas kept before any delete."""
    kept = responded.where(
        F.col("kept_at").isNotNull()
        & (F.col("deleted_at").isNull() | (F.col("kept_at") < F.col("deleted_at")))
        & F.col("series").isin(series)
    )
    return sources.join(kept.select("idea_id", "series"), "idea_id").select("series", "url").distinct()


def rejection_records(responded: DataFrame, sources: DataFrame) -> DataFrame:
    """One record per (series, slug): the earliest delete, with the idea's first source."""
    first_url = sources.groupBy("idea_id").agg(F.min_by("url", "source_no").alias("source_url"))
    r = responded.where("status = 'rejected'").join(first_url, "idea_id", "left")
    return first_per_key(
        r.select("series", "slug", F.col("hook").alias("topic"), "source_url", "deleted_at"),
        ["series", "slug"],
        "deleted_at",
    )


def pending_delivery(ideas: DataFrame, sources: DataFrame, batches: DataFrame) -> DataFrame:
    """What is still to be sent: digests, idea cards, and each supporting URL once per batch."""
    digests = batches.where("digest_sent_at is null").select(
        "batch_id", F.lit("digest").alias("kind"), F.col("batch_id").cast("string").alias("what")
    )
    cards = ideas.where("sent_at is null").select(
        "batch_id", F.lit("idea").alias("kind"), F.col("idea_id").alias("what")
    )
    links = (
        sources.where("sent_at is null and url <> ''")
        .join(ideas.select("idea_id", "batch_id"), "idea_id")
        .select("batch_id", F.lit("source").alias("kind"), F.col("url").alias("what"))
        .distinct()
    )
    return digests.unionByName(cards).unionByName(links)


def digest_lines(ideas: DataFrame) -> DataFrame:
    """Numbered lines of a batch's digest, per series."""
    n = scan(
        ideas.withColumn("_one", F.lit(1).cast("long")),
        ["batch_id", "series"],
        ["idea_no"],
        {"number": running_sum("_one"), "in_series": total("sum", "_one")},
    )
    intent = F.when(F.coalesce("intent", F.lit("")) != "", F.concat(F.lit(" ["), "intent", F.lit("]"))).otherwise("")
    return n.select(
        "batch_id",
        "series",
        "in_series",
        "number",
        F.concat(F.col("number").cast("string"), F.lit(". "), "hook", intent).alias("line"),
    )


# -- specs --------------------------------------------------------------------------------


def video_violations(videos: DataFrame) -> DataFrame:
    """Missing ids, repeated ids, and copies of an entry that is no base entry."""
    missing = videos.where("id = ''").select("slug", "id", F.lit("id_missing").alias("rule"))
    repeated = (
        videos.where("id <> ''").groupBy("slug", "id").agg(F.count("*").alias("n")).where("n > 1")
    ).select("slug", "id", F.lit("id_repeated").alias("rule"))
    bases = videos.where("of = ''").select("slug", F.col("id").alias("of"))
    dangling = (
        videos.where("of <> ''").join(bases, ["slug", "of"], "left_anti").select("slug", "id", F.lit("of_unknown").alias("rule"))
    )
    return missing.unionByName(repeated).unionByName(dangling)


def copies(videos: DataFrame) -> DataFrame:
    """Each base entry with its copies."""
    base = videos.where("of = ''").select("slug", F.col("id").alias("base"))
    c = videos.where("of <> ''").select("slug", F.col("of").alias("base"), "id")
    return base.join(c, ["slug", "base"]).select("slug", "base", "id")


def unset_windows(hooks: DataFrame) -> DataFrame:
    return hooks.where("end_ms <= start_ms")


def automation_violations(specs: DataFrame) -> DataFrame:
    """Per-video automation rules with severity; ``fields`` are the keys present."""
    from wordloom.functions.urls import literal_array

    kw = F.col("keywords")
    msg = F.coalesce("message", F.lit(""))
    found = F.array_compact(
        F.array(
            F.when(F.size(kw) == 0, F.struct(F.lit("error").alias("severity"), F.lit("keywords_missing").alias("rule"))),
            F.when(F.exists(kw, lambda k: F.trim(k) == ""), F.struct(F.lit("error").alias("severity"), F.lit("keyword_empty").alias("rule"))),
            F.when(F.exists(kw, lambda k: F.trim(k).rlike("\\s")), F.struct(F.lit("error").alias("severity"), F.lit("keyword_not_one_word").alias("rule"))),
            F.when(F.trim(msg) == "", F.struct(F.lit("error").alias("severity"), F.lit("message_missing").alias("rule")))
            .when(~msg.rlike("https?://"), F.struct(F.lit("warning").alias("severity"), F.lit("message_no_url").alias("rule"))),
        )
    )
    extra = F.transform(
        F.array_except("fields", literal_array(["trigger_keywords", "follower_message"])),
        lambda f: F.struct(F.lit("error").alias("severity"), F.concat(F.lit("unknown_field:"), f).alias("rule")),
    )
    return specs.select("id", F.explode(F.concat(found, extra)).alias("v")).select("id", "v.severity", "v.rule")


def readiness_violations(clips: DataFrame, documents: DataFrame, videos: DataFrame) -> DataFrame:
    """Why a clip is not ready to edit: no or several documents, empty lists, no titled video."""
    d = documents.groupBy("slug").agg(
        F.count("*").alias("n_docs"), F.min("n_edl").alias("n_edl"), F.min("n_words").alias("n_words")
    )
    v = videos.groupBy("slug").agg(F.bool_or(F.col("title") != "").alias("titled"))
    c = clips.join(d, "slug", "left").join(v, "slug", "left")
    n = F.coalesce("n_docs", F.lit(0))
    rule = (
        F.when(n == 0, "no_document")
        .when(n > 1, "several_documents")
        .when((F.col("n_edl") == 0) | (F.col("n_words") == 0), "empty_document")
        .when(~F.coalesce("titled", F.lit(False)), "no_titled_video")
    )
    return c.select("slug", rule.alias("rule")).where("rule is not null")


# -- calendar -------------------------------------------------------------------------------


def nearest_entry(asks: DataFrame, entries: DataFrame, window_s: int) -> DataFrame:
    """Closest calendar entry within the window of each ask; both carry epoch seconds ``at``.

    Asks and entries are reduced to one row per second first. A bucket of one window's length holds its own
    seconds, the last entry of the bucket before and the first one of the next, so the entries on both sides
    of an ask are found in order, without pairs.
    """
    bucket = F.floor(F.col("at") / window_s)
    found = F.struct("at", "entry")
    e = entries.where("at is not null").groupBy("at").agg(F.min("entry").alias("entry")).select(
        bucket.alias("b"), "at", found.alias("e"), F.lit(False).alias("asked")
    )
    edges = e.groupBy("b").agg(F.min("e").alias("first"), F.max("e").alias("last"))
    beyond = edges.select(
        F.explode(F.array(F.struct((F.col("b") - 1).alias("b"), F.col("first").alias("e")),
                          F.struct((F.col("b") + 1).alias("b"), F.col("last").alias("e")))).alias("x")
    ).select("x.b", "x.e.at", "x.e", F.lit(False).alias("asked"))
    a = asks.where("at is not null").select("at").distinct().select(
        bucket.alias("b"), "at", F.lit(None).cast(e.schema["e"].dataType).alias("e"), F.lit(True).alias("asked")
    )
    part = Window.partitionBy("b")
    up = part.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = part.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sides = F.array(F.last("e", ignorenulls=True).over(up), F.last("e", ignorenulls=True).over(down))
    near = F.array_min(
        F.filter(
            F.transform(sides, lambda x: F.struct(F.abs(x["at"] - F.col("at")).alias("d"), x["entry"].alias("entry"))),
            lambda x: x["d"] <= window_s,
        )
    )
    nearest = a.unionByName(e).unionByName(beyond).withColumn("near", near).where("asked and near is not null").select("at", "near")
    best = asks.join(nearest, "at").groupBy("ask").agg(F.min("near").alias("near"))
    return asks.join(best, "ask", "left").select("ask", "near.entry", F.col("near.d").alias("distance_s"))


def longest_prefix(stems: DataFrame, known: DataFrame) -> DataFrame:
    """Known stem for each file stem: itself, else the longest one it starts with.

    Prefix lengths come from the known stems, so it is an equi-join on (length, prefix).
    """
    k = known.select("slug", F.col("stem").alias("k")).distinct().withColumn("n", F.char_length("k"))
    sizes = k.groupBy("slug").agg(F.collect_set("n").alias("sizes"))
    s = stems.join(sizes, "slug").withColumn("n", F.explode("sizes")).where(F.col("n") <= F.char_length("stem"))
    s = s.withColumn("k", F.substring(F.col("stem"), F.lit(1), F.col("n")))
    best = s.join(k, ["slug", "n", "k"]).groupBy("slug", "stem").agg(F.max_by("k", "n").alias("known"))
    return stems.join(best, ["slug", "stem"], "left").select("slug", "stem", "known")


def backlog(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files not claimed in the ledger, oldest first, name as tie-break."""
    key = F.concat("slug", F.lit("/"), "file")
    return (
        files.withColumn("key", key)
        .join(ledger.select("key"), "key", "left_anti")
        .orderBy("rendered_at", "file")
    )


def booking_order(stems: DataFrame) -> DataFrame:
    """Order of a slug's files: the shorter of originals and copies spread through the longer; the
    copies rotated so that fewest stand beside their own original, the first such rotation.

    A copy clashes only in the one or two rotations that put it next to its original, so the
    clashes are counted from those instead of trying every rotation against every copy.
    ``stems(slug, stem, no, of)``, ``of`` null for originals.
    """
    s = stems.withColumn("is_copy", F.col("of").isNotNull()).withColumn("_one", F.lit(1).cast("long"))
    s = scan(s, ["slug", "is_copy"], ["no"], {"idx": running_sum("_one", False)})
    sizes = s.groupBy("slug").agg(
        F.sum(F.when(F.col("is_copy"), 0).otherwise(1)).alias("n_orig"),
        F.sum(F.when(F.col("is_copy"), 1).otherwise(0)).alias("n_copy"),
    )
    s = s.join(sizes, "slug")
    orig = s.where("not is_copy").select("slug", F.col("stem").alias("of"), F.col("idx").alias("o"))
    c = s.where("is_copy").join(orig, ["slug", "of"])
    m, n = F.col("n_copy"), F.col("n_orig")
    # copies in the gaps between originals: slot j follows original floor(j*n/m)
    few = c.where(m <= n)
    # the slots j whose gap touches original o: floor(j*n/m) in {o-1, o}
    lo = F.greatest(F.ceil((F.col("o") - 1) * m / n), F.lit(0))
    hi = F.least(F.ceil((F.col("o") + 1) * m / n) - 1, m - 1)
    few = few.where(hi >= lo).withColumn("j", F.explode(F.sequence(lo, hi)))
    few = few.select("slug", F.pmod(F.col("idx") - F.col("j"), m).alias("k"))
    # originals in the gaps between copies: original o follows copy slot floor(o*m/n)
    many = c.where(m > n).withColumn("p0", F.floor(F.col("o") * m / n))
    many = many.withColumn("p", F.explode(F.array("p0", F.col("p0") + 1))).where(F.col("p") < m)
    many = many.select("slug", F.pmod(F.col("idx") - F.col("p"), m).alias("k"))
    clashes = few.unionByName(many).groupBy("slug", "k").agg(F.count("*").alias("clashes"))
    turns = sizes.where("n_copy > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), m - 1)))
    best = (
        turns.join(clashes, ["slug", "k"], "left")
        .groupBy("slug")
        .agg(F.min_by("k", F.struct(F.coalesce("clashes", F.lit(0)), "k")).alias("turn"))
    )
    s = s.join(best, "slug", "left")
    slot = F.when(F.col("is_copy"), F.pmod(F.col("idx") - F.coalesce("turn", F.lit(0)), m)).otherwise(F.col("idx"))
    longer = F.when(m > n, F.col("is_copy")).otherwise(~F.col("is_copy"))
    own, other = F.when(F.col("is_copy"), m).otherwise(n), F.when(F.col("is_copy"), n).otherwise(m)
    s = s.withColumn("slot", slot)
    s = s.withColumn("at", F.when(longer, F.col("slot")).otherwise(F.floor(F.col("slot") * other / own)))
    s = s.withColumn("side", F.when(longer, 0).otherwise(1))
    return scan(s, ["slug"], ["at", "side"], {"place": running_sum("_one")}).select(
        "slug", "stem", F.col("place").cast("long").alias("place")
    )


def display_titles(videos: DataFrame) -> DataFrame:
    """Title of a set: its first base entry's, stars removed and blanks collapsed, else the slug."""
    rank = F.struct(F.when(F.col("of") == "", 0).otherwise(1).alias("a"), F.col("no").alias("b"))
    first = videos.groupBy("slug").agg(F.min_by("title", rank).alias("title"))
    text = F.trim(F.regexp_replace(F.replace("title", F.lit("*"), F.lit("")), "[ \\t\\n]+", " "))
    return first.select("slug", F.coalesce(F.nullif(text, F.lit("")), "slug").alias("title"))


# -- variants ---------------------------------------------------------------------------------


def missing_units(videos: DataFrame, usable: DataFrame) -> DataFrame:
    """Trim units a video names that are not usable."""
    named = videos.select("slug", F.explode("trim").alias("unit")).distinct()
    return named.join(usable.select("slug", "unit"), ["slug", "unit"], "left_anti")


def usable_units(trims: DataFrame) -> DataFrame:
    """Units all of whose rows resolved, with their spans."""
    good = trims.groupBy("slug", "unit").agg(F.bool_and(F.col("status") == "ok").alias("ok")).where("ok")
    return trims.join(good.select("slug", "unit"), ["slug", "unit"], "left_semi")


def fill_plan(videos: DataFrame, plan: DataFrame, copies_wanted: int) -> DataFrame:
    """Entries with empty flip or trim filled from the plan, and stub copies where a hook has fewer
    entries than wanted. ``videos(slug, base, copy, id, flip, trim)``, ``plan(slug, base, copy,
    flip, trim)``."""
    p = plan.withColumnsRenamed({"flip": "p_flip", "trim": "p_trim"})
    filled = videos.join(p, ["slug", "base", "copy"], "left").select(
        "slug", "base", "copy", "id", F.coalesce("flip", "p_flip").alias("flip"), F.coalesce("trim", "p_trim").alias("trim")
    )
    have = videos.groupBy("slug", "base").agg(F.max("copy").alias("last"))
    stubs = (
        have.where(F.col("last") < copies_wanted - 1)
        .withColumn("copy", F.explode(F.sequence(F.col("last") + 1, F.lit(copies_wanted - 1).cast("long"))))
        .join(p, ["slug", "base", "copy"])
        .select(
            "slug", "base", "copy",
            F.concat("base", F.lit("-"), (F.col("copy") + 1).cast("string")).alias("id"),
            F.col("p_flip").alias("flip"), F.col("p_trim").alias("trim"),
        )
    )
    return filled.unionByName(stubs)
