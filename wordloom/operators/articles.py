"""Content feed: filter, score, tier, deduplicate, store, query and prune articles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import urls as ur
from wordloom.functions.scan import running_sum, scan


@dataclass(frozen=True)
class FeedConfig:
    strong: list[str] = field(default_factory=list)
    weak: list[str] = field(default_factory=list)
    title: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    excluded_urls: list[str] = field(default_factory=list)
    min_score: int = 3
    lookback_days: int = 360


def recent(articles: DataFrame, today: str, days: int) -> DataFrame:
    """Published within ``days``; undated articles stay."""
    cutoff = F.date_sub(F.to_date(F.lit(today)), days)
    return articles.where(F.col("published").isNull() | (F.col("published") >= cutoff))


def prune(articles: DataFrame, today: str, days: int) -> DataFrame:
    """The store after dropping dated rows ``days`` or older."""
    cutoff = F.date_sub(F.to_date(F.lit(today)), days)
    return articles.where(F.col("published").isNull() | (F.col("published") > cutoff))


def keyword_reason(keywords: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    hit = ur.first_hit(text, [k.lower() for k in keywords])
    return F.concat(F.lit("keyword: "), hit)


def url_reason(patterns: list[str]) -> Column:
    """Only the URL is lower-cased, the patterns are matched as written."""
    return F.concat(F.lit("url_pattern: "), ur.first_hit(F.lower("url"), patterns))


def scored(articles: DataFrame, cfg: FeedConfig) -> DataFrame:
    """``score`` and ``matched``: title words 3, strong words 3, weak words 2 in the title else 1
    in the description, plus the source's base score."""
    title = F.lower("title")
    text = F.lower(F.coalesce("description", F.lit("")))

    def hits(words, cond):
        pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(w.lower()).alias("k")) for w in words])
        return F.filter(pairs, lambda p: cond(p["k"]))

    t = hits(cfg.title, lambda k: F.contains(title, k))
    s = hits(cfg.strong, lambda k: F.contains(title, k) | F.contains(text, k))
    w = hits(cfg.weak, lambda k: F.contains(title, k) | F.contains(text, k))
    weak_points = F.aggregate(
        w, F.lit(0), lambda acc, p: acc + F.when(F.contains(title, p["k"]), 2).otherwise(1)
    )
    base = F.coalesce(F.col("init_score"), F.lit(0)) if "init_score" in articles.columns else F.lit(0)
    matched = F.concat(
        F.transform(t, lambda p: F.concat(p["w"], F.lit(" (title-only)"))),
        F.transform(s, lambda p: p["w"]),
        F.transform(
            w,
            lambda p: F.when(F.contains(title, p["k"]), F.concat(p["w"], F.lit(" (title, weak)")))
            .otherwise(F.concat(F.lit("~"), p["w"])),
        ),
    )
    return articles.withColumn(
        "score", (3 * F.size(t) + 3 * F.size(s) + weak_points + base).cast("long")
    ).withColumn("matched", matched)


def tier_of(score: Column, min_score: int) -> Column:
    """passing, low_score, or null for articles that vanish."""
    return F.when(score >= min_score, "passing").when(score > 0, "low_score")


def feed_stages(
    fresh: DataFrame, rejected: DataFrame, previous: DataFrame, cfg: FeedConfig, today: str
) -> dict[str, DataFrame]:
    """Every stage of one run: ``filtered``, ``scored`` (all tiers with carried status) and
    ``store_rows`` (passing, always new).

    One pass tags each article with the reason it is dropped; the tiers are filters over that one
    frame, so nothing is scanned per tier.
    """
    tagged = recent(fresh, today, cfg.lookback_days).withColumn(
        "excluded_reason", F.coalesce(keyword_reason(cfg.excluded), url_reason(cfg.excluded_urls))
    )
    allowed = tagged.where("excluded_reason is null")
    filtered = without_rejected(allowed, rejected)
    s = scored(filtered, cfg)
    s = s.withColumn("tier", tier_of(F.col("score"), cfg.min_score)).where("tier is not null")
    excluded = (
        tagged.where("excluded_reason is not null")
        .withColumn("score", F.lit(0).cast("long"))
        .withColumn("matched", F.array().cast("array<string>"))
        .withColumn("tier", F.lit("excluded"))
    )
    everything = carry_status(s.unionByName(excluded), previous)
    return {
        "filtered": filtered,
        "scored": everything,
        "store_rows": s.where("tier = 'passing'").withColumn("status", F.lit("new")),
    }


def without_rejected(articles: DataFrame, rejected: DataFrame) -> DataFrame:
    """Articles whose URL was not rejected.

    They meet on the boxed URL: from an equality of plain columns the optimizer carries filters over ``url`` to
    the rejections, where those that read an article's text as well find no such column.
    """
    gone = rejected.where("source_url is not null").select(F.struct(F.col("source_url").alias("url")).alias("_key"))
    return articles.withColumn("_key", F.struct("url")).join(gone, "_key", "left_anti").drop("_key")


def carry_status(articles: DataFrame, previous: DataFrame) -> DataFrame:
    """Status of the previous run by id; new otherwise."""
    prev = previous.select("id", F.col("status").alias("_prev")).dropDuplicates(["id"])
    return articles.join(prev, "id", "left").withColumn(
        "status", F.coalesce("_prev", F.lit("new"))
    ).drop("_prev")


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of each key, as an aggregate (combined before the shuffle)."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.col(order)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, "_b.*").select(*rows.columns)


def insert_or_ignore(store: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch that are new to the store; the first of a repeated key counts."""
    return first_per_key(batch, keys, order).join(store.select(*keys), keys, "left_anti")


def limit_per_source(articles: DataFrame, limits: DataFrame) -> DataFrame:
    """First ``output_limit`` arrivals of each source; no limit keeps all.

    Sources without a limit never enter the ranking.
    """
    tagged = articles.join(limits, "source_name", "left")
    free = tagged.where("output_limit is null").drop("output_limit")
    capped = tagged.where("output_limit is not null")
    ranked = scan(
        capped.withColumn("_one", F.lit(1).cast("long")),
        ["source_name"],
        ["arrival"],
        {"rk": running_sum("_one")},
    )
    return free.unionByName(ranked.where("rk <= output_limit").select(*free.columns))


def search(
    store: DataFrame, tier: str | None, status: str | None, text: str | None, evergreen: bool, limit: int | None
) -> DataFrame:
    """Store query: filters, then best-first (evergreen) or newest-first order and a limit."""
    q = store
    if tier:
        q = q.where(F.col("tier") == tier)
    if status:
        q = q.where(F.col("status") == status)
    if text:
        like = f"%{text}%"
        q = q.where(F.col("title").ilike(like) | F.col("description").ilike(like))
    order = [F.col("published").desc_nulls_last(), F.col("id")]
    if evergreen:
        order = [F.col("score").desc(), *order]
    q = q.orderBy(*order)
    return q.limit(limit) if limit else q


def match_source(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """URL to source by host: equal, sub-domain or super-domain; on the path-split host the source
    whose path is a prefix wins, otherwise the first source listed.

    Hosts are matched on their dotted suffixes, so it stays an equi-join.
    """

    def bare(u):
        return F.regexp_replace(F.lower(ur.host(u)), r"^www\.", "")

    def suffixes(h):
        parts = F.split(h, "\\.")
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        )

    u = urls.withColumn("h", bare(F.col("url"))).withColumn("p", F.lower(ur.path(F.col("url"))))
    s = sources.select(
        F.col("name"),
        F.col("rank"),
        bare(F.col("homepage")).alias("sh"),
        F.rtrim(F.lower(ur.path(F.col("homepage"))), F.lit("/")).alias("sp"),
    ).where("sh <> ''")
    down = u.withColumn("k", F.explode(suffixes(F.col("h")))).join(s, F.col("k") == F.col("sh"))
    up = s.withColumn("k", F.explode(suffixes(F.col("sh")))).where("k <> sh")
    over = u.join(up, F.col("h") == F.col("k"))
    cols = ["url", "h", "p", "name", "rank", "sp"]
    pairs = down.select(*cols).unionByName(over.select(*cols))
    split_host = F.col("h").isin("reddit.com", "old.reddit.com")
    exact = split_host & (F.col("sp") != "") & F.col("p").startswith(F.col("sp"))
    best = pairs.groupBy("url").agg(
        F.min_by("name", F.struct(F.when(exact, 0).otherwise(1), F.col("rank"))).alias("name")
    )
    return urls.join(best, "url", "left")


def episode_numbers(registry: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``registry(series, slug, number)`` with the unseen slugs of ``arrivals(series, slug,
    arrival)`` numbered on from each series' last, first come first numbered."""
    fresh = (
        arrivals.groupBy("series", "slug")
        .agg(F.min("arrival").alias("arrival"))
        .join(registry.select("series", "slug"), ["series", "slug"], "left_anti")
        .withColumn("_one", F.lit(1).cast("long"))
    )
    top = registry.groupBy("series").agg(F.max("number").alias("top"))
    ranked = scan(fresh, ["series"], ["arrival"], {"n": running_sum("_one")})
    new = ranked.join(top, "series", "left").select(
        "series", "slug", (F.col("n") + F.coalesce("top", F.lit(0))).alias("number")
    )
    return registry.select("series", "slug", "number").unionByName(new)


def mark_status(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Store with ``changes(url, status)`` applied to rows whose url or url key matches."""
    from wordloom.functions.text import hash_key

    last = changes.groupBy("url").agg(F.max_by("status", "arrival").alias("to_status"))
    keyed = last.select(hash_key(F.col("url")).alias("id"), F.col("to_status").alias("by_id"))
    return (
        store.join(last, "url", "left")
        .join(keyed, "id", "left")
        .withColumn("status", F.coalesce("to_status", "by_id", "status"))
        .drop("to_status", "by_id")
    )


def apply_responses(store: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keep marks viewed; delete removes the row and records a rejection (first per url)."""
    last = responses.groupBy("url").agg(F.max_by("action", "arrival").alias("action"))
    deleted = responses.where("action = 'delete'")
    rejected = first_per_key(deleted.select("url", "arrival", "title"), ["url"], "arrival")
    kept = store.join(deleted.select("url").distinct(), "url", "left_anti")
    marked = kept.join(last.where("action = 'keep'").select("url", F.lit("viewed").alias("to")), "url", "left")
    return marked.withColumn("status", F.coalesce("to", "status")).drop("to"), rejected
