"""Queries over the content feed. Articles come from ``documents``, rejections from ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions import urls as ur
from wordloom.operators import articles as ar
from wordloom.plans.oracle_views import view
from wordloom.plans.registry import query

TODAY = "2025-02-04"
CFG = ar.FeedConfig(
    strong=["tion", "Sch"],
    weak=["ment", "ing", "eur"],
    title=["eau", "ung"],
    excluded=["license", "@", "Password"],
    excluded_urls=["/tag/7", "/blog/44"],
)

view("articles", r"""
SELECT substr(sha256(url), 1, 16) AS id, * FROM (
  SELECT doc_id AS arrival, source AS source_name,
    'https://' || source || '.example.com/' || CASE doc_id % 4
      WHEN 0 THEN 'blog/' || doc_id WHEN 1 THEN '2024/03/' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || doc_id
      WHEN 2 THEN 'tag/' || doc_id ELSE 'post/' || doc_id || '#c' END AS url,
    CASE WHEN doc_id % 2 = 0 THEN 'evergreen' ELSE 'news' END AS series,
    split_part(text, chr(10), 1) AS title,
    text AS description,
    CASE WHEN doc_id % 17 <> 0 THEN date '2024-01-01' + CAST(doc_id * 7919 % 400 AS INTEGER) END AS published,
    CASE source WHEN 'src3' THEN 1 WHEN 'src5' THEN 2 ELSE 0 END AS init_score
  FROM documents)
""")
view("feed", """
SELECT * FROM articles UNION ALL
SELECT * REPLACE (arrival + 1000000000 AS arrival, title || '!' AS title) FROM articles WHERE arrival % 7 = 0
""")
view("rejected", """
SELECT a.url AS source_url, a.title AS topic, a.series, CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE 's-' || (l.doc_id // 4) END AS slug, l.doc_id
FROM labels l JOIN articles a ON a.arrival = l.doc_id WHERE l.toxic = 1
""")
view("previous", "SELECT id, CASE WHEN arrival % 2 = 0 THEN 'viewed' ELSE 'done' END AS status FROM articles WHERE arrival % 3 = 0")


def articles(ws):
    d = ws.table("documents")
    i = F.col("doc_id")
    s = i.cast("string")
    tail = (
        F.when(i % 4 == 0, F.concat(F.lit("blog/"), s))
        .when(i % 4 == 1, F.concat(F.lit("2024/03/"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("/"), s))
        .when(i % 4 == 2, F.concat(F.lit("tag/"), s))
        .otherwise(F.concat(F.lit("post/"), s, F.lit("#c")))
    )
    a = d.select(
        i.alias("arrival"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), tail).alias("url"),
        F.when(i % 2 == 0, "evergreen").otherwise("news").alias("series"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"),
        F.when(i % 17 != 0, F.date_add(F.lit("2024-01-01"), (i * 7919 % 400).cast("int"))).alias("published"),
        F.when(F.col("source") == "src3", 1).when(F.col("source") == "src5", 2).otherwise(0).alias("init_score"),
    )
    return a.withColumn("id", tx.hash_key(F.col("url")))


def feed(ws):
    a = articles(ws)
    again = a.where("arrival % 7 = 0").withColumn("arrival", F.col("arrival") + 1000000000).withColumn(
        "title", F.concat("title", F.lit("!"))
    )
    return a.unionByName(again)


def rejected(ws):
    bad = ws.table("labels").where("toxic = 1").select(F.col("doc_id").alias("arrival"))
    a = articles(ws).join(bad, "arrival")
    return a.select(
        F.col("url").alias("source_url"),
        F.col("title").alias("topic"),
        "series",
        F.when(F.col("arrival") % 3 != 0, F.concat(F.lit("s-"), F.floor(F.col("arrival") / 4).cast("string"))).alias("slug"),
        F.col("arrival").alias("doc_id"),
    )


def previous(ws):
    return articles(ws).where("arrival % 3 = 0").select(
        "id", F.when(F.col("arrival") % 2 == 0, "viewed").otherwise("done").alias("status")
    )


TEXT = "lower(title || ' ' || coalesce(description, ''))"
KW_REASON = f"CASE WHEN contains({TEXT}, 'license') THEN 'keyword: license' WHEN contains({TEXT}, '@') THEN 'keyword: @' WHEN contains({TEXT}, 'password') THEN 'keyword: password' END"
URL_REASON = "CASE WHEN contains(lower(url), '/tag/7') THEN 'url_pattern: /tag/7' WHEN contains(lower(url), '/blog/44') THEN 'url_pattern: /blog/44' END"
T, X = "lower(title)", "lower(coalesce(description, ''))"


def _w(k):
    return f"CASE WHEN contains({T}, '{k}') THEN 2 WHEN contains({X}, '{k}') THEN 1 ELSE 0 END"


SCORE = " + ".join(
    [f"CASE WHEN contains({T}, '{k}') THEN 3 ELSE 0 END" for k in ("eau", "ung")]
    + [f"CASE WHEN contains({T}, '{k}') OR contains({X}, '{k}') THEN 3 ELSE 0 END" for k in ("tion", "sch")]
    + [_w(k) for k in ("ment", "ing", "eur")]
    + ["init_score"]
)
MATCHED = "concat_ws('|', " + ", ".join(
    [f"CASE WHEN contains({T}, '{k}') THEN '{k} (title-only)' END" for k in ("eau", "ung")]
    + [f"CASE WHEN contains({T}, '{k.lower()}') OR contains({X}, '{k.lower()}') THEN '{k}' END" for k in ("tion", "Sch")]
    + [f"CASE WHEN contains({T}, '{k}') THEN '{k} (title, weak)' WHEN contains({X}, '{k}') THEN '~{k}' END" for k in ("ment", "ing", "eur")]
) + ")"
view("recent_feed", f"SELECT * FROM feed WHERE published IS NULL OR published >= date '{TODAY}' - 360")
view("tagged_feed", f"SELECT *, coalesce({KW_REASON}, {URL_REASON}) AS excluded_reason FROM recent_feed")
view("scored_feed", f"""
SELECT *, CASE WHEN score >= 3 THEN 'passing' WHEN score > 0 THEN 'low_score' END AS tier FROM (
  SELECT *, CAST({SCORE} AS BIGINT) AS score, {MATCHED} AS matched_text FROM tagged_feed
  WHERE excluded_reason IS NULL AND url NOT IN (SELECT source_url FROM rejected))
""")
view("snapshot", """
SELECT s.id, s.arrival, s.url, s.tier, s.score, s.matched_text, s.excluded_reason, coalesce(p.status, 'new') AS status FROM (
  SELECT id, arrival, url, tier, score, matched_text, excluded_reason FROM scored_feed WHERE tier IS NOT NULL
  UNION ALL SELECT id, arrival, url, 'excluded', 0, '', excluded_reason FROM tagged_feed WHERE excluded_reason IS NOT NULL) s
LEFT JOIN previous p USING (id)
""")
view("store", f"""
SELECT a.*, CAST({SCORE} AS BIGINT) AS score, CASE WHEN {SCORE} >= 3 THEN 'passing' ELSE 'low_score' END AS tier,
       coalesce(p.status, 'new') AS status
FROM articles a LEFT JOIN previous p USING (id)
""")


def store(ws):
    s = ar.scored(articles(ws), CFG)
    s = s.withColumn("tier", F.when(F.col("score") >= 3, "passing").otherwise("low_score"))
    return ar.carry_status(s, previous(ws))


def stages(ws):
    return ar.feed_stages(feed(ws), rejected(ws), previous(ws), CFG, TODAY)


@query("p01_lookback", "SELECT id, arrival FROM recent_feed")
def lookback(ws):
    return ar.recent(feed(ws), TODAY, 360).select("id", "arrival")


@query("p02_excluded_keywords", f"SELECT id, arrival, {KW_REASON} AS reason FROM feed")
def keywords(ws):
    return feed(ws).select("id", "arrival", ar.keyword_reason(CFG.excluded).alias("reason"))


@query("p03_excluded_urls", f"SELECT id, arrival, {URL_REASON} AS reason FROM feed")
def url_patterns(ws):
    return feed(ws).select("id", "arrival", ar.url_reason(CFG.excluded_urls).alias("reason"))


@query("p04_article_urls", r"""
SELECT id, ok AS likely, ok AND NOT regexp_matches(p, '/tag/|/tags/|/category/|/topic/|/topics/|/author/|/page/|/product/|/search/') AS strict
FROM (SELECT id, p, h = 'src1.example.com' AND length(rtrim(p, '/')) > 1 AND NOT contains(url, '#') AS ok
      FROM (SELECT id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM articles))
""")
def article_urls(ws):
    base = F.lit("https://src1.example.com/")
    return articles(ws).select(
        "id",
        ur.is_article_url(F.col("url"), base).alias("likely"),
        ur.is_article_url(F.col("url"), base, strict=True).alias("strict"),
    )


MEDIA_SQL = r"""(lower(regexp_extract({u}, '^https?://([^/?#]+)', 1)) IN ('i.redd.it','v.redd.it','i.imgur.com','preview.redd.it','www.reddit.com','reddit.com','redd.it','youtu.be')
 OR regexp_matches(lower(regexp_extract({u}, '^https?://([^/?#]+)', 1)), '(^|\.)(youtube\.com|github\.com|hub\.docker\.com)$')
 OR regexp_matches(lower(regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1)), '(\.jpg|\.jpeg|\.png|\.gif|\.gifv|\.webp|\.mp4|\.mov)$'))"""
view("posts", """
SELECT doc_id AS id, doc_id % 3 = 0 AS is_self,
  CASE doc_id % 5 WHEN 0 THEN 'https://i.redd.it/' || doc_id || '.jpg' WHEN 1 THEN 'https://www.youtube.com/watch?v=' || doc_id
    WHEN 2 THEN 'https://' || source || '.example.com/p/' || doc_id WHEN 3 THEN 'https://cdn.example.org/a' || doc_id || '.PNG?x=1'
    ELSE 'https://gist.github.com/' || doc_id END AS link,
  text || ' see https://old.example.net/' || doc_id || ' and https://v.redd.it/z' AS body FROM documents
""")


def posts(ws):
    i = F.col("doc_id")
    s = i.cast("string")
    link = (
        F.when(i % 5 == 0, F.concat(F.lit("https://i.redd.it/"), s, F.lit(".jpg")))
        .when(i % 5 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), s))
        .when(i % 5 == 2, F.concat(F.lit("https://"), "source", F.lit(".example.com/p/"), s))
        .when(i % 5 == 3, F.concat(F.lit("https://cdn.example.org/a"), s, F.lit(".PNG?x=1")))
        .otherwise(F.concat(F.lit("https://gist.github.com/"), s))
    )
    body = F.concat("text", F.lit(" see https://old.example.net/"), s, F.lit(" and https://v.redd.it/z"))
    return ws.table("documents").select(i.alias("id"), (i % 3 == 0).alias("is_self"), link.alias("link"), body.alias("body"))


@query("p05_media_urls", f"SELECT id, {MEDIA_SQL.format(u='link')} AS media FROM posts")
def media(ws):
    return posts(ws).select("id", ur.is_media_url(F.col("link")).alias("media"))


FIRST_URL = f"""CASE WHEN NOT is_self AND NOT {MEDIA_SQL.format(u='link')} THEN link
 ELSE [u FOR u IN regexp_extract_all(body, 'https?://[^\\s)\\]>"]+') IF NOT {MEDIA_SQL.format(u='u')}][1] END"""


@query("p06_first_article_url", f"SELECT id, {FIRST_URL} AS url FROM posts")
def first_url(ws):
    u = ur.first_article_url(F.col("link"), F.col("is_self"), F.col("body"))
    return posts(ws).select("id", u.alias("url"))


@query("p07_require_link", f"SELECT id FROM posts WHERE {FIRST_URL} LIKE '%example.com%'")
def require_link(ws):
    u = ur.first_article_url(F.col("link"), F.col("is_self"), F.col("body"))
    return posts(ws).where(u.isNotNull() & u.contains("example.com")).select("id")


@query("p09_store_search", """
SELECT id, title, score FROM store WHERE tier = 'passing' AND status = 'new' AND (title ILIKE '%TION%' OR description ILIKE '%TION%')
ORDER BY score DESC, published DESC NULLS LAST, id LIMIT 25
""")
def store_search(ws):
    return ar.search(store(ws), "passing", "new", "TION", True, 25).select("id", "title", "score")


@query("o02_newest_first", """
SELECT id, CAST(published AS VARCHAR) AS day FROM store WHERE series = 'news' ORDER BY published DESC NULLS LAST, id LIMIT 40
""")
def newest(ws):
    q = ar.search(store(ws).where("series = 'news'"), None, None, None, False, 40)
    return q.select("id", F.col("published").cast("string").alias("day"))


@query("o01_passing_by_score", "SELECT id, arrival, score FROM scored_feed WHERE tier = 'passing' ORDER BY score DESC, arrival")
def by_score(ws):
    p = stages(ws)["store_rows"]
    return p.orderBy(F.col("score").desc(), "arrival").select("id", "arrival", "score")


@query("p12_tiers", """
SELECT id, arrival, tier, score FROM snapshot
""")
def tiers(ws):
    return stages(ws)["scored"].select("id", "arrival", "tier", "score")


@query("p13_retention", f"SELECT id FROM store WHERE published IS NULL OR published > date '{TODAY}' - 200")
def retention(ws):
    return ar.prune(store(ws), TODAY, 200).select("id")


@query("f09_relevance_score", f"SELECT id, CAST({SCORE} AS BIGINT) AS score, {MATCHED} AS matched FROM articles")
def relevance(ws):
    return ar.scored(articles(ws), CFG).select("id", "score", F.array_join("matched", "|").alias("matched"))


@query("f24_keyword_codec", f"""
SELECT id, CASE WHEN m = '' THEN '[]' ELSE '["' || replace(m, '|', '","') || '"]' END AS stored,
  len(string_split(m, '|')) - CASE WHEN m = '' THEN 1 ELSE 0 END AS n FROM (SELECT id, {MATCHED} AS m FROM articles)
""")
def codec(ws):
    from wordloom.sources.stores import decode_keywords, encode_keywords

    s = ar.scored(articles(ws), CFG).select("id", encode_keywords(F.col("matched")).alias("stored"))
    return s.select("id", "stored", F.size(decode_keywords(F.col("stored"))).cast("long").alias("n"))


@query("f05_clean_title", r"""
SELECT id, trim(regexp_replace(t, '^[A-Z][a-z]{2,20}(?:\s+[A-Z][a-z]{2,20}){0,2}\s+([A-Z])', '\1')) AS title FROM (
  SELECT id, regexp_replace(CASE arrival % 3 WHEN 0 THEN '2024-05-06 ' WHEN 1 THEN '7 Mar 2024 Engineering ' ELSE '' END || title,
    '^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:+Z.-]+)?|[0-9]{1,2}\s+[A-Za-z]{3,9}\.?\s+[0-9]{4}|[A-Za-z]{3,9}\.?\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{4}|[0-9]{4}[/.\-][0-9]{2}[/.\-][0-9]{2})\s*', '') AS t FROM articles)
""")
def titles(ws):
    prefix = F.when(F.col("arrival") % 3 == 0, "2024-05-06 ").when(F.col("arrival") % 3 == 1, "7 Mar 2024 Engineering ").otherwise("")
    return articles(ws).select("id", ur.clean_title(F.concat(prefix, "title")).alias("title"))


@query("f06_hash_keys", "SELECT arrival, substr(sha256(url), 1, 16) AS id, substr(sha256(series || ':s-' || arrival), 1, 16) AS idea_id FROM articles")
def hash_keys(ws):
    return articles(ws).select(
        "arrival", "id", tx.hash_key(F.concat("series", F.lit(":s-"), F.col("arrival").cast("string"))).alias("idea_id")
    )


view("raw_dates", """
SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%dT10:20:30Z')
  WHEN 2 THEN strftime(d, '%Y-%m-%dT10:20:30+02:00') WHEN 3 THEN strftime(d, '%-d %b %Y') WHEN 4 THEN strftime(d, '%B %-d, %Y')
  WHEN 5 THEN strftime(d, '%a, %d %b %Y 01:02:03 GMT') WHEN 6 THEN 'soon' ELSE strftime(d, '%Y/%m/%d') END AS raw,
  CASE doc_id % 8 WHEN 6 THEN NULL ELSE CAST(epoch(d) AS BIGINT) + CASE doc_id % 8 WHEN 1 THEN 37230 WHEN 2 THEN 30030 WHEN 5 THEN 3723 ELSE 0 END END AS secs
FROM (SELECT doc_id, CAST(date '2024-01-01' + CAST(doc_id % 700 AS INTEGER) AS TIMESTAMP) AS d FROM documents)
""")


@query("f07_date_normalise", "SELECT id, raw, coalesce(secs, -1) AS secs FROM raw_dates")
def dates(ws):
    i = F.col("doc_id")
    d = F.date_add(F.lit("2024-01-01"), (i % 700).cast("int"))

    def f(p):
        return F.date_format(d, p)

    raw = (
        F.when(i % 8 == 0, f("yyyy-MM-dd"))
        .when(i % 8 == 1, F.concat(f("yyyy-MM-dd"), F.lit("T10:20:30Z")))
        .when(i % 8 == 2, F.concat(f("yyyy-MM-dd"), F.lit("T10:20:30+02:00")))
        .when(i % 8 == 3, f("d MMM yyyy"))
        .when(i % 8 == 4, f("MMMM d, yyyy"))
        .when(i % 8 == 5, F.concat(f("EEE, dd MMM yyyy"), F.lit(" 01:02:03 GMT")))
        .when(i % 8 == 6, "soon")
        .otherwise(f("yyyy/MM/dd"))
    )
    return ws.table("documents").select(i.alias("id"), raw.alias("raw")).select(
        "id", "raw", F.coalesce(F.unix_timestamp(ur.parse_date(F.col("raw"))), F.lit(-1).cast("long")).alias("secs")
    )


@query("f08_url_and_text_dates", r"""
SELECT id, coalesce(CAST(epoch(try_strptime(regexp_extract(url, '/([0-9]{4}/[0-9]{2}/[0-9]{2})/?', 1), '%Y/%m/%d')) AS BIGINT), -1) AS url_secs,
  CAST(epoch(date '2024-02-01' + CAST(arrival % 28 AS INTEGER)) AS BIGINT) AS text_secs FROM articles
""")
def url_dates(ws):
    text = F.concat(F.lit("posted "), F.date_format(F.date_add(F.lit("2024-02-01"), (F.col("arrival") % 28).cast("int")), "d MMMM yyyy"), F.lit(" by"))
    return articles(ws).select(
        "id",
        F.coalesce(F.unix_timestamp(ur.url_date(F.col("url"))), F.lit(-1).cast("long")).alias("url_secs"),
        F.unix_timestamp(ur.text_date(text)).alias("text_secs"),
    )


@query("f10_short_names", r"""
SELECT id, trim(regexp_replace(lower(split_part(replace(regexp_extract(url, '^https?://([^/?#]+)', 1), 'www.', ''), '.', 1)), '[^a-z0-9]+', '-', 'g'), '-')
  || '-' || coalesce(nullif(substr(trim(regexp_replace(lower(list_extract([x FOR x IN string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') IF x <> ''], -1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 20), ''), 'page') AS name
FROM articles
""")
def short_names(ws):
    return articles(ws).select("id", ur.short_name(F.col("url")).alias("name"))


@query("f11_safe_slugs", r"""
SELECT id, coalesce(nullif(s, ''), id) AS slug FROM (SELECT id, trim(regexp_replace(lower(regexp_replace(title, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM articles)
""")
def slugs(ws):
    s = tx.safe_slug(F.col("title"))
    return articles(ws).select("id", F.coalesce(F.nullif(s, F.lit("")), "id").alias("slug"))


@query("f19_anchor", """
SELECT id, CASE WHEN length(description) <= 80 THEN description
  WHEN contains(left(description, 80), ' ') THEN left(left(description, 80), 80 - strpos(reverse(left(description, 80)), ' ')) ELSE left(description, 80) END AS anchor FROM articles
""")
def anchors(ws):
    from wordloom.functions.evidence import anchor

    return articles(ws).select("id", anchor(F.col("description")).alias("anchor"))


@query("f23_body_clean", r"""
SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS body,
  len([x FOR x IN string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ') IF x <> '']) AS n_words FROM documents
""")
def body_clean(ws):
    b = F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f]+", " "))
    return ws.table("documents").select(
        "doc_id", b.alias("body"), F.size(F.filter(F.split(b, " "), lambda x: x != "")).cast("long").alias("n_words")
    )


@query("j01_not_rejected", "SELECT id, arrival FROM feed WHERE url NOT IN (SELECT source_url FROM rejected)")
def not_rejected(ws):
    return ar.without_rejected(feed(ws), rejected(ws)).select("id", "arrival")


@query("j02_status_carry_over", "SELECT f.id, f.arrival, coalesce(p.status, 'new') AS status FROM feed f LEFT JOIN previous p USING (id)")
def carry(ws):
    return ar.carry_status(feed(ws), previous(ws)).select("id", "arrival", "status")


@query("j03_new_this_run", "SELECT id, arrival, tier FROM snapshot WHERE id NOT IN (SELECT id FROM previous)")
def new_this_run(ws):
    return stages(ws)["scored"].join(previous(ws).select("id"), "id", "left_anti").select("id", "arrival", "tier")


@query("u01_tier_union", "SELECT id, arrival, tier, status, coalesce(excluded_reason, '') AS reason FROM snapshot")
def tier_union(ws):
    return stages(ws)["scored"].select("id", "arrival", "tier", "status", F.coalesce("excluded_reason", F.lit("")).alias("reason"))


@query("u05_insert_or_ignore", """
SELECT id, arg_min(arrival, arrival) AS arrival, arg_min(title, arrival) AS title FROM feed WHERE id NOT IN (SELECT id FROM previous) GROUP BY id
""")
def upsert(ws):
    return ar.insert_or_ignore(previous(ws), feed(ws), ["id"], "arrival").select("id", "arrival", "title")


@query("d19_article_pipeline", """
SELECT id, arg_min(arrival, arrival) AS arrival, arg_min(score, arrival) AS score, arg_min(matched_text, arrival) AS matched, 'new' AS status
FROM scored_feed WHERE tier = 'passing' AND id NOT IN (SELECT id FROM previous) GROUP BY id
""")
def pipeline(ws):
    rows = stages(ws)["store_rows"]
    new = ar.insert_or_ignore(previous(ws), rows, ["id"], "arrival")
    return new.select("id", "arrival", "score", F.array_join("matched", "|").alias("matched"), "status")


@query("a08_stage_counts", """
SELECT 'raw' AS stage, count(*) AS n FROM feed UNION ALL SELECT 'recent', count(*) FROM recent_feed
UNION ALL SELECT 'filtered', count(*) FROM tagged_feed WHERE excluded_reason IS NULL AND url NOT IN (SELECT source_url FROM rejected)
UNION ALL SELECT 'scored', count(*) FROM snapshot UNION ALL SELECT 'top', count(*) FROM scored_feed WHERE tier = 'passing'
""")
def stage_counts(ws):
    st = stages(ws)

    def n(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")

    out = n("raw", feed(ws)).unionByName(n("recent", ar.recent(feed(ws), TODAY, 360)))
    out = out.unionByName(n("filtered", st["filtered"])).unionByName(n("scored", st["scored"]))
    return out.unionByName(n("top", st["store_rows"]))


@query("w14_source_limit", """
SELECT id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY arrival) AS rk FROM feed)
WHERE rk <= CASE WHEN source_name IN ('src1', 'src2') THEN 5 WHEN source_name = 'src3' THEN 20 ELSE 1000000000000 END
""")
def source_limit(ws):
    names = articles(ws).select("source_name").distinct()
    limits = names.withColumn(
        "output_limit",
        F.when(F.col("source_name").isin("src1", "src2"), 5).when(F.col("source_name") == "src3", 20),
    )
    return ar.limit_per_source(feed(ws), limits).select("id", "arrival")


view("registry", "SELECT series, slug, row_number() OVER (PARTITION BY series ORDER BY a) AS number FROM (SELECT series, source_name || '-' || (arrival % 40) AS slug, min(arrival) AS a FROM articles WHERE arrival < 100 GROUP BY 1, 2)")


@query("w15_episode_numbers", """
SELECT * FROM registry UNION ALL
SELECT f.series, slug, row_number() OVER (PARTITION BY f.series ORDER BY a) + coalesce(top, 0) FROM (
  SELECT series, source_name || '-' || (arrival % 40) AS slug, min(arrival) AS a FROM articles GROUP BY 1, 2) f
LEFT JOIN (SELECT series, max(number) AS top FROM registry GROUP BY 1) t ON t.series = f.series
WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.series = f.series AND r.slug = f.slug)
""")
def episodes(ws):
    slug = F.concat("source_name", F.lit("-"), (F.col("arrival") % 40).cast("string"))
    a = articles(ws).select("series", slug.alias("slug"), "arrival")
    none = ws.spark.createDataFrame([], "series string, slug string, number bigint")
    known = ar.episode_numbers(none, a.where("arrival < 100"))
    return ar.episode_numbers(known, a)


@query("j12_source_of_url", """
SELECT a.url, (SELECT arg_min(s.name, s.rank) FROM (
    SELECT 'exact-2' AS name, 1 AS rank, 'src2.example.com' AS h UNION ALL SELECT 'parent', 2, 'example.com' UNION ALL SELECT 'child', 0, 'deep.src3.example.com') s
  WHERE s.h = x.h OR x.h LIKE '%.' || s.h OR s.h LIKE '%.' || x.h) AS name
FROM articles a JOIN (SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM articles) x ON x.url = a.url
""")
def source_of_url(ws):
    rows = [("child", 0, "https://www.deep.src3.example.com/"), ("exact-2", 1, "https://src2.example.com/x/"), ("parent", 2, "http://example.com")]
    sources = ws.spark.createDataFrame(rows, "name string, rank int, homepage string")
    return ar.match_source(articles(ws).select("url"), sources)


@query("u08_merge_rejections", """
SELECT slug, arg_min(src, k) AS origin, arg_min(source_url, k) AS source_url FROM (
  SELECT slug, source_url, 'a' AS src, doc_id AS k FROM rejected WHERE slug IS NOT NULL AND doc_id % 2 = 0
  UNION ALL SELECT slug, source_url, 'b', 1000000000 + doc_id FROM rejected WHERE slug IS NOT NULL) GROUP BY slug
""")
def merge_rejections(ws):
    r = rejected(ws).where("slug is not null")
    a = r.where("doc_id % 2 = 0").select("slug", "source_url", F.lit("a").alias("origin"), F.col("doc_id").alias("k"))
    b = r.select("slug", "source_url", F.lit("b").alias("origin"), (F.col("doc_id") + 1000000000).alias("k"))
    return ar.first_per_key(a.unionByName(b), ["slug"], "k").select("slug", "origin", "source_url")


@query("p10_rejected_listing", "SELECT source_url, topic, series FROM rejected WHERE series = 'news' ORDER BY doc_id DESC")
def rejected_list(ws):
    return rejected(ws).where("series = 'news'").orderBy(F.col("doc_id").desc()).select("source_url", "topic", "series")


@query("d33_status_marking", """
SELECT s.id, coalesce(c.status, s.status) AS status FROM store s
LEFT JOIN (SELECT url, arg_max(status, event_id) AS status FROM (
    SELECT 'https://src' || (user_id % 20) || '.example.com/blog/' || (event_id % 1000) AS url, event_id,
           CASE event_type WHEN 'click' THEN 'viewed' ELSE 'done' END AS status FROM events) GROUP BY url) c USING (url)
""")
def marking(ws):
    e = ws.table("events").select(
        F.concat(F.lit("https://src"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com/blog/"), (F.col("event_id") % 1000).cast("string")).alias("url"),
        F.col("event_id").alias("arrival"),
        F.when(F.col("event_type") == "click", "viewed").otherwise("done").alias("status"),
    )
    return ar.mark_status(store(ws), e).select("id", "status")
