"""Raw web pages: article text, cards, dates, block matching, figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import evidence as ev
from wordloom.functions import urls as ur
from wordloom.functions.markup import CLASS_PARTS, NOISE_TAGS, article_of
from wordloom.functions.topk import top_per_key

# Markers of an interstitial served instead of the page.
BLOCK_MARKERS = [
    "captcha-delivery.com", "/cdn-cgi/challenge-platform", "Just a moment...",
    "Attention Required! | Cloudflare", "Access Denied", "Pardon Our Interruption",
    "Checking your browser...", "X-Hashcash-Solution",
]
# Article containers, best first, as (tag, attribute pattern).
CONTAINERS = [
    ("article", ""),
    ("[a-z0-9]+", r'itemprop="articleBody"'),
    *[("[a-z0-9]+", rf'class="[^"]*{part}') for part in CLASS_PARTS],
    ("main", ""),
    ("[a-z0-9]+", r'class="(?:[^"]* )?content[ "]'),
]
# Card families, first that yields wins.
CARD_FAMILIES = ["article", "post-item", "blog-item", "blog-post", "article-card", "post-card", "entry", "li"]
# Where pages state their date.
DATE_KEYS = ["datePublished", "dateCreated", "uploadDate"]
DATE_METAS = [
    ("property", "article:published_time"), ("property", "og:article:published_time"),
    ("name", "datePublished"), ("name", "pubdate"), ("name", "publishdate"), ("name", "timestamp"),
    ("name", "DC.date"), ("name", "sailthru.date"), ("itemprop", "datePublished"),
]
DATE_CLASSES = ["date", "published", "timestamp", "meta", "agate"]
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def is_bot_wall(html: Column) -> Column:
    """Short page carrying a marker of an anti-bot interstitial."""
    return (F.char_length(html) <= 50000) & F.exists(
        ur.literal_array(BLOCK_MARKERS), lambda m: F.contains(html, m)
    )


def drop_noise(html: Column) -> Column:
    for tag in NOISE_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return html


def plain_text(html: Column) -> Column:
    """Tags to blanks, entities decoded, blanks collapsed."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in _ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def _container(html: Column, tag: str, attr: str) -> Column:
    if tag.isalpha():
        return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.regexp_extract(html, rf"(?is)<({tag})\b[^>]*{attr}[^>]*>(.*?)</\1>", 2)


def extract_article(pages: DataFrame) -> DataFrame:
    """title and body: the first container with more than 200 characters, else all paragraphs.

    Regular expressions cover pages whose containers do not nest in themselves;
    ``extract_article_dom`` parses the tree.
    """
    p = pages.withColumn("_h", drop_noise(F.col("html")))
    h1 = plain_text(F.regexp_extract("_h", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    title = plain_text(F.regexp_extract("_h", r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    texts = F.transform(F.array(*[_container(F.col("_h"), t, a) for t, a in CONTAINERS]), plain_text)
    rich = F.get(F.filter(texts, lambda t: F.char_length(t) > 200), F.lit(0))
    paragraphs = F.array_join(
        F.transform(F.regexp_extract_all("_h", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain_text), " "
    )
    has_h1 = F.col("_h").rlike(r"(?i)<h1\b")
    return p.select("page_id", F.when(has_h1, h1).otherwise(title).alias("title"), F.coalesce(rich, paragraphs).alias("body"))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def _article_from_tree(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article_of(h or "") for h in html], columns=["title", "body"])


def extract_article_dom(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", _article_from_tree("html").alias("a")).select("page_id", "a.*")


def published_date(pages: DataFrame) -> DataFrame:
    """First readable date: JSON-LD, meta tags, <time>, a dated class, the URL, the text."""
    h = F.col("html")
    ld = F.array_join(
        F.regexp_extract_all(h, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1)), "\n"
    )
    found = [F.regexp_extract(ld, rf'"{k}"\s*:\s*"([^"]+)"', 1) for k in DATE_KEYS]
    for attr, name in DATE_METAS:
        tag = F.regexp_extract(h, rf'(?is)<meta\b[^>]*\b{attr}="{name}"[^>]*>', 0)
        found.append(F.regexp_extract(tag, r'(?i)content="([^"]+)"', 1))
    time_tag = F.regexp_extract(h, r"(?is)<time\b[^>]*>.*?</time>", 0)
    found.append(
        F.coalesce(F.nullif(F.regexp_extract(time_tag, r'datetime="([^"]+)"', 1), F.lit("")), plain_text(time_tag))
    )
    classes = "|".join(DATE_CLASSES)
    found.append(plain_text(F.regexp_extract(h, rf'(?is)<[a-z0-9]+\b[^>]*class="[^"]*(?:{classes})[^"]*"[^>]*>[^<]*<', 0)))
    found += [ur.url_date_text(F.col("url")), ur.text_date_text(plain_text(drop_noise(h)))]
    # one reader over an array keeps the generated code small
    read = F.filter(F.transform(F.array(*found), ur.parse_date), lambda d: d.isNotNull())
    return pages.select("page_id", F.get(read, F.lit(0)).alias("published"))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def article_cards(pages: DataFrame) -> DataFrame:
    """Cards of each page from the first family that yields any: heading, link on the same host,
    each URL once."""
    base = F.col("url")

    def family(name: str) -> Column:
        if name in ("article", "li"):
            blocks = F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\b[^>]*>.*?</{name}>"), F.lit(0))
        else:
            blocks = F.regexp_extract_all(
                "html", F.lit(rf'(?is)<([a-z0-9]+)\b[^>]*class="[^"]*{name}[^"]*"[^>]*>.*?</\1>'), F.lit(0)
            )

        def card(b):
            heading = F.regexp_extract(b, r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", 1)
            inner = F.regexp_extract(heading, r"(?is)<a\b[^>]*>(.*?)</a>", 1)
            link = F.regexp_extract(
                F.when(heading.rlike(r"(?i)<a\b"), heading).otherwise(b), r'(?is)<a\b[^>]*href="([^"]*)"', 1
            )
            title = F.when(plain_text(inner) != "", plain_text(inner)).otherwise(plain_text(heading))
            return F.struct(
                ur.clean_title(title).alias("title"),
                F.when(link != "", resolve_url(base, link)).alias("card_url"),
                F.substring(plain_text(F.regexp_extract(b, r"(?is)<p\b[^>]*>(.*?)</p>", 1)), 1, 500).alias("description"),
            )

        cards = F.transform(blocks, card)
        return F.filter(
            cards, lambda c: (c["title"] != "") & F.coalesce(ur.is_article_url(c["card_url"], base), F.lit(False))
        )

    chosen = F.array().cast("array<struct<title:string,card_url:string,description:string>>")
    families = [family(n) for n in CARD_FAMILIES]
    pick = F.when(F.size(families[0]) > 0, families[0])
    for f in families[1:]:
        pick = pick.when(F.size(f) > 0, f)
    rows = pages.select("page_id", F.posexplode(F.coalesce(pick, chosen)).alias("n", "c"))
    first = rows.groupBy("page_id", F.col("c.card_url").alias("card_url")).agg(F.min_by("c", "n").alias("c"))
    return first.select("page_id", "card_url", "c.title", "c.description")


# Elements whose text makes a block.
BLOCK_TAGS = "p|li|blockquote|h1|h2|h3|h4|h5|h6|td|pre"


def page_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks of each page, in order, with whether they open within the article."""
    # marks that no page holds: a block opens, the article opens, the article ends
    html = F.translate(drop_noise(F.col("html")), "\x01\x02\x03", "")
    html = F.regexp_replace(html, rf"(?i)<(?:{BLOCK_TAGS})\b[^>]*>", "\x01")
    html = F.regexp_replace(F.regexp_replace(html, r"(?i)<article\b[^>]*>", "\x02"), r"(?i)</article>", "\x03")

    def blocks(part: Column) -> Column:
        pieces = F.split(part, "\x01")
        inside = F.startswith(part, F.lit("\x02"))
        return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda t: F.struct(inside.alias("inside"), t.alias("t")))

    parts = F.split(html, "(?=[\x02\x03])")
    return (
        pages.select("page_id", F.posexplode(F.flatten(F.transform(parts, blocks))).alias("block", "b"))
        .select(
            "page_id",
            F.col("block").cast("long").alias("block"),
            F.col("b.inside").alias("in_article"),
            plain_text(F.regexp_replace("b.t", rf"(?is)</(?:{BLOCK_TAGS})>.*$", "")).alias("text"),
        )
        .where("text <> ''")
    )


def match_blocks(blocks: DataFrame, snippets: DataFrame, min_share: float = 0.6) -> DataFrame:
    """Best block for each snippet: blocks holding its anchor first (article before page), ranked by
    twice the snippet's word hits plus the context's; else the best share of snippet words."""
    def clean(c):
        # typographic quotes and dashes to plain ones, characters without width dropped
        c = F.translate(c, "\u2018\u2019\u201c\u201d\u2014\u2013\u200b\u200c\u200d\u2060\ufeff\u00ad", "''''--")
        return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f]+", " "))

    def words(c):
        return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.char_length(t) > 2)

    s = snippets.select(
        "page_id", "snippet_id", clean(ev.anchor(F.col("snippet"))).alias("anchor"),
        words(F.col("snippet")).alias("sw"), words(F.col("context")).alias("cw"),
    )
    b = blocks.select("page_id", "block", "in_article", clean(F.col("text")).alias("t"))
    p = b.join(s, "page_id").withColumn("have", F.split("t", "[^a-z0-9]+"))

    def hits(c):
        return F.size(F.filter(c, lambda w: F.array_contains(F.col("have"), w)))

    exact = F.contains(F.col("t"), F.col("anchor"))
    share = F.when(F.size("sw") > 0, hits(F.col("sw")) / F.size("sw")).otherwise(F.lit(0.0))
    p = p.select(
        "page_id", "snippet_id", "block",
        exact.alias("exact"), F.col("in_article").alias("scoped"),
        (2 * hits(F.col("sw")) + hits(F.col("cw"))).alias("score"), share.alias("share"),
    )
    rank = F.struct(
        F.col("exact").alias("a"),
        (F.col("exact") & F.col("scoped")).alias("b"),
        F.when(F.col("exact"), F.col("score").cast("double")).otherwise(F.col("share")).alias("c"),
        (-F.col("block")).alias("d"),
    )
    best = p.groupBy("page_id", "snippet_id").agg(
        F.max_by(F.struct("block", "exact", "share"), rank).alias("m")
    )
    found = F.col("m.exact") | (F.col("m.share") >= min_share)
    return best.select(
        "page_id",
        "snippet_id",
        F.when(found, F.col("m.block")).otherwise(-1).alias("block"),
        F.when(F.col("m.exact"), "exact").when(found, "fuzzy").otherwise("none").alias("match"),
    )


# Figure rules.
FIGURE_BLOCKLIST = (
    "avatar|gravatar|emoji|sprite|logos?|icons?|author|badge|ads?|adservice|doubleclick|promo|"
    "spacer|pixel|share|sharing|facebook|twitter|linkedin|thumbnail|featured|hero"
)
FIGURE_WORDS = (
    r"diagram|architecture|\bflow\b|pipeline|sequence|\bchart\b|\bgraph\b|benchmark|latency|"
    r"throughput|topology|schematic|comparison"
)


def score_figures(figures: DataFrame) -> DataFrame:
    """keep (size, shape, format and block-list rules) and score of figure candidates."""
    w, h = F.col("w"), F.col("h")
    blocked = F.lower("blob").rlike(f"(?:^|[^a-z0-9])(?:{FIGURE_BLOCKLIST})(?:[^a-z0-9]|$)")
    keep = (w >= 200) & (h >= 200) & (w <= 5 * h) & (h <= 5 * w) & (F.col("format") != "gif") & ~blocked
    text = F.lower(F.concat_ws(" ", "figcaption", "alt", "title"))
    score = (
        F.when(F.trim("figcaption") != "", 3).otherwise(0)
        + F.when(text.rlike(FIGURE_WORDS), 2).otherwise(0)
        + F.when(F.col("format").isin("png", "svg"), 1).otherwise(0)
        + F.when(w.between(400, 1600), 1).otherwise(0)
        + F.when(F.col("is_figure"), 1).otherwise(0)
    )
    return figures.withColumn("keep", keep).withColumn("score", score.cast("long"))


def best_figures(scored: DataFrame, limit: int = 8) -> DataFrame:
    return top_per_key(scored.where("keep"), ["page_id"], [F.col("score").desc(), F.col("fig")], limit)


def one_per_digest(figures: DataFrame) -> DataFrame:
    """One representative of each page's identical images: the best placed."""
    rank = F.struct(-F.col("score"), F.col("fig"))
    return figures.groupBy("page_id", F.md5("bytes").alias("digest")).agg(F.min_by("fig", rank).alias("fig"))


def distinct_media(urls: DataFrame) -> DataFrame:
    """Each URL of a page once: files before embeds before links, then by position."""
    rank = F.struct(
        F.when(F.col("kind") == "file", 0).when(F.col("kind") == "embed", 1).otherwise(2), F.col("n")
    )
    return urls.where("link <> ''").groupBy("page_id", "link").agg(F.min_by("kind", rank).alias("kind"))
