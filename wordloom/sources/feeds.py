"""Landed feeds, posts, ledgers and source configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions import urls as ur

# What a feed starts with.
FEED_MARKS = ["<rss", "<feed", "<atom", "<?xml"]


def looks_like_feed(body: Column) -> Column:
    """One of the marks within the first 500 characters."""
    head = F.substring(body, 1, 500)
    return F.exists(ur.literal_array(FEED_MARKS), lambda m: F.contains(head, m))


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files and entries of landed Atom files. Items without a link are dropped."""
    rss = (
        spark.read.format("xml")
        .option("rowTag", "item")
        .schema("link string, title string, description string, pubDate string, updated string")
        .load(path)
        .select("link", "title", F.col("description").alias("summary"), F.coalesce("pubDate", "updated").alias("raw_date"))
    )
    entries = (
        spark.read.format("xml")
        .option("rowTag", "entry")
        .schema(
            "link array<struct<_href:string,_rel:string>>, title string, summary string, content string, "
            "published string, updated string"
        )
        .load(path)
    )
    # the page itself, not the feed or an enclosure
    pages = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    atom = entries.select(
        F.coalesce(F.get(pages, F.lit(0)), F.get("link", F.lit(0)))["_href"].alias("link"),
        "title",
        F.coalesce("summary", "content").alias("summary"),
        F.coalesce("published", "updated").alias("raw_date"),
    )
    return feed_items(rss.unionByName(atom))


def feed_items(raw: DataFrame) -> DataFrame:
    """Article rows from ``link, title, summary, raw_date``: markup stripped, 500 characters of
    summary, date in UTC."""
    from wordloom.operators.pages import plain_text

    url = F.trim(F.coalesce("link", F.lit("")))
    return raw.where(url != "").select(
        tx.hash_key(url).alias("id"), url.alias("url"), F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.substring(plain_text(F.coalesce("summary", F.lit(""))), 1, 500).alias("description"),
        ur.parse_date(F.col("raw_date")).alias("published_at"),
    )


def post_articles(posts: DataFrame, site: str) -> DataFrame:
    """Article rows from landed posts: own text, else the link, 500 characters."""
    url = F.concat(F.lit(site), "permalink")
    return posts.select(
        tx.hash_key(url).alias("id"), url.alias("url"), "title", F.timestamp_seconds("created_utc").alias("published_at"),
        F.substring(F.coalesce(F.nullif(F.col("selftext"), F.lit("")), F.col("link"), F.lit("")), 1, 500).alias("description"),
    )


def since_cursor(posts: DataFrame, cursor: DataFrame) -> DataFrame:
    """Posts newer than their source's last one; sources without a cursor pass whole."""
    return posts.join(cursor, "source_name", "left").where(
        F.col("since").isNull() | (F.col("created_utc") > F.col("since"))
    ).drop("since")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Published keys; the second field may be missing, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_ledger(lines)


def parse_ledger(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.select(F.get(f, F.lit(0)).alias("key"), F.get(f, F.lit(1)).alias("at"))


def append_ledger(keys: DataFrame, path: str) -> None:
    keys.select(F.concat_ws("\t", "key", "at").alias("value")).write.mode("append").text(path)


def source_configs(spark: SparkSession, files: dict[str, list[dict]]) -> DataFrame:
    """Sources of several configuration files, each tagged with its series, in listed order."""
    rows = [
        (series, n, s.get("name", ""), s.get("company", ""), s.get("homepage", ""), s.get("fetch", "rss"), s.get("output_limit"), s.get("init_score", 0))
        for series, sources in files.items()
        for n, s in enumerate(sources)
    ]
    return spark.createDataFrame(
        rows, "series string, rank int, name string, company string, homepage string, fetch string, output_limit int, init_score int"
    )
