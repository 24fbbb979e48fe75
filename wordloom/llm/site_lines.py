"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are divided by all pages of the host; lines above the
boilerplate ratio are dropped from every page of that host. A line is compared without surrounding
white space, by a 64-bit hash; blank lines are never dropped. A page counts once per line.

Shuffles: (host, line hash) counts, combined before the shuffle, and one total per host. Texts are not
shuffled while the drop lists are small enough to broadcast (their size is measured); beyond that
they join by host, where Spark splits a hot host. A host's list is bounded by the distinct lines of
an average page over the ratio.

Defined results: null hosts form one host; null texts have no lines and stay null; a page repeated k
times counts k times; an empty table gives an empty result. Other columns pass through untouched;
results replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import broadcast_if_small, keep

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.05
#: A line on fewer pages is never boilerplate, however small its host.
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(line, "^[\\t-\\r ]+|[\\t-\\r ]+$", "")))


def _blank(line: Column) -> Column:
    return ~line.rlike("[^\\t-\\r ]")


def boilerplate_lines(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """_host, _drop: the hashes of the lines to drop on each host that has any."""
    named = pages.select(F.col(host).cast("string").alias("_host"), F.col(text).alias("_text"))
    totals = named.groupBy("_host").agg(F.count("*").alias("_pages"))
    full = F.filter(_lines(F.coalesce("_text", F.lit(""))), lambda x: ~_blank(x))
    seen = (
        named.select("_host", F.explode(F.array_distinct(F.transform(full, _key))).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_pages)
    )
    return (
        seen.join(totals, seen["_host"].eqNullSafe(totals["_host"]))
        .where(F.col("_n") > ratio * F.col("_pages"))
        .groupBy(seen["_host"])
        .agg(F.sort_array(F.collect_set("_line")).alias("_drop"))
    )


def drop_site_lines(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``pages`` with ``text`` cleaned, and ``n_lines``, ``n_dropped`` (lines before, lines dropped)."""
    lists = keep(boilerplate_lines(pages, host, text, ratio, min_pages), "boilerplate")
    lists = broadcast_if_small(lists, 16 + F.octet_length(F.coalesce("_host", F.lit(""))) + 8 * F.size("_drop"))
    # the page stays apart from what is added to it, whatever its columns are called
    page = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"),
        F.col(host).cast("string").alias("_own"),
        F.col(text).alias("_text"),
    )
    kept = F.when(
        F.col("_drop").isNotNull() & F.col("_text").isNotNull(),
        F.filter(_lines(F.col("_text")), lambda x: _blank(x) | ~F.array_contains("_drop", _key(x))),
    )
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(_lines(F.col("_text")))).cast("long")
    n_dropped = F.when(F.col("_kept").isNull(), 0).otherwise(n_lines - F.size("_kept")).cast("long")
    results = {
        "n_lines": n_lines,
        "n_dropped": n_dropped,
        text: F.when(n_dropped == 0, F.col("_text")).otherwise(F.array_join("_kept", "\n")),
    }
    cleaned = page.join(lists, F.col("_own").eqNullSafe(F.col("_host")), "left").withColumn("_kept", kept)
    return cleaned.select(
        *[F.col("page")[c].alias(c) if c not in results else results[c].alias(c) for c in pages.columns],
        *[results[c].alias(c) for c in ("n_lines", "n_dropped") if c not in pages.columns],
    )
