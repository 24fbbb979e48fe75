"""Benchmark decontamination by size-partitioned MinHash containment search. Native expressions only.

Question: which documents contain at least ``threshold`` of a test item's distinct five-word
shingles? Under a random hash, the shingle of an item with the least value lies in a document with
probability equal to that containment, however long the document is; so each of k hash functions
gives one probe, and an item that a document contains to ``threshold`` is missed only if all k minima
fall into the part it lacks: at most (1 - threshold)^k. Items are partitioned by their number of
shingles. In a partition with sizes from ``lower``, whole shingles must match, so the true bound is
ceil(threshold * lower) / lower, and k is the least number that brings the miss below ``MISS``; items
with at most k shingles probe with all of them. Probes fetch candidate pairs by an equi-join on the
shingle hash. Candidates are then verified exactly: their distinct shingle hashes in common are counted.

Words are lower-cased, split at blanks and U+0009 to U+000D. An item with fewer than five words is one
shingle of all of them, which a document holds where the same words stand in a row; documents are cut
into shingles of every length that occurs among the items (at most five lengths). A text without words
has none and fits nothing.

Shuffles: none of texts while probes and candidate ids are small enough to broadcast (measured);
beyond that, equi-joins on hash or id that Spark can split. Defined results: rows with a null id are
searched like others and report null; rows that share an id are taken as one document and report once; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import broadcast_if_small, keep, words

SHINGLE = 5
THRESHOLD = 0.8
#: Largest chance that an item in a document is not found.
MISS = 1e-6


def _word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))


def _shingles(hashes: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, in order, with repeats."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - length), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(length)])
    )
    return F.when(F.size(hashes) >= length, each).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(text: Column, lengths: list[int]) -> Column:
    """Hashes of all shingles of a document, of each of ``lengths``."""
    return F.element_at(F.transform(F.array(_word_hashes(text)), lambda h: F.concat(*[_shingles(h, n) for n in lengths])), 1)


def probes_of(size: Column, threshold: float = THRESHOLD) -> Column:
    """How many minima an item of this many shingles probes with; a rule per power of two."""

    def k(lower: int) -> int:
        share = math.ceil(threshold * lower) / lower
        return lower if share >= 1 else math.ceil(math.log(MISS) / math.log(1 - share))

    # from 1024 on the share is the threshold itself, but for a rounding
    rule = F.lit(math.ceil(math.log(MISS) / math.log(1 - threshold)))
    for e in range(9, -1, -1):
        # the least share within [2^e, 2^(e+1)) decides
        most = max(k(s) for s in range(2**e, 2 ** (e + 1)))
        rule = F.when(size < 2 ** (e + 1), F.lit(most)).otherwise(rule)
    return F.least(size, rule)


def item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """_item, _length, _size, _set: distinct shingle hashes of each item, and the words of a shingle."""
    hashed = items.select(F.col(item_id).alias("_item"), _word_hashes(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    each = _shingles(F.col("_words"), SHINGLE)
    for n in range(1, SHINGLE):
        each = F.when(F.size("_words") == n, _shingles(F.col("_words"), n)).otherwise(each)
    return hashed.select(
        "_item", F.least(F.size("_words"), F.lit(SHINGLE)).alias("_length"), F.array_distinct(each).alias("_set")
    ).select("_item", "_length", F.size("_set").alias("_size"), "_set")


def item_probes(sets: DataFrame, threshold: float) -> DataFrame:
    """_item, _hash: the minima of each item under its number of hash functions."""
    minima = F.transform(
        F.sequence(F.lit(1), probes_of(F.col("_size"), threshold)),
        lambda k: F.array_min(F.transform("_set", lambda x: F.struct(F.xxhash64(k, x).alias("h"), x.alias("x"))))["x"],
    )
    each = F.when(F.col("_size") <= probes_of(F.col("_size"), threshold), F.col("_set")).otherwise(minima)
    return sets.select("_item", F.explode(F.array_distinct(each)).alias("_hash"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_common, n_item, containment: every pair at or above the threshold."""
    sets = keep(item_shingles(items, item_id, text), "item-sets")
    lengths = sorted(r["_length"] for r in sets.select("_length").distinct().collect()) or [SHINGLE]  # at most five rows
    probes = broadcast_if_small(keep(item_probes(sets, threshold), "probes"), 24)
    found = (
        docs.select(F.col(doc_id).alias("_doc"), F.explode(shingle_hashes(F.col(text), lengths)).alias("_hash"))
        .join(probes, "_hash")
        .select("_doc", "_item")
        .distinct()
    )
    found = keep(found, "candidates")
    ids = broadcast_if_small(keep(found.select("_doc").distinct(), "candidate-docs"), 16)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    near = texts.join(ids, texts["_doc"].eqNullSafe(ids["_doc"]), "left_semi")
    shingles = near.select("_doc", F.explode(F.array_distinct(shingle_hashes(F.col("_text"), lengths))).alias("_hash"))
    wanted = broadcast_if_small(sets.select("_item", "_size", F.explode("_set").alias("_hash")), 32)
    # a document's shingles meet the items that hold them; verification is against every item it
    # was a candidate for, and no other
    common = (
        shingles.join(wanted, "_hash")
        .groupBy("_doc", "_item", "_size")
        .agg(F.countDistinct("_hash").alias("_n"))
        .where(F.col("_n") >= threshold * F.col("_size"))
    )
    pairs = found.select(F.col("_doc").alias("_d"), F.col("_item").alias("_i"))
    return common.join(
        pairs, common["_doc"].eqNullSafe(pairs["_d"]) & common["_item"].eqNullSafe(pairs["_i"]), "left_semi"
    ).select(
        F.col("_doc").alias(doc_id),
        F.col("_item").alias(item_id),
        F.col("_n").alias("n_common"),
        F.col("_size").cast("long").alias("n_item"),
        (F.col("_n") / F.col("_size")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id") -> DataFrame:
    """The documents that contain no test item; all their columns. Null ids that hit go together."""
    hit = keep(contained_items(docs, items, threshold, doc_id=doc_id).select(F.col(doc_id).alias("_hit")).distinct(), "hits")
    hit = broadcast_if_small(hit, 16)
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["_hit"]), "left_anti")
