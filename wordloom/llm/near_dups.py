"""Near-duplicate documents by MinHash.

1. Each text's shingle set gives ``HASHES`` minima under universal hashes, (a x + b) >> 32 modulo 2^64.
   Texts with the same set are one class, named by its least doc_id; only classes go on.
2. Banding: ``ROWS`` minima make a band key. Two sets with a Jaccard similarity of 0.85 share none of
   the 32 keys with a chance of (1 - 0.85^4)^32 < 1e-10; at 0.80, of (1 - 0.80^4)^32 < 5e-8.
3. Candidates of a band are compared with its least class first: a star, not all pairs. Components follow.
   A band whose open classes lie in different components goes on. Of each of its classes, the shingles
   that no other open class has are counted: what is left of it must reach its share of a union with the
   smallest partner, or it can have no link in the band and leaves it. The bands that are left tie their
   classes to groups. A group is dealt into blocks of bounded size, and every two blocks (but for those of its
   largest component) are compared as a whole, by the full sets, in one task. It returns links that unite its classes no further than all its
   links would, so fewer than it has classes. So every two classes of a band end up compared, connected or
   proven apart, and no row is made for a pair.
4. A comparison with a star's centre first estimates the similarity from both signatures, with a margin that a true link
   misses with a chance below 1e-9, then counts the intersection and union of the full sets.
5. Links make components by alternating large-star and small-star.

Texts move only for classes that were compared: the ids are broadcast while small (measured), else
joined. Bands and digests that are hot meet in joins that Spark splits, never in one task.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; so is a row
with a null doc_id, whose component is null and which is not kept. Rows of one doc_id with different
texts are told apart by their sets; two classes with the same least doc_id are one node. Repeated rows
get equal results. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import broadcast_if_small, keep
from wordloom.llm.components import components
from wordloom.llm.shingles import shingle_set

HASHES = 128
ROWS = 4
BANDS = HASHES // ROWS
#: Equal minima below which a comparison ends without the full sets (expected at 0.85: 109, deviation 4).
LEAST_EQUAL = 80
#: Linked from this percentage of the union in the intersection.
PERCENT = 85
#: Both for ``keep_one_of_each`` (expected at 0.80: 102, deviation 4.5; fewer than 73 with a chance below 1e-9).
KEEP_PERCENT, KEEP_LEAST_EQUAL = 80, 73
#: Classes of a block, and the bytes of text from which a group gets more blocks than by that count.
BLOCK, BLOCK_BYTES = 128, 4 << 20
#: Shingles of two blocks that are counted together.
_COLUMNS = 4096

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of a shingle set under each universal hash (uint32)."""
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    x = s >> np.uint64(32)
    for lo in range(0, len(x), 512):
        np.minimum(out, ((x[lo : lo + 512, None] * _A + _B) >> np.uint64(32)).min(0), out=out)
    return out.astype("<u4")


def signatures(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id, n_shingles, digest of the set, sig (binary)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text).cast("binary").alias("_text"))
    schema = rows.select("_id").schema.add("n_shingles", "long").add("digest", "binary").add("sig", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py() or b"")
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                names=["_id", "n_shingles", "digest", "sig"],
            )

    return rows.mapInArrow(run, schema)


def band_keys(sig: str) -> Column:
    """The key of each band of a signature."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(sig, i * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )


def _similar_signatures(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) with at least ``least`` equal minima."""
    sig = classes.select("rep", "sig")
    rows = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, HASHES) for c in (batch.column(2), batch.column(3)))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have ``100 * intersection >= percent * union``."""
    rows = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a").join(
        texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: OrderedDict[bytes, np.ndarray] = OrderedDict()  # the last few: a pivot comes again and again

        def of(data: bytes) -> np.ndarray:
            key = hashlib.blake2b(data, digest_size=16).digest()
            if key not in sets:
                sets[key] = shingle_set(data)
                if len(sets) > 32:
                    sets.popitem(last=False)
            sets.move_to_end(key)
            return sets[key]

        for batch in batches:
            linked = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = of(ta.as_py() or b""), of(tb.as_py() or b"")
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _unshared(texts: DataFrame) -> DataFrame:
    """rep, alone: how many shingles of a class stand in no other class of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py() or b"").view(np.int64)
                for lo in range(0, len(s), 1 << 16):
                    part = pa.array(s[lo : lo + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([rep.as_py()] * len(part), pa.int64()), part], names=["rep", "h"])

    hashes = texts.mapInArrow(run, "rep bigint, h bigint")
    once = hashes.groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).where("rep = last")
    return once.groupBy("rep").agg(F.count("*").alias("alone"))


def _blocks(able: DataFrame, texts: DataFrame) -> DataFrame:
    """group, first, second (two blocks, or one twice) and their classes: block, rep, comp, _text.

    ``able(key, rep, comp)`` are the classes of the open bands. Those tied by bands are a group, unless all of it is
    one component; its classes are dealt into blocks by their ids. The group's largest component has blocks of
    its own, which meet only the others: its classes are united already.
    """
    band = able.groupBy("key").agg(F.min("rep").alias("head"))
    tied = components(able.join(band, "key").where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v")))
    group = F.coalesce("component", "rep").alias("group")
    of = able.select("rep", "comp").distinct().join(tied, F.col("rep") == F.col("node"), "left").select("rep", "comp", group)
    mixed = of.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("group")
    members = keep(of.join(mixed, "group", "left_semi").join(texts, F.col("rep") == F.col("_id")).drop("_id"), "members")
    sums = members.groupBy("group", "comp").agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("bytes"))
    largest = sums.groupBy("group").agg(F.max(F.struct("n", "comp")).alias("m")).select("group", F.col("m.comp").alias("main"))
    sums = sums.join(largest, "group").groupBy("group", "main")

    def blocks(main: bool) -> Column:
        some = (F.col("comp") == F.col("main")) == F.lit(main)
        n, size = F.sum(F.when(some, F.col("n"))), F.sum(F.when(some, F.col("bytes")))
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    dealt = members.join(keep(sums.agg(blocks(False).alias("rest"), blocks(True).alias("of_main")), "groups"), "group")
    main, place = F.col("comp") == F.col("main"), F.xxhash64("rep")
    block = F.when(main, F.col("rest") + F.pmod(place, "of_main")).otherwise(F.pmod(place, "rest")).cast("int")
    last = F.col("rest") - 1 + F.when(main, 0).otherwise(F.col("of_main"))
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    return dealt.select("group", block.alias("block"), other, "rep", "comp", "_text").select(
        "group", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rep", "comp", "_text"
    )


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each two of the sets share."""
    hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
    hashes = hashes[counts > 1]
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    each = np.concatenate(sets)
    column = np.searchsorted(hashes, each)
    shared = column < len(hashes)
    shared[shared] = hashes[column[shared]] == each[shared]
    of, column = of[shared], column[shared]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, len(hashes), _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        has = np.zeros((len(sets), min(_COLUMNS, len(hashes) - lo)), np.float32)
        has[of[a:b], column[a:b] - lo] = 1
        both += has @ has.T
    return both.astype(np.int64)


def _block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of two blocks that unite what all their links unite. Classes of one
    component count as united."""

    def run(table: pa.Table) -> pa.Table:
        reps, comps, block = (table.column(c).to_numpy() for c in ("rep", "comp", "block"))
        sets = [shingle_set(t or b"") for t in table.column("_text").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        both = _intersections(sets)
        linked = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes - both))
        linked &= comps[:, None] != comps
        if (block != block[0]).any():  # each block with itself is a task of its own
            linked &= block[:, None] != block
        root = {c: c for c in comps.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked)))):
            x, y = top(int(comps[i])), top(int(comps[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(max(reps[i], reps[j]))
                b.append(min(reps[i], reps[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("group", "first", "second").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, least_equal: int = LEAST_EQUAL
) -> DataFrame:
    """id, n_shingles, component_id, kept."""
    rows = keep(signatures(docs, id_col, text), "signatures")
    classes = keep(
        rows.where("n_shingles > 0 and _id is not null")
        .groupBy("digest")
        .agg(F.min("_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig")),
        "classes",
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text).cast("binary").alias("_text"))

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs")
        near = keep(_similar_signatures(pairs, classes, least_equal), "similar")
        ids = keep(near.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "compared")
        some = keep(texts.join(broadcast_if_small(ids, 16), "_id", "left_semi"), "compared-texts")
        return keep(_confirmed(near, some, percent), "links")

    members = classes.select("rep", F.explode(band_keys("sig")).alias("key"))
    bands = members.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1").drop("n")
    shared = keep(members.join(bands, "key").where("rep <> pivot"), "bands")
    links = links_of(shared.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # one row per class with the bands in which it takes part: what is told of a class joins once
    still = keep(
        shared.groupBy("rep")
        .agg(F.collect_set("key").alias("open"))
        .join(classes.select("rep", "size", band_keys("sig").alias("keys")), "rep"),
        "open",
    )
    named = still.join(labels, F.col("rep") == F.col("node"), "left").select(
        "rep", "size", "keys", "open", F.coalesce("component", "rep").alias("comp")
    )
    at = named.select(F.explode("open").alias("key"), "rep", "comp")
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = keep(mixed, "mixed")
    if not mixed.isEmpty():
        mixed = broadcast_if_small(mixed, 16)
        left = at.join(mixed, "key", "left_semi").groupBy("rep").agg(F.collect_set("key").alias("open"))
        ids = keep(left.withColumnRenamed("rep", "_id"), "open")
        some = texts.join(broadcast_if_small(ids.select("_id"), 16), "_id", "left_semi")
        # an id with several rows may have several texts: nothing is counted for it
        often = rows.join(broadcast_if_small(ids.select("_id"), 16), "_id", "left_semi").groupBy("_id").count().where("count > 1")
        alone = _unshared(some).join(often, F.col("rep") == F.col("_id"), "left_anti")
        facts = ids.withColumnRenamed("_id", "rep").join(alone, "rep", "left")
        named = named.drop("open").join(facts, "rep")
        named = keep(named.withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0))), "counted")
        sized = named.select(F.explode("open").alias("key"), "rep", "comp", "size", "common")
        least = sized.groupBy("key").agg(F.min("size").alias("least"))
        # 100 * intersection >= percent * (size + size - intersection), and no more than what is common
        able = (100 + percent) * F.col("common") >= percent * (F.col("size") + F.col("least"))
        sized = keep(sized.join(least, "key").where(able).select("key", "rep", "comp"), "able")
        more = keep(_block_links(_blocks(sized, some), percent), "block-links")
        links = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.select("a", "b"))
        labels = components(links)
    of_class = keep(
        classes.select("digest", "rep")
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select("digest", F.coalesce("component", "rep").alias("_component")),
        "class-components",
    )
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return rows.join(of_class, "digest", "left").select(
        F.col("_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"),
    )


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = KEEP_PERCENT, least_equal: int = KEEP_LEAST_EQUAL
) -> DataFrame:
    """``docs`` without the documents that near duplicates with a smaller id stand for.

    Rows that share an id stay together if any of them stays; rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text, percent, least_equal)
    gone = (
        found.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max("kept").alias("_any"))
        .where("not _any")
        .select(F.col(id_col).alias("_gone"))
    )
    gone = broadcast_if_small(keep(gone, "duplicates"), 16)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
