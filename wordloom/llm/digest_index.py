"""Exact dedup against a persistent index of text digests.

The index is a folder of two Parquet tables, bucketed and sorted by SHA-256 digest: ``sightings`` (per
batch one row for each of its digests: how often, and its greatest row) and ``entries`` (one row per digest:
who stays). A batch is combined by digest before its only shuffle, appended to ``sightings``, and merged with
``entries`` by a sort-merge anti-join of equal buckets, which shuffles nothing; digests that are new are
appended. A batch that is added again, as after a failure, appends only what is missing.

Of equal texts the row with the greatest id stays, among those of the batch that brought the text first. So
batches in descending order of id keep the greatest of all.

Rows are judged by a join with the entries. Digests on more than one in ``HOT`` rows number less than ``HOT``
and are broadcast; every other digest holds a small share of the rows, so no key makes a large task. Texts
are never shuffled.

Defined results: null texts equal empty ones; a null id is below every other; of repeated rows with equal
ids one stays; an empty table gives an empty result. The number of buckets is fixed when an index is made.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import keep

#: A digest on over one in this many rows is looked up by broadcast. There are fewer than this many.
HOT = 1000


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, digest and a tag that tells repeated rows apart; stored, so that the tag stays what it is."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text)).alias("digest"))
    tag = F.concat_ws("-", F.lit(uuid.uuid4().hex[:16]), F.monotonically_increasing_id())
    return keep(rows.withColumn("row", tag), "digests")


class DigestIndex:
    """``DigestIndex(spark, path, buckets)`` makes an index or opens the one that is there."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        about = f"{path}/about"
        if buckets is not None:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(about)
        self.buckets = spark.read.parquet(about).first()["buckets"]
        tag = uuid.uuid4().hex
        self.sightings, self.entries = f"sightings_{tag}", f"entries_{tag}"
        for name, more, folder in ((self.sightings, "n BIGINT, ", "sightings"), (self.entries, "", "entries")):
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, {more}id BIGINT, row STRING, batch INT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/{folder}'"
            )

    def close(self) -> None:
        """Takes the names out of the session; the files stay."""
        for name in (self.sightings, self.entries):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Takes in one batch of ``digest_rows``."""
        top = F.max(F.struct("id", "row"))
        combined = rows.groupBy("digest").agg(F.count("*").alias("n"), top.alias("top"))
        combined = combined.repartition(self.buckets, "digest").select("digest", "n", "top.*", F.lit(batch).alias("batch"))
        again = self._of_batch(batch).select("digest").hint("merge")
        combined.join(again, "digest", "left_anti").write.insertInto(self.sightings)
        self.fresh(batch).write.insertInto(self.entries)

    def _of_batch(self, batch: int) -> DataFrame:
        return self.spark.table(self.sightings).where(F.col("batch") == batch)

    def fresh(self, batch: int) -> DataFrame:
        """The batch's digests that the index does not hold: a merge of equal buckets."""
        entries = self.spark.table(self.entries).select("digest").hint("merge")
        return self._of_batch(batch).join(entries, "digest", "left_anti").select("digest", "id", "row", "batch")

    def groups(self) -> DataFrame:
        """digest, keep_id, keep_row, group_size (over all batches)."""
        sizes = self.spark.table(self.sightings).groupBy("digest").agg(F.sum("n").alias("group_size"))
        entries = self.spark.table(self.entries).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
        return sizes.hint("merge").join(entries, "digest")

    def judge(self, rows: DataFrame) -> DataFrame:
        """``rows`` that were added, with keep_id, group_size and kept."""
        total = rows.count()
        groups = keep(self.groups().where(F.col("group_size") > 1), "copies")
        often = F.col("group_size") * HOT > total
        named = ["digest", "keep_id", "keep_row", "group_size"]
        # a text that was met once stays: only copies are looked up
        hot = F.broadcast(groups.where(often).select(*[F.col(c).alias(f"hot_{c}") for c in named]))
        tried = rows.join(hot, rows["digest"] == hot["hot_digest"], "left")
        found = tried.where("hot_digest IS NOT NULL").select(*rows.columns, *[F.col(f"hot_{c}").alias(c) for c in named[1:]])
        rest = tried.where("hot_digest IS NULL").select(*rows.columns).join(groups.where(~often), "digest", "left")
        kept = F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True))
        return found.unionByName(rest).select(
            *rows.columns,
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            kept.alias("kept"),
        )


def cuts_of(rows: DataFrame, batches: int) -> list[int]:
    """Ids that cut the rows into batches, in descending order."""
    ends = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if ends["lo"] is None:
        return []
    return [ends["hi"] - (ends["hi"] - ends["lo"]) * k // batches for k in range(1, batches)]


def exact_duplicates(docs: DataFrame, path: str, buckets: int, batches: int = 3) -> DataFrame:
    """Per row id, digest, row, keep_id, group_size, kept; the index is left at ``path``.

    The table comes in as ``batches`` ranges of ids, the greatest first; each opens the index anew.
    """
    spark = docs.sparkSession
    rows = digest_rows(docs)
    number = F.lit(0)
    cuts = cuts_of(rows, batches)
    for cut in cuts:
        number = number + F.coalesce(F.col("id") < cut, F.lit(True)).cast("int")
    for batch in range(len(cuts) + 1):
        index = DigestIndex(spark, path, buckets)
        index.add(rows.where(number == batch), batch)
        index.close()
    index = DigestIndex(spark, path)
    judged = keep(index.judge(rows), "judged")
    index.close()
    return judged
