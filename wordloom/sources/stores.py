"""Article store, run snapshots and keyed replacement on Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = "array<string>"


def encode_keywords(words: Column) -> Column:
    return F.to_json(words)


def decode_keywords(text: Column) -> Column:
    """Unreadable JSON gives an empty list."""
    return F.coalesce(F.from_json(text, KEYWORDS), F.array().cast(KEYWORDS))


def write_store(articles: DataFrame, path: str, mode: str = "append") -> None:
    """One dataset partitioned by series; readers that name a series prune to it."""
    articles.write.mode(mode).partitionBy("series").parquet(path)


def read_store(spark: SparkSession, path: str, series: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("series") == series) if series else df


def save_run_stage(rows: DataFrame, path: str, run_type: str, run_at: str, stage: str) -> None:
    (
        rows.withColumn("run_type", F.lit(run_type))
        .withColumn("run_at", F.lit(run_at))
        .withColumn("stage", F.lit(stage))
        .write.mode("append")
        .partitionBy("run_type", "run_at", "stage")
        .parquet(path)
    )


def latest_run(spark: SparkSession, path: str, run_type: str, stage: str) -> DataFrame:
    """Rows of the newest run of a type; the newest ``run_at`` comes from partition values alone."""
    runs = spark.read.option("basePath", path).parquet(path).where(F.col("run_type") == run_type)
    newest = runs.agg(F.max("run_at").alias("run_at"))
    return runs.where(F.col("stage") == stage).join(newest, "run_at", "left_semi")


def replace_by_key(
    existing: DataFrame, incoming: DataFrame, key: str, carry_kind: str | None = None
) -> DataFrame:
    """Rows of the incoming keys replace the existing ones; rows of ``carry_kind`` survive."""
    hit = incoming.select(key).distinct()
    kept = existing.join(hit, key, "left_anti")
    out = kept.unionByName(incoming)
    if carry_kind is not None:
        carried = existing.where(F.col("kind") == carry_kind).join(hit, key, "left_semi")
        out = out.unionByName(carried)
    return out


def import_new(store: DataFrame, landed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append and the inserted / skipped counts."""
    distinct = landed.dropDuplicates([key])
    new = distinct.join(store.select(key), key, "left_anti")
    counts = landed.agg(F.count("*").alias("landed")).crossJoin(
        new.agg(F.count("*").alias("inserted"))
    )
    return new, counts.select("inserted", (F.col("landed") - F.col("inserted")).alias("skipped"))
