"""Structured Streaming forms of the incremental jobs.

A stored table is a folder of ``run=<id>/batch=<n>`` folders: the run belongs to a checkpoint, and a
batch that is played again writes its own folder again. A batch always looks at what all other
folders hold, so a job that starts anew on an old store (a new checkpoint) loses and repeats nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def landed_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(df: DataFrame, write: Callable, checkpoint: str, mode: str = "append") -> None:
    """Process what has landed, batch by batch, and stop."""
    q = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


# -- stored batches ------------------------------------------------------------------------------


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a store, with ``run`` and ``batch``; empty before the first is written."""
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def _run_of(checkpoint: str) -> str:
    return "r" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def _others(spark: SparkSession, path: str, schema: T.StructType, run: str, batch_id: int) -> DataFrame:
    return stored(spark, path, schema).where(~((F.col("run") == run) & (F.col("batch") == batch_id)))


def _write(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


# -- jobs ----------------------------------------------------------------------------------------


def upsert_stream(items: DataFrame, key: str, time: str, path: str, checkpoint: str) -> None:
    """Insert-or-ignore: of an item's rows in a batch the earliest, unless the store has the item.
    Nothing is too late: the store is asked, not a window of time."""
    run, schema = _run_of(checkpoint), items.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), time).alias("row")).select("row.*")
        seen = _others(batch.sparkSession, path, schema, run, batch_id).select(key)
        _write(first.join(seen, key, "left_anti"), path, run, batch_id)

    run_available(items, write, checkpoint)


RESPONSE = T.StructType(
    [T.StructField("idea_id", T.LongType()), T.StructField("deleted_at", T.LongType()), T.StructField("kept_at", T.LongType())]
)


def response_stream(responses: DataFrame, path: str, checkpoint: str) -> None:
    """Keep and delete events to the first of each per idea. Only ideas that a batch changes are
    written; minima of minima are the same in whatever batches the events came."""
    firsts = responses.groupBy("idea_id").agg(
        F.min(F.when(F.col("action") == "delete", F.col("arrival"))).alias("deleted_at"),
        F.min(F.when(F.col("action") == "keep", F.col("arrival"))).alias("kept_at"),
    )
    run = _run_of(checkpoint)
    run_available(firsts, lambda b, i: _write(b, path, run, i), checkpoint, "update")


def response_status(spark: SparkSession, path: str) -> DataFrame:
    """Status per idea of what ``response_stream`` has stored. A delete is final."""
    s = stored(spark, path, RESPONSE).groupBy("idea_id").agg(F.min("deleted_at").alias("d"), F.min("kept_at").alias("k"))
    return s.select(
        "idea_id", F.when(F.col("d").isNotNull(), "rejected").when(F.col("k").isNotNull(), "viewed").otherwise("new").alias("status")
    )


def limited_events(events: DataFrame, min_gap_s: int, delay: str) -> DataFrame:
    """Events of a key at least ``min_gap_s`` after the last one let through, in order of event time.

    Rows wait in the key's state until the watermark has passed them, so rows that come out of order
    within ``delay`` are judged in order. A key without waiting rows is forgotten once its last event
    can no longer hold one back.
    """
    gap_us = min_gap_s * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, ids = state.get if state.exists else (None, [], [])
        waiting = list(zip(times, ids))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["ts_us"].tolist(), rows["event_id"].tolist())
        waiting.sort()
        passed_us = state.getCurrentWatermarkMs() * 1000
        out, left = [], []
        for ts, event in waiting:
            if ts >= passed_us:
                left.append((ts, event))
            elif last is None or ts - last >= gap_us:
                out.append((key[0], event, ts))
                last = ts
        if not left and (last is None or last + gap_us < passed_us):
            state.remove()
        else:
            state.update((last, [t for t, _ in left], [e for _, e in left]))
            wake = (left[0][0] if left else last + gap_us) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts_us"])

    slim = events.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("ts_us"))
    return slim.groupBy("user_id").applyInPandasWithState(
        step,
        "user_id bigint, event_id bigint, ts_us bigint",
        "last bigint, times array<bigint>, ids array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Pause-delimited groups per user; the same plan serves batch and stream."""
    e = events.withWatermark("ts", delay) if delay else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).drop("w")


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Finished rows of a stream, batch by batch."""
    run = _run_of(checkpoint)
    run_available(rows, lambda b, i: _write(b, path, run, i), checkpoint)


NUMBERED = T.StructType(
    [T.StructField("series", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("number", T.LongType())]
)


def numbering_stream(arrivals: DataFrame, path: str, checkpoint: str) -> None:
    """Keep-first-number-forever registry: each batch writes its unseen slugs, numbered on from the last
    number of all other batches."""
    from wordloom.operators.articles import episode_numbers

    run = _run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = _others(batch.sparkSession, path, NUMBERED, run, batch_id).select("series", "slug", "number")
        fresh = episode_numbers(known, batch).join(known.select("series", "slug"), ["series", "slug"], "left_anti")
        _write(fresh, path, run, batch_id)

    run_available(arrivals, write, checkpoint)
