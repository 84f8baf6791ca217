"""Session merging of committed segments: a batch form and one over a stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.shared import run_numbers


def merge_segments(segments: DataFrame, key: str, ts: str, order: str, text: str, quiet: str) -> DataFrame:
    """(key, started, n_segments, merged): segments no further apart than ``quiet`` are one utterance.

    Segments are numbered over partitions sorted by key and time, so one key may have most of them; what meets in one task
    is one utterance. Segments without a time are utterances of their own, those without a key one speaker's.
    """
    spark = segments.sparkSession
    gap = spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {quiet}"))).first()[0]
    s = segments.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(order).alias("_order"), F.col(text).alias("_text"))
    s = run_numbers(s.withColumn("_us", F.unix_micros(F.col("_ts").cast("timestamp"))), "_key", "_us", ["_order"], gap, "_no")
    parts = F.array_sort(F.collect_list(F.struct("_ts", "_order", "_text")))
    told = F.array_join(F.transform(parts, lambda x: x["_text"]), " ")
    return s.groupBy("_no").agg(F.first("_key").alias(key), F.min("_ts").alias("started"), F.count("*").alias("n_segments"), told.alias("merged")).drop("_no")


def merge_stream(segments: DataFrame, key: str, ts: str, text: str, quiet: str = "650 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The same over a stream: a session closes once the watermark has passed its quiet time."""
    parts = F.array_sort(F.collect_list(F.struct(ts, text)))
    return (
        segments.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet).alias("session"))
        .agg(F.count("*").alias("n_segments"), F.array_join(F.transform(parts, lambda x: x[text]), " ").alias("merged"))
        .select(key, F.col("session.start").alias("started"), "n_segments", "merged")
    )
