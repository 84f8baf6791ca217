"""Session merging over a stream with late data."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.shared import fresh_path
from marlstone.streaming.sessions import merge_segments, merge_stream

START = dt.datetime(2024, 1, 1)


def rows(*items):
    return [(k, START + dt.timedelta(milliseconds=ms), text) for k, ms, text in items]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    schema = "speaker string, ts timestamp, text string"
    first = rows(("a", 0, "where"), ("a", 500, "is"), ("a", 900, "it"), ("a", 3000, "again"), ("b", 100, "hello"))
    late = rows(("a", 1200, "now"), ("b", 60_000, "end"))
    more = rows(("b", 70_000, "more"))  # rows are late from the batch after the next
    gone = rows(("a", 1500, "too late"), ("b", 120_000, "last"))
    for n, part in enumerate((first, late, more, gone)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n < 3:
            import time

            time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    merged = merge_stream(stream, "speaker", "ts", "text")
    q = merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "offsets")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.speaker, r.n_segments, r.merged) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, "again"), ("a", 4, "where is it now"), ("b", 1, "end"), ("b", 1, "hello"), ("b", 1, "more")]
    batch = spark.createDataFrame(first + late, schema).withColumn("n", F.monotonically_increasing_id())
    same = sorted((r.speaker, r.n_segments, r.merged) for r in merge_segments(batch, "speaker", "ts", "n", "text", "650 milliseconds").collect())
    assert same == [("a", 1, "again"), ("a", 4, "where is it now"), ("b", 1, "end"), ("b", 1, "hello")]
