"""Admission by a sliding window and runs of segments, against plain code, with one key over many partitions and over a stream."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators.limits import admissions
from marlstone.shared import fresh_path, run_numbers
from marlstone.streaming.limits import admit_stream
from marlstone.streaming.sessions import merge_segments


@pytest.fixture
def many_parts(spark):
    """Partitions stay as many as asked for, so that a key is spread over them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain(times, limit, window):
    """Whether each of the ``times``, in order, is admitted."""
    recent, out = [], []
    for t in times:
        recent = [r for r in recent if r >= t - window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


@pytest.mark.parametrize("spread", [300.0, 3000.0, 40_000.0])  # over the limit always, at times, hardly ever
def test_one_key_over_all_partitions(spark, many_parts, spread):
    r = random.Random(int(spread))
    hot = [float(r.randrange(int(spread))) for _ in range(2000)]
    cold = {k: [float(r.randrange(400)) for _ in range(r.randrange(1, 30))] for k in ("a", "z", None)}
    rows = [("hot", t) for t in hot] + [(k, t) for k, v in cold.items() for t in v] + [("none", None), ("none", None), ("none", 5.0)]
    df = spark.createDataFrame(rows, "ip string, t double").repartition(5)
    got = {x.key: (x.n_events, x.n_admitted) for x in admissions(df, "ip", F.col("t"), 5, 60.0).collect()}
    want = {k: (len(v), sum(plain(sorted(v), 5, 60.0))) for k, v in {"hot": hot, **cold}.items()}
    assert got == want | {"none": (3, 3)}


def test_keys_keep_their_type_and_no_events_give_no_rows(spark):
    df = spark.createDataFrame([(2**53 + 1, 0.0), (None, 0.0)], "id long, t double")
    assert sorted((r.key or 0, r.n_events) for r in admissions(df, "id", F.col("t")).collect()) == [(0, 1), (2**53 + 1, 1)]
    assert admissions(df.limit(0), "id", F.col("t")).count() == 0


def test_runs_of_one_key_over_all_partitions(spark, many_parts):
    r = random.Random(3)
    rows = [("hot", r.randrange(60_000), i) for i in range(3000)] + [(r.choice(["a", "z", None]), r.randrange(5000), i) for i in range(3000, 3200)]
    rows += [("hot", None, 9001), ("hot", None, 9002)]
    df = spark.createDataFrame(rows, "who string, at long, id long").repartition(5)
    out = run_numbers(df, "who", "at", ["id"], 40, "run")
    assert out.select(F.spark_partition_id()).distinct().count() > 6
    got = out.collect()
    want, last = {}, None
    for who, at, i in sorted(rows, key=lambda x: (x[0] or "", x[1] is not None, x[1] or 0, x[2])):
        if last is None or last[0] != who or None in (at, last[1]) or at - last[1] > 40:
            first = i
        want[i] = first
        last = (who, at)
    firsts = {}
    for x in sorted(got, key=lambda x: (x.run, x.at or 0, x.id)):
        firsts.setdefault(x.run, x.id)
    assert len(got) == len(rows) and {x.id: firsts[x.run] for x in got} == want


def test_utterances_of_one_speaker_over_all_partitions(spark, many_parts):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(milliseconds=100 * i + (10_000 * (i // 50))), i, f"w{i}") for i in range(1000)] + [(None, start, 5000, "x"), ("s", None, 5001, None)]
    df = spark.createDataFrame(rows, "who string, ts timestamp, n long, word string")
    got = {(r.who, r.started): (r.n_segments, r.merged) for r in merge_segments(df, "who", "ts", "n", "word", "650 milliseconds").collect()}
    want = {("s", rows[50 * i][1]): (50, " ".join(f"w{j}" for j in range(50 * i, 50 * i + 50))) for i in range(20)}
    assert got == want | {(None, start): (1, "x"), ("s", None): (1, "")}


def test_admission_over_a_stream_with_late_events_and_a_restart(spark, tmp_path):
    start, schema = dt.datetime(2024, 1, 1), "ip string, ts timestamp"
    r = random.Random(7)
    seconds = {"a": sorted(r.sample(range(0, 300), 90)), "b": sorted(r.sample(range(0, 300), 12))}
    rows = sorted(((k, s) for k, v in seconds.items() for s in v), key=lambda x: x[1] + r.uniform(0, 9))  # out of order within the lateness
    parts = [rows[:30], rows[30:60], rows[60:], [("end", 900)]]
    out, offsets = str(tmp_path / "out"), fresh_path(spark, "offsets")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        told = admit_stream(stream, "ip", "ts", 4, 30.0)
        q = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for n, part in enumerate(parts):
        spark.createDataFrame([(k, start + dt.timedelta(seconds=s)) for k, s in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 1:
            run()  # the query ends here and goes on from its checkpoint
        time.sleep(1.1)  # files are taken by age
    run()
    got = sorted((x.ip, int((x.ts - start).total_seconds()), x.admitted) for x in spark.read.parquet(out).collect())
    want = sorted((k, s, ok) for k, v in seconds.items() for s, ok in zip(v, plain(v, 4, 30), strict=True))
    assert got == want
