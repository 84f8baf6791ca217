"""Admission by a sliding window over a stream, with late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.limits import Admitted


def admit_stream(events: DataFrame, key: str, ts: str, limit: int = 30, window: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """(key, ts, admitted) of each event of a stream, as ``operators.limits.admissions`` over all of them would admit it.

    An event is decided once the watermark has passed its time, so those up to ``late`` are decided in the order of their
    times and not of their coming; later ones are dropped. The state of a key holds its events to be decided and ``limit``
    admitted times at most; it goes once nothing of it counts any more. Events without a time are dropped.
    """
    kind = events.schema[key].dataType
    rows = events.where(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, late)
    span = round(window * 1e6)

    def decide(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, times, counts = state.get if state.exists else ([], [], [])
        waiting = sorted([*waiting, *(int(t) for b in batches for t in b["_us"])])
        mark = state.getCurrentWatermarkMs()
        due = [t for t in waiting if t <= mark * 1000]
        kept = Admitted(limit, span, zip(times, counts, strict=True))
        yes = [kept.add(t, 1) > 0 for t in due]
        waiting = waiting[len(due) :]
        held = [(t, n) for t, n in kept.recent if t >= mark * 1000 - span]
        if waiting or held:
            state.update((waiting, [t for t, _ in held], [n for _, n in held]))
            state.setTimeoutTimestamp(max(mark + 1, (waiting[0] if waiting else held[-1][0] + span) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": pd.Series([own[0]] * len(due), dtype=object), "us": pd.Series(due, dtype="int64"), "admitted": pd.Series(yes, dtype=bool)})

    out = S.StructType([S.StructField("key", kind), S.StructField("us", S.LongType()), S.StructField("admitted", S.BooleanType())])
    held = "waiting array<long>, times array<long>, counts array<long>"
    told = rows.groupBy(key).applyInPandasWithState(decide, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col("key").alias(key), F.timestamp_micros("us").alias(ts), "admitted")
