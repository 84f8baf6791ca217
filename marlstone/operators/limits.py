"""Admission by a sliding window: at most so many events of a key in the last so many seconds; rejected ones don't count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.shared import sorted_parts, written

_PIECE = "part int, key string, n_events long, n_admitted long, opens boolean, closes boolean, known_from double, recent array<struct<t: double, n: long>>"
_HEAD = "part int, n_admitted long, recent array<struct<t: double, n: long>>"


class Admitted:
    """The times admitted in the last ``window``, each with how many: ``limit`` at most. One older than ``window`` is forgotten."""

    def __init__(self, limit: int, window: float, recent=()):
        self.limit, self.window, self.recent = limit, window, deque((t, n) for t, n in recent)
        self.held = sum(n for _, n in self.recent)

    def add(self, t: float, n: int) -> int:
        """How many of ``n`` events at ``t``, no earlier than those before, are admitted."""
        while self.recent and self.recent[0][0] < t - self.window:
            self.held -= self.recent.popleft()[1]
        taken = min(n, self.limit - self.held)
        if taken > 0:
            self.recent.append((t, taken))
            self.held += taken
        return max(taken, 0)


class _Piece:
    """The events of one key in one partition. Where it opens the partition, admission is unknown at first, since events before
    may fill the window. It is known from a time on whose window holds only events that any beginning would admit: those with
    fewer than ``limit`` events of any kind in their own window, and none of it before the partition."""

    def __init__(self, part: int, key: str, opens: bool, limit: int, window: float):
        self.part, self.key, self.opens, self.limit, self.window = part, key, opens, limit, window
        self.n_events = self.n_admitted = 0
        self.first = self.unsure = self.known_from = None
        self.near: deque = deque()
        self.near_n = 0
        self.state = None if opens else Admitted(limit, window)

    def add(self, t: float | None, n: int) -> None:
        self.n_events += n
        if t is None:  # admitted, and remembered by none
            self.n_admitted += n
        elif self.state is not None:
            self.n_admitted += self.state.add(t, n)
        else:
            start = t - self.window
            self.first = t if self.first is None else self.first
            while self.near and (self.near[0][0] < start or self.near_n - self.near[0][1] >= self.limit):
                self.near_n -= self.near.popleft()[1]
            if start <= self.first or self.near_n + n > self.limit:
                self.unsure = t
            self.near.append((t, n))
            self.near_n += n
            if self.unsure < start:
                self.state, self.known_from = Admitted(self.limit, self.window, self.near), t

    def row(self, closes: bool) -> dict:
        recent = [{"t": t, "n": n} for t, n in self.state.recent] if closes and self.state is not None else None
        return {"part": self.part, "key": self.key, "n_events": self.n_events, "n_admitted": self.n_admitted, "opens": self.opens, "closes": closes,
                "known_from": self.known_from, "recent": recent}


def _columns(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def admissions(events: DataFrame, key: str, ts: Column, limit: int = 30, window: float = 60.0) -> DataFrame:
    """(key, n_events, n_admitted): at most ``limit`` admitted in the last ``window`` seconds; rejected ones aren't kept.

    ``ts`` is in seconds. An entry exactly ``window`` old still counts. Events without a time are admitted and count for no
    other; those without a key are one key's. An empty table gives no rows.

    Events of one key and time are counted first. The counts are folded in partitions sorted by key and time, so a key with
    most events is spread over many; a fold holds ``limit`` times at most. What a partition admits of its first key depends on
    the partition before only until the key stays under the limit for a window's length; up to there it is folded once more
    when the times before are known. Partitions whose beginnings are known go together, so there is one more job for most
    tables, and one for each partition in a row that a key fills while it is over the limit without a break.
    """
    kind = events.schema[key].dataType
    times = events.select(F.col(key).cast("string").alias("key"), ts.cast("double").alias("t")).groupBy("key", "t").agg(F.count("*").alias("n"))
    parts = sorted_parts(times, ["key", "t"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = None, []
        for b in batches:
            for part, k, t, n in _columns(b, "_part", "key", "t", "n"):
                if own is None or own.key != k:
                    if own is not None:
                        done.append(own.row(False))
                    own = _Piece(part, k, own is None, limit, window)
                own.add(t, n)
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist(done, _PIECE_ARROW)
                done = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([*done, own.row(True)], _PIECE_ARROW)

    found = written(parts.mapInArrow(pieces, _PIECE), "pieces")
    ends = found.where("opens OR closes").collect()  # two a partition, with `limit` times each
    opening = {r["part"]: r for r in ends if r["opens"]}
    closing = {r["part"]: r for r in ends if r["closes"]}
    order = sorted(opening)
    after = {p: [tuple(x) for x in r["recent"]] for p, r in closing.items() if r["recent"] is not None}
    before = dict(zip(order[1:], order[:-1], strict=True))
    heads: list[tuple] = []
    left = set(order)
    while left:
        start = {}
        for p in left:
            q = before.get(p)
            if q is None or closing[q]["key"] != opening[p]["key"]:
                start[p] = []
            elif q in after:
                start[p] = after[q]
        until = {p: opening[p]["known_from"] for p in start}

        def head(batches: Iterator[pa.RecordBatch], start: dict = start, until: dict = until) -> Iterator[pa.RecordBatch]:
            state, taken, part, first = None, 0, None, None
            for b in batches:
                for p, k, t, n in _columns(b, "_part", "key", "t", "n"):
                    if state is None:
                        if p not in start:
                            return
                        state, part, first = Admitted(limit, window, start[p]), p, k
                    if k != first or (t is not None and until[part] is not None and t > until[part]):
                        break
                    taken += state.add(t, n) if t is not None else 0
                else:
                    continue
                break
            if state is not None:
                yield pa.RecordBatch.from_pylist([{"part": part, "n_admitted": taken, "recent": [{"t": t, "n": n} for t, n in state.recent]}], _HEAD_ARROW)

        for r in parts.mapInArrow(head, _HEAD).collect():  # one a partition
            heads.append((opening[r["part"]]["key"], 0, r["n_admitted"]))
            if opening[r["part"]]["closes"]:
                after.setdefault(r["part"], [tuple(x) for x in r["recent"]])
            left.discard(r["part"])
    rest = events.sparkSession.createDataFrame(heads, "key string, n_events long, n_admitted long")
    both = found.select("key", "n_events", "n_admitted").unionByName(rest)
    return both.groupBy("key").agg(F.sum("n_events").alias("n_events"), F.sum("n_admitted").alias("n_admitted")).withColumn("key", F.col("key").cast(kind))


_TIMES = pa.list_(pa.struct([("t", pa.float64()), ("n", pa.int64())]))
_PIECE_ARROW = pa.schema([
    ("part", pa.int32()), ("key", pa.string()), ("n_events", pa.int64()), ("n_admitted", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()),
    ("known_from", pa.float64()), ("recent", _TIMES),
])
_HEAD_ARROW = pa.schema([("part", pa.int32()), ("n_admitted", pa.int64()), ("recent", _TIMES)])
