"""Packing documents into sequences of bounded length by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's tokens go, uncut, into the window they leave the least
room in; where none has room and no window is free, the fullest is emitted, filled up
with their first part if more than ``SLACK`` places of it are left. What is
longer than a window is whole sequences and a rest. So a task holds its open windows and one text, whatever the table's
size. The windows that stay open at a partition's end are merged: their pieces are packed again, the larger first, by
ever fewer tasks (``FAN_IN`` partitions' open windows each), until one is left; it fills the fuller windows from the
emptier ones and cuts the last window at powers of two, which need no padding.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from marlstone.llm.common import written
from marlstone.llm.token_count import tokens

LENGTH, WINDOWS, SLACK, FAN_IN, END, VOCABULARY = 1024, 64, 16, 16, 0, "byte_bpe_50k.json"
_HOLD = 4 << 20  # bytes of identifiers handed on at a time

Piece = tuple[object, int, int, np.ndarray]  # doc_id, start, the document's tokens, identifiers


class Packer:
    """Open windows of one task; ``put`` gives the sequences that are emitted on the way."""

    def __init__(self, length: int, windows: int, slack: int = 0):
        self.length, self.windows, self.slack = length, windows, slack
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.open: dict[int, list[Piece]] = {}
        self.opened = 0

    def put(self, doc: object, start: int, total: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        while len(ids):
            if len(ids) >= self.length:
                room, w = self.length, None
            elif (at := bisect_left(self.rooms, (len(ids), -1))) < len(self.rooms):
                room, w = self.rooms.pop(at)
            elif len(self.rooms) < self.windows:
                room, w = self.length, self.opened
                self.open[w] = []
                self.opened += 1
            else:
                room, w = self.rooms.pop(0)
                if room <= self.slack:
                    yield self.open.pop(w)
                    continue
            part = (doc, start, total, ids[:room])
            start, left, ids = start + room, room - len(ids), ids[room:]
            if w is None:
                yield [part]
            else:
                self.open[w].append(part)
                if left > 0:
                    insort(self.rooms, (left, w))
                else:
                    yield self.open.pop(w)

    def rest(self) -> list[list[Piece]]:
        return list(self.open.values())


def _size(window: list[Piece]) -> int:
    return sum(len(p[3]) for p in window)


def merged(windows: list[list[Piece]], length: int) -> Iterator[list[Piece]]:
    """Sequences of all pieces of ``windows``: full ones, filled from the emptiest, and powers of two."""
    held = sorted(windows, key=_size, reverse=True)
    i, j = 0, len(held) - 1
    while i < j:
        room = length - _size(held[i])
        while room and held[j]:
            doc, start, total, ids = held[j].pop()
            held[i].append((doc, start, total, ids[:room]))
            if len(ids) > room:
                held[j].append((doc, start + room, total, ids[room:]))
            room -= min(room, len(ids))
        j -= not held[j]
        if not room:
            yield held[i]
            i += 1
    if i == j:
        pieces, size = held[i][::-1], _size(held[i])
        for power in (1 << b for b in reversed(range(size.bit_length())) if size >> b & 1):
            out, room = [], power
            while room:
                doc, start, total, ids = pieces.pop()
                out.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    pieces.append((doc, start + room, total, ids[room:]))
                room -= min(room, len(ids))
            yield out


_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]


class _Rows:
    """Sequences as record batches; a sequence_id is made of the round, the partition and a count."""

    def __init__(self, kind: pa.DataType, turn: int):
        self.kind, self.base, self.n, self.held = kind, turn << 56 | TaskContext.get().partitionId() << 32, 0, 0
        self.columns: list[list] = [[] for _ in _NAMES]

    def add(self, window: list[Piece], is_open: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in window:
            for c, v in zip(self.columns, (doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.base + self.n, offset, is_open), strict=True):
                c.append(v)
            offset += len(ids)
        self.n += 1
        self.held += 4 * offset

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.held > least or (not least and self.columns[0]):
            kinds = (self.kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], _NAMES)
            self.columns, self.held = [[] for _ in _NAMES], 0


def pack(docs: DataFrame, path: str, length: int = LENGTH, windows: int = WINDOWS, slack: int = SLACK, end: int = END, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the documents ``docs`` (doc_id, text).

    A document is the identifiers of its whole text by the vocabulary in the file ``path`` and then ``end``; ``ids`` has a
    piece's, little-endian, 32 bits each. Sequences have at most ``length`` identifiers and are gapless; those of fewer
    have a power of two, or, with ``slack``, that many fewer at most (then fewer documents are cut). Null and empty texts
    are ``end`` alone; rows with null or repeated doc_ids are documents of their own. Other columns are not used; an
    empty table gives an empty result. ``path`` is the driver's file: Spark sends it to the workers.
    """
    if length & (length - 1) or not 0 <= slack < length:
        raise ValueError("length must be a power of two, and slack less")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, file = Packer(length, windows, slack), None, SparkFiles.get(name)
        for b in batches:
            rows = rows or _Rows(b.schema.field(0).type, 0)
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(np.asarray(tokens(text.as_py(), file), np.uint32), np.uint32(end))
                for window in packer.put(doc.as_py(), 0, len(ids), ids):
                    rows.add(window)
                yield from rows.flush(_HOLD)
        if rows:
            for window in packer.rest():
                rows.add(window, True)
            yield from rows.flush()

    def again(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, rows = Packer(length, windows, slack), None
            for b in batches:
                rows = rows or _Rows(b.schema.field(0).type, turn)
                for doc, start, ids, total in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                    for window in packer.put(doc, start, total, np.frombuffer(ids, "<u4")):
                        rows.add(window)
                    yield from rows.flush(_HOLD)
            if rows:
                for window in merged(packer.rest(), length) if last else packer.rest():
                    rows.add(window, not last)
                yield from rows.flush()

        return run

    done = None
    pieces, turn = written(docs.select("doc_id", "text").mapInArrow(first, schema), "pieces"), 0
    while True:
        emitted = pieces.where("NOT open").drop("open")
        done = emitted if done is None else done.unionByName(emitted)
        left = pieces.where("open")
        tasks = left.agg(F.count_distinct(F.shiftright("sequence_id", 32))).first()[0]  # one number
        if not tasks:
            return done
        turn, tasks = turn + 1, -(-tasks // fan_in)
        # dealt by no key, so no task gets more than its share; pieces of equal length and place are of different rows or alike
        dealt = left.select("doc_id", "start", "ids", "doc_tokens", "length", "sequence_id", "offset").repartition(tasks)
        dealt = dealt.sortWithinPartitions(F.desc("length"), "sequence_id", "offset").select("doc_id", "start", "ids", "doc_tokens")
        pieces = written(dealt.mapInArrow(again(turn, tasks == 1), schema), "pieces")


def op11_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
