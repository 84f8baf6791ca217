"""The folder all machines share, tables that cut lineage, sides of checked size, running sums over a whole table."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Sides of at most this many rows and bytes are broadcast, after both were counted; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a local one for local masters; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marlstone-"))
    return sc.getCheckpointDir().rstrip("/")


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, what ``fresh_path`` names is noted, and deleted at its end: results must be written elsewhere by then."""
    own: list[str] = []
    before = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in own:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _scratch.get()) is not None:
        own.append(path)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which keeps the partitions and their order (Parquet files may be regrouped when read)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done; it does so when the driver's JVM collects its garbage, which
    may be late where one job follows another."""
    gc.collect()
    spark._jvm.System.gc()


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 for each plain value, what strings, binaries and arrays of numbers hold, and the
    JSON of anything else."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, S.StringType | S.BinaryType):
            own = F.octet_length(c) + 16
        elif isinstance(kind, S.ArrayType) and isinstance(kind.elementType, S.NumericType):
            own = F.when(c.isNull(), 0).otherwise(F.size(c)) * 8 + 24
        elif isinstance(kind, S.ArrayType | S.MapType | S.StructType):
            own = F.octet_length(F.to_json(c)) + 24
        else:
            own = F.lit(8)
        total = total + F.coalesce(own, F.lit(8))
    return total


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, to be broadcast if it was counted to have ``rows`` rows and ``size`` bytes at most."""
    n, held = df.select(row_bytes(df).alias("size")).limit(rows + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def running_sum(df: DataFrame, order: list[str], value: str, out: str, within: str | None = None) -> DataFrame:
    """``df`` range-sorted by ``order`` with ``out``, the running sum of ``value``, from anew at each ``within``.

    ``within`` must be order[0], a string column. A null value adds nothing; the other columns, ids of any size beside nulls
    too, go through as they are. Rows equal in all of ``order`` stand together, in any order. One
    number a partition, and the value of ``within`` it is for, passes through the driver.
    """
    sort = [F.col(c).asc_nulls_last() for c in order]
    parts = checkpointed(df.repartitionByRange(*sort).sortWithinPartitions(*sort)).withColumn("_part", F.spark_partition_id())
    key = F.coalesce(F.concat(F.lit("k"), F.col(within)), F.lit("n")) if within else F.lit("k")  # in the rows' order, null last
    ends = parts.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    tails = parts.withColumn("_key", key).join(
        F.broadcast(df.sparkSession.createDataFrame([(r["_part"], r["last"]) for r in ends], "_part int, _last string")), "_part"
    ).where("_key = _last").groupBy("_part").agg(F.sum(value).alias("sum")).collect()
    tail, carry, before, open_key = {r["_part"]: r["sum"] for r in tails}, {}, 0, None
    for r in sorted(ends, key=lambda r: r["_part"]):
        first, last = r["first"], r["last"]
        carry[r["_part"]] = before if first == open_key else 0
        before = tail[r["_part"]] + (carry[r["_part"]] if first == last else 0)
        open_key = last
    names = [c for c in parts.columns if c != "_part"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, 0
        for b in batches:
            if not len(b):
                continue
            part = b.column(b.schema.get_field_index("_part"))[0].as_py()
            v = pc.fill_null(b.column(b.schema.get_field_index(value)).cast(pa.int64()), 0).to_numpy()
            k = np.full(len(b), "k", object)
            if within is not None:
                k = np.array(["n" if x is None else "k" + x for x in b.column(b.schema.get_field_index(within)).to_pylist()], object)
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            upto, size = np.cumsum(v), np.diff(np.append(starts, len(v)))
            sums = upto - np.repeat(upto[starts] - v[starts], size)
            if at is None:
                total = carry.get(part, 0)
            elif at != k[0]:
                total = 0
            sums[: size[0]] += total
            at, total = k[-1], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], pa.array(sums, pa.int64())], [*names, out])

    return parts.mapInArrow(add, parts.select(names).schema.add(out, "long"))


def sorted_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-sorted by ``order``, nulls first, and checkpointed, with ``_part``, the number of each row's partition."""
    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return parts.withColumn("_part", F.spark_partition_id())


def run_numbers(df: DataFrame, key: str, at: str, order: list[str], gap: int, out: str) -> DataFrame:
    """``df`` with ``out``, the number of a row's run: rows of one ``key`` whose ``at`` (long) follow each other by ``gap`` at most.

    Rows stand in the order of key, at and ``order``; a null ``at`` is a run of its own, null keys are one key. One key may
    have most rows: it is spread over partitions, of which the first and last row and the number of runs pass the driver.
    """
    marked = df.withColumn("_run_key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")))
    parts = sorted_parts(marked, ["_run_key", at, *order])
    names = df.columns
    field = lambda b, n: b.column(b.schema.get_field_index(n))

    def breaks(b: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, tuple]:
        """Which rows begin a run, given the row before (key, at), and the last row."""
        k, t = field(b, "_run_key"), field(b, at)
        v, null = pc.fill_null(t, 0).to_numpy(), pc.is_null(t).to_numpy(zero_copy_only=False)
        same = np.append(False, pc.equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False))
        near = np.append(False, (v[1:] - v[:-1] <= gap) & ~null[1:] & ~null[:-1])
        if last is not None and last[0] == k[0].as_py():
            same[0], near[0] = True, last[1] is not None and not null[0] and int(v[0]) - last[1] <= gap
        return ~(same & near), (k[-1].as_py(), t[-1].as_py())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, n, part = None, None, 0, None
        for b in batches:
            if len(b):
                if first is None:
                    first, part = (field(b, "_run_key")[0].as_py(), field(b, at)[0].as_py()), field(b, "_part")[0].as_py()
                new, last = breaks(b, last)
                n += int(new.sum())
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k0": [first[0]], "t0": pa.array([first[1]], pa.int64()),
                                              "k1": [last[0]], "t1": pa.array([last[1]], pa.int64()), "n": pa.array([n], pa.int64())})

    found = parts.select("_run_key", at, "_part").mapInArrow(ends, "part int, k0 string, t0 long, k1 string, t1 long, n long").collect()  # a row a partition
    before, upto, last = {}, 0, None
    for r in sorted(found, key=lambda r: r["part"]):
        before[r["part"]] = (upto, last)
        joined = last is not None and last[0] == r["k0"] and None not in (last[1], r["t0"]) and r["t0"] - last[1] <= gap
        upto, last = upto + r["n"] - joined, (r["k1"], r["t1"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto, last = None, None
        for b in batches:
            if len(b):
                if upto is None:
                    upto, last = before[field(b, "_part")[0].as_py()]
                new, last = breaks(b, last)
                no = upto + np.cumsum(new)
                upto = int(no[-1])
                yield pa.RecordBatch.from_arrays([*[field(b, n) for n in names], pa.array(no, pa.int64())], [*names, out])

    return parts.mapInArrow(number, S.StructType([*df.schema.fields, S.StructField(out, S.LongType())]))
