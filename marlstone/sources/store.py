"""JSON-lines and collection sources and sinks; paths may be in any store Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marlstone.operators.records import RECORD, clean, filled, normalize
from marlstone.shared import bounded, running_sum, written

#: Language codes and the prefixes of their files.
PREFIXES = {
    "as": "asm", "bn": "ben", "gu": "guj", "hi": "hin", "kn": "kan", "ml": "mal", "mr": "mar",
    "ne": "nep", "or": "ori", "pa": "pan", "sa": "san", "ta": "tam", "te": "tel", "ur": "urd",
}
POINTS = 2**63 - 1
_TEXTS = "chunk_id text parent_text chunk_type language passage_lang query_id search_text source_query".split()
CHUNK = S.StructType([S.StructField(n, S.StringType()) for n in _TEXTS])


QUERY = S.StructType([S.StructField(n, S.StringType()) for n in "qid query language gold kind".split()] + [S.StructField("expect_answer", S.BooleanType())])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def parquet_path(root: str, language: str, split: str = "train") -> str:
    prefix = PREFIXES.get(language.lower())
    if prefix is None:
        raise ValueError(f"language {language!r} is none of {sorted(PREFIXES)}")
    return f"{root}/train/{prefix}train.parquet" if split == "train" else f"{root}/validation/{prefix}val.parquet"


def read_hub(spark: SparkSession, root: str, languages: list[str], split: str = "train") -> DataFrame:
    """Clean records of several languages' hub files."""
    parts = [clean(normalize(spark.read.parquet(parquet_path(root, x, split)), x)) for x in languages]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: S.StructType = RECORD) -> DataFrame:
    """Objects of a JSON-lines file; blank lines are skipped and a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, limit: int | None = None, schema: S.StructType = RECORD) -> DataFrame:
    """As ``read_jsonl``, of the first ``limit`` lines only, blank ones counted, in the file's order; with ``line``, from 0.

    ``path`` is one file. Its lines are numbered where they are read: blocks in order, a running count over them.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("line", F.lit(0).cast("long"))
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("at"))
    one = running_sum(raw.select("at").withColumn("one", F.lit(1)), ["at"], "one", "upto")
    lines = raw.join(written(one.select("at", (F.col("upto") - 1).alias("line")), "lines"), "at")
    lines = lines if limit is None else lines.where(F.col("line") < limit)
    return lines.where("trim(value) <> ''").select("line", F.from_json("value", schema).alias("r")).select("r.*", "line")


def first_rows(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order`` (the size asked of a sample), found by a running count and not in one task."""
    upto = running_sum(df.select(F.col(order).alias("_at")).withColumn("_one", F.lit(1)), ["_at"], "_one", "_upto")
    keep = written(upto.where(F.col("_upto") <= limit).select("_at"), "first")
    return df.join(bounded(keep), df[order] == keep["_at"], "left_semi").select(*df.columns)


def first_of(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of any scan, in the order of its files and of the rows in them; it is read to its end.
    ``first_of_files`` is not, but needs a plain scan of Parquet files."""
    placed = written(df.withColumn("_place", F.monotonically_increasing_id()), "placed")
    return first_rows(placed, "_place", limit).drop("_place")


def first_of_files(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of ``files``, a plain scan of Parquet files, in the order of the files' paths, each with
    ``_place``, its number from 0.

    Rows of each file are counted, which reads footers only. Files beyond the one that the limit falls in are not opened. Of
    that one a single task reads what is wanted and stops. One row for each file needed, so ``limit`` at most, passes
    through the driver.
    """
    path = F.col("_metadata.file_path")
    counts = files.groupBy(path.alias("_file")).agg(F.count("*").alias("n")).orderBy("_file").limit(limit).collect()
    start, starts, left = 0, [], None
    for r in counts:
        starts.append((r["_file"], start))
        if start + r["n"] >= limit:
            left = limit - start
            break
        start += r["n"]
    if not starts:
        return files.withColumn("_place", F.lit(0).cast("long")).limit(0)
    last, begin = starts[-1]
    own = files.select("*", path.alias("_file"), F.col("_metadata.row_index").alias("_place"))
    end = own.where(F.col("_file") == last).drop("_file")
    if left is not None:
        head = written(end.coalesce(1).limit(left), "head")  # parts of the file one after the other, as far as needed
        n = head.agg(F.max("_place")).first()[0]
        end = head if n == left - 1 else end.where(F.col("_place") < left)  # a store may hand the parts out in another order
    end = end.withColumn("_place", F.col("_place") + begin)
    if len(starts) == 1:
        return end
    at = files.sparkSession.createDataFrame(starts[:-1], "_file string, _start long")
    whole = own.where(F.col("_file") < last).join(bounded(at), "_file")
    return whole.withColumn("_place", F.col("_place") + F.col("_start")).select(end.columns).unionByName(end)


def read_sample(spark: SparkSession, root: str, language: str, limit: int, split: str = "train", kept: bool = True) -> DataFrame:
    """Clean records of a language's hub file: the first ``limit`` that stay (``kept``), or those among its first ``limit`` rows.

    What is read goes with ``limit`` and not with the file: where too few stay, four times as many rows are taken.
    """
    files = spark.read.parquet(parquet_path(root, language, split))
    if not kept:
        return clean(normalize(first_of_files(files, limit), language))
    taken = max(limit, 1)
    while True:
        raw = written(first_of_files(files, taken), "raw")
        rows = written(clean(normalize(raw, language, keep=("_place",))), "sample")
        if rows.count() >= limit or raw.count() < taken:
            return first_rows(rows, "_place", limit).drop("_place")
        taken *= 4


def read_languages(spark: SparkSession, root: str, languages: list[str], skip: tuple[str, ...] = ("sa",)) -> DataFrame:
    """Raw rows of ``root``/language/train-*.parquet, each with its language; languages in ``skip`` and missing folders give none."""
    out = None
    for x in languages:
        if x in skip or not exists(spark, f"{root}/{x}"):
            continue
        part = spark.read.parquet(f"{root}/{x}").withColumn("language", F.lit(x))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], RECORD)


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A query set (qid, query, language, gold, kind, expect_answer) of a JSON-lines file, its first ``limit`` lines."""
    return read_lines(spark, path, limit, QUERY)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return clean(read_jsonl(spark, path))


def _usable(rows: DataFrame, name: Column) -> DataFrame:
    parent = F.coalesce(F.nullif(F.col("parent_text"), F.lit("")), F.col("text"))
    return rows.where("trim(coalesce(text, '')) <> ''").withColumns({"chunk_id": F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), name), "parent_text": parent})


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index in ``folder``: chunks.jsonl if there is one, else the collection ``vectors`` without its vectors."""
    if exists(spark, f"{folder}/chunks.jsonl"):
        rows = read_lines(spark, f"{folder}/chunks.jsonl", schema=CHUNK)
        return _usable(rows, F.concat(F.lit("jsonl:"), F.col("line").cast("string"))).drop("line")
    rows = Collection(spark, f"{folder}/vectors").read()
    have = [c for c in CHUNK.names if c in rows.columns]
    rows = rows.select("point_id", *have, *[F.lit(None).cast("string").alias(c) for c in CHUNK.names if c not in have])
    return _usable(rows, F.col("point_id").cast("string")).drop("point_id")


def write_preview(records: DataFrame, path: str, order: str = "query_id", n: int = 200) -> None:
    """The first ``n`` clean records, for a look at them."""
    write_jsonl(first_rows(records, order, n), path)


def write_report(spark: SparkSession, folder: str, day: str, summary: DataFrame, rows: DataFrame) -> None:
    """A benchmark's summary and its rows as JSON under ``folder``/report-day."""
    write_jsonl(summary, f"{folder}/report-{day}/summary")
    write_jsonl(rows, f"{folder}/report-{day}/rows")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def point_id(chunk_id: Column) -> Column:
    """First 64 bits of the id's SHA-1, modulo 2^63 - 1."""
    return (F.conv(F.substring(F.sha1(chunk_id.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(POINTS).cast("decimal(20,0)")).cast("long")


class Collection:
    """Rows under unique point ids, stored as runs that a manifest names; the last complete manifest is current.

    An upsert writes its own rows as a new run and then a manifest ``m0``, ``m1``..., so its cost goes with what it brings,
    not with what is there. Of rows with one id that of the later run counts. ``FAN`` runs of one level are merged to one of
    the next, so a row is written again once for each power of ``FAN`` upserts, and a read joins few runs. A job that is lost
    leaves files that no manifest names; the version before stays readable. Two writers at once: the second fails.
    """

    FAN = 8
    _RUN = "folder string, level int, seq long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.vector, self.size = spark, path, None, None

    def _named(self, start: str) -> list[str]:
        fs, p = _fs(self.spark, self.path)
        return [n for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()).startswith(start)]

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._named("m") if n[1:].isdigit() and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def runs(self, version: int | None = None) -> list:
        """(folder, level, seq, batch) of a version, the current one unless given, in the order of their writing."""
        at = self.versions()
        if not at:
            raise FileNotFoundError(self.path)
        rows = self.spark.read.schema(self._RUN).json(f"{self.path}/m{at[-1] if version is None else version}").collect()  # FAN for each level at most
        return sorted(rows, key=lambda r: r["seq"])

    def batch(self) -> int | None:
        """The largest number of a batch that was put in."""
        return max((r["batch"] for r in self.runs() if r["batch"] is not None), default=None) if self.versions() else None

    def read(self, version: int | None = None) -> DataFrame:
        return self._whole(self.runs(version)).drop("_seq")

    def _whole(self, runs: list) -> DataFrame:
        """The rows of ``runs``, the later one's of each point id."""
        parts = [self.spark.read.parquet(f"{self.path}/{r['folder']}").withColumn("_seq", F.lit(r["seq"]).cast("long")) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        if len(parts) == 1:
            return out
        cols = [c for c in out.columns if c != "point_id"]
        best = out.groupBy("point_id").agg(F.max_by(F.struct(*cols), "_seq").alias("_r"))
        return best.select(*[F.col("_r")[c].alias(c) if c != "point_id" else F.col(c) for c in out.columns])

    def _commit(self, runs: list[tuple]) -> None:
        taken = [int(n[1:]) for n in self._named("m") if n[1:].isdigit()]
        rows = self.spark.createDataFrame(runs, self._RUN).coalesce(1)
        rows.write.mode("error").json(f"{self.path}/m{max(taken, default=-1) + 1}")

    def _put(self, rows: DataFrame) -> str:
        folder = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the runs and manifests that none of the last ``keep`` versions names; no writer may be at work."""
        fs, _ = _fs(self.spark, self.path)
        at = self.versions()[-keep:]
        stay = {f"m{n}" for n in at} | {r["folder"] for n in at for r in self.runs(n)}
        for name in [*self._named("m"), *self._named("run-")]:
            if name not in stay:
                fs.delete(_fs(self.spark, f"{self.path}/{name}")[1], True)

    def ensure(self, schema: S.StructType, vector: str | None = None, size: int | None = None, recreate: bool = False) -> Collection:
        """Makes an empty collection of ``schema`` (chunk_id, ...) if there is none, or anew with ``recreate``.

        With ``vector``, the name of a column of numbers, and ``size`` each later upsert is checked to have that many.
        """
        if recreate:
            self.drop()
        if not self.versions():
            self.upsert(self.spark.createDataFrame([], schema))
        self.vector, self.size = vector, size
        return self

    def drop(self) -> None:
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)

    def upsert(self, rows: DataFrame, order: str | None = None, batch: int | None = None) -> Collection:
        """Rows (chunk_id, ...) put in by point id; of rows with one id the last in ``order`` counts. ``batch`` is noted."""
        rows = rows.withColumn("point_id", F.coalesce(point_id(F.col("chunk_id")), F.lit(-1)))  # rows without an id are one point
        if self.vector:
            n = F.size(F.col(self.vector))
            rows = rows.withColumn(self.vector, F.when(n == self.size, F.col(self.vector)).otherwise(F.raise_error(F.concat(F.lit("a vector has the size "), n.cast("string")))))
        cols = rows.columns
        last = F.max_by(F.struct(*cols), F.col(order) if order else F.xxhash64(F.to_json(F.struct(*cols))))
        new = rows.groupBy("point_id").agg(last.alias("_r")).select(*[F.col("_r")[c].alias(c) for c in cols])
        runs = [tuple(r) for r in self.runs()] if self.versions() else []
        runs.append((self._put(new), 0, max((r[2] for r in runs), default=-1) + 1, batch))
        self._commit(runs)
        level = 0
        while len(same := [r for r in runs if r[1] == level]) >= self.FAN:  # they stand together: older runs have higher levels
            whole = self._whole([dict(zip(("folder", "level", "seq", "batch"), r, strict=True)) for r in same]).drop("_seq")
            one = (self._put(whole), level + 1, same[-1][2], max((r[3] for r in same if r[3] is not None), default=None))
            runs = sorted([r for r in runs if r[1] != level] + [one], key=lambda r: r[2])
            self._commit(runs)
            level += 1
        return self


def manifest(chunks: DataFrame, **notes: str) -> DataFrame:
    """One row: counts and languages of a chunk table, and ``notes``; also what a health report shows."""
    return chunks.agg(
        F.count("*").alias("points"), F.array_sort(F.collect_set(filled(F.col("language")))).alias("languages"),
        F.array_sort(F.collect_set("chunk_type")).alias("chunk_types"),
    ).withColumns({k: F.lit(v) for k, v in notes.items()})
