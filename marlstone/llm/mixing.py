"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a hash order and pass up to ``max_repeats`` times. A copy's virtual finish time is its
source's cumulative size up to and including it, divided by the source's target. All copies are range-sorted by finish
time and truncated at the total budget. Both running sums go over range-sorted partitions: each partition's total is
carried to the next as one number, so no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import first_rows, free_names, fresh_path, running_sum, scratch, written

WEIGHTS, BUDGET, MAX_REPEATS = (5.0, 2.0, 1.0), 1.5, 2


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII blanks; 0 for null."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")  # a count of the matches would hold them all
    return F.coalesce(F.length(marks) - F.length(F.replace(marks, F.lit("x"))), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of ``sources`` (source, source_size).

    Sources by code point, null last, take the weights in turn. A target is the least of max_repeats times the source's
    size and its weight's share of what the capped ones leave; each pass of the loop caps those above, and only sums
    reach the driver.
    """
    at = running_sum(sources.withColumn("_one", F.lit(1)), ["source"], "_one", "_nth", within=None)
    cycle = F.array(*map(F.lit, weights))
    s = written(at.select("source", "source_size", F.element_at(cycle, (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight")), "sources")
    total = budget * (s.agg(F.sum("source_size")).first()[0] or 0)
    share, capped = 0.0, -1
    while True:  # at most one pass for each source that caps anew, in practice a few
        cap = F.col("source_size") * max_repeats
        full = (F.col("weight") * share > cap) if capped >= 0 else F.lit(False)
        n, taken, rest = s.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped:
            break
        capped, share = n, ((total - (taken or 0)) / rest if rest else share)
    return s.select("source", "source_size", F.least((F.col("source_size") * max_repeats).cast("double"), F.col("weight") * share).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, copies, row_key.

    ``row_key`` hashes doc_id and text. A source and a document of size 0 take 0; null texts have size 0; null sources
    are one source. Repeated rows count each. Ties of finish time go by source, hash, and pass. A source's words taken
    differ from its target by less than its largest document, plus its share of the last document cut.
    """
    key = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("mix")))
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order.alias("shuffle"), key.alias("row_key"))
    d = written(d, "sizes")
    targets = written(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_repeats), "targets")
    total = int(targets.agg(F.sum("target")).first()[0] or 0)
    queued = running_sum(d, ["source", "shuffle", "doc_id", "row_key"], "size", "cum", within="source")
    queued = written(queued.withColumn("row", F.monotonically_increasing_id()), "queued")
    t = targets.withColumnRenamed("source", "_s")
    joined = queued.join(t, queued["source"].eqNullSafe(t["_s"])).drop("_s")
    joined = written(joined, "joined")
    turns = joined.where("size > 0").select(
        "row", "source", "shuffle", "size", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn"),
        "cum", "source_size", "target",
    ).select("row", "source", "shuffle", "size", "turn", ((F.col("turn") * F.col("source_size") + F.col("cum")) / F.col("target")).alias("finish"))
    # rows past finish time 1 come in only as far as other sources' cuts leave room, at most one document each
    ranked = running_sum(turns, ["finish", "source", "shuffle", "row", "turn"], "size", "spent")
    took = ranked.where(F.col("spent") <= total).groupBy("row").agg(F.count("*").alias("copies"))
    return joined.join(took, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"),
        F.coalesce("copies", F.lit(0)).alias("copies"), "row_key",
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, and size, target, taken and copies (times taken).

    Columns of ``docs`` with one of these four names are left out for the new ones; other names may clash with nothing.
    Repeated rows of one doc_id and text come back as one, their copies added up: that of the smallest hash of all its
    columns. Null sources are one source; null and empty texts have size 0 and are never taken. An empty table gives an
    empty result.
    """
    new = ["size", "target", "taken", "copies"]
    rows = docs.drop(*new)
    key, mine, other, n_rows = free_names(docs, "_row_key", "_id", "_key", "_rows")
    path = fresh_path(docs.sparkSession, "plan")
    with scratch(docs.sparkSession):  # all else that is written on the way is deleted
        of = mix(docs, **how).groupBy("doc_id", "row_key").agg(
            F.max("size").alias("size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.sum("copies").alias("copies"), F.count("*").alias(n_rows)
        ).where("copies > 0").withColumnsRenamed({"doc_id": mine, "row_key": other})
        of.write.parquet(path)
    of = docs.sparkSession.read.schema(of.schema).parquet(path)
    rows = rows.withColumn(key, F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    if not of.where(F.col(n_rows) > 1).isEmpty():
        rows = first_rows(rows, ["doc_id", key])
    out = rows.join(of, (F.col(key) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(mine)))
    return out.select(*[c for c in docs.columns if c not in new], *new)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':mix') AS shuffle
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
b AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total FROM w),
fill AS (
  SELECT 0 AS step, (SELECT total FROM b) / (SELECT sum(weight) FROM w) AS share
  UNION ALL
  SELECT step + 1, n.share FROM fill f, LATERAL (
    SELECT ((SELECT total FROM b) - sum(CASE WHEN weight * f.share > 2 * source_size THEN 2 * source_size ELSE 0 END))
           / nullif(sum(CASE WHEN weight * f.share > 2 * source_size THEN 0 ELSE weight END), 0) AS share
    FROM w) n
  WHERE n.share IS NOT NULL AND n.share <> f.share AND step < 200),
t AS (SELECT source, source_size, least(2.0 * source_size, weight * (SELECT share FROM fill ORDER BY step DESC LIMIT 1))::DOUBLE AS target FROM w),
q AS (SELECT d.*, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, turn, (turn * source_size + cum)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, shuffle, doc_id, turn ROWS UNBOUNDED PRECEDING) AS spent FROM c),
k AS (SELECT doc_id, count(*) AS copies FROM r WHERE spent <= (SELECT floor(sum(target)) FROM t) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(k.copies, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN k USING (doc_id)
"""
