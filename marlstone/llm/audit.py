"""How text filters overlap: what each removes at each place of every order in which they may be applied.

The orders are the paths of a permutation trie. A path's prefix leaves the same documents however its filters are
ordered, so the trie's states are the sets of filters applied so far: 32 for five filters, with 80 edges. They are
visited depth first; each state's survivors are a persisted DataFrame made of its parent's by one filter, and are met
again by memoisation. Survivors are narrow: each document's verdicts and labels, taken once from its whole text. One
aggregation a state counts what every filter still to come removes there; rows of a part (a language) are only ever
summed, so a hot part does no harm.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bind, fresh_path, written

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EDGE = "part string, filter string, reached long, removed long, good_lost long, toxic_lost long"


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic), a row per row of ``docs`` (doc_id, text, lang): whether it fails each filter.

    A: under 100 words; B: under 80 distinct words of 100; C: over 10 capitals in 100 characters; D: one of ``#$%&*|``;
    E: a smaller doc_id of the table has the same text. Null texts are empty; a null lang is the part of the empty
    string. A null doc_id is no smaller than any and has no smaller one, so such rows never fail E; rows of one doc_id
    don't fail it by each other. ``labels`` (doc_id, quality, toxic): of repeated labels one that says 1 counts.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    counted = bind(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), counted.alias("w"), text.alias("t"))
    capitals = F.length("t") - F.length(F.translate("t", CAPITALS, ""))
    rows = rows.select(
        "doc_id", "part", "sha", (F.col("w.n") < 100).alias("A"), (100 * F.col("w.own") < 80 * F.col("w.n")).alias("B"),
        (100 * capitals > 10 * F.length("t")).alias("C"), F.col("t").rlike("[#$%&*|]").alias("D"),
    )
    rows = written(rows, "verdicts")
    # the first document of a text is looked up by its own doc_id, not the others by their text: no key is hot
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, ["doc_id", "sha"], "left").join(marks, "doc_id", "left")
    return rows.select(
        "part", "A", "B", "C", "D", (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def edges(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """(state, part, filter, reached, removed, good_lost, toxic_lost) for each edge of the trie and each part with documents there.

    ``rows``: part, good, toxic and a column of each filter that says whether it fails. ``state`` has the bit 2^i where
    the i-th filter was applied before; ``reached`` counts the documents that got there.
    """
    spark = rows.sparkSession
    folder, done = fresh_path(spark, "edges"), set()

    def visit(state: int, survivors: DataFrame) -> None:
        if state in done or state == (1 << len(filters)) - 1:
            return
        done.add(state)
        rest = [(i, f) for i, f in enumerate(filters) if not state >> i & 1]
        survivors = survivors.persist(StorageLevel.DISK_ONLY)
        per = lambda f: F.struct(
            F.lit(f).alias("filter"), F.count("*").alias("reached"), F.count_if(F.col(f)).alias("removed"),
            F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost"),
        )
        counts = survivors.groupBy("part").agg(F.array(*[per(f) for _, f in rest]).alias("e")).select("part", F.explode("e").alias("e"))
        counts.select("part", "e.*").write.parquet(f"{folder}/state={state}")
        for i, f in rest:
            visit(state | 1 << i, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(0, rows)
    return spark.read.schema(_EDGE + ", state int").parquet(folder)


def _plan(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """(filter_order, step, state, filter): every step of every order, a row for each; as many as the filters' orders."""
    at = {f: i for i, f in enumerate(filters)}
    return spark.createDataFrame(
        [("".join(p), k + 1, sum(1 << at[f] for f in p[:k]), p[k]) for p in itertools.permutations(filters) for k in range(len(p))],
        "filter_order string, step int, state int, filter string",
    )


def report(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row for each part,
    order of ``filters`` and step, zeros included; ``rows`` as for ``edges``. Empty rows give an empty result.
    """
    spark, n = rows.sparkSession, len(filters)
    only = lambda f: F.count_if(F.expr(" AND ".join([f"`{f}`", *[f"NOT `{g}`" for g in filters if g != f]])))
    totals = rows.groupBy("part").agg(F.count("*").alias("all"), *[F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("fails"), only(f).alias("unique_fails")).alias(f) for f in filters])
    totals = written(totals.select("part", "all", F.explode(F.array(*filters)).alias("t")).select("part", "all", "t.*"), "totals")
    e = written(edges(rows, filters), "edges")
    share = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)]), (F.bit_count("state") + 1).cast("int"))
    shapley = e.groupBy("part", "filter").agg(F.sum(share * F.col("removed")).alias("shapley"))
    steps = totals.join(F.broadcast(_plan(spark, filters)), "filter").join(shapley, ["part", "filter"]).join(e, ["part", "state", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step", (zero("reached") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"),
        "unique_fails", zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), "shapley",
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return report(written(verdicts(docs, labels), "audited"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY 1, 2),
s(f) AS (VALUES (0), (1), (2), (3), (4)),
o AS (SELECT [p.f, q.f, r.f, x.f, y.f] AS p FROM s p, s q, s r, s x, s y WHERE len(list_distinct([p.f, q.f, r.f, x.f, y.f])) = 5),
k AS (SELECT array_to_string(list_transform(p, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, k AS step, p[k] AS f, list_sum(list_transform(p[1:k - 1], lambda i: 1 << i)) AS before FROM o, (VALUES (1), (2), (3), (4), (5)) v(k)),
z AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask >> f & 1 = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask >> f & 1 = 1 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask >> f & 1 = 1 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask >> f & 1 = 1 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask >> f & 1 = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM z
"""
