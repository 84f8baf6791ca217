"""Search by cosine: of all vectors exactly, or of the lists of a stored index of vectors.

Vectors and queries are both packed into blocks, rows that hold a matrix; blocks meet by an equal-key join and each pair of
blocks is one matrix product, of which a query's best go on. Nothing passes through the driver but an index's centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.shared import bounded, written

#: Vectors and queries of a block at most; vectors an index is fitted on at most, and the lists it has at most.
BLOCK, QUERY_BLOCK, SAMPLE, MOST_LISTS = 2048, 256, 20_000, 4096
#: Numbers that placing vectors holds at a time: distances to centroids, or parts of the vectors given out.
CELLS = 1 << 20
#: The share of true neighbours that an index must find, by the lists that this many of its own vectors ask for.
RECALL, NEIGHBOURS, TRIED = 0.95, 10, 200
_BLOCKS = "g int, ids array<bigint>, m binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, whose lengths must agree."""
    size = np.unique(np.diff(column.offsets.to_numpy()))
    if len(size) > 1:
        raise ValueError(f"vectors of the sizes {size.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(g, ids, m): the vectors of ``rows`` (g, id, embedding) as matrices of ``size`` rows at most, of one g each.

    Vectors without a direction (null, of zeros, or with a part that is no number) are in none.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2))
            good = np.linalg.norm(x.astype(np.float64), axis=1) > 0
            g, ids, x = b.column(0).to_numpy()[good], b.column(1).to_numpy()[good], x[good]
            out = []
            for one in np.unique(g):
                own = np.flatnonzero(g == one)
                out += [(int(one), ids[at], x[at].tobytes()) for at in (own[i : i + size] for i in range(0, len(own), size))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.list_(pa.int64()), pa.binary()))], ["g", "ids", "m"])

    kept = rows.select(F.col("g").cast("int").alias("g"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return kept.where("id IS NOT NULL AND size(embedding) > 0").mapInArrow(pack, _BLOCKS)


def _best(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score, rank): the ``k`` best for each query, of blocks that meet under an equal g; ties by vec_id."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, m, qids, qm in zip(*b.columns, strict=True):
                vec, qid = np.array(ids.as_py(), np.int64), np.array(qids.as_py(), np.int64)
                s = np.round(_unit(np.frombuffer(qm.as_py(), np.float32).reshape(len(qid), -1)) @ _unit(np.frombuffer(m.as_py(), np.float32).reshape(len(vec), -1)).T, 6)
                least = np.partition(s, len(vec) - k, axis=1)[:, len(vec) - k] if k < len(vec) else s.min(axis=1)
                q, v = np.nonzero(s >= least[:, None])  # with all that tie for the last place
                order = np.lexsort((vec[v], -s[q, v], q))
                q, v = q[order], v[order]
                first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
                kept = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
                yield pa.RecordBatch.from_arrays([pa.array(qid[q[kept]]), pa.array(vec[v[kept]]), pa.array(s[q, v][kept])], ["qid", "vec_id", "score"])

    asked = queries.select("g", F.col("ids").alias("qids"), F.col("m").alias("qm"))
    met = vectors.join(asked, "g").select("ids", "m", "qids", "qm").mapInArrow(score, "qid long, vec_id long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id"))
    return met.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, vec_id, score, rank) by cosine of ``vectors`` (vec_id, embedding) to ``queries`` (qid, embedding), exactly.

    The stated queries are held against all vectors, which are scanned once, whatever the number of queries; the metadata
    predicate ``keep`` comes first. Blocks of queries go to every task where they are few (counted), else to each of as
    many groups as shuffles have partitions, over which the vectors' blocks are dealt. Vectors without a direction have
    no cosine; vectors without an id are left out; queries of equal qid are one question with several vectors.
    """
    v = vectors if keep is None else vectors.where(keep)
    asked = written(blocks(queries.select(F.lit(0).alias("g"), F.col("qid").alias("id"), "embedding"), block), "query-blocks")
    held = blocks(v.select(F.lit(0).alias("g"), F.col("vec_id").alias("id"), "embedding"), BLOCK)
    few = bounded(asked)
    if few is not asked:
        return _best(held, few, k)
    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    return _best(dealt, asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), k)


class VectorIndex:
    """A stored index of vectors: inverted lists by trained centroids, searched by the lists nearest to a query.

    Centroids are fitted on ``SAMPLE`` vectors at most (those of the smallest hashes); every vector is in the list of its
    nearest centroid. How many lists a search has to probe is measured when the index is built: ``TRIED`` of its vectors are
    searched exactly, and the lists their ``NEIGHBOURS`` are in say how many find ``RECALL`` of them. A list's vectors are stored in blocks under its folder, so a search reads the lists it asks for
    and scores their vectors exactly. The centroids are written last: an index without them isn't there.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/centroids").orderBy("g").collect()  # MOST_LISTS at most
        self.centroids = np.array([r["center"] for r in rows], np.float64)
        self.probes = rows[0]["probes"] if rows else 1
        self.blocks = spark.read.schema("ids array<bigint>, m binary, g int").parquet(f"{folder}/lists")

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, lists: int | None = None, seed: int = 1) -> VectorIndex:
        """The index of ``vectors`` (vec_id, embedding); ``lists`` is the root of their number unless given."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        v = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        v = v.where("id IS NOT NULL AND aggregate(embedding, 0D, (s, x) -> s + x * x) > 0")
        lists = min(MOST_LISTS, lists or max(1, round(v.count() ** 0.5)))
        some = written(v.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select(array_to_vector("embedding").alias("features")), "sample")
        centers = []
        if not some.isEmpty():
            centers = KMeans(k=lists, distanceMeasure="cosine", maxIter=10, seed=seed).fit(some).clusterCenters() if lists > 1 else [some.first()["features"].toArray()]
        put = cls._placed(v, np.array(centers, np.float64), 1)
        blocks(put.hint("rebalance", "g").sortWithinPartitions("g"), BLOCK).write.partitionBy("g").mode("overwrite").parquet(f"{folder}/lists")
        stored = spark.read.schema("ids array<bigint>, m binary, g int").parquet(f"{folder}/lists")
        probes = cls._probes(v, stored, np.array(centers, np.float64), seed) if centers else 1
        rows = [(i, c.tolist(), probes) for i, c in enumerate(map(np.asarray, centers))]
        spark.createDataFrame(rows, "g int, center array<double>, probes int").write.mode("overwrite").parquet(f"{folder}/centroids")
        return cls(spark, folder)

    @staticmethod
    def _probes(v: DataFrame, stored: DataFrame, centers: np.ndarray, seed: int) -> int:
        """Lists to probe: the fewest that hold ``RECALL`` of the true neighbours of ``TRIED`` vectors."""
        asked = written(v.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(TRIED).select(F.col("id").alias("qid"), "embedding"), "tried")
        true = dense_top_k(v.withColumnRenamed("id", "vec_id"), asked, NEIGHBOURS)
        found = true.join(stored.select("g", F.explode("ids").alias("vec_id")), "vec_id").select("qid", "g").collect()  # TRIED * NEIGHBOURS rows
        near = {r["qid"]: np.argsort(np.argsort(-(_unit(centers) @ np.array(r["embedding"], np.float64)), kind="stable")) for r in asked.collect()}
        places = np.sort([near[r["qid"]][r["g"]] for r in found])
        return int(places[max(0, int(np.ceil(RECALL * len(places))) - 1)]) + 1

    @staticmethod
    def _placed(rows: DataFrame, centers: np.ndarray, n: int) -> DataFrame:
        """(g, id, embedding): each of ``rows`` (id, embedding) under its ``n`` nearest centroids."""
        unit = _unit(centers) if len(centers) else centers

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1))
                step = max(1, CELLS // max(1, len(unit), min(n, len(unit)) * x.shape[1])) if len(x) else 1
                for start in range(0, len(x) if len(unit) else 0, step):  # neither distances nor copies grow with the lists
                    near = np.argsort(-(x[start : start + step] @ unit.T), axis=1, kind="stable")[:, :n]
                    at = pa.array(np.repeat(np.arange(start, start + len(near)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], ["g", "id", "embedding"])

        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where("size(embedding) > 0")
        return rows.mapInArrow(place, "g int, id long, embedding array<float>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, vec_id, score, rank): the ``k`` best of the ``probes`` lists nearest to each of ``queries`` (qid, embedding).

        Unless given, ``probes`` is what the index was measured to need. With as many probes as lists the result is that of ``dense_top_k``.
        """
        near = self._placed(queries.select(F.col("qid").alias("id"), "embedding"), self.centroids, probes or self.probes)
        asked = written(blocks(near.repartition("g").sortWithinPartitions("g"), QUERY_BLOCK), "query-blocks")
        return _best(self.blocks, bounded(asked), k)
