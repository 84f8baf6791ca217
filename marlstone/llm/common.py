"""Plumbing of the training-data operators: file systems of workers, names that can't clash, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.shared import bounded, checkpointed, fresh_path, released, running_sum, scratch, shared_dir, written

__all__ = ["bind", "bounded", "checkpointed", "components", "first_rows", "free_names", "fresh_path", "lower_ascii", "open_fs", "released", "running_sum", "scratch", "shared_dir", "spread", "written"]


def open_fs(uri: str):
    """(filesystem, path) of a URI for Python workers: file, hdfs, s3, gs, as far as pyarrow knows the scheme."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.replace("file:", "", 1) if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other characters as they are; null becomes empty."""
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, body) -> Column:
    """``body(value)`` with value computed once; written inside lambdas, Spark would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names, longer by underscores where ``df`` has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each combination of ``keys``: that of the smallest hash of all its columns, the same in each run."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    row, *names = free_names(df, "_row", *[f"_k{i}" for i in range(len(keys))])
    best = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min_by(whole, F.md5(F.to_json(whole).cast("binary"))).alias(row))
    return best.select(*[F.col(row)[c].alias(c) for c in df.columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as shuffles have: small rows that stand for much work, which
    adaptive execution would else gather in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); label is the smallest node it reaches.

    Contraction: each node points at its smallest neighbour, pointers are followed twice more, edges are redrawn
    between the nodes pointed at. A chain shrinks threefold a round, a star at once. A hub is only a key of partial
    aggregates and of joins whose large partitions adaptive execution splits. Every round is a written table.
    """
    spark = edges.sparkSession
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    labels = written(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")),
        "labels",
    )
    for _ in range(rounds):
        if edges.isEmpty():
            return labels
        up = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), "pointers")
        on = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
        to = up
        for _ in range(2):
            to = to.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        up = written(to, "pointers")
        mine = up.select(F.col("node").alias("label"), "to")
        labels = written(
            labels.join(mine, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
        )
        a = up.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = up.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = (
            edges.join(a, "a", "left").join(b, "b", "left")
            .select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
        )
        edges = written(
            moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges"
        )
    raise RuntimeError(f"no fixed point after {rounds} rounds")
