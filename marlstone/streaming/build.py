"""An index of chunks built from a stream of records in micro-batches, each text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import records as R
from marlstone.sources.store import Collection


def batch_cap(n_records: int, left: int, most: int, expected: int) -> int:
    """Chunks a batch may give: its share of ``most`` (rounded up), its number of records at least, what is left at most."""
    return min(left, max(n_records, -(-n_records * most // expected)))


def add_batch(collection: Collection, records: DataFrame, batch: int, most: int | None = None, expected: int | None = None, encode: Callable | None = None) -> int:
    """Chunks put into ``collection`` from the clean ``records`` of one batch.

    A text that the collection has is left out. ``most``, the size asked of the index, caps each batch by its share of
    ``expected`` records; None takes all. ``encode``, a function from chunk rows to chunk rows, may add vectors. Numbers of
    batches ascend: one that is not above all that were put in came again and adds nothing, so a restarted stream is safe.
    A batch writes its own chunks only; of what is there it reads the texts' hashes.
    """
    done = collection.batch()
    if done is not None and batch <= done:
        return 0
    old = collection.read() if collection.versions() else None
    cap = None
    if most is not None:
        n = records.count()
        cap = batch_cap(n, most - (old.count() if old is not None else 0), most, max(1, expected or n))
        if cap <= 0:
            return 0
    chunks = R.compact_chunks(records, limit=cap).withColumn("digest", T.text_hash(F.col("text")))
    chunks = chunks.withColumn("_at", F.struct("ord", "rn"))
    one = chunks.groupBy("digest").agg(F.min_by(F.struct(*[c for c in chunks.columns if c not in ("digest", "_at")]), "_at").alias("c")).select("digest", "c.*")
    if old is not None:
        one = one.join(old.select("digest"), "digest", "left_anti")
    one = one.withColumn("batch", F.lit(batch).cast("long"))
    collection.upsert(encode(one) if encode else one, batch=batch)
    return collection.read().where(F.col("batch") == batch).count()


def build_stream(records: DataFrame, collection: Collection, checkpoint: str, most: int | None = None, expected: int | None = None, encode: Callable | None = None):
    """The started query that feeds ``collection`` from the stream ``records`` (clean or not) until it has no more."""
    return (
        records.writeStream.foreachBatch(lambda df, n: add_batch(collection, R.clean(df), n, most, expected, encode) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
