"""Samples that read what they need of large files, an encoder loaded once for each worker, and refusal across scripts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.functions import translit as X
from marlstone.operators import corpus as C
from marlstone.operators import rerank as R
from marlstone.sources import store


def rows_read(spark, act):
    """What ``act`` gives, and how many rows its stages read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = lambda: [(x.stageId(), x.inputRecords()) for x in _listed(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))]
    before = dict(seen())
    out = act()
    return out, sum(n for i, n in seen() if i not in before)


def _listed(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """Three files of about 130,000 rows, each in several row groups, numbered in the order of their paths; a blank in the path."""
    path = str(tmp_path_factory.mktemp("some files") / "t")
    rows = spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).repartitionByRange(3, "id").sortWithinPartitions("id")
    rows.write.option("parquet.block.size", 400_000).parquet(path)
    return path


def test_first_rows_of_files(spark, big):
    files = spark.read.parquet(big)
    first = [r[0] for r in files.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).orderBy("f").select("n").collect()]
    for limit in (1, 7, 30_000, first[0] - 1, first[0], first[0] + 5, 400_000, 500_000):
        got, n = rows_read(spark, lambda: store.first_of_files(files, limit).collect())  # noqa: B023
        want = min(limit, 400_000)
        assert sorted(r._place for r in got) == list(range(want)) and all(r.id == r._place for r in got)
        if limit < first[0]:  # besides the rows counted from footers: once from the file, twice from where they were written
            assert n - 400_000 <= 3 * limit + 10_000
    assert store.first_of_files(spark.read.schema("id long").parquet(_empty(spark, big)), 5).count() == 0


def _empty(spark, big):
    path = big + "-none"
    spark.range(0).write.parquet(path)
    return path


def test_first_of_a_scan_stops(spark, big):
    got = store.first_of(spark.read.parquet(big).where("id % 2 = 0"), 9).collect()
    assert len(got) == 9 and all(r.id % 2 == 0 for r in got)


def test_sample_of_a_hub_file(spark, tmp_path):
    long = "This passage is long enough to be kept, as all know who have read it."
    raw = spark.range(5000).select(
        F.col("id").alias("query_id"), F.lit("where?").alias("query"),
        F.struct(F.array(F.when(F.col("id") % 100 == 99, F.lit(long)).otherwise(F.lit("short"))).alias("English_passages")).alias("passages"),
    )
    raw.coalesce(1).write.parquet(str(tmp_path / "train" / "hintrain.parquet"))
    ids = lambda df: sorted(r.query_id for r in df.collect())
    assert ids(store.read_sample(spark, str(tmp_path), "hi", 3)) == [99, 199, 299]
    assert ids(store.read_sample(spark, str(tmp_path), "hi", 80)) == list(range(99, 5000, 100))
    assert ids(store.read_sample(spark, str(tmp_path), "hi", 250, kept=False)) == [99, 199]
    assert "_place" not in store.read_sample(spark, str(tmp_path), "hi", 3).columns


def test_an_encoder_is_loaded_once_for_each_worker(spark, tmp_path):
    model, log = tmp_path / "weights.json", str(tmp_path / "loads")
    model.write_text(json.dumps({"a": 3.0, "b": 4.0}))

    def load(path):
        import numpy

        with open(path) as f:
            w = json.load(f)
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: numpy.array([[t.count("a") * w["a"], t.count("b") * w["b"]] for t in texts])

    encode = C.Resident(spark, str(model), load)
    docs = spark.range(400).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, "ab").otherwise("b").alias("text")).repartition(16)
    got = {tuple(round(x, 4) for x in r.embedding) for r in C.embed(docs, encode, batch=4).collect()}
    assert got == {(0.6, 0.8), (0.0, 1.0)}
    assert C.embed(docs, encode, batch=4).count() == 400
    with open(log) as f:
        loads = f.read().split()
    assert len(loads) == len(set(loads)) <= 16


def test_refusals_across_scripts_are_those_of_plain_code(spark, sf):
    asked, found, docs = catalog._cross_script(spark, sf)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = spark.createDataFrame([("d", k, v) for k, v in texts.items()] + [("q", r.qid, r.text or "") for r in asked.collect()], "of string, id long, text string")
    toks = {(r.of, r.id): r.w for r in words.select("of", "id", F.array_distinct(C.T.tokens(F.col("text"))).alias("w")).collect()}
    stop = lambda w, words, sounds: len(w) < 2 or w in words or X.folded(X.romanized(w)) in sounds

    def share(qid, doc, words, sounds):
        q = [w for w in toks["q", qid] if not stop(w, words, sounds)]
        t = toks["d", doc]
        said = [X.romanized(w) for w in t if not stop(w, words, sounds)]
        sure = [w for w in q if w in t or len(X.romanized(w)) >= 3 and X.heard(X.romanized(w), said)]
        return len(q), len(sure) / len(q) if q else 0.0

    hits = {}
    for r in found.collect():
        hits.setdefault(r.qid, []).append((r.rank, r.doc_id))
    got = catalog.QUERIES["cross_script_refusals"](spark, sf).collect()
    assert len(got) == len({r.qid for r in asked.collect()}) and sum(not r.refused for r in got) > 0
    for r in got:
        of = [share(r.qid, doc, R.GUARD_STOP, R.GUARD_SOUNDS) for _, doc in hits.get(r.qid, [])]
        cover, n = max((c for _, c in of), default=0.0), max((n for n, _ in of), default=0)
        assert r.confidence == pytest.approx(cover, abs=1e-6)
        assert r.refused == (cover < (1.0 if n <= 3 else 0.5))
        if of:
            best = max(((round(share(r.qid, doc, R.STOP, R.SOUNDS)[1], 8), -rank, doc) for rank, doc in hits[r.qid]))
            assert (r.chunk_id, r.rerank_score) == (str(best[2]), pytest.approx(best[0], abs=1e-8))


def test_texts_of_hits_are_dealt_alone(spark):
    conf, key = spark.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(key)
    conf.set(key, "-1")
    try:
        docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        found = spark.range(12).select(F.col("id").alias("qid"), (F.col("id") % 3 * 7).alias("doc_id"))
        store = spark.sparkContext._jsc.sc().statusStore()
        seen = lambda: {x.stageId(): x.shuffleWriteRecords() for x in _listed(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
        old = seen()
        got = catalog._with_texts(found, docs).collect()
        assert sorted((r.qid, r.doc_id) for r in got) == [(i, i % 3 * 7) for i in range(12)] and all(r.text for r in got)
        assert sum(n for i, n in seen().items() if i not in old) < 500
    finally:
        conf.set(key, before)
