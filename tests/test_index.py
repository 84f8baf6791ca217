"""The stored index, dense search, and the sources and sinks around them."""

import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import corpus as C
from marlstone.shared import fresh_path

GUJARATI = (
    (0, "ગોવા ભારતના દક્ષિણ-પશ્ચિમ કિનારે આવેલું એક રાજ્ય છે."), (1, "પાણીનું ઉકળવાનું તાપમાન 100 ડિગ્રી સેલ્સિયસ છે."),
    (2, "વકીલની ફી સામાન્ય રીતે કલાકના દરે વસૂલવામાં આવે છે."), (3, "ગ્લુકોઝ એ શરીરની ઊર્જાનો મુખ્ય સ્રોત છે."),
    (4, "ગુજરાત ભારતના પશ્ચિમ ભાગમાં આવેલું રાજ્ય છે."), (5, "આ ગીતનું રેકોર્ડિંગ 1998 માં થયું હતું."),
)
ENGLISH = ((0, "Goa is a coastal state in India."), (1, "The weather forecast is unrelated."), (2, "New Delhi is the capital."))


def index(spark, rows, language):
    docs = spark.createDataFrame([(*r, language) for r in rows], "doc_id long, text string, language string")
    return C.Index.build(docs, fresh_path(spark, "index"), buckets=4)


def search(ix, *questions, k=20):
    q = ix.spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(questions)], "qid long, text string, languages array<string>")
    out = {}
    for r in ix.search(q, k).orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r)
    return out


def test_exact_terms_and_missing_languages(spark):
    got = search(index(spark, ENGLISH, "en"), ("Where is Goa located?", None), ("Where is Goa located?", ["hi"]), ("?!", None), (None, None), k=2)
    assert got[0][0].doc_id == 0 and got[0][0].score > got[0][-1].score
    assert got[1][0].doc_id == 0 and set(got) == {0, 1}  # no Hindi there: all documents count; no words: no hits


def test_source_question_comes_first(spark):
    asked = "क्यान्सर भएका प्रसिद्ध व्यक्तिहरू"
    rows = [(1, "सेलिब्रिटीहरूले क्यान्सरसँग लड्दैछन्।", asked + " सेलिब्रिटीहरूले क्यान्सरसँग लड्दैछन्।", asked, "ne"), (2, "अर्को असम्बन्धित अनुच्छेद।", None, None, "ne"), (3, "क्यान्सर", None, asked, "hi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, search_text string, source_query string, language string")
    got = search(C.Index.build(docs, fresh_path(spark, "index"), buckets=2), (asked, ["NE "]), (asked, None))
    assert [(r.doc_id, r.exact) for r in got[0]] == [(1, True)] and got[0][0].score >= 1
    assert [r.doc_id for r in got[1] if r.exact] == [1, 3]


def test_other_scripts_are_found_by_sound(spark):
    ix = index(spark, GUJARATI, "gu")
    assert [(r.language, r.script) for r in ix.languages.collect()] == [("gu", 0x0A80)]
    got = search(ix, ("Goa કયાં છે?", None), ("ઉકળવાનું તાપમાન", None))
    assert got[0][0].doc_id == 0 and got[1][0].doc_id == 1


def test_index_against_a_plain_computation(spark, sf):
    import math
    import re
    from collections import Counter

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: [t.lower() for t in re.findall(r"\w+", r.text or "")] for r in docs.collect()}
    asked = ["the of and", "license data data", "zzz"]
    df = Counter(t for ws in texts.values() for t in set(ws))
    raw = {t: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    average = sum(map(len, texts.values())) / len(texts)

    def score(q, ws):
        tf = Counter(ws)
        return sum((raw[t] if raw[t] >= 0 else floor) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / average)) for t in q.split() if tf[t])

    ix = C.Index.build(docs, fresh_path(spark, "index"), buckets=3)
    got = ix.scores(spark.createDataFrame(list(enumerate(asked)), "qid long, text string")).collect()
    want = {(i, d): score(q, ws) for i, q in enumerate(asked) for d, ws in texts.items() if set(q.split()) & set(ws)}
    assert {(r.qid, r.doc_id) for r in got} == set(want)
    assert all(abs(r.score - want[r.qid, r.doc_id]) < 1e-9 for r in got)


def test_empty_index(spark):
    ix = C.Index.build(spark.createDataFrame([], "doc_id long, text string"), fresh_path(spark, "index"), buckets=2)
    assert search(ix, ("anything", None)) == {}


def test_dense_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = 0
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)] + [(300, None)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 10").select(F.col("vec_id").alias("qid"), "embedding")
    got = C.dense_top_k(v, q, 4, block=3).collect()
    y = x.astype(float)
    n = np.linalg.norm(y, axis=1)
    for i in range(10):
        own = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i]
        want = sorted(((-round(float(y[i] @ y[j] / n[i] / n[j]), 6), j) for j in range(300) if n[j] and n[i]))[:4]
        assert own == [(j, -s) for s, j in want]
    assert C.dense_top_k(v, q.limit(0), 4).count() == 0


def test_dense_blocks_meet_by_groups(spark, sf, monkeypatch):
    from marlstone.operators import dense

    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    few = sorted(map(tuple, C.dense_top_k(v, q, 5).collect()))
    monkeypatch.setattr(dense, "bounded", lambda df: df)
    many = C.dense_top_k(v, q, 5, block=2)
    assert sorted(map(tuple, many.collect())) == few
    for plan in (many, C.dense_top_k(v, q, 5, block=1000)):
        assert plan._jdf.queryExecution().sparkPlan().toString().count("embeddings.parquet") == 1


def test_vector_index(spark, sf):
    from marlstone.operators.dense import VectorIndex

    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    odd = spark.createDataFrame([(10**9, [0.0] * 64, 1), (10**9 + 1, None, 1), (None, [1.0] * 64, 1)], v.schema)
    ix = VectorIndex.build(v.unionByName(odd), fresh_path(spark, "vectors"))
    assert sum(len(r.ids) for r in ix.blocks.collect()) == v.count()
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    want = {(r.qid, r.vec_id) for r in C.dense_top_k(v, q, 10).collect()}
    got = {(r.qid, r.vec_id) for r in ix.search(q, 10).collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert {(r.qid, r.vec_id) for r in ix.search(q, 10, len(ix.centroids)).collect()} == want
    none = VectorIndex.build(v.limit(0), fresh_path(spark, "vectors"))
    assert none.search(q, 10).count() == 0 and ix.search(q.limit(0), 10).count() == 0


def test_lines_and_limits(spark, tmp_path):
    from marlstone.sources import store

    path = f"file://{tmp_path}/q.jsonl"
    lines = [json.dumps({"qid": f"q{i}", "query": "x" * (i % 7)}) if i % 3 else "" for i in range(400)]
    (tmp_path / "q.jsonl").write_text("\n".join(lines) + "\n")
    got = store.read_queries(spark, path, 100).orderBy("line").collect()
    assert [(r.qid, r.line) for r in got] == [(f"q{i}", i) for i in range(100) if i % 3]
    assert store.read_queries(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("n"), F.lit("t").alias("t"))
    assert sorted(r.n for r in store.first_rows(df, "n", 9).collect()) == list(range(9))


def test_stream_builds_each_text_once(spark, tmp_path):
    from marlstone.operators import records as R
    from marlstone.sources.store import Collection
    from marlstone.streaming import build

    assert (build.batch_cap(10, 100, 50, 100), build.batch_cap(10, 3, 500, 100), build.batch_cap(256, 10_000, 700, 100)) == (10, 3, 1792)
    said = "The old harbour town lies on the eastern shore of the lake, where ships were built. "
    rows = [(i, "q?", [said + f"Record {i % 3} tells of its people and their many trades."]) for i in range(6)]
    raw = spark.createDataFrame(rows, "query_id long, query string, texts array<string>")
    rec = R.normalize(raw.select("query_id", "query", F.struct(F.col("texts").alias("English_passages")).alias("passages")), "en")
    for i in range(2):
        rec.where(f"query_id >= {3 * i} AND query_id < {3 * i + 3}").write.mode("append").parquet(str(tmp_path / "in"))
    whole = R.compact_chunks(R.clean(rec))
    box = Collection(spark, fresh_path(spark, "collection"))
    stream = spark.readStream.schema(rec.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    build.build_stream(stream, box, fresh_path(spark, "offsets")).awaitTermination()
    got = [r.text for r in box.read().collect()]
    assert sorted(got) == sorted({r.text for r in whole.collect()}) and len(got) == len(set(got))
    assert build.add_batch(box, R.clean(rec), 0) == 0
    small = Collection(spark, fresh_path(spark, "collection"))
    assert build.add_batch(small, R.clean(rec), 0, most=4, expected=6) == small.read().count() <= 4


def test_collections_check_vectors(spark):
    from marlstone.sources.store import Collection

    box = Collection(spark, fresh_path(spark, "vectors"))
    schema = spark.createDataFrame([], "chunk_id string, text string, v array<float>").schema
    assert box.ensure(schema, "v", 2).read().count() == 0
    box.upsert(spark.createDataFrame([("a", "x", [1.0, 2.0]), (None, "y", [0.0, 1.0])], schema))
    box.upsert(spark.createDataFrame([(None, "z", [0.0, 1.0])], schema))
    assert sorted(r.text for r in box.read().collect()) == ["x", "z"]
    with pytest.raises(Exception, match="a vector has the size 1"):
        box.upsert(spark.createDataFrame([("b", "x", [1.0])], schema))
    assert box.ensure(schema, recreate=True).read().count() == 0


def test_upserts_write_what_they_bring(spark, tmp_path, monkeypatch):
    import os

    from marlstone.sources.store import Collection

    box, want, sizes = Collection(spark, f"file://{tmp_path}/box"), {}, []
    rows = lambda n: spark.createDataFrame([(f"c{i % 40}", n) for i in range(10 * n, 10 * n + 10)], "chunk_id string, v int").coalesce(1)
    monkeypatch.setattr(Collection, "FAN", 3)
    for n in range(9):
        box.upsert(rows(n), batch=n)
        want |= {f"c{i % 40}": n for i in range(10 * n, 10 * n + 10)}
        assert {r.chunk_id: r.v for r in box.read().collect()} == want and len(box.runs()) <= 5 and box.batch() == n
        sizes.append(sum(spark.read.parquet(f"{tmp_path}/box/{d}").count() for d in os.listdir(tmp_path / "box") if d.startswith("run-")))
    assert sizes[-1] <= 9 * 10 * 3  # each row once, and once for each power of FAN
    before = {r.chunk_id: r.v for r in box.read().collect()}
    monkeypatch.setattr(Collection, "_commit", lambda self, runs: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        box.upsert(rows(40))
    assert {r.chunk_id: r.v for r in box.read().collect()} == before
    os.makedirs(tmp_path / "box" / "m99")  # a manifest that was never completed
    assert {r.chunk_id: r.v for r in box.read().collect()} == before
    monkeypatch.undo()
    box.upsert(rows(3))
    box.vacuum(1)
    assert len(box.versions()) == 1 and {r.chunk_id: r.v for r in box.read().collect()} == before | {f"c{i}": 3 for i in range(30, 40)}


def test_a_dropped_passage_takes_its_mark_along(spark):
    from marlstone.operators import records as R

    long = ["too short", "The second passage is certainly long enough to be kept here.", "The third passage is certainly long enough to be kept too."]
    raw = spark.createDataFrame([(1, "q?", long, [0, 1, 0])], "query_id long, query string, e array<string>, s array<int>")
    rec = R.clean(R.normalize(raw.select("query_id", "query", F.struct(F.col("e").alias("English_passages"), F.col("s").alias("is_selected")).alias("passages")), "en"))
    assert rec.first().is_selected == [1, 0]
    assert [r.passage for r in R.passages(rec).collect()] == [long[1]]


def test_encoder_hook(spark):
    import numpy

    def encode(texts):
        return numpy.array([[t.count("a"), t.count("b"), 0.0] for t in texts])

    docs = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "ab"), (4, None)], "vec_id long, text string")
    v = C.embed(docs, encode, batch=2)
    assert {r.vec_id: [round(x, 4) for x in r.embedding] for r in v.collect()} == {1: [1, 0, 0], 2: [0, 1, 0], 3: [0.7071, 0.7071, 0], 4: [0, 0, 0]}
    got = C.semantic_search(v, spark.createDataFrame([(9, "b")], "qid long, text string"), encode, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (3, 0.707107)]


def test_samples_and_curated_records(spark, tmp_path):
    from marlstone.operators import records as R
    from marlstone.sources import store

    facts = spark.createDataFrame([(1, "en", "Where?", "There.", "It is there, as everyone knows."), (2, "hi", "कहाँ?", "वहाँ।", "वह वहाँ है।")], "n int, language string, query string, answer string, passage string")
    got = R.curated(facts).orderBy("query_id").collect()
    assert [(r.query_id, r.eng_query, r.translated_passages) for r in got] == [(9001, "Where?", []), (9002, "Where?", ["वह वहाँ है।"])]
    two = facts.withColumn("n", (F.col("n") + 1).cast("int")).unionByName(spark.createDataFrame([(1, "en", "Which?", "This.", "This one.")], facts.schema)).repartition(3)
    assert {r.eng_query for r in R.curated(two).collect()} == {"Which?"}
    long = "यह एक बहुत लंबा वाक्य है जिसमें उत्तर दिल्ली भी लिखा हुआ है।"
    rows = [(1, "hi", "दिल्ली कहाँ है", long, "दिल्ली", None), (2, "hi", "where", long, "दिल्ली", None), (3, "hi", "भारत की राजधानी का नाम क्या है और वह कहाँ बसी हुई है", long, "दिल्ली", "X"), (4, "hi", "दिल्ली कहाँ", long, "मुंबई", None), (5, "hi", "दिल्ली किधर है", long, "", None)]
    raw = spark.createDataFrame(rows, "n int, language string, query string, passage string, answer string, query_type string")
    got = R.sample_records(raw, 2, {"hi": (0x900, 0x97F)}).orderBy("query_id").collect()
    assert [(r.query_id, r.query[:4], r.query_type) for r in got] == [(9101, "भारत", "X"), (9102, "दिल्", "DESCRIPTION")]
    df = spark.range(100).repartition(3).sortWithinPartitions("id")
    df.write.parquet(str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert store.first_of(back, 7).count() == 7 and store.first_of(back, 7).columns == ["id"]
    (tmp_path / "chunks.jsonl").write_text('\n{"text": "one"}\n{"chunk_id": "c", "text": "two"}\n{"text": " "}\n')
    assert sorted(r.chunk_id for r in store.read_chunks(spark, f"file://{tmp_path}").collect()) == ["c", "jsonl:1"]


def test_postings_of_long_and_odd_texts(spark, tmp_path):
    """One text of many words beside empty ones: each posting has its count and length, and nothing else of its text."""
    long = " ".join(f"w{i % 30_000}" for i in range(40_000))
    rows = [(1, long), (2, None), (3, ""), (4, "?!"), (5, "B a b A b"), (6, "x")]
    ix = C.Index.build(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "odd"), buckets=4)
    want = set()
    for doc_id, text in rows:
        n = Counter(re.findall(r"\w+", (text or "").lower()))
        want |= {(t, doc_id, tf, n.total()) for t, tf in n.items()}
    assert {tuple(r) for r in ix.postings.select("term", "doc_id", "tf", "dl").collect()} == want
    assert ix.corpus.first()["n_docs"] == 6 and ix.corpus.first()["avgdl"] == pytest.approx(40_006 / 6)
    none = C.Index.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), buckets=4)
    assert none.postings.count() == 0 and none.corpus.first()["n_docs"] == 0


def test_postings_are_dealt_once_by_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the word{i % 7} and word{i % 3}") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"the word{q % 7} and") for q in range(30)], "qid long, text string")
    plan = C.Index.build(docs, str(tmp_path / "ix"), buckets=2).scores(queries)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "hashpartitioning(doc_id" in dealt[0]


def test_placing_vectors_holds_few_numbers_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from marlstone.operators import dense

    class Rows:  # gives the function that the tasks run
        select = where = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    rng = np.random.default_rng(1)
    vectors, centers = [rng.normal(size=8).tolist() for _ in range(60)], rng.normal(size=(20, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], ["id", "embedding"])
    whole = pa.Table.from_batches(dense.VectorIndex._placed(Rows(), centers, 3)([batch]))
    monkeypatch.setattr(dense, "CELLS", 100, raising=False)
    parts = list(dense.VectorIndex._placed(Rows(), centers, 3)([batch]))
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist() and len(whole) == 180
    assert max(map(len, parts)) * 20 // 3 <= 100


def test_postings_are_written_where_texts_are_read(spark, tmp_path):
    """Building shuffles no posting: each task writes its own documents' postings, so a hot term is in a file of each task."""
    docs = spark.range(60).repartition(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word"), F.col("id").cast("string")).alias("text"))
    postings = C.Index.build(docs, str(tmp_path / "ix"), buckets=2).postings
    hot = postings.where("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) == 3 and sum(r["count"] for r in hot) == 60


def test_best_are_the_top_of_all_scores(spark, monkeypatch):
    """Many copies, pairs asked for besides, languages, ids of either kind; by each of the three ways a list may be held."""
    rows = [(i, f"{'red ' * (i % 5)}{'blue ' * (i % 3)}green w{i % 11} w{i % 7}", ("fr", "de", None)[i % 3]) for i in range(300)] + [(1000 + i, "red blue copy", "de") for i in range(50)]
    docs = spark.createDataFrame([*rows, (7000, "", "fr"), (7001, None, None)], "doc_id long, text string, language string")
    q = [(i, f"red w{i % 11} {'blue ' * (i % 4)}copy", [None, ["fr"], ["de", "fr"], [""], []][i % 5]) for i in range(40)] + [(90, "none of them", None), (91, "", ["fr"]), (92, None, None)]
    q = spark.createDataFrame(q, "qid long, text string, only array<string>")
    also = spark.createDataFrame([(1, 297), (2, 1049), (3, 5), (0, 7000), (90, 1)], "qid long, doc_id long")
    for kind, asked, hows in (("long", q, ({}, {"_CELLS": 0}, {"bounded": lambda df: df, "_HELD": 8})), ("string", q.drop("only"), ({},))):
        named = also.withColumn("doc_id", F.col("doc_id").cast(kind))
        ix = C.Index.build(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), fresh_path(spark, "best"), buckets=2)
        pairs = {(r.qid, r.doc_id): r.score for r in ix.scores(asked).collect()}
        want = C.top_k(ix.scores(asked), 4).orderBy("qid", "rank").collect()
        for how in hows:
            with monkeypatch.context() as m:
                for name, value in how.items():
                    m.setattr(C, name, value)
                best = ix.best(asked, 4, also=named).collect()
                if not how:
                    assert ix.top(asked, 4).orderBy("qid", "rank").collect() == want
            got = {(r.qid, r.doc_id): r.score for r in best}
            assert len(best) == len(got) < len(pairs) / 2 and all(s == pytest.approx(pairs.get(p, 0.0)) for p, s in got.items())
            assert {(r.qid, r.doc_id) for r in want} | {p for r in named.collect() if (p := tuple(r)) in pairs} <= set(got)


def test_scripts_of_languages_and_terms_without_a_shuffle(spark):
    from marlstone.operators.rerank import roman_vocabulary

    rows = [(9, "गोवा राज्य", "hi"), (4, "x1गोवा plain ગોવા", " HI "), (2, "latin only", "hi"), (7, "ܫܠܡܐ סלאם", "he"), (3, "Ünïcode", "de"), (5, "گوا ہے", "ur"), (6, None, "xx"), (8, "गोवा", "")]
    ix = C.Index.build(spark.createDataFrame(rows, "doc_id long, text string, language string"), fresh_path(spark, "index"), buckets=2)
    assert {tuple(r) for r in ix.languages.select("language", "script").collect()} == {("hi", 0x0A80), ("he", None), ("de", None), ("ur", 0x0600), ("xx", None)}
    assert {r.native for r in ix.roman.collect()} >= {"गोवा", "राज्य", "ગોવા", "گوا"} and ix.roman.count() == ix.roman.select("native").distinct().count()
    plan = roman_vocabulary(ix.terms.select("term"), once=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
