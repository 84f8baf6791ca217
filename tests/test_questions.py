"""The whole path of questions, and how answers are judged."""

from pyspark.sql import functions as F

from marlstone.operators import answers as A
from marlstone.operators import questions as Q
from marlstone.operators.corpus import Index
from marlstone.shared import fresh_path

DOCS = (
    (1, "Goa is a state on the southwestern coast of India. Its beaches draw many visitors.", None), (2, "India is in South Asia. New Delhi is its capital.", None),
    (3, "Paris is the capital of France. It stands on the Seine.", None), (4, "Photosynthesis turns light into sugar in green leaves.", "How do plants make sugar?"),
    (5, "ગોવા ભારતના કિનારે આવેલું એક રાજ્ય છે.", None), (6, "Water boils at 100 degrees at sea level.", None), (7, "Mount Everest is the highest mountain.", None),
)
ASKED = (
    ("goa", "Where is Goa located?"), ("weather", "What's the weather in Goa today?"), ("bomb", "How to make a bomb"), ("blank", "  "),
    ("none", "Who invented the telephone exchange?"), ("source", "How do plants make sugar?"), ("roman", "goa kya chhe"), ("capital", "What is the capital of France?"),
)


def ask(spark, **how):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source_query string").withColumn("language", F.when(F.col("doc_id") == 5, "gu").otherwise("en"))
    ix = Index.build(docs, fresh_path(spark, "index"), buckets=2)
    q = spark.createDataFrame([(*a, None, None) for a in ASKED], "qid string, text string, forced string, hint string")
    return {r.qid: r for r in Q.answer(ix, docs, q, **how).collect()}


def test_questions_are_answered_or_refused(spark):
    got = ask(spark)
    assert len(got) == len(ASKED)
    assert not got["goa"].refused and got["goa"].grounded and "Goa is a state" in got["goa"].answer and got["goa"].sources[0] == "1"
    assert not got["capital"].refused and "Paris" in got["capital"].answer
    assert not got["source"].refused and got["source"].confidence >= 1 and "Photosynthesis" in got["source"].answer
    reasons = {k: r.refusal_reason for k, r in got.items() if r.refused}
    assert reasons == {"weather": "low_confidence", "bomb": "unsafe", "blank": "empty_query", "none": "low_confidence"}
    assert got["bomb"].answer == Q.UNSAFE_ANSWER and got["blank"].answer == A.REFUSAL and got["blank"].candidates == 0
    assert {r.mode for r in got.values()} == {"fast"} and {r.retrieval_mode for r in got.values()} == {"sparse"}
    assert got["goa"].query_language == "en"


def test_generation_falls_back(spark):
    got = ask(spark, mode="generative")
    assert got["goa"].mode == "fast" and got["goa"].error == "generator_unavailable" and "Goa is a state" in got["goa"].answer
    told = ask(spark, mode="generative", generate=lambda p: F.when(p.contains("[1] Goa is a state") & p.endswith("QUESTION:\nWhere is Goa located?\n"), "Goa lies on the coast of India."))
    assert told["goa"].mode == "generative" and told["goa"].answer == "Goa lies on the coast of India." and told["goa"].grounded
    wild = ask(spark, mode="generative", generate=lambda p: F.lit("Stock markets crashed forty percent yesterday."))
    assert wild["goa"].refused and wild["goa"].refusal_reason == "ungrounded" and wild["goa"].answer == A.REFUSAL


def test_dense_hits_are_fused(spark):
    dense = spark.createDataFrame([("goa", "1", 0.9, 1), ("goa", "7", 0.2, 2)], "qid string, id string, score double, rank long")
    got = ask(spark, dense=dense)
    assert got["goa"].retrieval_mode == "hybrid" and got["goa"].sources[0] == "1" and "7" in got["goa"].sources


def test_verification(spark):
    hits = spark.createDataFrame([(i, 1, "x", "New Delhi is the capital of India.") for i in range(2)], "qid int, rank int, text string, parent_text string")
    said = ["New Delhi is the capital of India.", "The stock market crashed 40 percent today.", " ", A.REFUSAL, None]
    got = {r.qid: r for r in A.verify(spark.createDataFrame(list(enumerate(said)), "qid int, answer string"), hits).collect()}
    assert [got[i].grounded for i in range(5)] == [True, False, True, True, True]
    assert got[0].overlap > 0.5 and got[1].answer == A.REFUSAL and got[2].overlap == 1.0


def test_passages_and_prompt(spark):
    hits = spark.createDataFrame([(1, 2, "b", ""), (1, 1, "a", " one "), (1, 3, "c", "one"), (1, 4, " ", None)], "qid int, rank int, text string, parent_text string")
    p = A.passages(hits, 2).select("passages", A.prompt(F.lit("why?"), F.col("passages")).alias("p"), A.prompt(F.lit("why?"), F.lit(None).cast("array<string>")).alias("none")).first()
    assert p.passages == ["on", "b"] and p.p == "CONTEXT:\n[1] on\n\n[2] b\n\nQUESTION:\nwhy?\n" and p.none == "CONTEXT:\n(no passages)\n\nQUESTION:\nwhy?\n"


def test_benchmark_and_query_set(spark):
    rec = "query_id long, query string, eng_query string, language string"
    curated = spark.createDataFrame([(9001, "गोवा कहाँ है?", "Where is Goa?", "hi"), (9002, "", "Only English?", "en")], rec)
    later = spark.createDataFrame([(i, f"q{i}", "", "hi") for i in range(40)], rec)
    s = A.query_set(later, curated, skip=30, held_out=5).collect()
    assert [r.qid for r in s if r.kind == "held_out"] == [f"h{i}" for i in range(30, 35)] or sorted(r.gold for r in s if r.kind == "held_out") == [str(i) for i in range(30, 35)]
    assert [(r.query, r.language) for r in s if r.kind == "curated"] == [("Where is Goa?", "en"), ("गोवा कहाँ है?", "hi"), ("Only English?", "en")]
    assert [r.query for r in s if not r.expect_answer] == list(A.ADVERSARIAL)
    results = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", True, False), ("x", False, True), ("y", False, False)], "qid string, expect_answer boolean, refused boolean")
    hits = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "9", 1), ("x", "1", 1)], "qid string, id string, rank int")
    gold = spark.createDataFrame([("a", "2"), ("b", "3"), ("x", "1")], "qid string, id string")
    assert tuple(A.benchmark(results, hits, gold).first()) == (3, 0.3333, 0.1667, 2, 0.5)


def test_latencies(spark):
    spans = spark.createDataFrame([("r1", "bm25", 2.0), ("r1", "bm25", 1.5), ("r1", "rerank", 9.0), ("r2", "bm25", 7.0), ("r3", "bm25", 5.0)], "request_id string, stage string, ms double")
    per = A.accumulated(spans)
    assert {r.request_id: r.latency_ms for r in per.collect()}["r1"] == {"bm25": 3.5, "rerank": 9.0}
    got = {r.stage: tuple(r)[1:] for r in A.stage_latencies(per).collect()}
    assert got == {"bm25": (5.0, 5.0, 7.0), "rerank": (9.0, 9.0, 9.0)}


def test_kinds_are_filtered_before_the_cut(spark):
    rows = [(i, f"harbour town number {i}" + " harbour" * (i < 30), "semantic+sliding" if i % 7 else "semantic") for i in range(30)]
    rows += [(100 + i, "a harbour far away among many other words of a long text " * 3, "sentence" if i % 2 else "parent_child+sentence") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk_type string")
    ix = Index.build(docs, fresh_path(spark, "index"), buckets=2)
    assert ix.kinds == ["parent_child", "semantic", "sentence", "sliding"]
    q = spark.createDataFrame([(1, "harbour town", None)], "qid long, text string, languages array<string>")
    ids = lambda **how: [r.chunk_id for r in Q.retrieve(ix, docs, q, **how).orderBy("rank").collect()]
    assert sorted(ids(k=5, chunk_type="sentence")) == ["100", "101", "102", "103", "104"] and len(ids(k=5)) == 5
    assert sorted(ids(k=9, chunk_type="parent_child")) == ["100", "102", "104"] and ids(k=5, chunk_type="other") == []
    dense = spark.createDataFrame([(1, str(i), 1.0 - i / 1000, r + 1) for r, i in enumerate([*range(30), 103, 104])], "qid long, id string, score double, rank long")
    assert sorted(ids(k=5, chunk_type="sentence", dense=dense)) == ["100", "101", "102", "103", "104"]
