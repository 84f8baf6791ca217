"""The index of chunks as runs of sentences, held against the index of the chunks' own rows."""

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import records as R
from marlstone.operators.corpus import Index
from marlstone.operators.spans import ChunkIndex

LONG = " ".join(f"Sentence {i} of a text that is long enough to be packed into several chunks, with alpha and beta{i % 3}." for i in range(40))
TEXTS = [
    LONG, LONG.upper(), "Short one. Short one. Short one. Short one. Short one. Short one. Short one. Short one.", "No mark at its end and forty characters or more of it",
    "A line.\nA line.\t\tA  line! Alpha?  Beta। Gamma॥ Delta beta beta. İstanbul ÉTÉ été Été.  Odd blanks here. ...  ! ", "too short", "", None,
    "Alpha beta gamma. " * 30, "One. Two! Three? Four. Five. Six. Seven. Eight. Nine. Ten. Alpha. Beta.", "??? !!! ... ??? !!! ... ??? !!! ... ??? !!! ... ???", "नमस्ते दुनिया। यह एक वाक्य है जो काफी लंबा है। alpha नमस्ते।",
]


def _raw(spark):
    rows = [(i, "document", ([t], []), "en" if i % 3 else None) for i, t in enumerate(TEXTS)]
    rows.append((90, "several", ([TEXTS[8], TEXTS[4], TEXTS[8], TEXTS[2]], [TEXTS[11], TEXTS[4]]), "hi"))
    rows.append((91, "", ([LONG], []), "en"))
    df = spark.createDataFrame(rows, "query_id long, query string, passages struct<English_passages: array<string>, Translated_passages: array<string>>, lang string")
    return R.normalize(df, F.col("lang"))


def _both(spark, tmp_path):
    records = _raw(spark)
    chunks = R.compact_chunks(R.clean(records), ordered=False).withColumnRenamed("chunk_id", "doc_id").localCheckpoint()
    return chunks, Index.build(chunks.select("doc_id", "text", "chunk_type"), f"{tmp_path}/rows", buckets=2), ChunkIndex.build(records, f"{tmp_path}/spans", buckets=2)


def test_chunk_index_is_the_index_of_the_chunks(spark, tmp_path, monkeypatch):
    from marlstone.operators import spans

    chunks, want, got = _both(spark, tmp_path)
    a, b = want.corpus.first(), got.corpus.first()
    assert (a["n_docs"], round(a["avgdl"], 9)) == (b["n_docs"], round(b["avgdl"], 9)) == (chunks.count(), round(a["avgdl"], 9))
    terms = lambda ix: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in ix.terms.collect())
    assert terms(got) == terms(want)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "short one one"), (3, "été istanbul beta gamma"), (4, "नमस्ते"), (5, "sentence 7 of"), (6, "nowhere"), (7, "eight")], "qid long, text string")
    asked = asked.withColumn("languages", F.lit(None).cast("array<string>"))
    for kind in (None, "sliding", "parent_child"):
        assert sorted(got.search(asked, 7, kind).collect()) == sorted(want.search(asked, 7, kind).collect()), kind
    monkeypatch.setattr(spans, "_CELLS", 8)  # a piece for each query or two
    few = asked.where("qid IN (1, 2)")
    assert sorted(got.search(few, 2, "semantic").collect()) == sorted(want.search(few, 2, "semantic").collect())
    assert got.rows.count() <= len(TEXTS) + 2 < chunks.count() < want.postings.count()


def test_retrieve_of_kind_cuts_texts_into_tokens_by_sentence(spark, sf, monkeypatch):
    """The query's index is not that of the chunks' rows, which holds five postings for each of a text."""
    from marlstone import catalog

    monkeypatch.setattr(Index, "build", classmethod(lambda *a, **k: (_ for _ in ()).throw(AssertionError("an index of rows"))))
    assert catalog.retrieve_of_kind(spark, sf).count() > 0


def test_blanks_are_those_of_the_pattern(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(1, 0x3002)], "c string")
    text = F.concat(F.lit("a "), "c", "c", F.lit("b.\n \tc"), "c")
    plain = F.trim(F.regexp_replace(F.translate(text, "\0", " "), r"(?U)\s+", " "))
    assert every.where(~T.clean_text(text).eqNullSafe(plain)).collect() == []
    clean = T.clean_text(F.concat(F.lit("Ab. c! "), "c", F.lit(" d? . e।f।"), "c", F.lit(" g")))
    assert every.where(~T.clean_sentences(clean).eqNullSafe(T.sentences(clean))).collect() == []
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_\x{0900}-\x{0D7F}\x{0600}-\x{06FF}]+"), F.lit(0)), F.lower)
    assert every.where(~T.tokens(text).eqNullSafe(tokens)).collect() == []
