"""The whole path of a question, for a table of questions at once: guard, route, search, fuse, rerank, refuse, answer, verify."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import answers as A
from marlstone.operators import rerank as R
from marlstone.operators.corpus import Index, fuse
from marlstone.operators.routing import route
from marlstone.shared import bounded, written

#: Hits fused, hits kept, share of a question's words that they must have, and what is said instead.
CANDIDATES, SELECTED, RELEVANT = 20, 5, 0.5
UNSAFE_ANSWER = "I cannot help with that request."
ROMANIZED_ANSWER = (
    "That looks like an Indian language written in English letters, which cannot match the indexed passages. Choose your "
    "language next to the microphone and ask again, or type the question in its own script."
)


def found(index: Index, queries: DataFrame, docs: DataFrame | Callable[[DataFrame], DataFrame], dense: DataFrame | None = None, k: int = CANDIDATES, chunk_type: str | None = None) -> DataFrame:
    """Hits of ``queries`` (qid, text, languages): qid, rank, chunk_id, text, parent_text, source_query, orig_score, rrf_score.

    ``dense`` (qid, id, score, rank), the hits of an encoder outside, is fused with the index's own by reciprocal ranks;
    without it the index's own stand as they are. ``docs`` has doc_id, text and, where there, parent_text, source_query and
    chunk_type; it may be a function that gives it for the hits' ids (id). With ``chunk_type`` only chunks of that kind are hits, of either side, before anything is cut.
    """
    if dense is not None and callable(docs):
        raise ValueError("hits of another side need a table of documents")
    own = index.search(queries, k, chunk_type).select("qid", F.col("doc_id").cast("string").alias("id"), "score", "rank")
    if dense is not None and chunk_type is not None:
        of_kind = of_type(docs, chunk_type).select(F.col("doc_id").cast("string").alias("id"))
        dense = first_ranked(dense.join(of_kind, "id", "left_semi"), k, "id")
    if dense is not None:
        own = fuse([dense, own], limit=k).select("qid", "id", F.col("orig_score").alias("score"), "rank", "rrf")
    else:
        own = own.withColumn("rrf", F.lit(0.0))
    own = written(own, "hits")
    docs = docs(own.select("id").distinct()) if callable(docs) else docs
    have = docs.columns
    maybe = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), "text", maybe("parent_text"), maybe("source_query"), maybe("chunk_type"))
    texts = texts.join(bounded(own.select("id").distinct()), "id", "left_semi")
    return own.join(texts, "id").select(
        "qid", "rank", F.col("id").alias("chunk_id"), "text", F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text")).alias("parent_text"),
        "source_query", F.col("score").alias("orig_score"), F.col("rrf").alias("rrf_score"), "chunk_type",
    )


def of_type(hits: DataFrame, chunk_type: str) -> DataFrame:
    """Hits of chunks of that kind; chunks of several kinds (``a+b``) are of each."""
    return hits.where(F.array_contains(F.split(F.coalesce("chunk_type", F.lit("")), r"\+"), chunk_type))


def response(hits: DataFrame) -> DataFrame:
    """What is shown of hits: without the source question and whatever else starts with an underscore."""
    return hits.select(*[c for c in hits.columns if not c.startswith("_") and c != "source_query"])


def answer(index: Index, docs: DataFrame, queries: DataFrame, dense: DataFrame | None = None, model: DataFrame | None = None, mode: str = "fast", generate=None) -> DataFrame:
    """One row for each of ``queries`` (qid, text, forced, hint): qid, query, answer, grounded, refused, refusal_reason, mode,
    retrieval_mode, query_language, candidates, selected, confidence, sources (ids by rank), error.

    Blank questions are refused as empty_query and unsafe ones as unsafe, both before anything is searched; then by what
    the hits have (low_confidence, or romanized_input where the question is an Indic one in Latin letters); then answers
    that their hits don't bear out (ungrounded). qid must tell questions apart.
    """
    q = route(queries.select("qid", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "forced", "hint"), model)
    q = written(q.withColumn("gate", F.when(F.col("text") == "", "empty_query").when(A.matches(F.col("text"), A.UNSAFE), "unsafe")), "questions")
    open_ = q.where("gate IS NULL")
    hits = written(found(index, open_.select("qid", "text", F.col("search_languages").alias("languages")), docs, dense), "found")
    asked = open_.select("qid", F.col("text").alias("query"))
    best = R.rerank(asked, hits, SELECTED).select("qid", "chunk_id", F.col("rank").cast("long").alias("place"))
    kept = written(hits.join(best, ["qid", "chunk_id"]).drop("rank").withColumnRenamed("place", "rank"), "selected")
    judged = R.refusals(asked, kept, RELEVANT)
    top = kept.where("rank = 1").select("qid", F.col("parent_text").alias("top"))
    said = asked.withColumnRenamed("query", "question").join(top, "qid", "left").join(A.passages(kept), "qid", "left")
    said = A.answered(said, mode, generate)
    proof = A.verify(said, kept)
    sources = kept.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("sources"))
    counts = hits.groupBy("qid").agg(F.count("*").alias("candidates"))
    out = (
        q.join(judged, "qid", "left").join(said.drop("answer").withColumnRenamed("mode", "used"), "qid", "left").join(proof, "qid", "left")
        .join(sources, "qid", "left").join(counts, "qid", "left")
    )
    no = F.coalesce("refused", F.lit(True))
    none = F.array().cast("array<string>")
    reason = F.when(F.col("gate").isNotNull(), F.col("gate")).when(no & F.col("romanized"), "romanized_input").when(no, "low_confidence").when(~F.col("grounded"), "ungrounded")
    told = (
        F.when(F.col("gate") == "unsafe", UNSAFE_ANSWER).when(F.col("gate").isNotNull(), A.REFUSAL).when(no & F.col("romanized"), ROMANIZED_ANSWER)
        .when(no, A.REFUSAL).otherwise(F.col("answer"))
    )
    listed = F.coalesce("sources", none)
    return out.select(
        "qid", F.col("text").alias("query"), told.alias("answer"), (reason.isNull() & F.col("grounded")).alias("grounded"), reason.isNotNull().alias("refused"),
        reason.alias("refusal_reason"), F.when(reason.isNull() | (reason == "ungrounded"), F.col("used")).otherwise(mode).alias("mode"),
        F.lit("sparse" if dense is None else "hybrid").alias("retrieval_mode"), F.array_join(F.array_sort("languages"), ",").alias("query_language"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), F.size(listed).alias("selected"),
        F.round(F.when(F.col("gate").isNotNull(), 0.0).when(no, F.coalesce("confidence", F.lit(0.0))).otherwise(F.greatest(F.coalesce("confidence", F.lit(0.0)), "overlap")), 4).alias("confidence"),
        F.when(no, F.slice(listed, 1, 3)).otherwise(listed).alias("sources"), F.when(reason.isNull(), F.col("error")).alias("error"),
    )


def retrieve(index: Index, docs: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, k: int = SELECTED, dense: DataFrame | None = None, chunk_type: str | None = None) -> DataFrame:
    """The ``k`` hits of each of ``queries`` (qid, text, languages) as they are shown: by words, or with ``dense`` hits fused.

    Blank questions are an error of their asker: they have no hits. Where hits are fused, twice ``k`` candidates of either
    side take part, twenty at least. ``chunk_type`` keeps chunks of that kind before any cut, so
    ``k`` of them are found if there are as many; one of several kinds (``a+b``) is of each.
    """
    most = max(2 * k, CANDIDATES)
    hits = found(index, queries.where("trim(coalesce(text, '')) <> ''"), docs, dense, most, chunk_type)
    return response(first_ranked(hits, k))


def first_ranked(hits: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The first ``k`` hits of each question, ranked anew after a filter."""
    w = Window.partitionBy("qid").orderBy("rank", key)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
