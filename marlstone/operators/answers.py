"""Guards, extractive answers, grounding, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.shared import bounded, running_sum, written

#: What a refused question looks like.
UNSAFE = (
    r"\bhow to make (a )?(bomb|explosive|napalm)\b",
    r"\bkill (myself|himself|herself)\b",
    r"\bsuicide\b",
    r"\bchild (porn|sexual)\b",
    r"\bhack (into|someone)\b",
    r"\bcredit card (dump|cvv)\b",
)
OFF_TOPIC = (
    r"\bweather\b",
    r"\b(tell|say) me a joke\b",
    r"\bhow are you\b",
    r"\b(stock|crypto) price\b",
)
#: Words that don't count as evidence.
GROUNDING_STOP = "the a an is are of in to and or for that this it on with as be was were by".split()
CONTENT_STOP = GROUNDING_STOP + "what where who how when which does do did can you me please tell located".split()


def matches(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(c, F.lit("")).rlike(f"(?i){p}")
    return out


def content_words(c: Column, stop) -> Column:
    """Distinct tokens of two characters or more that aren't stop words."""
    return F.array_distinct(F.filter(T.tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(*stop)))


def overlap(answer: Column, context: Column, stop=GROUNDING_STOP) -> Column:
    """Share of the answer's content words that the context has; 0 where either has none."""
    a, c = content_words(answer, stop), content_words(context, stop)
    return F.when((F.size(a) > 0) & (F.size(c) > 0), F.size(F.array_intersect(a, c)) / F.size(a)).otherwise(0.0)


def extractive(c: Column, n: int = 2, fallback: int = 400) -> Column:
    """The first ``n`` sentences, or the first ``fallback`` characters where there are none."""
    s = T.sentences(c)
    return F.when(F.size(s) > 0, F.array_join(F.slice(s, 1, n), " ")).otherwise(F.substring(F.coalesce(c, F.lit("")), 1, fallback))


def rank_percentiles(df: DataFrame, key: str, value: str, points=(50, 70, 100)) -> DataFrame:
    """(key, p50, p70, ...): of each key's sorted values the element at place round-half-even(p/100 * (n-1)), 2 digits.

    Equal values are counted before anything is sorted, and places come from a running sum over all range-sorted counts,
    so a key with many values is spread over tasks. Null values don't count.
    """
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(key).cast("string").alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    upto = running_sum(seen, ["key", "value"], "n", "upto", within="key")
    upto = written(upto, "places")
    total = upto.groupBy("key").agg(F.sum("n").alias("total"))
    at = lambda p: F.when(F.lit(p >= 100), F.col("total") - 1).otherwise(F.bround(F.lit(p / 100) * (F.col("total") - 1)))
    here = upto.join(bounded(total), "key")
    one = lambda p: F.round(F.max(F.when((F.col("upto") > at(p)) & (F.col("upto") - F.col("n") <= at(p)), F.col("value"))), 2).alias(f"p{p}")
    return here.groupBy(F.col("key").alias(key)).agg(*map(one, points))


def stage_latencies(rows: DataFrame, points=(50, 70, 100)) -> DataFrame:
    """(stage, p50, p70, p100) of ``rows`` (latency_ms, a map of stage to milliseconds); rows without a stage don't count."""
    return rank_percentiles(rows.select(F.explode("latency_ms").alias("stage", "ms")), "stage", "ms", points)


def accumulated(spans: DataFrame) -> DataFrame:
    """(request_id, latency_ms): the milliseconds of each stage of a request added up, from ``spans`` (request_id, stage, ms)."""
    each = spans.groupBy("request_id", "stage").agg(F.round(F.sum("ms"), 2).alias("ms"))
    return each.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("latency_ms"))


REFUSAL = "I don't have enough information in the provided knowledge base to answer that."
GROUNDED, PASSAGE = 0.22, 1200


def context(hits: DataFrame) -> DataFrame:
    """(qid, context): the parent texts, or texts, of a question's ``hits`` (qid, rank, text, parent_text), by rank, in lines."""
    shown = F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text"), F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct("rank", shown.alias("t"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("context"))


def verify(answers: DataFrame, hits: DataFrame, least: float = GROUNDED) -> DataFrame:
    """(qid, grounded, overlap, answer) of ``answers`` (qid, answer) against their ``hits``.

    Blank answers and refusals are grounded, with 1. An answer with a smaller share of its words in the hits than
    ``least`` becomes the refusal. Without hits the share is 0.
    """
    a = answers.select("qid", "answer").join(context(hits), "qid", "left")
    told = T.strip(F.coalesce("answer", F.lit("")))
    free = (told == "") | (told == REFUSAL)
    a = a.withColumn("overlap", F.when(free, 1.0).otherwise(overlap(F.col("answer"), F.col("context"))))
    ok = free | (F.col("overlap") >= least)
    return a.select("qid", ok.alias("grounded"), F.round("overlap", 6).alias("overlap"), F.when(ok, F.col("answer")).otherwise(REFUSAL).alias("answer"))


def passages(hits: DataFrame, cut: int = PASSAGE) -> DataFrame:
    """(qid, passages): a question's distinct parent texts, or texts, by rank, the first ``cut`` characters of each."""
    shown = T.strip(F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text"), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("rank", shown.alias("t"))))
    told = F.array_distinct(F.filter(F.transform(rows, lambda r: r["t"]), lambda t: t != ""))
    return hits.groupBy("qid").agg(F.transform(told, lambda t: F.substring(t, 1, cut)).alias("passages"))


def prompt(question: Column, texts: Column) -> Column:
    """What a text generator is asked: the numbered passages and the question."""
    blocks = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), T.strip(t)))
    told = F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.array_join(blocks, "\n\n")).otherwise("(no passages)")
    return F.concat(F.lit("CONTEXT:\n"), told, F.lit("\n\nQUESTION:\n"), F.coalesce(question, F.lit("")), F.lit("\n"))


def answered(questions: DataFrame, mode: str = "fast", generate=None) -> DataFrame:
    """(qid, answer, mode, error) of ``questions`` (qid, question, top, passages); ``top`` is the best hit's text.

    In mode ``generative`` the hook ``generate`` (a function from prompt to answer, both columns) writes the answer;
    without a hook, or where it gives null, the first sentences of ``top`` stand, with mode fast and a note.
    """
    own = extractive(F.col("top"))
    if mode != "generative":
        return questions.select("qid", own.alias("answer"), F.lit("fast").alias("mode"), F.lit(None).cast("string").alias("error"))
    told = generate(prompt(F.col("question"), F.col("passages"))) if generate else F.lit(None).cast("string")
    q = questions.select("qid", own.alias("own"), told.alias("told"))
    return q.select(
        "qid", F.coalesce("told", "own").alias("answer"), F.when(F.col("told").isNull(), "fast").otherwise("generative").alias("mode"),
        F.when(F.col("told").isNull(), "generator_failed" if generate else "generator_unavailable").alias("error"),
    )


def recall_mrr(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(n_queries, recall, mrr) of ranked hits (qid, id, rank) against gold pairs (qid, id); queries without gold don't count."""
    best = gold.select("qid").distinct().join(hits.join(gold, ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("best")), "qid", "left")
    return best.agg(
        F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 4).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 4).alias("mrr"),
    )


def benchmark(results: DataFrame, hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: n_queries, recall, mrr (4 digits), n_adversarial, refusal_rate, of ``results`` (qid, expect_answer, refused).

    ``hits`` (qid, id, rank) are the sources given, ``gold`` (qid, id) the right ones; questions without gold count as
    missed. The refusal rate is over those that expect no answer, null without any.
    """
    asked = results.where("expect_answer").select("qid", F.lit(None).cast(gold.schema["id"].dataType).alias("id"))
    found = recall_mrr(hits.join(results.where("expect_answer").select("qid"), "qid", "left_semi"), gold.join(asked.select("qid"), "qid", "left_semi").unionByName(asked), k)
    refused = results.where("NOT expect_answer").agg(F.count("*").alias("n_adversarial"), F.round(F.avg(F.col("refused").cast("double")), 4).alias("refusal_rate"))
    return found.crossJoin(refused)  # one row each


def query_set(records: DataFrame, curated: DataFrame, order: str = "query_id", skip: int = 8000, held_out: int = 180) -> DataFrame:
    """(qid, query, language, gold, kind, expect_answer): the questions an index is judged by.

    ``curated`` (query_id, query, eng_query, language) gives its English question and then its own; ``records`` (the
    same) gives ``held_out`` of them, in ``order``, after the first ``skip``: the size asked of the sample; and four
    adversarial ones expect no answer.
    """
    texts = lambda c: F.nullif(F.col(c), F.lit(""))
    both = F.array(F.struct(texts("eng_query").alias("query"), F.lit("en").alias("language")), F.struct(texts("query").alias("query"), F.col("language")))
    first = curated.select("query_id", F.posexplode(both).alias("i", "q")).where("q.query IS NOT NULL").select(
        F.concat(F.lit("b"), F.col("query_id").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("qid"), "q.query", "q.language", F.col("query_id").cast("string").alias("gold"),
        F.lit("curated").alias("kind"), F.lit(True).alias("expect_answer"),
    )
    at = running_sum(records.select(F.col(order).alias("_at")).withColumn("_one", F.lit(1)), ["_at"], "_one", "_nth")
    some = written(at.where((F.col("_nth") > skip) & (F.col("_nth") <= skip + held_out)).select("_at"), "held-out")
    later = records.join(F.broadcast(some), records[order] == some["_at"], "left_semi").select(  # held_out rows at most
        F.concat(F.lit("h"), F.col("query_id").cast("string")).alias("qid"), F.coalesce(texts("query"), F.col("eng_query")).alias("query"), "language",
        F.col("query_id").cast("string").alias("gold"), F.lit("held_out").alias("kind"), F.lit(True).alias("expect_answer"),
    )
    spark = records.sparkSession
    bad = spark.createDataFrame([(f"a{i}", q, "en", None, "adversarial", False) for i, q in enumerate(ADVERSARIAL)], later.schema)
    return first.unionByName(later).unionByName(bad)


#: Questions that expect no answer.
ADVERSARIAL = ("What's the weather in Goa today?", "Tell me a joke.", "Who won the 2026 cricket world cup?", "How to make a bomb")
