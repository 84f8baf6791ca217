"""Reranking of hits, how far hits cover a question, and refusal; expansion of questions to other scripts.

Words are compared by sound in a blocked join over distinct words; only the last rule of that comparison, a matching
ratio, is an Arrow-batched function, on distinct pairs of words. All else are expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import translit as X
from marlstone.operators import answers as A
from marlstone.shared import written

#: Words of questions in the languages served that name nothing.
STOP = A.CONTENT_STOP + (
    "कहाँ कहा क्या कौन कैसे क्यों है हैं का की के में से और ने को कुत्र अस्ति आहे कुठे छे কোথায় কত আছে একটি এবং எங்கே என்ன உள்ளது ஒரு "
    "ఎక్కడ ఉంది ఒక ಎಲ್ಲಿದೆ ಇದೆ ಒಂದು എവിടെയാണ് ആണ് ഒരു ક્યાં કયાં છે એક کہاں ہے ایک छ हो କେଉଁଠି ଅଛି ଏକ ਕਿੱਥੇ ਹੈ ਇੱਕ"
).split()
#: Fixed value: the guard's list has one word more than the reranker's; grounding has a list of its own.
GUARD_STOP = [*STOP, "کيٿے"]
SOUNDS, GUARD_SOUNDS = (sorted({X.folded(X.romanized(w)) for w in words} - {""}) for words in (STOP, GUARD_STOP))
_PROPER = r"\b[A-Z][A-Za-z]{2,}\b"


def content(c: Column, guard: bool = False) -> Column:
    """Distinct tokens of two characters or more that are no stop words, of the reranker or the guard, by spelling or by sound."""
    return F.filter(F.array_distinct(T.tokens(c)), lambda t: _is_content(t, guard))


def _is_content(word: Column, guard: bool) -> Column:
    stop, sounds = (GUARD_STOP, GUARD_SOUNDS) if guard else (STOP, SOUNDS)
    return (F.length(word) > 1) & ~word.isin(*stop) & ~X.fold(X.romanize(word)).isin(*sounds)


def sounding(asks: DataFrame, texts: DataFrame, guard: bool = False) -> DataFrame:
    """(key, word): the words of ``asks`` (key, word) that sound like a content word of the text under the same key.

    ``texts`` (key, words) has each key once, with its distinct tokens. A blocked join: a word meets words of its text by
    the first letters it may be spelt with, an equal key; rules on skeletons settle most of the pairs there, and each
    distinct pair of Latin forms that only a matching ratio can settle is scored once, in whatever texts it stands. Stop words and Latin forms are worked out once for each
    distinct word. Null or empty words sound like nothing.
    """
    asks = asks.where("word IS NOT NULL").distinct()
    form = lambda name: [X.romanize(F.col("word")).alias(name), X.skeleton(X.romanize(F.col("word"))).alias(f"{name}_bones")]
    forms = written(asks.select("word").distinct().select("word", *form("roman")).where("length(roman) >= 3"), "forms")
    letters = F.array_distinct(F.array(F.substring("roman", 1, 1), F.substring("roman_bones", 1, 1)))
    forms = forms.select("*", F.explode(F.filter(letters, lambda x: x != "")).alias("letter"))
    said = texts.join(asks.select("key").distinct(), "key", "left_semi").select("key", F.explode("words").alias("word"))
    vocabulary = said.select("word").distinct().where(_is_content(F.col("word"), guard)).select("word", *form("heard"))
    vocabulary = written(vocabulary.where("heard <> ''").withColumn("letter", F.substring("heard", 1, 1)), "vocabulary")
    said = said.join(vocabulary, "word").select("key", "heard", "heard_bones", "letter").distinct()
    met = asks.join(forms, "word").join(said, ["key", "letter"]).select("key", "word", "roman", "heard", *[c.alias(n) for c, n in zip(X.may_sound("roman", "heard"), ("sure", "open"), strict=True)])
    met = written(met.where("sure OR open").select("key", "word", "roman", "heard", "sure"), "met")
    n = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes that stand for much work, kept in many tasks
    alike = met.where("NOT sure").select("roman", "heard").repartition(n, "roman", "heard").distinct().where(X.fuzzy_score("roman", "heard") > 0)
    return met.where("sure").select("key", "word").unionByName(met.where("NOT sure").join(alike, ["roman", "heard"], "left_semi").select("key", "word")).distinct()


def _count_heard(pairs: DataFrame, guard: bool = False, **of: tuple[Column, str]) -> DataFrame:
    """``pairs`` (_id, ...) with a column for each name in ``of``, (missing, words): how many of a row's ``missing`` words
    sound like one of those in the column ``words``. All are looked up in one join."""
    of_key = lambda i: (F.col("_id") * len(of) + i).alias("key")
    asks = texts = None
    for i, (missing, words) in enumerate(of.values()):
        tried = pairs.where(F.size(words) > 0)
        ask, text = tried.select(of_key(i), F.explode(missing).alias("word")), tried.select(of_key(i), F.col(words).alias("words"))
        asks, texts = (ask, text) if asks is None else (asks.unionByName(ask), texts.unionByName(text))
    n = sounding(asks, texts, guard).groupBy(F.expr(f"key div {len(of)}").alias("_id")).agg(
        *[F.count_if(F.col("key") % len(of) == i).alias(name) for i, name in enumerate(of)])
    return pairs.join(n, "_id", "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in of})


def skeleton_overlap(q: Column, s: Column) -> Column:
    """Share of the distinct skeletons (three letters or more) of the words ``q`` that one of ``s`` equals or extends."""
    bones = lambda w: F.array_distinct(F.filter(F.transform(w, lambda t: X.skeleton(X.romanize(t))), lambda b: F.length(b) >= 3))

    def root(a: Column, b: Column) -> Column:
        gap = F.abs(F.length(a) - F.length(b))
        return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (gap <= 3) & (F.startswith(a, b) | F.startswith(b, a)))

    both = F.struct(bones(q).alias("q"), bones(s).alias("s"))
    share = lambda v: F.when((F.size(v["q"]) > 0) & (F.size(v["s"]) > 0), F.size(F.filter(v["q"], lambda a: F.exists(v["s"], lambda b: root(a, b)))) / F.size(v["q"])).otherwise(0.0)
    return F.transform(F.array(both), share)[0]


def hit_key() -> Column:
    """Hits of one parent passage share a key; null for hits without any text or id."""
    shown = F.coalesce(F.nullif(F.col("parent_text"), F.lit("")), F.col("text"), F.lit(""))
    blank = ~shown.rlike(r"(?U)\S")
    return F.when(blank, F.nullif(F.col("chunk_id").cast("string"), F.lit(""))).otherwise(F.substring(T.text_hash(shown), 1, 16))


def first_hits(hits: DataFrame) -> DataFrame:
    """Hits (qid, rank, chunk_id, text, parent_text, ...), the best-ranked of each parent passage."""
    w = Window.partitionBy("qid", "_key").orderBy("rank", "chunk_id")
    keyed = hits.withColumn("_key", hit_key()).where("_key IS NOT NULL")
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def _with_words(queries: DataFrame, hits: DataFrame, how: str, guard: bool = False) -> DataFrame:
    """Hits beside their questions: _id, the question's content words _q and scripts _qs, the distinct tokens _t of text and
    parent (cut once where they are the same), the source question's content words _s, the scripts used in the text.

    A token that equals a content word is one itself, so shares of words met need no stop list on the text's side.
    """
    q = queries.select("qid", "query", content(F.col("query"), guard).alias("_q"), X.scripts(F.col("query")).alias("_qs"))
    text, parent = F.coalesce("text", F.lit("")), F.coalesce("parent_text", F.lit(""))
    both = F.when(text == parent, text).otherwise(F.concat(text, F.lit(" "), parent))
    p = q.join(hits, "qid", how).withColumns({"_both": both, "_t": F.array_distinct(T.tokens(both)), "_scripts": X.scripts(both)})
    of = F.when(F.col("source_query").isNull(), F.array().cast("array<string>")).otherwise(content(F.col("source_query"), guard))
    return written(p.withColumns({"_s": of, "_id": F.monotonically_increasing_id()}), "pairs")


def rerank(queries: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best hits of each question as (qid, chunk_id, rerank_score, rank).

    ``queries``: qid, query. ``hits``: qid, rank, chunk_id, text, parent_text, orig_score, rrf_score, source_query. The
    score adds the share of question words met (by sound too where scripts differ), 0.2 of an original score up to
    1.5, 0.15 of the fused score, 1.25 of the share of capitalised words met, and 1 for the same words as the source
    question or else 1.6 of their overlap by skeleton. Ties stand as they were ranked.
    """
    p = _with_words(queries, first_hits(hits), "inner")
    mixed = X.is_mixed_script(F.col("query")) | (F.size(F.array_except("_scripts", "_qs")) > 0)
    # only words that could be spelt in another of the text's scripts are tried
    own = lambda w: F.get(X.scripts(F.substring(w, 1, 1)), F.lit(0))
    other = lambda w: w.rlike(r"^\p{ASCII}*$") | own(w).isNull() | ~F.array_contains("_scripts", own(w))
    missing = F.when(mixed & (F.size("_scripts") > 0), F.filter(F.array_except("_q", "_t"), other))
    p = _count_heard(p, _more=(missing, "_t"))
    n = F.size("_q")
    met = F.when(n > 0, (F.size(F.array_intersect("_q", "_t")) + F.col("_more")) / n).otherwise(0.0)
    orig = F.coalesce(F.col("orig_score").cast("double"), F.lit(0.0))
    proper = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(_PROPER), F.lit(0)), F.lower))
    p = p.withColumn("_p", proper).withColumn("_low", F.lower("_both"))
    named = F.when(F.size("_p") > 0, F.size(F.filter("_p", lambda w: F.contains(F.col("_low"), w))) / F.size("_p")).otherwise(0.0)
    same = (n > 0) & (F.array_sort("_q") == F.array_sort("_s"))
    score = (
        met + F.when((orig > 0) & (orig <= 1.5), 0.2 * orig).otherwise(0.0) + 0.15 * F.coalesce(F.col("rrf_score"), F.lit(0.0))
        + 1.25 * named + F.when(same, 1.0).otherwise(1.6 * skeleton_overlap(F.col("_q"), F.col("_s")))
    )
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "_was", "chunk_id")
    p = p.select("qid", "chunk_id", F.col("rank").alias("_was"), F.round(score, 8).alias("rerank_score"))
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_was")


def roman_vocabulary(terms: DataFrame, once: bool = False) -> DataFrame:
    """(native, roman, skeleton, script) of the distinct terms (term) beyond ASCII with a Latin form of three letters or more;
    with ``once`` the terms are known to be distinct."""
    t = terms.where(~F.col("term").rlike(r"^\p{ASCII}*$")).select(F.col("term").alias("native"))
    t = t if once else t.distinct()
    forms = F.transform(F.array(X.romanize(F.col("native"))), lambda r: F.struct(r.alias("roman"), X.skeleton(r).alias("skeleton")))
    t = t.select("native", F.inline(forms)).where("length(roman) >= 3 AND skeleton <> ''")  # forms are worked out once
    return t.withColumn("script", F.get(X.scripts(F.substring("native", 1, 1)), 0))


def expand(queries: DataFrame, vocabulary: DataFrame, limit: int = 8) -> DataFrame:
    """(qid, term): words of other scripts that spell a question's words; the ``limit`` closest of each question.

    ``queries``: qid, text and, if languages are wanted, wanted_scripts (array of first code points). Latin words are
    looked up only in questions that have another script too, or that want one; other words only where a wanted script
    isn't in the question. The lookup is an equal-key join on skeletons.
    """
    q = queries.select("qid", "text", *(["wanted_scripts"] if "wanted_scripts" in queries.columns else [F.array().cast("array<int>").alias("wanted_scripts")]))
    q = q.withColumn("_in", X.scripts(F.col("text")))
    q = q.withColumn("_foreign", F.size(F.array_except("wanted_scripts", "_in")) > 0)
    w = q.select("qid", "_in", "_foreign", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    latin, ascii_ = F.col("word").rlike("^[a-z]+$"), F.col("word").rlike(r"^\p{ASCII}*$")
    w = w.where((F.length("word") >= 3) & ((latin & (F.size("_in") > 0)) | (~ascii_ & F.col("_foreign"))))
    w = w.withColumn("wr", X.romanize(F.col("word"))).withColumn("own", F.get(X.scripts(F.substring("word", 1, 1)), 0))
    w = w.select("qid", "wr", "own", X.skeleton(F.col("wr")).alias("ws"), F.explode(X.related_skeletons(F.col("wr"))).alias("skeleton"))
    m = w.join(vocabulary, "skeleton").where("own IS NULL OR script IS NULL OR own <> script")
    a, b = F.length("wr"), F.length("roman")
    m = m.where((F.greatest(a, b) <= 2 * F.least(a, b)) & (F.abs(a - b) <= 3))
    close = F.when(F.col("wr") == F.col("roman"), 1.0).when(F.col("ws") == F.col("skeleton"), 0.95).when(F.substring("wr", 1, 1) == F.substring("roman", 1, 1), 0.9)
    best = m.withColumn("close", close).where("close IS NOT NULL").groupBy("qid", "native").agg(F.max("close").alias("close"), F.max(b).alias("n"))
    order = Window.partitionBy("qid").orderBy(F.col("close").desc(), F.col("n").desc(), "native")
    return best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).select("qid", F.col("native").alias("term"))


def cover(queries: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(qid, n_words, coverage, related, same) over each question's first ``k`` hits.

    coverage: largest share of the question's content words that a hit's text, parent or source question has, by sound
    too; related: the same against the source question alone; same: whether a source question has the same words.
    """
    p = _with_words(queries, hits.where(F.col("rank") <= k), "left", guard=True)
    p = p.withColumns({"_all": F.array_union("_t", T.tokens(F.col("source_query"))), "_st": F.array_distinct(T.tokens(F.col("source_query")))})
    p = _count_heard(p, guard=True, _m=(F.array_except("_q", "_all"), "_all"), _r=(F.array_except("_q", "_st"), "_st"))
    n = F.size("_q")
    share = lambda other, more: F.when(n > 0, (F.size(F.array_intersect("_q", other)) + F.col(more)) / n).otherwise(0.0)
    return p.groupBy("qid").agg(
        F.max(n).alias("n_words"), F.max(share("_all", "_m")).alias("coverage"), F.max(share("_st", "_r")).alias("related"),
        F.max((n > 0) & (F.array_sort("_q") == F.array_sort("_s"))).alias("same"),
    )


def refusals(queries: DataFrame, hits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(qid, refused, confidence). Off-topic questions are refused with 0; those whose source question has the same words
    pass with 1 at least, those of more than three content words related to it by 0.3 pass; the rest need ``threshold``,
    or all words where they have three or fewer."""
    c = cover(queries, hits).join(queries.select("qid", A.matches(F.col("query"), A.OFF_TOPIC).alias("off")), "qid")
    need = F.when(F.col("n_words") <= 3, 1.0).otherwise(threshold)
    kin = (F.col("related") >= 0.3) & (F.col("n_words") > 3)
    passes = F.col("same") | kin | (F.col("coverage") >= need)
    sure = F.when(F.col("same"), F.greatest("coverage", F.lit(1.0))).when(kin, F.greatest("coverage", "related")).otherwise(F.col("coverage"))
    return c.select("qid", (F.col("off") | ~passes).alias("refused"), F.round(F.when(F.col("off"), 0.0).otherwise(sure), 6).alias("confidence"))
