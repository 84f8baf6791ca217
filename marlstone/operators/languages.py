"""Which languages a text may be in: its scripts, and n-gram models learnt from the corpus itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.shared import bounded, running_sum, written

#: ISO 639-3 codes and the shorter ones used here; scripts and the languages written in them.
ISO3 = {
    "asm": "as", "ben": "bn", "eng": "en", "gom": "kok", "guj": "gu", "hin": "hi", "kan": "kn", "kok": "kok", "mal": "ml", "mar": "mr", "nep": "ne",
    "ori": "or", "ory": "or", "pan": "pa", "san": "sa", "tam": "ta", "tel": "te", "urd": "ur",
}
SCRIPTS = (
    ("devanagari", 0x0900, 0x097F, ("hi", "mr", "ne", "sa")), ("bengali", 0x0980, 0x09FF, ("as", "bn")), ("gurmukhi", 0x0A00, 0x0A7F, ("pa",)),
    ("gujarati", 0x0A80, 0x0AFF, ("gu",)), ("odia", 0x0B00, 0x0B7F, ("or",)), ("tamil", 0x0B80, 0x0BFF, ("ta",)), ("telugu", 0x0C00, 0x0C7F, ("te",)),
    ("kannada", 0x0C80, 0x0CFF, ("kn",)), ("malayalam", 0x0D00, 0x0D7F, ("ml",)), ("arabic", 0x0600, 0x06FF, ("ur",)),
    ("arabic supplement", 0x0750, 0x077F, ("ur",)),
)
ORDERS, ALPHA, BUDGET, LEAST, LEAST_TEXT, MARGIN = (1, 2, 3), 0.5, 60_000, 400, 20, 0.25


def normalize_code(c: Column) -> Column:
    """``hin_Deva`` and ``hi-IN`` are ``hi``; null and empty are empty."""
    short = F.split(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-")), "-")[0]
    table = F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])
    return F.coalesce(F.element_at(table, short), short)


def _letters(c: Column, first: int, last: int) -> Column:
    only = F.regexp_replace(F.coalesce(c, F.lit("")), r"\P{L}", "")
    return F.length(F.regexp_replace(only, rf"[^\x{{{first:04X}}}-\x{{{last:04X}}}]", ""))


def dominant_script(c: Column) -> Column:
    """(script, letters, latin): the script other than Latin with most letters, of equals the first met; null for none."""
    text = F.coalesce(c, F.lit(""))
    each = F.array(*[
        F.struct(_letters(c, lo, hi).alias("n"), (-F.length(F.regexp_extract(text, rf"^([^\x{{{lo:04X}}}-\x{{{hi:04X}}}]*)", 1))).alias("at"), F.lit(name).alias("script"))
        for name, lo, hi, _ in SCRIPTS
    ])
    best = F.array_max(F.filter(each, lambda s: s["n"] > 0))
    return F.struct(best["script"].alias("script"), F.coalesce(best["n"], F.lit(0)).alias("letters"), _letters(c, 0, 0x024F).alias("latin"))


def script_languages(c: Column) -> Column:
    """Languages of the dominant script; English too where more letters are Latin."""
    table = F.create_map(*[x for name, _, _, langs in SCRIPTS for x in (F.lit(name), F.array(*[F.lit(v) for v in langs]))])
    none, english = F.array().cast("array<string>"), F.array(F.lit("en"))

    def of(s: Column) -> Column:
        own = F.coalesce(F.element_at(table, s["script"]), none)
        return F.when(s["script"].isNull(), F.when(s["latin"] > 0, english).otherwise(none)).otherwise(F.when(s["latin"] > s["letters"], F.concat(own, english)).otherwise(own))

    return F.transform(F.array(dominant_script(c)), of)[0]


def _profile(c: Column) -> Column:
    inner = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    return F.concat(F.lit(" "), inner, F.lit(" "))


def grams(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, order, gram, n) of the padded texts in the column ``_p``, counted before they are dealt out."""
    def cut(p: Column, n: int) -> Column:
        gram = lambda i: F.concat(*[F.get(p, i + k) for k in range(n)])
        all_ = F.transform(F.sequence(F.lit(0), F.size(p) - n), lambda i: F.struct(F.lit(n).alias("order"), gram(i).alias("gram")))
        return F.when(F.size(p) >= n, all_).otherwise(F.array().cast("array<struct<order:int,gram:string>>"))

    # characters are split once: substring() would count from the start of a long text for every gram
    each = F.transform(F.array(F.split("_p", "")), lambda p: F.concat(*[cut(p, n) for n in ORDERS]))[0]
    return df.select(*keys, F.explode(each).alias("_g")).groupBy(*keys, "_g.order", "_g.gram").agg(F.count("*").alias("n"))


def samples(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of ``docs`` (doc_id, language, text, parent_text), the parent's text preferred; blank ones go."""
    shown = F.trim(F.coalesce(F.nullif("parent_text", F.lit("")), F.col("text"), F.lit("")))
    rows = docs.select("doc_id", F.lower(F.trim("language")).alias("lang"), shown.alias("text"))
    return rows.where("lang <> '' AND text <> ''").withColumn("lang", normalize_code(F.col("lang")))


def fit(samples: DataFrame, order: str, budget: int = BUDGET) -> DataFrame:
    """(lang, order, gram, logp) from ``samples`` (lang, text, ``order``); ``gram`` null holds what unseen grams get.

    ``budget``: characters of a language that a model is fitted on, taken in order, with the text that reaches it;
    languages of fewer than 400 have no model. ``order`` tells the texts of a language apart. Running sums go over the
    texts' lengths, range-sorted; only the texts that are wanted are read after that.
    """
    size = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col(order).alias("_at"), F.length("text").alias("_n"))
    upto = running_sum(size, ["lang", "_at"], "_n", "_upto", within="lang")
    first = written(upto.where(F.col("_upto") - F.col("_n") < budget).select("lang", "_at", "_n"), "sample")
    t = samples.join(bounded(first), (samples["lang"] == first["lang"]) & (samples[order] == first["_at"])).select(samples["lang"], "text", "_n")
    enough = t.groupBy("lang").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= LEAST).select("lang")
    g = grams(t.join(F.broadcast(enough), "lang", "left_semi").withColumn("_p", _profile(F.col("text"))), "lang")
    total = g.groupBy("lang", "order").agg(F.sum("n").alias("t"), F.count("*").alias("v"))
    below = F.col("t") + ALPHA * (F.col("v") + 1)
    seen = g.join(F.broadcast(total), ["lang", "order"]).select("lang", "order", "gram", F.ln((F.col("n") + ALPHA) / below).alias("logp"))
    return seen.unionByName(total.select("lang", "order", F.lit(None).cast("string").alias("gram"), F.ln(ALPHA / below).alias("logp")))


def predict(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(qid, lang, margin) of ``texts`` (qid, text): the language of the best mean log-probability, and its lead over the
    next. Null where the padded text has fewer than 20 characters or fewer than two languages have a model; with a
    column candidates (array) only its languages count."""
    p = texts.select("qid", _profile(F.col("text")).alias("_p")).where(F.length("_p") >= LEAST_TEXT)
    g = grams(p, "qid")
    unseen = model.where("gram IS NULL").select("lang", "order", F.col("logp").alias("floor"))
    total = g.groupBy("qid", "order").agg(F.sum("n").alias("t"))
    found = g.join(model.where("gram IS NOT NULL"), ["order", "gram"]).groupBy("qid", "lang", "order").agg(F.sum(F.col("n") * F.col("logp")).alias("s"), F.sum("n").alias("m"))
    # each text meets each language's one row of an order: a few rows a text
    mean = total.join(F.broadcast(unseen), "order").join(found, ["qid", "lang", "order"], "left").select(
        "qid", "lang", ((F.coalesce("s", F.lit(0.0)) + (F.col("t") - F.coalesce("m", F.lit(0))) * F.col("floor")) / F.col("t")).alias("mean")
    )
    if "candidates" in texts.columns:
        mean = mean.join(texts.select("qid", F.explode("candidates").alias("lang")), ["qid", "lang"], "left_semi")
    score = mean.groupBy("qid", "lang").agg(F.round(F.avg("mean"), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "lang")
    top = score.withColumns({"_r": F.row_number().over(w), "_next": F.lead("score").over(w)}).where("_r = 1 AND _next IS NOT NULL")
    top = top.select("qid", "lang", (F.col("score") - F.col("_next")).alias("margin"))
    return texts.select("qid").join(top, "qid", "left")


def same_language(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(lang, total, answered, same_language) of queries (qid, lang), with the top hit's language: and over all, as null."""
    top = hits.where(F.col("rank") == 1).select("qid", F.col("lang").alias("_hit"))
    return queries.join(top, "qid", "left").rollup("lang").agg(
        F.count("*").alias("total"), F.count("_hit").alias("answered"), F.count_if(F.col("_hit") == F.col("lang")).alias("same_language"))
