"""License scans: phrases that stand in a text, and an exact set-similarity join of text blocks with license templates.

A block is a window of words, twice the longest template long and started every such length, so whatever a template's
length of words holds lies whole in one. The join is the prefix-filter join for containment. Template tokens are ranked
by the number of texts that hold them, rarest first. A block that holds the share t of a template's n tokens lacks
n - ceil(t n) at most, so it holds one of the first n - ceil(t n) + 1: only these are looked up. The length filter asks
for blocks of ceil(t n) distinct template tokens or more. The positional filter adds to what may still match: after the
first common token, at place i of the template and j of the block (in the same order), no more than min(n - i, m - j)
tokens can follow. Pairs that stay are verified on whole token sets.

Every text is cut into words once, for its number of words and the vocabulary words it holds (those of templates and
phrases). Places are looked for only in texts that hold all words of a phrase, or a prefix token and the needed number
of tokens of a template: any other text has neither. All of it is DataFrame functions, and no pair of blocks is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bind, bounded, lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Base phrases and the label each stands for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Opening sentences of common licenses and notices, and the labels the join adds.
TEMPLATES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("either version 2 of the license or at your option any later version", "gpl-2.0-or-later"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, token): the distinct words of each template."""
    rows = [(i, label, w) for i, (text, label) in enumerate(templates) for w in dict.fromkeys(text.lower().split())]
    return spark.createDataFrame(rows, "template int, label string, token string")


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, in order."""
    return F.array_remove(F.split(lower_ascii(text), GAP), "")


def read_once(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, text_key, n_words, have) of each row of ``docs``; ``have``: the distinct words of ``vocabulary`` it holds."""
    cut = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), words(F.col("text")).alias("ws"))
    return cut.select("doc_id", "text_key", F.size("ws").cast("long").alias("n_words"), F.array_intersect("ws", F.array(*map(F.lit, vocabulary))).alias("have"))


def ranked_templates(rows: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(template, label, token, seen, place, n, need): tokens in global order, those that the fewest ``rows`` (have) hold first."""
    count = rows.select(F.explode_outer("have").alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    t = templates.join(bounded(written(count, "frequencies")), "token", "left")
    order = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("token").alias("token"))
    sets = t.groupBy("template", "label").agg(F.array_sort(F.collect_list(order)).alias("tokens"))
    return sets.select(
        "template", "label", F.posexplode("tokens").alias("place", "t"), F.size("tokens").alias("n"), F.ceil(threshold * F.size("tokens") - 1e-9).cast("int").alias("need")
    ).select("template", "label", F.col("t.token").alias("token"), F.col("t.seen").alias("seen"), "place", "n", "need")


def candidate_texts(rows: DataFrame, ranked: list, phrases) -> DataFrame:
    """The distinct text_key of ``rows`` that may hold a phrase or a template; ``ranked`` are the rows of ranked templates."""
    have, may = F.col("have"), F.lit(False)
    for phrase, _ in phrases:
        own = list(dict.fromkeys(phrase.split()))
        may = may | (F.size(F.array_intersect("have", F.array(*map(F.lit, own)))) == len(own))
    for k in sorted({r["template"] for r in ranked}):
        own = [r for r in ranked if r["template"] == k]
        n, need = own[0]["n"], own[0]["need"]
        prefix = [r["token"] for r in own if r["place"] < n - need + 1]
        may = may | (F.arrays_overlap(have, F.array(*map(F.lit, prefix))) & (F.size(F.array_intersect(have, F.array(*[F.lit(r["token"]) for r in own]))) >= need))
    return rows.where(may).select("text_key").distinct()


def block_matches(places: DataFrame, ranked: DataFrame, block_words: int) -> DataFrame:
    """(text_key, block, template, label, score) of every block that holds the needed share of a template.

    ``places`` has (text_key, pos, token) of vocabulary words. A template's places are the shortest runs of words that
    hold all it has in the block. It is left out only where each of them lies inside a place of a template the block
    holds a larger share of, or as large a share and more tokens; so it doesn't stand beside one that contains it.
    """
    prefix = ranked.where(F.col("place") < F.col("n") - F.col("need") + 1)
    nth = F.floor(F.col("pos") / (block_words // 2))
    at = places.join(bounded(ranked.select("token", "seen").distinct()), "token")
    at = at.select("text_key", "pos", F.struct("seen", "token").alias("t"), F.explode(F.array(nth, nth - 1)).alias("block")).where("block >= 0")
    blocks = at.groupBy("text_key", "block").agg(
        F.array_sort(F.collect_set("t")).alias("tokens"), F.array_sort(F.collect_list(F.struct("pos", F.col("t.token").alias("token")))).alias("words")
    )
    lookup = bounded(prefix.select("token", "template", "place", "n", "need"))
    probe = blocks.select("text_key", "block", "tokens", "words", F.size("tokens").alias("m"), F.posexplode_outer("tokens").alias("j", "x")).withColumn("token", F.col("x.token"))
    fits = (F.col("m") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("place") - 1, F.col("m") - F.col("j") - 1) >= F.col("need"))
    met = probe.join(lookup, "token")
    # the first common token decides: later ones repeat the pair with a weaker bound
    met = met.groupBy("text_key", "block", "template").agg(F.max(fits).alias("fits"), F.first("tokens").alias("tokens"), F.first("words").alias("words")).where("fits")
    sets = bounded(ranked.groupBy("template", "label").agg(F.collect_set("token").alias("set"), F.max("n").alias("n"), F.max("need").alias("need")))
    own = F.array_intersect(F.col("tokens.token"), F.col("set"))
    got = met.join(sets, "template").select("text_key", "block", "template", "label", "words", own.alias("own"), "n", "need").where("size(own) >= need")
    x = F.struct((F.size("own") / F.col("n")).alias("score"), F.size("own").alias("same"))
    got = got.select("text_key", "block", F.struct("template", "label", x.alias("x"), _places().alias("places")).alias("y"))
    got = got.groupBy("text_key", "block").agg(F.collect_list("y").alias("all"))
    inside = "exists(all, z -> z.x > y.x AND exists(z.places, v -> v.lo <= w.lo AND v.hi >= w.hi))"
    kept = got.select("text_key", "block", F.expr(f"filter(all, y -> exists(y.places, w -> NOT {inside}))").alias("kept"))
    return kept.select("text_key", "block", F.explode("kept").alias("y")).select("text_key", "block", "y.template", "y.label", "y.x.score")


def _places() -> Column:
    """(lo, hi) of each run of ``words`` (pos, token; by pos) that holds all tokens ``own`` and no shorter run that does."""
    first = "array_min(transform(filter(words, w -> w.pos >= a.pos AND w.token = t), w -> w.pos))"
    runs = F.expr(
        f"transform(filter(words, w -> array_contains(own, w.token)), a -> struct(a.pos AS lo, transform(own, t -> {first}) AS at))"
    )
    whole = bind(runs, lambda r: F.transform(
        F.filter(r, lambda f: ~F.exists(f["at"], lambda p: p.isNull())), lambda f: F.struct(f["lo"].alias("lo"), F.array_max(f["at"]).alias("hi"))
    ))
    return bind(whole, lambda r: F.filter(r, lambda w: ~F.exists(r, lambda v: (v["hi"] == w["hi"]) & (v["lo"] > w["lo"]))))


def phrase_starts(places: DataFrame, phrases) -> DataFrame:
    """(text_key, at, base): ascending starts, from 0, where a phrase's words stand consecutively, and the labels."""
    spark = places.sparkSession
    table = [(w, k, nth, len(p.split()), label) for k, (p, label) in enumerate(phrases) for nth, w in enumerate(p.split())]
    own = F.broadcast(spark.createDataFrame(table, "token string, phrase int, nth int, size int, base string"))  # the phrases: a parameter
    runs = places.join(own, "token").groupBy("text_key", (F.col("pos") - F.col("nth")).alias("at"), "phrase", "size", "base").count().where("count = size")
    return runs.groupBy("text_key").agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.collect_set("base")).alias("base"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, template_score.

    A-Z are lower-cased; null texts are empty. Without a phrase first_word and last_word are null and base_labels is
    empty. ``template_score`` is the largest share of a template that a block of the text holds, 0 below the threshold;
    ``score`` is the same, but 1 with a base phrase. Repeated rows each come back; other columns are not used. An empty
    table gives an empty result; a text of any length is one row's words, no block of it meets another.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for text, _ in [*phrases, *templates] for w in text.lower().split()})
    rows = written(read_once(docs, vocabulary), "read")
    longest = max((len(text.split()) for text, _ in templates), default=1)
    ranked = written(ranked_templates(rows, template_table(spark, templates), threshold), "ranked")
    wanted = bounded(written(candidate_texts(rows, ranked.collect(), phrases), "candidates"))  # ranked: the templates, a parameter
    texts = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text").join(wanted, "text_key", "left_semi")
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "token string"))
    places = texts.select("text_key", F.posexplode_outer(words(F.col("text"))).alias("pos", "token")).join(known, "token").distinct()
    places = written(places, "places")
    found = block_matches(places, ranked, 2 * longest).groupBy("text_key").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    found = written(phrase_starts(places, phrases).join(found, "text_key", "full"), "found")

    none = F.array().cast("array<string>")
    out = rows.join(bounded(found), "text_key", "left").withColumn("base", F.coalesce("base", none))
    best = F.coalesce("best", F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"), best.alias("template_score"),
    )


def op6_license(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql(phrases=PHRASES, templates=TEMPLATES) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    here = lambda p: " AND ".join(f"ws[i + {k + 1}] = {quoted(w)}" for k, w in enumerate(p.split()))
    step = max(len(t.split()) for t, _ in templates)
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base
      FROM (SELECT doc_id, i, CASE {" ".join(f"WHEN {here(p)} THEN {quoted(label)}" for p, label in phrases)} END AS label FROM p)
      WHERE label IS NOT NULL GROUP BY doc_id),
tpl(template, label, txt) AS (VALUES {", ".join(f"({i}, {quoted(label)}, {quoted(t)})" for i, (t, label) in enumerate(templates))}),
tok AS (SELECT DISTINCT template, label, unnest(string_split(txt, ' ')) AS token FROM tpl),
tn AS (SELECT template, count(*) AS n FROM tok GROUP BY template),
h AS (SELECT doc_id, template, label, token, i, unnest([i // {step}, i // {step} - 1]) AS block FROM p JOIN tok ON token = ws[i + 1]),
c AS (SELECT doc_id, block, template, label, count(DISTINCT token) AS same, count(DISTINCT token) / n AS score FROM h JOIN tn USING (template) WHERE block >= 0
      GROUP BY doc_id, block, template, label, n HAVING count(DISTINCT token) >= ceil({THRESHOLD}::DOUBLE * n - 1e-9)),
g AS (SELECT h.doc_id, h.block, h.template, h.token, h.i FROM h JOIN c USING (doc_id, block, template)),
nx AS (SELECT x.doc_id, x.block, x.template, x.i AS lo, y.token, min(y.i) AS i FROM g x JOIN g y USING (doc_id, block, template) WHERE y.i >= x.i GROUP BY ALL),
r AS (SELECT doc_id, block, template, hi, max(lo) AS lo FROM (
        SELECT nx.doc_id, nx.block, nx.template, lo, max(i) AS hi FROM nx JOIN c USING (doc_id, block, template) GROUP BY ALL HAVING count(*) = any_value(same))
      GROUP BY ALL),
pl AS (SELECT r.*, label, score, same FROM r JOIN c USING (doc_id, block, template)),
k AS (SELECT DISTINCT a.doc_id, a.label, a.score FROM pl a WHERE NOT EXISTS (
        SELECT 1 FROM pl o WHERE o.doc_id = a.doc_id AND o.block = a.block AND o.lo <= a.lo AND o.hi >= a.hi
        AND (o.score > a.score OR o.score = a.score AND o.same > a.same))),
m AS (SELECT doc_id, list(DISTINCT label) AS found, max(score) AS best FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score, coalesce(best, 0.0::DOUBLE) AS template_score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


OP6_SQL = _sql()
