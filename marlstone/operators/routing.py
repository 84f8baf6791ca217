"""Which languages a question may be searched in: by script, marker words, n-gram models, sound, and what its asker says.

All are expressions over a question's text and codes; the only join is with the margins of ``languages.predict``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import translit as X
from marlstone.operators import languages as L

WORD = r"[\p{L}\p{N}_\x{0900}-\x{0D7F}\x{0600}-\x{06FF}']+"
#: Words that tell apart the languages of one script, and letters that only one of them has.
MARKERS = {
    "hi": ("कहाँ", "कहां", "है", "हैं", "क्या", "कौन", "कब", "कैसे", "कितना", "नहीं", "और", "मैं"),
    "mr": ("कुठे", "आहे", "आहेत", "काय", "कोण", "कसे", "नाही", "आणि", "मी"),
    "ne": ("छ", "छन्", "छैन", "कस्तो", "हुन्छ", "तपाईं", "गर्नु"),
    "sa": ("अस्ति", "कुत्र", "किम्", "कथम्", "भवति", "तत्र", "यत्र", "एव"),
    "bn": ("কোথায়",),
    "as": ("ক'ত",),
}
EXCLUSIVE = {"as": ("ৰ", "ৱ")}
#: Question words of Indic languages as typed in Latin letters.
ROMANIZED = (
    "ache", "ahe", "aahe", "ala", "che", "chha", "chhe", "cha", "ekkada", "elli", "ellide", "emiti", "enge", "engey", "enna", "enthu", "evide", "hai", "hain",
    "kaha", "kahan", "kaisa", "kaise", "kan", "kaun", "kay", "keu", "kithe", "kitna", "kon", "kot", "kothay", "kouthi", "kuthe", "kya", "kyaan", "kyan", "nahi",
    "nahin", "shu", "undi", "unnadi",
)
#: Question words by which a language is known in any script, and sounds too common to decide alone.
SPOKEN = {
    "gu": ("ક્યાં", "છે", "छे", "શું", "કોણ", "કેમ", "કેટલું", "કેટલા", "નથી", "અને", "સુધી", "सुधी", "શકાય", "सकाई"),
    "hi": ("कहाँ", "कहां", "है", "हैं", "क्या", "कौन", "कैसे", "कितना", "कितने", "नहीं"),
    "mr": ("कुठे", "आहे", "आहेत", "काय", "कोण", "कसे", "नाही"),
    "ne": ("छ", "छन्", "छैन", "कस्तो", "हुन्छ"),
    "sa": ("अस्ति", "कुत्र", "किम्", "कथम्", "भवति"),
    "bn": ("কোথায়", "আছে", "কী", "কে", "কেমন"),
    "as": ("ক'ত", "আছে", "কি", "কোন"),
    "pa": ("ਕਿੱਥੇ", "ਹੈ", "ਕੀ", "ਕੌਣ", "ਕਿਵੇਂ"),
    "or": ("କେଉଁଠି", "ଅଛି", "କଣ", "କିଏ"),
    "ta": ("எங்கே", "என்ன", "உள்ளது", "யார்", "எப்படி"),
    "te": ("ఎక్కడ", "ఏమిటి", "ఉంది", "ఎవరు", "ఎలా"),
    "kn": ("ಎಲ್ಲಿ", "ಇದೆ", "ಏನು", "ಯಾರು", "ಹೇಗೆ"),
    "ml": ("എവിടെ", "എന്ത്", "ആണ്", "ആര്", "എങ്ങനെ"),
    "ur": ("کہاں", "ہے", "کیا", "کون", "کیسے"),
}
COMMON_SOUNDS = ("hai", "hain", "ki", "ke", "ka", "he", "ho", "ce", "kan", "kia", "kaise", "kise", "kaun", "kon", "kitna", "kitne", "nahi", "nhin")


def _none() -> Column:
    return F.array().cast("array<string>")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else _none()


def _with(value: Column, body) -> Column:
    """``body(value)``, with value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))


def refine(text: Column, candidates: Column, predicted: Column | None = None, margin: Column | None = None) -> Column:
    """``candidates`` narrowed to those written: by letters of one alone, else by most marker words (ties stay), else by the
    model's ``predicted`` language where its ``margin`` is 0.25 or more, else all."""
    text = F.coalesce(text, F.lit(""))
    table = F.create_map(*[x for k, v in MARKERS.items() for x in (F.lit(k), _strings(v))])
    said = words(text)
    scores = F.transform(candidates, lambda c: F.struct(F.size(F.array_intersect(F.coalesce(F.element_at(table, c), _none()), said)).alias("n"), c.alias("lang")))
    most = _with(scores, lambda s: F.struct(F.array_max(s)["n"].alias("n"), s.alias("s")))
    by_words = _with(most, lambda m: F.when(m["n"] > 0, F.transform(F.filter(m["s"], lambda x: x["n"] == m["n"]), lambda x: x["lang"])))
    out = candidates
    if predicted is not None:
        sure = (margin >= L.MARGIN) & F.array_contains(candidates, predicted)
        out = F.when(F.coalesce(sure, F.lit(False)), F.array(predicted)).otherwise(out)
    out = F.coalesce(by_words, out)
    for lang, letters in EXCLUSIVE.items():
        out = F.when(F.array_contains(candidates, lang) & text.rlike("[" + "".join(letters) + "]"), F.array(F.lit(lang))).otherwise(out)
    return F.when(F.size(candidates) < 2, candidates).otherwise(out)


def detected(text: Column, predicted: Column | None = None, margin: Column | None = None) -> Column:
    """Languages that ``text`` may be written in, sorted; empty where that can't be told."""
    family = L.script_languages(text)
    own = F.array_except(family, F.array(F.lit("en")))
    return F.when(F.size(own) == 0, family).otherwise(F.array_sort(F.array_union(refine(text, own, predicted, margin), F.array_except(family, own))))


def looks_romanized(text: Column) -> Column:
    """Whether a text without other scripts than Latin has question words of an Indic language."""
    script = L.dominant_script(text)
    return script["script"].isNull() & (script["latin"] > 0) & F.arrays_overlap(F.transform(words(text), F.lower), _strings(ROMANIZED))


def spoken(text: Column) -> Column:
    """The one language of another script whose question words the text sounds like most; else null.

    It takes a word that isn't common to many languages. Languages of the written script are left to marker words.
    """
    heard = F.array_distinct(F.filter(F.transform(words(text), lambda w: X.fold(X.romanize(w))), lambda w: w != ""))
    marks = {k: sorted({X.folded(X.romanized(w)) for w in v}) for k, v in SPOKEN.items()}
    table = F.array(*[F.struct(F.lit(k).alias("lang"), _strings(v).alias("all"), _strings([x for x in v if x not in COMMON_SOUNDS]).alias("sure")) for k, v in marks.items()])

    def hits(v: Column) -> Column:
        other = F.filter(table, lambda m: ~F.array_contains(v["family"], m["lang"]) & F.arrays_overlap(v["heard"], m["sure"]))
        return F.transform(other, lambda m: F.struct(F.size(F.array_intersect(v["heard"], m["all"])).alias("n"), m["lang"].alias("lang")))

    def winner(h: Column) -> Column:
        best = F.filter(h, lambda x: x["n"] == F.array_max(h)["n"])
        return F.when(F.size(best) == 1, F.get(best, F.lit(0))["lang"])

    return _with(F.struct(heard.alias("heard"), L.script_languages(text).alias("family")), lambda v: _with(hits(v), winner))


def _either(code: Column, written: Column) -> Column:
    """``code`` alone where the written languages have it or there are none, else both."""
    return F.when((F.size(written) == 0) | F.array_contains(written, code), F.array(code)).otherwise(F.array_sort(F.array_union(F.array(code), written)))


def resolved(text: Column, forced: Column, hint: Column, predicted: Column | None = None, margin: Column | None = None) -> Column:
    """Languages of a question for its asker, sorted: the forced one; else what it sounds like; else the hint; with those it
    is written in, where these don't have it."""
    given = F.struct(
        L.normalize_code(forced).alias("forced"), L.normalize_code(hint).alias("hint"), detected(text, predicted, margin).alias("written"),
        L.script_languages(text).alias("family"), spoken(text).alias("spoken"),
    )

    def choose(v: Column) -> Column:
        foreign = (F.size(v["family"]) > 0) & ~F.array_contains(v["family"], v["forced"])
        by_force = F.when(foreign, F.array_sort(F.array_union(F.array(v["forced"]), v["written"]))).otherwise(F.array(v["forced"]))
        by_sound = F.when(F.array_contains(v["written"], v["spoken"]), F.array(v["spoken"])).otherwise(F.array_sort(F.array_union(F.array(v["spoken"]), v["written"])))
        return F.when(v["forced"] != "", by_force).when(v["spoken"].isNotNull(), by_sound).when(v["hint"] != "", _either(v["hint"], v["written"])).otherwise(v["written"])

    return _with(given, choose)


def searched(text: Column, forced: Column, hint: Column) -> Column:
    """Languages that passages may be in, sorted: as ``resolved``, but of the written script all languages."""
    given = F.struct(L.normalize_code(forced).alias("forced"), L.normalize_code(hint).alias("hint"), F.array_sort(L.script_languages(text)).alias("family"), spoken(text).alias("spoken"))

    def choose(v: Column) -> Column:
        cross = v["spoken"].isNotNull() & (F.size(v["family"]) > 0) & ~F.array_contains(v["family"], v["spoken"])
        return (
            F.when(v["forced"] != "", _either(v["forced"], v["family"]))
            .when(cross, F.array_sort(F.array_union(F.array(v["spoken"]), v["family"])))
            .when(v["hint"] != "", _either(v["hint"], v["family"])).otherwise(v["family"])
        )

    return _with(given, choose)


def route(queries: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """``queries`` (qid, text, forced, hint) with languages (resolved), search_languages and romanized.

    With a ``model`` of languages.fit, what it says of texts whose script several languages share counts too.
    """
    predicted = margin = None
    out = queries
    if model is not None:
        asked = queries.select("qid", "text", F.array_except(L.script_languages(F.col("text")), F.array(F.lit("en"))).alias("candidates"))
        out = out.join(L.predict(asked.where("size(candidates) > 1"), model).select("qid", F.col("lang").alias("_lang"), F.col("margin").alias("_margin")), "qid", "left")
        predicted, margin = F.col("_lang"), F.col("_margin")
    text, forced, hint = F.col("text"), F.col("forced"), F.col("hint")
    return out.select(
        *queries.columns, resolved(text, forced, hint, predicted, margin).alias("languages"), searched(text, forced, hint).alias("search_languages"),
        looks_romanized(text).alias("romanized"),
    )
