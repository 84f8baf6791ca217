"""Codes, scripts and n-gram models against a plain computation."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import languages as L


def test_codes_and_scripts(spark):
    df = spark.createDataFrame([("hin_Deva",), ("EN-us",), ("bn",), (None,), ("xx",)], "c string")
    assert [r[0] for r in df.select(L.normalize_code(F.col("c"))).collect()] == ["hi", "en", "bn", "", "xx"]
    df = spark.createDataFrame([("गोवा कहाँ है",), ("Goa કયાં છે",), ("Where is ગોવા located",), ("where",), ("১২ !",), (None,), ("گوا کہاں ہے",)], "t string")
    got = [r[0] for r in df.select(L.script_languages(F.col("t"))).collect()]
    assert got == [["hi", "mr", "ne", "sa"], ["gu"], ["gu", "en"], ["en"], [], [], ["ur"]]


def test_model(spark):
    lines = {"a": ["the cat sat on the mat by the door of the house " * 9, "and then it slept"], "b": ["der hund lag an der wand vor dem haus im dorf " * 10], "c": ["too short"]}
    rows = [(k, t, n) for k, ts in lines.items() for n, t in enumerate(ts)]
    model = L.fit(spark.createDataFrame(rows, "lang string, text string, n int"), "n")
    got = {(r.lang, r.order, r.gram): r.logp for r in model.collect()}
    assert {k[0] for k in got} == {"a", "b"}
    pad = lambda t: f" {' '.join(t.lower().split())} "
    want = {}
    for k in "ab":
        for n in L.ORDERS:
            c = Counter(p[i : i + n] for p in map(pad, lines[k]) for i in range(len(p) - n + 1))
            below = sum(c.values()) + 0.5 * (len(c) + 1)
            want |= {(k, n, g): math.log((x + 0.5) / below) for g, x in c.items()} | {(k, n, None): math.log(0.5 / below)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    texts = spark.createDataFrame([(1, "The cat slept on the house"), (2, "der Hund vor dem Haus"), (3, "cat"), (4, None)], "qid int, text string")
    out = {r.qid: r for r in L.predict(texts, model).collect()}
    assert out[1].lang == "a" and out[2].lang == "b" and out[3].lang is None and out[4].lang is None

    def score(t, k):
        p = pad(t)
        return sum(sum(want.get((k, n, p[i : i + n]), want[k, n, None]) for i in range(len(p) - n + 1)) / (len(p) - n + 1) for n in L.ORDERS) / 3

    assert out[1].margin == pytest.approx(score("The cat slept on the house", "a") - score("The cat slept on the house", "b"), abs=1e-6)
    assert all(r.lang is None for r in L.predict(texts, model.where("lang = 'a'")).collect())


def test_same_language(spark):
    q = spark.createDataFrame([(1, "hi"), (2, "hi"), (3, "bn")], "qid int, lang string")
    h = spark.createDataFrame([(1, 1, "hi"), (1, 2, "bn"), (2, 1, "bn")], "qid int, rank int, lang string")
    got = {r.lang: tuple(r)[1:] for r in L.same_language(q, h).collect()}
    assert got == {"hi": (2, 2, 1), "bn": (1, 0, 0), None: (3, 2, 1)}


#: Questions, what their asker forced and what was heard, and the languages they resolve to and are searched in.
ROUTES = (
    ("Where is Goa located?", None, None, "en", "en", False), ("गोवा कहाँ है?", None, None, "hi", "hi,mr,ne,sa", False), ("गोवा कुठे आहे?", None, None, "mr", "hi,mr,ne,sa", False),
    ("गोवा कुत्र अस्ति?", None, None, "sa", "hi,mr,ne,sa", False), ("গোয়া কোথায়?", None, None, "bn", "as,bn", False), ("গোৱা ক'ত আছে?", None, None, "as", "as,bn", False),
    ("ગોવા ક્યાં છે?", None, None, "gu", "gu", False), ("ಗೋವಾ ಎಲ್ಲಿದೆ?", None, None, "kn", "kn", False), ("ഗോവ എവിടെയാണ്?", None, None, "ml", "ml", False),
    ("ଗୋଆ କେଉଁଠି ଅଛି?", None, None, "or", "or", False), ("ਗੋਆ ਕਿੱਥੇ ਹੈ?", None, None, "pa", "pa", False), ("கோவா எங்கே உள்ளது?", None, None, "ta", "ta", False),
    ("గోవా ఎక్కడ ఉంది?", None, None, "te", "te", False), ("گوا کہاں ہے؟", None, None, "ur", "ur", False), ("गोवा कहाँ है?", "mr", None, "mr", "mr", False),
    ("गोवा कहाँ है?", "gu", None, "gu,hi", "gu,hi,mr,ne,sa", False), ("ગોવા ક્યાં છે?", "gu", None, "gu", "gu", False), ("गोवा", None, "mar", "mr", "mr", False),
    ("गोवा", None, "ne", "ne", "ne", False), ("गोवा", None, None, "hi,mr,ne,sa", "hi,mr,ne,sa", False), ("Where is Goa located?", None, "ta", "en,ta", "en,ta", False),
    ("एन्जाइना कहाँ फैलिन्छ ?", None, "nep", "hi,ne", "ne", False), ("गोवा क्यां छे?", None, "hi", "gu,hi,mr,ne,sa", "gu,hi,mr,ne,sa", False),
    ("गोवा कहाँ है?", None, "hi", "hi", "hi", False), ("क्यान्सर भएका वा भएका प्रसिद्ध व्यक्तिहरू", None, None, "hi,mr,ne,sa", "hi,mr,ne,sa", False),
    ("Goa kya chhe", None, None, "en", "en", True), ("goa kahan hai", None, None, "en", "en", True), ("goa kuthe ahe", None, None, "en,mr", "en,mr", True),
    ("goa engey ulladhu enna", None, None, "en", "en", True), ("What is the weather in Goa today?", None, None, "en", "en", False), ("ݐݑݒ", None, None, "ur", "ur", False),
    ("", None, None, "", "", False), ("123 ?", None, "hin", "hi", "hi", False),
)


def test_routes(spark):
    from marlstone.operators.routing import route

    rows = [(i, text, forced, hint) for i, (text, forced, hint, *_) in enumerate(ROUTES)]
    out = route(spark.createDataFrame(rows, "qid int, text string, forced string, hint string")).orderBy("qid").collect()
    assert [(",".join(r.languages), ",".join(r.search_languages), r.romanized) for r in out] == [r[3:] for r in ROUTES]
