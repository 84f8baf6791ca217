"""Words across scripts: expressions against the plain functions, spellings of one name, reranking and refusal."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import translit as X
from marlstone.operators import rerank as R

GOA = ["गोवा", "ગોવા", "গোয়া", "కోవా", "கோவா", "ಗೋವಾ", "ഗോവ", "ਗੋਆ", "گوا"]
HIT = "qid int, rank int, chunk_id string, text string, parent_text string, orig_score double, rrf_score double, source_query string"


@pytest.mark.parametrize("name", GOA)
def test_one_name(name):
    assert X.sound_score("goa", X.romanized(name)) > 0


@pytest.mark.parametrize(("a", "b", "want"), [("goa", "goa", 1.0), ("goa", "gola", 0.0), ("goa", "kov", 0.0), ("gov", "goa", 0.9), ("inda", "indane", 0.88), ("", "a", 0.0), ("ab", "abc", 0.0)])
def test_sound_score(a, b, want):
    assert X.sound_score(a, b) == want


def test_expressions_equal_plain_functions(spark):
    words = [*GOA, "Panaji", "École", "दिल्ली", "छह", "", None, "a१b", "𝒳y", "ارد"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    got = df.select("w", X.romanize(w).alias("r"), X.skeleton(X.romanize(w)).alias("s"), X.related_skeletons(X.romanize(w)).alias("k"), X.scripts(w).alias("b"), X.is_mixed_script(w).alias("m"), X.fuzzy_score(F.lit("goa"), X.romanize(w)).alias("f")).collect()
    for x in got:
        r = X.romanized(x.w or "")
        assert (x.r, x.s, x.f) == (r, X.skeleton_of(r), X.sound_score("goa", r))
        assert not x.k or x.k[0] == x.s
        assert (x.k == []) == (x.s == "")
    assert {tuple(x.b) for x in got if x.w in GOA} == {(0x900,), (0xA80,), (0x980,), (0xC00,), (0xB80,), (0xC80,), (0xD00,), (0xA00,), (0x600,)}
    mixed = spark.createDataFrame([("Goa કયાં છે?",), ("where",), ("કયાં",), (None,)], "t string").select(X.is_mixed_script(F.col("t"))).collect()
    assert [m[0] for m in mixed] == [True, False, False, False]


@pytest.fixture(scope="module")
def asked(spark):
    q = [(1, "Where is Goa located?"), (2, "Goa કયાં છે?"), (3, "what is the capital of India"), (4, "tell me a joke"), (5, None), (6, "price of tea")]
    hits = [
        (1, 1, "a", "Pune is a city", "Pune is a city", 0.5, 0.01, None),
        (1, 2, "b", "Goa is a state.", "Goa is a state. It is small.", 0.5, 0.01, "where is goa"),
        (1, 3, "c", "It is small.", "goa is a  state. It is small.", 0.9, 0.01, None),
        (2, 1, "d", "પુણે શહેર", "", None, None, None),
        (2, 2, "e", "ગોવા રાજ્ય", None, None, None, None),
        (3, 1, "f", "Goa lies in India", "Goa lies in India", 0.5, 0.1, ""),
        (4, 1, "g", "a joke", "a joke", 0.5, 0.1, "tell me a joke"),
        (5, 1, "", " ", "", None, None, None),
    ]
    return spark.createDataFrame(q, "qid int, query string"), spark.createDataFrame(hits, HIT)


def test_rerank(asked):
    q, h = asked
    got = {(r.qid, r["rank"]): r for r in R.rerank(q, h).collect()}
    assert [got[1, n].chunk_id for n in (1, 2)] == ["b", "a"] and (1, 3) not in got  # c repeats b's parent
    # all words, 0.2 of the score, 0.15 of the fused, half the capitalised words (Where, Goa), the same question
    assert got[1, 1].rerank_score == pytest.approx(1 + 0.1 + 0.0015 + 1.25 / 2 + 1)
    assert got[2, 1].chunk_id == "e" and got[2, 1].rerank_score > got[2, 2].rerank_score
    assert (5, 1) not in got
    assert len(R.rerank(q, h, 1).where("qid = 1").collect()) == 1 and R.rerank(q, h.limit(0)).count() == 0


def test_refusals(asked):
    got = {r.qid: (r.refused, r.confidence) for r in R.refusals(*asked).collect()}
    assert got[1] == (False, 1.0) and got[2] == (False, 1.0) and got[3] == (True, 0.5)
    assert got[4] == (True, 0.0) and got[5][0] and got[6] == (True, 0.0)


def test_expand(spark):
    terms = spark.createDataFrame([(w,) for w in ["ગોવા", "ગોલા", "ગોવા", "goa", "શહેર", "गोवा"]], "term string")
    q = spark.createDataFrame([(1, "Goa કયાં છે?", []), (2, "Goa", []), (3, "गोवा", [0xA80]), (4, None, None)], "qid int, text string, wanted_scripts array<int>")
    got = {(r.qid, r.term) for r in R.expand(q, R.roman_vocabulary(terms)).collect()}
    assert (1, "ગોવા") in got and (3, "ગોવા") in got and not {t for n, t in got if n in (2, 4)} and (1, "ગોલા") not in got and (3, "गोवा") not in got
    assert len(R.expand(q, R.roman_vocabulary(terms), 1).where("qid = 1").collect()) == 1


def test_rules_without_a_ratio(spark):
    import random

    from pyspark.sql import functions as F

    from marlstone.functions import translit as X

    rng = random.Random(4)
    words = ["".join(rng.choice("aeikpstvdhrnm") for _ in range(rng.randint(0, 9))) for _ in range(120)] + ["goa", "gova", "kathmandu", "katmandoo", "mumbai", "mumbay", "delhi", "dehli", "", "a"]
    words += [w[:-1] for w in words[:60]] + [w + "a" for w in words[:60]]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words[::2]], "a string, b string")
    pairs = pairs.withColumns({"a_bones": X.skeleton(F.col("a")), "b_bones": X.skeleton(F.col("b"))})
    sure, open_ = X.may_sound("a", "b")
    for r in pairs.select("a", "b", sure.alias("sure"), open_.alias("open")).collect():
        score = X.sound_score(r.a, r.b)
        assert (score > 0) == (r.sure or (r.open and score > 0)) and not (r.sure and r.open)


def test_words_heard_in_texts(spark):
    from marlstone.operators.rerank import sounding

    asks = spark.createDataFrame([(1, "goa"), (1, "delhi"), (2, "goa"), (2, None), (3, "goa"), (4, "kathmandu"), (5, "is")], "key long, word string")
    texts = spark.createDataFrame([(1, ["गोवा", "है"]), (2, ["paris"]), (4, ["काठमाण्डू", "katmandu"]), (5, ["is", "iss"]), (6, ["goa"]), (7, None)], "key long, words array<string>")
    assert sorted(map(tuple, sounding(asks, texts).collect())) == [(1, "goa"), (4, "kathmandu")]
