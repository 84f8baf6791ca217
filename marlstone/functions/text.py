"""Text functions as column expressions; lengths and offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is made of, and what ends a sentence.
TOKEN = r"[a-z\p{L}\p{N}_\x{0900}-\x{0D7F}\x{0600}-\x{06FF}]++"  # letters met most first, and none given back: the same tokens, sooner
SENTENCE_END = ".!?।॥"
_EDGE = r"(?U)^\s+|\s+$"
#: All that (?U)\s stands for.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(c, _EDGE, "")


def clean_text(c: Column) -> Column:
    """NUL to blank, stripped, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.translate(c, "\0" + _BLANKS, " " * (1 + len(_BLANKS))), " {2,}", " "))


def text_hash(c: Column) -> Column:
    """SHA-1 of the lower-cased text with runs of blanks as one."""
    return F.sha1(F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))).cast("binary"))


def tokens(c: Column) -> Column:
    """Lower-cased tokens in order, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def sentences(c: Column) -> Column:
    """Sentences, stripped, without empty ones."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), rf"(?U)(?<=[{SENTENCE_END}])\s+")
    return F.filter(parts, lambda s: s != "")  # parts begin and end at no blank: a cut takes all that follow a mark


def clean_sentences(c: Column) -> Column:
    """``sentences`` of a text that ``clean_text`` gave, which has no blanks but single spaces."""
    return F.filter(F.split(c, rf" (?<=[{SENTENCE_END}] )"), lambda s: s != "")


def sentence_chunks(sents: Column, min_chars: int = 40) -> Column:
    """Sentences joined until a chunk has ``min_chars``; the last chunk may be shorter."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(acc, s):
        full = (F.length(acc["buf"]) >= min_chars)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["buf"] == ""), s).otherwise(F.concat(acc["buf"], F.lit(" "), s)).alias("buf"),
        )

    return F.aggregate(sents, empty, add, lambda a: F.when(a["buf"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["buf"]))))


def sliding_chunks(sents: Column, window: int = 3, stride: int = 1) -> Column:
    """Windows of sentences; the tail window is added where the stride skips it."""
    n = F.size(sents)
    join = lambda at: F.array_join(F.slice(sents, at, window), " ")
    steps = F.sequence(F.lit(1), n - window + 1, F.lit(stride))
    all_ = F.transform(steps, join)
    tail = join(n - window + 1)
    more = F.when(F.element_at(all_, -1) != tail, F.concat(all_, F.array(tail))).otherwise(all_)
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= window, F.array(F.array_join(sents, " "))).otherwise(more)


def packed_chunks(sents: Column, target: int = 450, limit: int = 700, long_sentence: int = 80) -> Column:
    """Sentences packed to about ``target`` characters and never beyond ``limit`` (unless one alone is longer)."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(acc, s):
        over = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(s) + 1 > limit)
        joined = F.when(acc["buf"] == "", s).otherwise(F.concat(acc["buf"], F.lit(" "), s))
        enough = (F.length(joined) >= target) & (F.length(s) > long_sentence)
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["buf"]))).when(enough, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"),
            F.when(over, s).when(enough, F.lit("")).otherwise(joined).alias("buf"),
        )

    return F.aggregate(sents, empty, add, lambda a: F.when(a["buf"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["buf"]))))
