"""Deduplication, chunking and the inverted index."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marlstone.functions import text as T
from marlstone.functions import translit as X
from marlstone.operators.dense import dense_top_k
from marlstone.operators.rerank import expand, roman_vocabulary
from marlstone.shared import bounded, written


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row, in ``order``, of each combination of ``keys``; a partial aggregate, so hot keys don't gather."""
    cols = df.columns
    best = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in cols])


def chunks(docs: DataFrame, make, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk) of ``make`` on each text's sentences, split once."""
    s = docs.select(F.col(doc_id).alias("doc_id"), T.sentences(F.col(text)).alias("s"))
    return s.select("doc_id", F.posexplode(F.transform(F.array("s"), lambda x: make(x))[0]).alias("n", "chunk")).select("doc_id", F.col("n").cast("long").alias("chunk_no"), "chunk")


def child_chunks(docs: DataFrame, parent_id: Column, text: str = "text") -> DataFrame:
    """(parent_id, child_id, child_index, child_text, parent_text): sentence chunks, or the text where it has none."""
    s = docs.select(parent_id.alias("parent_id"), F.col(text).alias("parent_text"), T.sentences(F.col(text)).alias("s"))
    kids = F.transform(F.array("s"), lambda s: T.sentence_chunks(s))[0]
    kids = F.when(F.size("s") > 0, kids).otherwise(F.array("parent_text"))
    out = s.select("parent_id", "parent_text", F.posexplode(kids).alias("child_index", "child_text"))
    return out.select("parent_id", F.concat("parent_id", F.lit("::c"), "child_index").alias("child_id"), F.col("child_index").cast("long").alias("child_index"), "child_text", "parent_text")


class Index:
    """A stored inverted index: tables under one folder, built once and read by every search.

    postings (bucket, term, doc_id, tf, dl, language, kinds), in folders by hash of the term, in order of documents; terms
    (bucket, term, df, idf); corpus, one row (n_docs, avgdl, ...); sources (doc_id, language, kinds, source_key) of the
    documents that came with a question; languages (language, script); roman, the Latin spellings of words of other
    scripts. ``kinds`` has a bit for each kind of chunk, in the order of corpus.kinds. A search reads the buckets of its
    terms; languages and kinds are tested beside each posting, so no table of documents and no text is read.
    """

    TABLES = ("postings", "terms", "corpus", "sources", "languages", "roman")

    def __init__(self, spark: SparkSession, folder: str, k1: float = 1.5, b: float = 0.75):
        self.spark, self.folder, self.k1, self.b = spark, folder, k1, b
        for name in self.TABLES[1:]:
            setattr(self, name, spark.read.parquet(f"{folder}/{name}"))
        kind = self.sources.schema["doc_id"].dataType.simpleString()  # folders of no rows have no schema
        self.postings = spark.read.schema(f"term string, doc_id {kind}, tf int, dl int, language string, kinds long, bucket int").parquet(f"{folder}/postings")
        one = self.corpus.first()  # one row
        self.buckets, self.kinds = one["buckets"], one["kinds"]

    @classmethod
    def build(cls, docs: DataFrame, folder: str, buckets: int = 64, epsilon: float = 0.25, **how) -> Index:
        """The index of ``docs``: doc_id, text; and, where there, search_text (indexed in place of text), language,
        chunk_type, a chunk's kind or several joined by a plus sign (63 kinds at most in all), and source_query, the
        question a passage came with. A doc_id is one row's.

        Negative idf values are replaced by ``epsilon`` times the mean over all terms before replacement. Documents are
        in order of doc_id. Texts are cut into tokens once.
        """
        spark, have = docs.sparkSession, docs.columns
        text = F.coalesce(F.nullif(F.col("search_text"), F.lit("")), F.col("text")) if "search_text" in have else F.col("text")
        part = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        language = F.lower(F.trim(F.coalesce("language", F.lit("")))) if "language" in have else F.lit("")
        own = F.split(F.coalesce("chunk_type", F.lit("")), r"\+") if "chunk_type" in have else F.array().cast("array<string>")
        kinds = sorted(r[0] for r in docs.select(F.explode(own).alias("kind")).where("kind <> ''").distinct().limit(64).collect())
        if len(kinds) > 63:
            raise ValueError("more than 63 kinds of chunks")
        bits = F.lit(0).cast("long")
        for i, kind in enumerate(kinds):
            bits = bits + F.when(F.array_contains(own, kind), F.lit(1 << i)).otherwise(0)
        meta = [language.alias("language"), bits.alias("kinds")]
        toks = docs.select("doc_id", *meta, F.sort_array(T.tokens(text)).alias("toks"))
        counted = toks.select("doc_id", "language", "kinds", F.size("toks").alias("dl"), _counted("toks").alias("counted"))  # postings carry no array
        each = counted.select("doc_id", "language", "kinds", "dl", F.explode_outer("counted").alias("c"))  # not explode, whose filter of empty arrays would cut the texts again
        tf = each.where("c IS NOT NULL").select("doc_id", "dl", "language", "kinds", "c.term", "c.tf")

        def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
            w = df.write.mode("overwrite").option("compression", "zstd").option("parquet.dictionary.page.size", 8 << 20)  # a file's terms fit
            (w.partitionBy(by) if by else w).parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        # each task writes its documents' postings to all folders: none is shuffled, and a hot term is in as many files as there are tasks
        rows = tf.select("term", "doc_id", "tf", "dl", "language", "kinds", part).sortWithinPartitions("bucket")
        postings = save(rows, "postings", "bucket")
        n_docs = docs.count()
        df = postings.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
        df = written(df, "counts")
        n_tokens = df.agg(F.sum("n")).first()[0] or 0  # one number
        terms = save_terms(save, df.drop("n"), n_docs, epsilon)
        save(spark.createDataFrame([(n_docs, n_tokens / n_docs if n_docs else 0.0, buckets, kinds)], "n_docs long, avgdl double, buckets int, kinds array<string>"), "corpus")
        asked = T.tokens(F.col("source_query")) if "source_query" in have else F.array().cast("array<string>")
        save(docs.select("doc_id", *meta, F.when(F.size(asked) > 0, tokens_key(asked)).alias("source_key")).where("source_key IS NOT NULL"), "sources")
        # the first document of a language with a token in a script of its own; only such documents' texts are read again
        indic = F.ascii("term").between(*X.BRAHMIC) | F.ascii("term").between(*X.ARABIC_BLOCK)
        near = F.col("term").between(chr(X.ARABIC_BLOCK[0]), chr(X.BRAHMIC[1] + 1))  # what files can be skipped by
        first = postings.where(near & indic & (F.col("language") != "")).groupBy("language").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        script = F.get(X.scripts(F.regexp_extract(text, _FIRST_INDIC, 1)), F.lit(0))
        found = docs.join(bounded(written(first, "first")), "doc_id", "left_semi").select(language.alias("language"), script.alias("script"))
        spoken = docs.select(language.alias("language")).where("language <> ''").distinct()
        save(spoken.join(found, "language", "left").select("language", "script"), "languages")
        save(roman_vocabulary(terms.select("term"), once=True), "roman")
        return cls(spark, folder, **how)

    def _terms(self, queries: DataFrame, expanded: bool) -> DataFrame:
        """(qid, bucket, term, qtf): a query's repeated term counts each time, words of other scripts once."""
        own = queries.select("qid", F.explode(T.tokens(F.col("text"))).alias("term"))
        if expanded:
            wanted = queries.select("qid", "text", F.explode_outer("languages").alias("language")).join(F.broadcast(self.languages), "language", "left")
            wanted = wanted.groupBy("qid", "text").agg(F.collect_set("script").alias("wanted_scripts"))
            own = own.unionByName(expand(wanted, self.roman).select("qid", "term"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")
        return own.groupBy("qid", "term").agg(F.count("*").alias("qtf")).select("qid", bucket, "term", "qtf")

    def _of_kind(self, kind: str | None) -> Column:
        if kind is None:
            return F.lit(True)
        return F.col("kinds").bitwiseAND(F.lit(1 << self.kinds.index(kind))) != 0 if kind in self.kinds else F.lit(False)

    def _wanted(self, queries: DataFrame, expanded: bool, kind: str | None) -> tuple[DataFrame, DataFrame]:
        """(doc_id, t, tf, dl, language), the postings that ``queries`` ask for, each once, and (t, qid, w, only), who asks for them."""
        q = bounded(written(self._terms(queries, expanded), "query-terms"))
        q = self.terms.join(q, ["bucket", "term"]).select("qid", "bucket", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        by_language = "only" in queries.columns
        if by_language:
            q = q.join(queries.select("qid", "only"), "qid")
        q = written(q, "weights")
        speak = [F.flatten(F.collect_set("only")).alias("speak"), F.bool_or(F.col("only").isNull()).alias("any")] if by_language else []
        wanted = q.groupBy("bucket", "term").agg(F.count("*").alias("n"), *speak).withColumn("t", F.monotonically_increasing_id())
        wanted = bounded(written(wanted, "wanted"))
        hit = self.postings.join(wanted, ["bucket", "term"]).where(self._of_kind(kind))
        if by_language:
            hit = hit.where(F.col("any") | F.array_contains("speak", F.col("language")))
        hit = hit.select("doc_id", "t", "tf", "dl", *(["language"] if by_language else []))
        asked = q.join(wanted.select("bucket", "term", "t"), ["bucket", "term"]).select("t", "qid", "w", *(["only"] if by_language else []))
        return hit, written(asked, "asked")

    def _part(self) -> Column:
        """What a posting adds to a score for each unit of its term's weight."""
        return F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / self.corpus.first()["avgdl"]))

    def scores(self, queries: DataFrame, expanded: bool = False, kind: str | None = None) -> DataFrame:
        """(qid, doc_id, score) of ``queries`` (qid, text; with ``expanded`` also languages, an array), all of them.

        Postings of other languages than those in a query's ``only`` (an array, if there; null: any) and of chunks that
        aren't of ``kind`` are left out before scores are summed; statistics are of all documents.
        """
        hit, asked = self._wanted(queries, expanded, kind)
        # each posting is dealt once, to its document's partition, and meets the queries that ask for it only there
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        hit = hit.repartition(parts, "doc_id").join(bounded(asked), "t")
        if "only" in queries.columns:
            hit = hit.where(_spoken())
        return hit.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * self._part()).alias("score"))

    def best(self, queries: DataFrame, k: int, expanded: bool = False, kind: str | None = None, also: DataFrame | None = None) -> DataFrame:
        """Of ``scores`` those that ``top_k`` may keep, and those of the pairs ``also`` (qid, doc_id).

        Documents and queries are not paired in rows: each posting is dealt once, to its document's partition, and meets
        there a list of the queries that ask for it; a partition gives ``k`` documents a query, or little more.
        """
        hit, asked = self._wanted(queries, expanded, kind)
        keys, low = ["t"], F.lit((1 << 33) - 1)
        numbers = written(asked.select("qid").distinct().withColumn("q", F.monotonically_increasing_id()), "numbers")
        wide = (numbers.agg(F.max(F.col("q").bitwiseAND(low))).first()[0] or 0) + 1  # one number
        numbers = bounded(numbers.select("qid", (F.shiftright("q", 33) * wide + F.col("q").bitwiseAND(low)).alias("q")))
        asked = asked.join(numbers.withColumnRenamed("qid", "_qid"), F.expr("qid <=> _qid"))
        if "only" in queries.columns:
            keys = ["t", "language"]
            spoken = F.broadcast(self.languages.agg(F.concat(F.collect_set("language"), F.array(F.lit(""))).alias("spoken")))  # one row
            asked = asked.crossJoin(spoken).select("t", "q", "w", F.explode(F.array_distinct(F.coalesce("only", "spoken"))).alias("language"))
        lists = asked.groupBy(*keys, F.expr(f"q div {_QUERIES}").alias("piece")).agg(F.collect_list(F.struct("q", "w")).alias("of"))
        lists = written(lists.select(*keys, F.col("of.q").alias("qs"), F.col("of.w").alias("ws"), F.monotonically_increasing_id().alias("l")), "lists")
        hit = hit.select("doc_id", self._part().alias("part"), *keys)
        if also is None:
            hit = hit.withColumn("also", F.lit(None).cast("string"))
        else:
            named = also.join(numbers, "qid").groupBy("doc_id").agg(F.array_join(F.collect_set(F.col("q").cast("string")), ",").alias("also"))  # Arrow is slow to write null arrays
            hit = hit.join(bounded(written(named, "also")), "doc_id", "left")
        held, carried = None, ["qs", "ws"]
        if bounded(lists) is not lists:
            held = self.spark.sparkContext.broadcast(lists.select("l", "qs", "ws").orderBy("l").toArrow().combine_chunks())  # counted to be as small as a broadcast side
            carried, lists = [], F.broadcast(lists.select(*keys, "l"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        hit = hit.join(lists, keys).select("doc_id", "l", "part", "also", *carried).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "l")
        kind_of = hit.schema["doc_id"].dataType.simpleString()
        return hit.mapInArrow(_best(k, held), f"q long, doc_id {kind_of}, score double").join(numbers, "q").select("qid", "doc_id", "score")

    def top(self, queries: DataFrame, k: int, kind: str | None = None) -> DataFrame:
        """``top_k`` of the scores of ``queries``."""
        return top_k(self.best(queries, k, kind=kind), k)

    def search(self, queries: DataFrame, k: int = 20, kind: str | None = None) -> DataFrame:
        """(qid, doc_id, score, rank, exact): the ``k`` best of each query (qid, text, languages).

        Statistics are of the whole corpus. Only documents in a wanted language count (null or empty: any), or all where
        the corpus has none of the wanted. Documents whose source question has the query's very tokens come first, in
        order, with 1 at least; the others need a score above zero. Queries without tokens have no hits. With ``kind`` only
        chunks of that kind count, before the cut, so ``k`` of them are found if there are as many.
        """
        q = queries.select("qid", "text", F.transform(F.coalesce("languages", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))).alias("languages"))
        q = q.withColumn("languages", F.array_distinct(F.filter("languages", lambda x: x != "")))
        spoken = F.broadcast(self.languages.agg(F.collect_set("language").alias("spoken")))  # one row
        q = q.crossJoin(spoken).select("qid", "text", F.when(F.arrays_overlap("languages", "spoken"), F.col("languages")).alias("only"), "languages")
        key = q.select("qid", "only", tokens_key(T.tokens(F.col("text"))).alias("source_key")).where(F.size(T.tokens(F.col("text"))) > 0)
        exact = self.sources.where(self._of_kind(kind)).join(bounded(key), "source_key").where(_spoken()).select("qid", "doc_id", F.lit(True).alias("exact"))
        exact = written(exact, "exact")
        both = self.best(q, k, expanded=True, kind=kind, also=exact).join(exact, ["qid", "doc_id"], "full").withColumn("exact", F.coalesce("exact", F.lit(False)))
        score = F.round(F.when(F.col("exact"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("score")), 6)
        w = Window.partitionBy("qid").orderBy(F.col("exact").desc(), F.when(F.col("exact"), 0.0).otherwise(F.col("score")).desc(), "doc_id")
        ranked = both.withColumn("score", score).where("exact OR score > 0").withColumn("rank", F.row_number().over(w).cast("long"))
        return ranked.where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank", "exact")


def save_terms(save: Callable, df: DataFrame, n_docs: int, epsilon: float) -> DataFrame:
    """The table of terms from (bucket, term, df), their numbers of documents."""
    raw = save(df.withColumn("raw", F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)), "raw")
    mean = raw.agg(F.avg("raw")).first()[0]  # one number
    idf = F.when(F.col("raw") < 0, F.lit(epsilon * (mean or 0.0))).otherwise(F.col("raw"))
    return save(raw.select("bucket", "term", "df", idf.alias("idf")), "terms")


def _counted(toks: str) -> Column:
    """(term, tf) of a document's sorted tokens: runs of equal ones, counted in the row and so without a shuffle."""
    def runs(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        one = lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf")))
        return F.transform(F.array(at), one)[0]

    none = F.array().cast("array<struct<term: string, tf: int>>")
    return F.when(F.size(toks) > 0, F.transform(F.array(F.col(toks)), runs)[0]).otherwise(none)


def _spoken() -> Column:
    return F.col("only").isNull() | F.array_contains("only", F.col("language"))


def tokens_key(toks: Column) -> Column:
    return F.sha2(F.array_join(toks, "\n"), 256)


_FIRST_INDIC = r"(?<![\p{L}\p{N}_\x{0900}-\x{0D7F}\x{0600}-\x{06FF}])([\x{0900}-\x{0D7F}\x{0600}-\x{06FF}])"


#: Queries in one list at most, cells of a table of lists or rows and queries, pairs held before they are cut to
#: the best; and how far below the last place a score may be that rounding could still bring there.
_QUERIES, _CELLS, _HELD, _NEAR = 512, 1 << 22, 1 << 16, 2e-6


def _best(k: int, lists) -> Callable:
    """From postings (doc_id, l, part, also) in order of doc_id: the ``k`` best documents of each query of a partition with a
    score above zero, ties by doc_id; and the scores of the queries in ``also``. ``lists`` is a broadcast table (l, qs, ws) of
    the queries of each list and their weights; where it is None, postings carry those themselves."""

    def tabled() -> tuple | None:
        """Weights as a table of lists and queries, which queries a list's columns are, and how many it has; None where that is large."""
        if lists is None or not len(lists.value):
            return None
        qs = lists.value.column("qs").combine_chunks()
        q, each = qs.flatten().to_numpy(), qs.value_lengths().to_numpy()
        width = min(int(q.max()) + 1, _QUERIES)
        if len(each) * width > _CELLS:
            return None
        table, piece = np.zeros((len(each), width)), q[np.cumsum(each) - 1] // _QUERIES
        np.add.at(table, (np.repeat(np.arange(len(each)), each), q % _QUERIES), lists.value.column("ws").combine_chunks().flatten().to_numpy())
        return table, piece, each

    def by_table(table: np.ndarray, piece: np.ndarray, at: np.ndarray, part: np.ndarray, doc: np.ndarray, least: Callable) -> Iterator[tuple]:
        """(document, query, score) of scores that reach what ``least`` says of (documents, queries)."""
        own = piece[at]
        for p in np.unique(own):
            here = np.flatnonzero(own == p)
            starts = np.flatnonzero(np.append(True, doc[here][1:] != doc[here][:-1]))
            s = np.add.reduceat(table[at[here]] * part[here, None], starts, axis=0)
            d, q = np.nonzero(least(s, doc[here][starts][:, None], p * _QUERIES + np.arange(s.shape[1])[None, :]))
            yield doc[here][starts][d], p * _QUERIES + q, s[d, q]

    def by_pairs(qs: pa.ListArray, ws: pa.ListArray, part: np.ndarray, doc: np.ndarray, least: Callable) -> Iterator[tuple]:
        q, row = qs.flatten().to_numpy(), np.repeat(np.arange(len(part)), qs.value_lengths().to_numpy())
        n = int(q.max()) + 1
        key, place = np.unique(doc[row] * n + q, return_inverse=True)
        s = np.bincount(place, ws.flatten().to_numpy() * part[row], len(key))
        good = np.flatnonzero(least(s, key // n, key % n))
        yield key[good] // n, key[good] % n, s[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, upto, limit, table, bar = [], 0, 0, _HELD, tabled(), np.zeros(0)
        for b in _whole(batches):
            starts = _starts(b)
            ids, named = (b.column(c).take(pa.array(starts)) for c in ("doc_id", "also"))
            mine = None
            if named.null_count < len(named):
                told = pc.split_pattern(named.drop_null(), ",")
                flat = pc.cast(told.flatten(), pa.int64()).to_numpy()
                n = int(flat.max()) + 1
                mine = np.repeat(np.flatnonzero(named.is_valid()), told.value_lengths().to_numpy()) * n + flat

            def asked(d, q, mine=mine, n=n if mine is not None else 0):
                return np.zeros(1, bool) if mine is None else (q < n) & np.isin(d * n + q, mine)

            def least(s, d, q):
                if len(bar) <= (top := int(q.max())):
                    bar.resize(top + 1, refcheck=False)
                return (s > 0) & (s >= bar[q] - _NEAR) | asked(d, q)  # noqa: B023

            part, doc = b.column("part").to_numpy(), np.cumsum(np.isin(np.arange(len(b)), starts)) - 1
            at = None if lists is None else np.searchsorted(lists.value.column("l").to_numpy(), b.column("l").to_numpy())
            for lo, hi in _slices(starts, len(b), _CELLS // _QUERIES):
                if table is not None and (hi - lo) * table[0].shape[1] <= min(2 * _CELLS, 32 * int(table[2][at[lo:hi]].sum())):  # else most cells are empty
                    got = by_table(*table[:2], at[lo:hi], part[lo:hi], doc[lo:hi], least)
                else:
                    qs, ws = (b.column(c)[lo:hi] if lists is None else lists.value.column(c).combine_chunks().take(pa.array(at[lo:hi])) for c in ("qs", "ws"))
                    got = by_pairs(qs, ws, part[lo:hi], doc[lo:hi], least)
                for d, q, s in got:
                    own = np.broadcast_to(asked(d, q), d.shape)
                    if own.any():
                        yield pa.RecordBatch.from_arrays([pa.array(q[own]), ids.take(pa.array(d[own])), pa.array(s[own])], ["q", "doc_id", "score"])
                        d, q, s = d[~own], q[~own], s[~own]
                    if len(q):
                        held.append((q, d + upto, s, ids.take(pa.array(d))))
                        size += len(q)
                if size > limit:
                    one, (q, last) = _cut_all(held, k)
                    held, size = [one], len(one[0])
                    bar[q] = np.maximum(bar[q], last)
                    limit = max(_HELD, 2 * size)
            upto += len(starts)
        if held:
            (q, _, s, doc_id), _ = _cut_all(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(q), doc_id, pa.array(s)], ["q", "doc_id", "score"])

    return run


def cut_best(k: int, q: np.ndarray, doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Places of the best ``k`` of each query, those that come near the last of them, and of equal scores the first ``k``;
    and the queries with ``k`` scores, with the last of those."""
    order = np.lexsort((doc, -s, q))
    q, s = q[order], s[order]
    new = np.append(True, q[1:] != q[:-1])
    first = np.flatnonzero(new)
    end, group = np.append(first[1:], len(q)), np.cumsum(new) - 1
    last = s[np.minimum(first + k, end) - 1]
    other = new | np.append(True, s[1:] != s[:-1])
    equal = np.arange(len(q)) - np.flatnonzero(other)[np.cumsum(other) - 1]
    full = end - first >= k
    return order[(s >= last[group] - _NEAR) & (equal < k)], (q[first][full], last[full])


def _cut_all(held: list, k: int) -> tuple:
    q, doc, s = (np.concatenate([h[i] for h in held]) for i in range(3))
    kept, last = cut_best(k, q, doc, s)
    return (q[kept], doc[kept], s[kept], pa.concat_arrays([h[3] for h in held]).take(pa.array(kept))), last


def _slices(starts: np.ndarray, end: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents, of about ``rows`` rows."""
    lo = 0
    while lo < end:
        i = int(np.searchsorted(starts, lo + rows, "right")) - 1
        hi = end if lo + rows >= end else int(starts[i]) if starts[i] > lo else int(starts[i + 1]) if i + 1 < len(starts) else end
        yield lo, hi
        lo = hi


def _starts(b: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch at which a document begins."""
    ids = b.column("doc_id")
    return np.flatnonzero(np.append(True, pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, each document's in one batch."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        at = int(_starts(b)[-1])
        if at == 0 and rest and rest[-1].column("doc_id")[-1] == b.column("doc_id")[0]:
            rest.append(b)
            continue
        if at == 0:  # one document alone, another than those before
            if rest:
                yield pa.concat_batches(rest)
            rest = [b]
            continue
        yield pa.concat_batches([*rest, b.slice(0, at)])
        rest = [b.slice(at)]
    if rest:
        yield pa.concat_batches(rest)


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(qid, doc_id, score, rank): the k best above zero, ties by doc_id."""
    s = scores.select("qid", "doc_id", F.round("score", digits).alias("score")).where("score > 0")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id"))
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


_LOADED: dict = {}


class Resident:
    """An encoder of a file that Spark ships to the workers, each process of which loads it once, for all its tasks.

    ``load`` gets the path of the worker's copy of ``path`` and gives the function from a list of texts to their vectors.
    The file's name must be new to the session, or its content the same.
    """

    def __init__(self, spark: SparkSession, path: str, load: Callable[[str], Callable]):
        spark.sparkContext.addFile(path)
        self.name, self.load, self.key = path.rstrip("/").rsplit("/", 1)[-1], load, uuid.uuid4().hex

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load(SparkFiles.get(self.name))
        return _LOADED[self.key](texts)


def embed(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], column: str = "text", out: str = "embedding", batch: int = 256) -> DataFrame:
    """``rows`` with ``out``, the vectors that the hook ``encode`` gives for the texts in ``column``, ``batch`` at a time.

    The hook (a ``Resident`` where it has a model) is sent to the workers and gets a list of strings (nulls as empty ones); it returns one row of numbers each.
    Vectors are brought to length one; zero vectors stay.
    """
    schema = S.StructType([*rows.schema.fields, S.StructField(out, S.ArrayType(S.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                x = np.asarray(encode([t or "" for t in part[column]]), np.float32)
                if x.shape[0] != len(part):
                    raise ValueError(f"{len(part)} texts gave {x.shape[0]} vectors")
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                yield part.assign(**{out: list(x / np.where(norm > 0, norm, 1))})

    return rows.mapInPandas(run, schema)


def semantic_search(vectors: DataFrame, queries: DataFrame, encode: Callable, k: int = 20, keep: Column | None = None) -> DataFrame:
    """``dense_top_k`` of ``queries`` (qid, text) whose vectors the hook gives."""
    return dense_top_k(vectors, embed(queries.select("qid", "text"), encode), k, keep)


def fuse(lists: list[DataFrame], k: int = 60, limit: int = 20) -> DataFrame:
    """(qid, id, rrf, orig_score, rank) of ranked lists (qid, id, score, rank): reciprocal ranks summed.

    ``orig_score`` is of the first list that has the id; ties stand in the order first seen.
    """
    all_ = None
    for i, x in enumerate(lists):
        x = x.select("qid", F.col("id").cast("string").alias("id"), "score", "rank", F.lit(i).alias("list")).where("trim(id) <> ''")
        all_ = x if all_ is None else all_.unionByName(x)
    seen = F.struct("list", "rank")
    g = all_.groupBy("qid", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("rrf"), F.min_by("score", seen).alias("orig_score"), F.min(seen).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.col("rrf").desc(), "seen", "id")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).drop("seen")
