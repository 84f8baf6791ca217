"""Named queries over the driver's tables and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import answers as A
from marlstone.operators import corpus as C
from marlstone.operators.limits import admissions
from marlstone.shared import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN = r"trim(regexp_replace(translate({0}, chr(0), ' '), '\s+', ' ', 'g'))"
_HASH = r"sha1(lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))))"
_TOKENS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_\x{{0900}}-\x{{0D7F}}\x{{0600}}-\x{{06FF}}]+'), lambda t: lower(t))"
_SENTS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g'), '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT min(doc_id) AS doc_id, {_HASH.format('text')} AS text_hash FROM documents GROUP BY 2")
def dedupe_first_by_hash(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))
    return C.keep_first(docs, [F.col("text_hash")], ["doc_id"])


@query(f"SELECT min(doc_id) AS doc_id, source, {_HASH.format('text')} AS text_hash FROM documents GROUP BY 2, 3")
def dedupe_by_hash_and_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", T.text_hash(F.col("text")).alias("text_hash"))
    return C.keep_first(docs, [F.col("text_hash"), F.col("source")], ["doc_id"])


@query(f"SELECT doc_id, i - 1 AS chunk_no, s[i] AS chunk FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTS.format('text')} AS s FROM documents))")
def sentence_split(spark, d):
    return C.chunks(table(spark, d, "documents"), lambda s: s)


@query(
    f"""SELECT doc_id, i - 1 AS chunk_no, CASE WHEN len(s) <= 3 THEN array_to_string(s, ' ') ELSE array_to_string(s[i:i + 2], ' ') END AS chunk
FROM (SELECT doc_id, s, unnest(range(1, greatest(len(s) - 1, 2))) AS i FROM (SELECT doc_id, {_SENTS.format('text')} AS s FROM documents) WHERE len(s) > 0)"""
)
def chunk_sliding_3_1(spark, d):
    return C.chunks(table(spark, d, "documents"), lambda s: T.sliding_chunks(s, 3, 1))


_FOLD = """SELECT doc_id, i - 1 AS chunk_no, c[i] AS chunk FROM (
  SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN r.buf = '' THEN r.done ELSE list_append(r.done, r.buf) END AS c FROM (
      SELECT doc_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'buf': '', 's': ''}}, list_transform(s, lambda x: {{'done': []::VARCHAR[], 'buf': '', 's': x}})),
        lambda a, x: {step}) AS r
      FROM (SELECT doc_id, {sents} AS s FROM documents))))"""
_MERGE = _FOLD.format(
    sents=_SENTS.format("text"),
    step="""{'done': CASE WHEN length(a.buf) >= 40 THEN list_append(a.done, a.buf) ELSE a.done END,
                 'buf': CASE WHEN length(a.buf) >= 40 OR a.buf = '' THEN x.s ELSE a.buf || ' ' || x.s END, 's': ''}""",
)
_PACK = _FOLD.format(
    sents=_SENTS.format("text"),
    step="""CASE WHEN a.buf <> '' AND length(a.buf) + length(x.s) + 1 > 700 THEN {'done': list_append(a.done, a.buf), 'buf': x.s, 's': ''}
          WHEN length(x.s) > 80 AND length(CASE WHEN a.buf = '' THEN x.s ELSE a.buf || ' ' || x.s END) >= 450
            THEN {'done': list_append(a.done, CASE WHEN a.buf = '' THEN x.s ELSE a.buf || ' ' || x.s END), 'buf': '', 's': ''}
          ELSE {'done': a.done, 'buf': CASE WHEN a.buf = '' THEN x.s ELSE a.buf || ' ' || x.s END, 's': ''} END""",
)


@query(_MERGE)
def chunk_sentence_merge(spark, d):
    return C.chunks(table(spark, d, "documents"), T.sentence_chunks)


@query(_PACK)
def chunk_semantic(spark, d):
    return C.chunks(table(spark, d, "documents"), T.packed_chunks)


@query(f"SELECT doc_id::VARCHAR AS parent_id, doc_id || '::c' || chunk_no AS child_id, chunk_no AS child_index, chunk AS child_text FROM ({_MERGE})")
def chunk_parent_child(spark, d):
    docs = table(spark, d, "documents").where("trim(text) <> ''")
    return C.child_chunks(docs, F.col("doc_id").cast("string")).drop("parent_text")


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)")
def token_stats(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(
    f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents)
GROUP BY term ORDER BY n DESC, term LIMIT 100"""
)
def postings_top_terms(spark, d):
    p = _index(spark, d).postings
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).orderBy(F.col("n").desc(), "term").limit(100)


_BM25 = f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents),
l AS (SELECT doc_id, len({_TOKENS.format('text')}) AS dl FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
r AS (SELECT term, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p GROUP BY 1),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM l)))), 6) AS score
      FROM p JOIN q USING (term) JOIN i USING (term) JOIN l USING (doc_id) GROUP BY 1, 2),
"""


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


_INDEXES: dict = {}


def _stored(spark, d, name: str, docs) -> C.Index:
    """The stored index of the rows that ``docs`` gives, built by the first query of a session that needs it."""
    from marlstone.shared import fresh_path
    from marlstone.sources.store import exists

    key = spark.sparkContext.applicationId, d, name
    if key not in _INDEXES or not exists(spark, f"{_INDEXES[key].folder}/roman/_SUCCESS"):  # the last table written
        _INDEXES[key] = C.Index.build(docs(), fresh_path(spark, name), buckets=8)
    return _INDEXES[key]


def _index(spark, d) -> C.Index:
    def docs() -> DataFrame:
        own = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("language"))
        # a document with the number of a benchmark item came with that item's question
        asked = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").alias("source_query"))
        return own.join(asked, "doc_id", "left")

    return _stored(spark, d, "index", docs)


def _bm25(spark, d, k: int) -> DataFrame:
    return _index(spark, d).top(_items(spark, d), k)


@query(_BM25 + "k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT * FROM k WHERE rank <= 5")
def bm25_topk(spark, d):
    return _bm25(spark, d, 5)


@query(
    _BM25 + """k AS (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
FROM s JOIN documents USING (doc_id) WHERE score > 0 AND lang = 'fr') SELECT * FROM k WHERE rank <= 5"""
)
def bm25_topk_lang_filtered(spark, d):
    """Statistics over the whole corpus; postings of other languages are left out before scores are summed."""
    return _index(spark, d).top(_items(spark, d).withColumn("only", F.array(F.lit("fr"))), 5)


_COS = """WITH s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])
  / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 {0}),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) """


def _dense_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _vector_index(spark, d):
    from marlstone.operators.dense import VectorIndex
    from marlstone.shared import fresh_path

    return VectorIndex.build(table(spark, d, "embeddings"), fresh_path(spark, "vectors"))


def _vectors(spark, d, k, keep=None):
    return C.dense_top_k(table(spark, d, "embeddings"), _dense_queries(spark, d), k, keep)


@query(_COS.format("") + "SELECT * FROM k WHERE rank <= 10")
def dense_topk_cosine(spark, d):
    return _vectors(spark, d, 10)


@query(_COS.format("AND v.label = 1") + "SELECT * FROM k WHERE rank <= 10")
def dense_topk_label_filtered(spark, d):
    return _vectors(spark, d, 10, F.col("label") == 1)


@query(_COS.format("") + "SELECT * FROM k WHERE rank <= 10")
def dense_index_all_lists(spark, d):
    """The stored index of vectors with every list probed: what it stores is whole, and its scores are exact."""
    ix = _vector_index(spark, d)
    return ix.search(_dense_queries(spark, d), 10, len(ix.centroids))


@query()
def dense_index_topk(spark, d):
    """The same by the lists nearest to each query; tests hold its recall against the exact way."""
    return _vector_index(spark, d).search(_dense_queries(spark, d), 10)


@query(
    _BM25 + """a AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20),
b AS (SELECT qid, doc_id, 1.0 AS score, row_number() OVER (PARTITION BY qid ORDER BY rank DESC) AS rank FROM a WHERE rank <= 10),
u AS (SELECT *, 0 AS list FROM a UNION ALL SELECT *, 1 FROM b),
g AS (SELECT qid, doc_id::VARCHAR AS id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, arg_min(score, list * 1000 + rank) AS orig_score, min(list * 1000 + rank) AS seen FROM u GROUP BY 1, 2),
k AS (SELECT qid, id, rrf, orig_score, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, seen, id) AS rank FROM g) SELECT * FROM k WHERE rank <= 20"""
)
def rrf_fusion(spark, d):
    from pyspark.sql import Window

    a = written(_bm25(spark, d, 20).withColumnRenamed("doc_id", "id"), "ranked")

    back = a.where("rank <= 10").select("qid", "id", F.lit(1.0).alias("score"), F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rank").desc())).alias("rank"))
    return C.fuse([a, back])


def _sql_any(c: str, patterns) -> str:
    return " OR ".join(f"regexp_matches({c}, '(?i){p}')" for p in patterns)


@query(f"SELECT conv_id, turn, ({_sql_any("coalesce(text, '')", A.UNSAFE)}) AS unsafe, ({_sql_any("coalesce(text, '')", A.OFF_TOPIC)}) AS off_topic FROM conversations")
def unsafe_offtopic_flags(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", A.matches(F.col("text"), A.UNSAFE).alias("unsafe"), A.matches(F.col("text"), A.OFF_TOPIC).alias("off_topic"))


def _sql_words(c: str, stop) -> str:
    quoted = ", ".join(f"'{w}'" for w in stop)
    return f"list_distinct(list_filter({_TOKENS.format(c)}, lambda t: length(t) > 1 AND t NOT IN ({quoted})))"


@query(
    f"""SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(c) > 0 THEN len(list_intersect(a, c)) / len(a) ELSE 0 END, 6) AS overlap FROM (
  SELECT y.conv_id, y.turn, {_sql_words('y.text', A.GROUNDING_STOP)} AS a, {_sql_words('x.text', A.GROUNDING_STOP)} AS c
  FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user' AND y.role = 'assistant')"""
)
def grounding_overlap(spark, d):
    c = table(spark, d, "conversations")
    x = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    y = c.where("role = 'assistant'").join(x, ["conv_id", "turn"])
    return y.select("conv_id", "turn", F.round(A.overlap(F.col("text"), F.col("asked")), 6).alias("overlap"))


@query(f"SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], ' ') ELSE left(coalesce(text, ''), 400) END AS answer FROM (SELECT doc_id, text, {_SENTS.format('text')} AS s FROM documents)")
def extractive_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", A.extractive(F.col("text")).alias("answer"))


@query(
    _BM25 + f"""k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0),
h AS (SELECT qid, doc_id, text, {_SENTS.format('text')} AS st FROM k JOIN documents USING (doc_id) WHERE rank = 1),
a AS (SELECT qid, doc_id, text, CASE WHEN len(st) > 0 THEN array_to_string(st[1:2], ' ') ELSE left(text, 400) END AS answer FROM h),
w AS (SELECT qid, doc_id, answer, {_sql_words('a.answer', A.GROUNDING_STOP)} AS x, {_sql_words('a.text', A.GROUNDING_STOP)} AS y FROM a)
SELECT qid, doc_id, answer, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(x) ELSE 0 END, 6) AS grounding FROM w"""
)
def rag_answer_batch(spark, d):
    docs = table(spark, d, "documents")
    top = _with_texts(_bm25(spark, d, 1), docs.select("doc_id", "text"))
    out = top.select("qid", "doc_id", A.extractive(F.col("text")).alias("answer"), "text")
    return out.select("qid", "doc_id", "answer", F.round(A.overlap(F.col("answer"), F.col("text")), 6).alias("grounding"))


@query(
    _COS.format("AND v.vec_id <> q.vec_id") + """, h AS (SELECT qid, min(rank) AS best FROM k JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = k.vec_id
  WHERE rank <= 5 AND a.label = b.label GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN best <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / best, 0)), 4) AS mrr
FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0) LEFT JOIN h USING (qid)"""
)
def recall_mrr_by_label(spark, d):
    v = table(spark, d, "embeddings")
    hits = _vectors(spark, d, 6).where("qid <> vec_id")
    label = v.select("vec_id", "label")
    own = label.withColumnsRenamed({"vec_id": "qid", "label": "own"})
    from pyspark.sql import Window

    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 5")
    good = hits.join(label, "vec_id").join(own, "qid").where("own = label").select("qid", F.col("vec_id").alias("id"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.lit(-1).cast("long").alias("id"))
    return A.recall_mrr(hits.withColumnRenamed("vec_id", "id"), good.unionByName(asked), 5)


@query(
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, round(v[round_even(0.5 * (len(v) - 1), 0)::INT + 1], 2) AS p50, round(v[round_even(0.7 * (len(v) - 1), 0)::INT + 1], 2) AS p70, round(v[len(v)], 2) AS p100 FROM s"""
)
def latency_percentiles(spark, d):
    return A.rank_percentiles(table(spark, d, "events"), "event_type", "value")


@query("SELECT lang, count(*) AS n_docs, count(DISTINCT source) AS n_sources, sum(CASE WHEN length(text) >= 40 THEN 1 ELSE 0 END)::BIGINT AS n_long FROM documents GROUP BY ROLLUP(lang)")
def language_rollup(spark, d):
    return table(spark, d, "documents").rollup("lang").agg(
        F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.count_if(F.length("text") >= 40).alias("n_long")
    )


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts::TIMESTAMP) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
f AS (SELECT user_id AS key, 0::BIGINT AS i, []::DOUBLE[] AS recent, 0::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT key, e.i, CASE WHEN len(list_filter(recent, lambda r: r >= e.t - 3600)) < 3 THEN list_append(list_filter(recent, lambda r: r >= e.t - 3600), e.t)
    ELSE list_filter(recent, lambda r: r >= e.t - 3600) END, n + CASE WHEN len(list_filter(recent, lambda r: r >= e.t - 3600)) < 3 THEN 1 ELSE 0 END
  FROM f JOIN e ON e.user_id IS NOT DISTINCT FROM f.key AND e.i = f.i + 1)
SELECT key, max(i) AS n_events, max(n) AS n_admitted FROM f GROUP BY key"""
)
def rate_limit_admissions(spark, d):
    e = table(spark, d, "events")
    return admissions(e, "user_id", F.col("ts").cast("timestamp").cast("double"), 3, 3600.0)


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n_segments, string_agg(event_type, ' ' ORDER BY ts, event_id) AS merged FROM n GROUP BY user_id, no"""
)
def session_merge_utterances(spark, d):
    from marlstone.streaming.sessions import merge_segments

    return merge_segments(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", "30 minutes")


@query("SELECT doc_id, (('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT % 9223372036854775807)::BIGINT AS point_id FROM documents")
def point_ids(spark, d):
    from marlstone.sources.store import point_id

    return table(spark, d, "documents").select("doc_id", point_id(F.col("doc_id").cast("string")).alias("point_id"))


def _with_texts(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` (doc_id, ...) with the columns of its documents; no text of another one is dealt."""
    from marlstone.shared import bounded

    found = written(found, "found")
    return found.join(docs.join(bounded(found.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id")


def _hits(spark, d) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as questions, and their 20 best documents as hits."""
    hits = _with_texts(_bm25(spark, d, 20), table(spark, d, "documents").select("doc_id", "text")).select(
        "qid", "rank", F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("text").alias("parent_text"), F.col("score").alias("orig_score"),
        (1.0 / (60 + F.col("rank"))).alias("rrf_score"), F.lit(None).cast("string").alias("source_query"),
    )
    return _items(spark, d).withColumnRenamed("text", "query"), written(hits, "hits")  # read several times


def _sql_fold(c: str) -> str:
    from marlstone.functions.translit import FOLDS

    for spelling, sound in FOLDS:
        c = f"replace({c}, '{spelling}', '{sound}')"
    return c


def _sql_content(c: str) -> str:
    """Content words of a text in Latin letters, which are their own Latin form."""
    from marlstone.operators.rerank import SOUNDS, STOP

    quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
    return f"list_distinct(list_filter({_TOKENS.format(c)}, lambda t: length(t) > 1 AND t NOT IN ({quoted(STOP)}) AND {_sql_fold('t')} NOT IN ({quoted(SOUNDS)})))"


@query(
    _BM25 + f"""k AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0),
u AS (SELECT k.qid, k.doc_id::VARCHAR AS chunk_id, k.score, k.rank, d.text, i.text AS query, {_HASH.format('d.text')} AS h FROM k JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = k.qid WHERE rank <= 20),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, CASE WHEN trim(text) = '' THEN chunk_id ELSE substr(h, 1, 16) END ORDER BY rank, chunk_id) = 1),
w AS (SELECT *, {_sql_content('query')} AS qw, {_sql_content("(text || ' ' || text)")} AS dw,
        list_distinct(list_transform(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z]{{2,}}')), lambda x: lower(x))) AS names, lower(text || ' ' || text) AS low FROM f),
x AS (SELECT qid, chunk_id, rank AS was, round(round(CASE WHEN len(qw) > 0 AND len(dw) > 0 THEN len(list_intersect(qw, dw)) / len(qw) ELSE 0 END
        + CASE WHEN score > 0 AND score <= 1.5 THEN 0.2::DOUBLE * score ELSE 0 END + 0.15::DOUBLE * (1.0::DOUBLE / (60 + rank))
        + 1.25::DOUBLE * CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda x: contains(low, x))) / len(names) ELSE 0 END, 8), 6) AS rerank_score FROM w),
z AS (SELECT qid, chunk_id, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, was, chunk_id) AS rank FROM x)
SELECT * FROM z WHERE rank <= 5"""
)
def rerank_topk(spark, d):
    """Scores to 6 digits; the items are in Latin letters, so nothing is compared by sound."""
    from pyspark.sql import Window

    from marlstone.operators.rerank import rerank

    questions, hits = _hits(spark, d)
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "was", "chunk_id")
    out = rerank(questions, hits, 20).withColumn("rerank_score", F.round("rerank_score", 6)).join(hits.select("qid", "chunk_id", F.col("rank").alias("was")), ["qid", "chunk_id"])
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").drop("was")


@query()
def coverage_refusals(spark, d):
    from marlstone.operators.rerank import refusals

    return refusals(*_hits(spark, d))


_SLIDE = """SELECT doc_id, i - 1 AS chunk_no, CASE WHEN len(s) <= 3 THEN array_to_string(s, ' ') ELSE array_to_string(s[i:i + 2], ' ') END AS chunk
FROM (SELECT doc_id, s, unnest(range(1, greatest(len(s) - 1, 2))) AS i FROM (SELECT doc_id, {0} AS s FROM c) WHERE len(s) > 0)""".format(_SENTS.format("text"))


@query(
    f"""WITH c AS (SELECT doc_id, lang, {_CLEAN.format('text')} AS text FROM documents WHERE length({_CLEAN.format('text')}) >= 40),
p AS ({_PACK.replace('FROM documents', 'FROM c')}), m AS ({_MERGE.replace('FROM documents', 'FROM c')}), s AS ({_SLIDE}),
u AS (SELECT doc_id, 0 AS s_no, chunk_no, 'semantic' AS kind, chunk FROM p UNION ALL SELECT doc_id, 1, chunk_no, 'parent_child', chunk FROM m
      UNION ALL SELECT doc_id, 2, chunk_no, 'sentence', chunk FROM m UNION ALL SELECT doc_id, 3, chunk_no, 'sliding', chunk FROM s),
n AS (SELECT u.*, lang || ':' || doc_id || ':p0:english' || CASE kind WHEN 'parent_child' THEN '::c' || chunk_no || ':parent_child' ELSE ':' || kind || ':' || chunk_no END AS chunk_id FROM u JOIN c USING (doc_id))
SELECT doc_id AS query_id, arg_min(chunk_id, s_no * 1000000 + chunk_no) AS chunk_id, string_agg(DISTINCT kind, '+' ORDER BY kind) AS chunk_type,
       arg_min(chunk, s_no * 1000000 + chunk_no) AS text FROM n GROUP BY doc_id, {_HASH.format('chunk')}"""
)
def compact_index_chunks(spark, d):
    """The whole table's chunks, without a limit."""
    return _chunks(_records(table(spark, d, "documents"))).select("query_id", "chunk_id", "chunk_type", "text")


def _records(docs: DataFrame) -> DataFrame:
    """Documents as records of one passage."""
    from marlstone.operators import records as R

    texts = docs.select(F.col("doc_id").alias("query_id"), F.lit("document").alias("query"), F.struct(F.array("text").alias("English_passages")).alias("passages"), "lang")
    return R.normalize(texts, F.col("lang"))


def _chunks(records: DataFrame) -> DataFrame:
    from marlstone.operators import records as R

    return R.compact_chunks(R.clean(records), ordered=False)


@query(
    f"WITH ch AS (SELECT chunk_id AS doc_id, chunk_type, text FROM ({ORACLE['compact_index_chunks']})), " + _BM25.replace("FROM documents", "FROM ch").removeprefix("WITH ")
    + """k AS (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s JOIN ch USING (doc_id)
  WHERE score > 0 AND list_contains(string_split(chunk_type, '+'), 'sliding')) SELECT qid, doc_id AS chunk_id, score AS orig_score, rank FROM k WHERE rank <= 5"""
)
def retrieve_of_kind(spark, d):
    """Benchmark items over the compact chunks: the best chunks of one kind, which several kinds at once may have."""
    from marlstone.operators.questions import retrieve
    from marlstone.operators.spans import ChunkIndex
    from marlstone.shared import bounded, fresh_path

    docs = table(spark, d, "documents")
    ix = ChunkIndex.build(_records(docs), fresh_path(spark, "chunk-index"), buckets=8)

    def chunks(ids: DataFrame) -> DataFrame:
        """Those of the documents that hits are of, whose numbers their ids have."""
        own = ids.select(F.regexp_extract("id", r"(?s)^.*:(-?\d+):p\d+:english:", 1).cast("long").alias("doc_id")).distinct()
        # written, or the texts of all would be cleaned before the join
        return _chunks(_records(written(docs.join(bounded(own), "doc_id", "left_semi"), "hit-documents"))).withColumnRenamed("chunk_id", "doc_id")

    asked = _items(spark, d).withColumn("languages", F.lit(None).cast("array<string>"))
    return retrieve(ix, chunks, asked, 5, chunk_type="sliding").select("qid", "chunk_id", "orig_score", "rank")


_PROFILE = r"(' ' || trim(regexp_replace(lower({0}), '\s+', ' ', 'g')) || ' ')"
_GRAMS = "SELECT {0}, o, substr(p, i, o) AS gram, count(*) AS n FROM (SELECT {0}, p, o, unnest(range(1, length(p) - o + 2)) AS i FROM {1}, (VALUES (1), (2), (3)) v(o) WHERE length(p) >= o) GROUP BY ALL"


@query(
    f"""WITH a AS (SELECT lang, text, sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - length(text) AS before FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
t AS (SELECT lang, {_PROFILE.format('text')} AS p FROM a WHERE before < 60000 AND lang IN (SELECT lang FROM a WHERE before < 60000 GROUP BY 1 HAVING sum(length(text)) >= 400)),
g AS ({_GRAMS.format('lang', 't')}), z AS (SELECT lang, o, sum(n) AS t, count(*) AS v FROM g GROUP BY 1, 2),
m AS (SELECT lang, o, gram, ln((n + 0.5) / (t + 0.5 * (v + 1))) AS logp FROM g JOIN z USING (lang, o)),
f AS (SELECT lang, o, ln(0.5 / (t + 0.5 * (v + 1))) AS floor FROM z),
q AS (SELECT item_id AS qid, {_PROFILE.format("coalesce(text, '')")} AS p FROM benchmark),
h AS ({_GRAMS.format('qid', '(SELECT * FROM q WHERE length(p) >= 20)')}), tt AS (SELECT qid, o, sum(n) AS t FROM h GROUP BY 1, 2),
s AS (SELECT qid, lang, o, sum(n * logp) AS s, sum(n) AS m FROM h JOIN m USING (o, gram) GROUP BY 1, 2, 3),
e AS (SELECT qid, lang, (coalesce(s, 0) + (t - coalesce(m, 0)) * floor) / t AS mean FROM tt JOIN f USING (o) LEFT JOIN s USING (qid, lang, o)),
r AS (SELECT qid, lang, round(avg(mean), 9) AS score FROM e GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS nx FROM r WINDOW w AS (PARTITION BY qid ORDER BY score DESC, lang))
SELECT q.qid, k.lang, round(score - nx, 6) AS margin FROM q LEFT JOIN k ON k.qid = q.qid AND rk = 1 AND nx IS NOT NULL"""
)
def ngram_language(spark, d):
    """Models learnt from ``documents.lang``, asked of the benchmark items."""
    from marlstone.operators import languages as L

    out = L.predict(_items(spark, d), L.fit(table(spark, d, "documents").select("lang", "text", "doc_id"), "doc_id"))
    return out.withColumn("margin", F.round("margin", 6))


@query(
    _BM25 + f"""w AS (SELECT item_id AS qid, {_TOKENS.format('text')} AS toks, CASE item_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'xx' END AS want FROM benchmark),
o AS (SELECT qid, toks, CASE WHEN want IN (SELECT lang FROM documents) THEN want END AS wl FROM w),
x AS (SELECT o.qid, d.doc_id FROM o JOIN documents d ON wl IS NULL OR d.lang = wl JOIN benchmark b ON b.item_id = d.doc_id
      WHERE {_TOKENS.format('b.text')} = toks AND len(toks) > 0),
v AS (SELECT s.qid, s.doc_id, s.score FROM s JOIN o USING (qid) JOIN documents USING (doc_id) WHERE wl IS NULL OR lang = wl),
m AS (SELECT qid, doc_id, v.score, x.doc_id IS NOT NULL AS exact FROM v FULL JOIN x USING (qid, doc_id)),
z AS (SELECT qid, doc_id, exact, CASE WHEN exact THEN greatest(coalesce(score, 0), 1.0) ELSE score END AS score FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE score END DESC, doc_id) AS rank FROM z WHERE exact OR score > 0)
SELECT qid, doc_id, score, rank, exact FROM k WHERE rank <= 5"""
)
def bm25_search(spark, d):
    """Benchmark items over the stored index: wanted languages (one that the corpus lacks for some), exact source questions first."""
    want = F.when(F.col("qid") % 3 == 0, F.array(F.lit("fr"))).when(F.col("qid") % 3 == 1, F.array(F.lit("xx")))
    return _index(spark, d).search(_items(spark, d).withColumn("languages", want), 5)


@query(
    f"""WITH x AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
y AS (SELECT a.conv_id, a.turn, a.text AS answer, x.text AS context FROM conversations a JOIN x ON x.conv_id = a.conv_id AND a.turn = x.turn + 1 WHERE a.role = 'assistant'),
w AS (SELECT conv_id, turn, answer, {_sql_words('answer', A.GROUNDING_STOP)} AS a, {_sql_words('context', A.GROUNDING_STOP)} AS c FROM y),
v AS (SELECT *, CASE WHEN trim(coalesce(answer, ''), chr(9) || chr(10) || chr(13) || ' ') IN ('', '{A.REFUSAL.replace("'", "''")}') THEN 1.0::DOUBLE
   WHEN len(a) > 0 AND len(c) > 0 THEN len(list_intersect(a, c)) / len(a) ELSE 0 END AS o FROM w)
SELECT conv_id || ':' || turn AS qid, o >= 0.22 AS grounded, round(o, 6) AS overlap, CASE WHEN o >= 0.22 THEN answer ELSE '{A.REFUSAL.replace("'", "''")}' END AS answer FROM v"""
)
def grounding_verify(spark, d):
    c = table(spark, d, "conversations")
    x = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    y = c.where("role = 'assistant'").join(x, ["conv_id", "turn"])
    y = y.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), "text", "asked")
    hits = y.select("qid", F.lit(1).alias("rank"), F.col("asked").alias("text"), F.lit(None).cast("string").alias("parent_text"))
    return A.verify(y.select("qid", F.col("text").alias("answer")), hits)


@query()
def question_answers(spark, d):
    """The whole path for the benchmark items and the questions that expect no answer."""
    from marlstone.operators.questions import answer

    items = _items(spark, d).select(F.col("qid").cast("string").alias("qid"), "text")
    bad = spark.createDataFrame([(f"a{i}", q) for i, q in enumerate(A.ADVERSARIAL)], "qid string, text string")
    asked = items.unionByName(bad).withColumns({"forced": F.lit(None).cast("string"), "hint": F.lit(None).cast("string")})
    return answer(_index(spark, d), table(spark, d, "documents").select("doc_id", "text"), asked).drop("sources")


_LATIN = "abcdefghijklmnopqrstuvwxyz"
#: A Devanagari letter for each of _LATIN, of which six are two Latin letters each; Gujarati has the same ones 0x180 further on.
_NAGARI = "अबचदएफगहइजकलमनओपखरसतउवभझयश"
_GUJARATI = "".join(chr(ord(c) + 0x180) for c in _NAGARI)


def _spelt(c, letters: str):
    """A text with its letters a to z of either case in another script, letter by letter; all else stays."""
    return F.translate(c, _LATIN + _LATIN.upper(), letters * 2)


def _sql_spelt(c: str, letters: str) -> str:
    return f"translate({c}, '{_LATIN + _LATIN.upper()}', '{letters * 2}')"


def _sql_roman(c: str) -> str:
    c = f"translate({c}, '{_NAGARI + _GUJARATI}', '{_LATIN * 2}')"
    for letter, sound in zip("cfqwxz", ("ch", "ph", "kh", "bh", "jh", "sh"), strict=True):
        c = f"replace({c}, '{letter}', '{sound}')"
    return c


_BONES = _sql_fold("translate({0}, 'vwyh', '')")


@query(
    f"WITH nd AS (SELECT doc_id, lang, {_sql_spelt('text', _NAGARI)} AS text FROM documents), nb AS (SELECT item_id, {_sql_spelt('text', _GUJARATI)} AS text FROM benchmark), "
    + _BM25[: _BM25.index("q AS (")].replace("FROM documents", "FROM nd").removeprefix("WITH ")
    + f"""o AS (SELECT item_id AS qid, unnest({_TOKENS.format('text')}) AS term FROM nb),
va AS (SELECT term AS native, {_sql_roman('term')} AS roman FROM i WHERE regexp_matches(term, '[^\x00-\x7F]')),
vo AS (SELECT *, {_BONES.format('roman')} AS bones FROM va WHERE length(roman) >= 3),
qa AS (SELECT DISTINCT qid, {_sql_roman('term')} AS wr FROM o WHERE length(term) >= 3 AND regexp_matches(term, '[^\x00-\x7F]')),
qb AS (SELECT *, {_BONES.format('wr')} AS ws FROM qa),
qc AS (SELECT *, unnest(CASE WHEN ws = '' THEN [] WHEN right(ws, 1) IN ('a', 'e', 'i', 'o', 'u') THEN [ws, left(ws, length(ws) - 1)]
  ELSE [ws, ws || 'a', ws || 'e', ws || 'i', ws || 'o', ws || 'u'] END) AS bones FROM qb),
m AS (SELECT qid, native, length(roman) AS n, CASE WHEN wr = roman THEN 1.0 WHEN ws = v.bones THEN 0.95 WHEN left(wr, 1) = left(roman, 1) THEN 0.9 END AS near
  FROM qc JOIN vo v ON v.bones = qc.bones AND v.bones <> '' WHERE greatest(length(wr), length(roman)) <= 2 * least(length(wr), length(roman)) AND abs(length(wr) - length(roman)) <= 3),
e AS (SELECT qid, native, row_number() OVER (PARTITION BY qid ORDER BY max(near) DESC, max(n) DESC, native) AS r FROM m WHERE near IS NOT NULL GROUP BY 1, 2),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, term FROM o UNION ALL SELECT qid, native FROM e WHERE r <= 8) GROUP BY 1, 2),
""" + _BM25[_BM25.index("s AS (SELECT qid") :]
    + """k AS (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s JOIN documents USING (doc_id)
  WHERE score > 0 AND CASE WHEN qid % 2 = 0 THEN lang = 'fr' ELSE lang IN ('en', 'de') END) SELECT * FROM k WHERE rank <= 5"""
)
def cross_script_search(spark, d):
    """All documents spelt in one script and searched with the benchmark items spelt in another: words meet by sound only."""
    return _cross_script(spark, d)[1].select("qid", "doc_id", "score", "rank")


def _cross_script(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions in one script, their five best documents in another, and those documents' texts."""
    docs = table(spark, d, "documents").select("doc_id", _spelt("text", _NAGARI).alias("text"), F.col("lang").alias("language"))
    asked = _items(spark, d).select("qid", _spelt("text", _GUJARATI).alias("text"))
    want = F.when(F.col("qid") % 2 == 0, F.array(F.lit("fr"))).otherwise(F.array(F.lit("en"), F.lit("de")))
    return asked, _stored(spark, d, "nagari", lambda: docs).search(asked.withColumn("languages", want), 5), docs


@query()
def cross_script_refusals(spark, d):
    """Whether those documents cover the questions, and in which order: all content words are compared by sound."""
    from marlstone.operators.rerank import refusals, rerank

    asked, found, docs = _cross_script(spark, d)
    hits = written(_with_texts(found, docs.select("doc_id", "text")).select(
        "qid", "rank", F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("text").alias("parent_text"), F.lit(0.0).alias("orig_score"), F.lit(0.0).alias("rrf_score"),
        F.lit(None).cast("string").alias("source_query"),
    ), "hits")
    questions = asked.withColumnRenamed("text", "query")
    best = rerank(questions, hits, 1).select("qid", "chunk_id", "rerank_score")
    return refusals(questions, hits).join(best, "qid", "left")


def flagship(spark, sf_dir: str):
    return QUERIES["rag_answer_batch"](spark, sf_dir)
