"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Comparing MinHash signatures of whole documents with those of short items fails for long documents: their Jaccard
similarity is near zero. The containment form of MinHash sketches only the small side and asks whether the large side
holds the sketched shingles. Items are partitioned by their number of shingles, in classes from a power of two up to
the next; a class sketches each item by its smallest hashes, floor((1 - t) * u) + 1 of them for the class's upper bound
u. A document that holds the share t of an item lacks at most floor((1 - t) * n) of its shingles, so it holds one of the
sketch at least: the search loses nothing. Documents of fewer shingles than an item needs are pruned by size.
Candidates are then verified on the shingles' words themselves. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bind, bounded, free_names, fresh_path, scratch, written

WIDTH, THRESHOLD = 5, 0.8
#: What lies between words: ASCII but its letters and digits, and the blanks, dashes and quotes beyond it.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\u00A0-\u00BF\u2000-\u206F\u3000-\u303F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def shingles(w: Column, width: int, make, kind: str) -> Column:
    """array<kind> of ``make`` over each run of ``width`` words of the array ``w``; empty where there are fewer."""
    at = lambda ws: F.sequence(F.lit(1), F.size(ws) - (width - 1))
    each = lambda ws: F.transform(at(ws), lambda i: make([F.element_at(ws, i + k) for k in range(width)]))
    return bind(w, lambda ws: F.when(F.size(ws) >= width, each(ws)).otherwise(F.array().cast(f"array<{kind}>")))


def hashed_shingles(docs: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(``keep``, n, h): a row for each run of a number of words in ``sizes`` of ``docs`` (text); n counts the text's words.

    Words, the words after them and so on stand beside each other in one array of structs, which is dealt out before
    anything is hashed: the hashing then is compiled code over rows, not a function called for each element.
    """
    most = max(sizes)
    cut = docs.select(*keep, words(F.col("text")).alias("ws"))
    beside = F.arrays_zip(*[(F.col("ws") if k == 0 else F.slice("ws", k + 1, F.greatest(F.size("ws"), F.lit(1)))).alias(f"w{k}") for k in range(most)])
    rows = cut.select(*keep, F.size("ws").alias("n"), beside.alias("z")).select(*keep, "n", F.explode_outer("z").alias("z")).select(*keep, "n", *[F.col(f"z.w{k}") for k in range(most)])
    hashed = [F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*[f"w{i}" for i in range(k)])) for k in sizes]
    rows = rows.select(*keep, "n", (hashed[0] if len(sizes) == 1 else F.explode(F.array(*hashed))).alias("h"))
    return rows.where("h IS NOT NULL")


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _both(parts: list[Column]) -> Column:
    return F.struct(F.xxhash64(*parts).alias("h"), _joined(parts).alias("s"))


def item_sets(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, list[int]]:
    """(item_id, set_id, k, sh): each item's distinct shingles (h, s) of k words, sorted by hash; and the k that occur."""
    it = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    it = written(it.withColumn("k", F.least(F.size("w"), F.lit(width))), "itemwords")
    sizes = sorted(r["k"] for r in it.select("k").distinct().collect())  # ``width`` values at most
    sh = F.array().cast("array<struct<h:bigint,s:string>>")
    for k in sizes:
        sh = F.when(F.col("k") == k, shingles(F.col("w"), k, _both, "struct<h:bigint,s:string>")).otherwise(sh)
    it = it.select("item_id", "k", F.array_sort(F.array_distinct(sh)).alias("sh"))
    return written(it.withColumn("set_id", F.sha2(F.to_json("sh"), 256)), "items"), sizes


def sketches(kinds: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(set_id, need, h): the least hashes of each distinct set, as many as its size class asks for."""
    n = F.size("sh").cast("double")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1  # of the class of sizes from a power of two to the next
    length = F.floor((1 - threshold) * upper + 1e-9) + 1
    sketch = F.slice(F.col("sh.h"), F.lit(1), F.least(n, length).cast("int"))
    return kinds.select("set_id", (F.ceil(threshold * n - 1e-9) + F.col("k") - 1).alias("need"), F.explode(sketch).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared, containment, text_key) where the document holds the share
    ``threshold`` or more of the item's distinct shingles of ``width`` words.

    Words are lower-cased runs of letters, digits and characters beyond ASCII. An item of fewer words than ``width`` is
    one shingle of all its words; an item without words matches nothing. Null texts have no words. Items of the same
    shingles are searched once and each reported, texts met in several rows are verified once; repeated rows give one
    pair. Null ids stay null. ``text_key`` tells apart texts that share a doc_id. Other columns are not used. A text of any
    length is read whole, a row for each of its shingles; empty tables on either side give an empty result.
    """
    it, sizes = item_sets(items, width)
    if not sizes:
        return it.select(
            F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", F.lit(0).alias("n_shingles"),
            F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment"), F.lit(b"").alias("text_key"),
        ).limit(0)
    kinds = it.groupBy("set_id").agg(F.first("k").alias("k"), F.first("sh").alias("sh"))
    sketch = bounded(written(sketches(kinds, threshold), "sketches"))

    key = F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key")
    d = docs.select("doc_id", "text", key).where("text IS NOT NULL")
    rows = hashed_shingles(d, sizes, "doc_id", "text_key")
    hits = rows.join(sketch, "h").where("n >= need").select("doc_id", "text_key", "set_id").distinct()
    hits = written(hits, "candidates")

    pairs = bounded(written(hits.select("text_key", "set_id").distinct(), "pairs"))
    texts = d.select("text_key", "text").join(bounded(hits.select("text_key").distinct()), "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = bounded(kinds.select("set_id", "k", F.col("sh.s").alias("sh")))
    there = F.array().cast("array<string>")
    for k in sizes:
        there = F.when(F.col("k") == k, shingles(words(F.col("text")), k, _joined, "string")).otherwise(there)
    proof = texts.join(pairs, "text_key").join(sets, "set_id").select(
        "text_key", "set_id", F.size("sh").alias("n_shingles"), F.size(F.array_intersect("sh", there)).alias("n_shared")
    ).where(F.col("n_shared") >= F.ceil(threshold * F.col("n_shingles") - 1e-9))
    proof = bounded(written(proof, "proof"))
    return hits.join(proof, ["text_key", "set_id"]).join(bounded(it.select("item_id", "set_id").distinct()), "set_id").select(
        "doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "text_key"
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs``, all its columns and rows, but for the texts that hold an item; null texts stay."""
    (mine,) = free_names(docs, "_text_key")
    path = fresh_path(docs.sparkSession, "bad")
    with scratch(docs.sparkSession):  # all else that is written on the way is deleted
        bad = contaminated(docs, items, threshold, width).select(F.col("text_key").alias(mine + "_bad")).distinct()
        bad.write.parquet(path)
    bad = bounded(docs.sparkSession.read.schema(bad.schema).parquet(path))
    rows = docs.withColumn(mine, F.unhex(F.md5(F.col("text").cast("binary"))))
    return rows.join(bad, F.col(mine) == F.col(mine + "_bad"), "left_anti").select(*docs.columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


OP1_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+') FROM benchmark WHERE text IS NOT NULL),
ks AS (SELECT DISTINCT least(len(ws), 5) AS k FROM w WHERE side = 'i' AND len(ws) > 0),
s AS (
  SELECT DISTINCT side, id, k, array_to_string(ws[i:i + k - 1], ' ') AS sh
  FROM (SELECT side, id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks
        WHERE len(ws) >= k AND (side = 'd' OR k = least(len(ws), 5)))),
n AS (SELECT id, count(*)::INT AS n_shingles FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n_shingles, count(*)::INT AS n_shared, count(*) / n_shingles AS containment
FROM s d JOIN s i ON d.side = 'd' AND i.side = 'i' AND d.k = i.k AND d.sh = i.sh JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n_shingles
HAVING count(*) >= ceil(0.8::DOUBLE * n_shingles - 1e-9)
"""
