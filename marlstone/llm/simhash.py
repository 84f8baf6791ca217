"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints that differ in at most 4 of 64 bits differ in at most one bit of one of three segments (22, 21 and 21
bits). Every fingerprint is indexed under its segments with one bit deleted, 64 variants in all, so such a pair meets
under an equal key; the join's own condition then verifies the distance, so no unverified pair leaves it.

Large groups of near copies never become all pairs. Fingerprints that agree outside one group of 4 neighbouring bits
are links by construction, so they are tied to the smallest of them first (16 keys each) and contracted. In a key's
bucket the most frequent of the contracted groups is never compared with itself: each remaining link has an end outside
it. Copies of one text share a fingerprint and count once.

Texts of high shingle similarity may differ in far more bits than segments can find, so ``keep_one`` can add an exact
set-similarity join: links between texts whose word shingles have a Jaccard similarity of 4/5 or more. Shingles have one
global order, frequent ones last (counted in a sample, which touches speed only). Similar sets share a shingle among
the first n - ceil(4n/5) + 1 of each. The join's own condition has the length and positional filters and compares
sketches (the parities of shingles by hash class: those that differ bound the symmetric difference from below), folded to
256 bits; what it lets pass is held against the whole sketches and then verified on whole shingle sets. In a bucket all are first compared with one member only; what that links is
contracted before the remaining pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import shingles as S
from marlstone.llm.common import bounded, components, first_rows, free_names, fresh_path, released, scratch, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
WIDTH, SEED, MAX_DISTANCE, NIBBLE = 4, 42, 4, 4
BIG_GROUP = 16
SIMILAR_WIDTH = 5  # words of a shingle; the similarity asked for is SIMILAR[0] / SIMILAR[1]
SIMILAR = (4, 5)
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 3, 100_000  # one text of 8 is counted; shingles in 3 of those or more are frequent
SKETCH = 1024  # bits, a power of two


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 without words."""
    return int(S.fingerprints(S.words(pa.array([text], pa.string())), WIDTH, SEED)[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, fp) of ``docs`` (text, and the columns ``keep``): fp is a long of the fingerprint's 64 bits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(len(keep))
            fps = [S.fingerprints(S.words(text.slice(at, to - at)), WIDTH, SEED) for at, to in S.slices(text)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64())], [*keep, "fp"])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(of, rows.drop("text").schema.add("fp", "long"))


def _certain_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints equal outside one aligned group of 4 bits: a star for each key."""
    group = F.explode(F.sequence(F.lit(0), F.lit(64 // NIBBLE - 1)))
    keyed = fps.select("fp", group.alias("g")).selectExpr(
        "g", f"fp & ~shiftleft({2**NIBBLE - 1}L, {NIBBLE} * g) AS base",
        f"CAST(shiftrightunsigned(fp, {NIBBLE} * g) & {2**NIBBLE - 1} AS INT) AS part",
    )
    members = keyed.groupBy("g", "base").agg(F.expr("bit_or(shiftleft(1, part))").alias("parts")).where("bit_count(parts) > 1")
    there = F.expr(f"filter(sequence(0, {2**NIBBLE - 1}), p -> (shiftright(parts, p) & 1) = 1)")
    star = members.withColumn("there", there).selectExpr("g", "base", "there[0] AS first", "explode(slice(there, 2, 16)) AS part")
    return star.selectExpr(f"base | shiftleft(CAST(part AS BIGINT), {NIBBLE} * g) AS a", f"base | shiftleft(CAST(first AS BIGINT), {NIBBLE} * g) AS b")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp, grp, many): each fingerprint under its 64 one-bit deletions; key holds the segment less the bit, and the bit."""
    keys = [
        f"transform(sequence(0, {n - 1}), j -> (((shiftrightunsigned(fp, {at}) & {2**n - 1}) & ~shiftleft(1L, j)) * 64) + {at} + j)"
        for at, n in SEGMENTS
    ]
    return fps.selectExpr(f"explode(concat({', '.join(keys)})) AS key", "fp", "grp", "many")


def link_components(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, label) of distinct fingerprints ``fps`` (fp): label is one fingerprint of those reachable over links.

    ``max_distance`` may be 0 to 4, what three segments with one deletion bring together for certain; at 0 to 3, where
    4 neighbouring bits could be too many, only the verified links count.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("three segments and one deletion find distances up to 4")
    near = components(_certain_links(fps)) if max_distance >= NIBBLE else None
    grp = fps.select("fp", F.col("fp").alias("grp")) if near is None else fps.join(
        near.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("grp"))
    big = grp.groupBy("grp").count().where(f"count >= {BIG_GROUP}").select("grp", F.lit(True).alias("many"))
    grp = written(grp.join(big, "grp", "left").select("fp", "grp", F.coalesce("many", F.lit(False)).alias("many")), "groups")

    rows = _variants(grp)
    of_key = _variants(grp.where("many")).groupBy("key", "grp").count().groupBy("key").agg(F.expr("max_by(grp, count)").alias("main"))
    of_key = bounded(written(of_key, "of-key"))
    one = rows.join(of_key, "key", "left").where("main IS NULL OR grp <> main").select(
        "key", F.expr("key % 64").alias("bit"), F.col("fp").alias("p"), F.col("grp").alias("pg"), "main"
    )
    two = rows.select("key", F.col("fp").alias("q"), F.col("grp").alias("qg"))
    # a pair meets under many keys; it is taken under the first: the bit that differs in the first segment with one at most
    at = "coalesce(" + ", ".join(
        f"CASE WHEN (p ^ q) & {m} = 0 THEN {at} WHEN bit_count((p ^ q) & {m}) = 1 THEN bit_count(((p ^ q) & {m}) - 1) END"
        for at, m in ((at, f"shiftleft({2**n - 1}L, {at})") for at, n in SEGMENTS)
    ) + ")"
    cond = (one["key"] == two["key"]) & F.expr(f"pg <> qg AND bit_count(p ^ q) <= {max_distance} AND (p < q OR qg <=> main) AND bit = {at}")
    # Spark takes exploded rows for as small as the table they come from and would send 64 times that through the driver
    links = one.join(two.hint("merge"), cond).select(F.least("pg", "qg").alias("a"), F.greatest("pg", "qg").alias("b")).distinct()
    label = components(links)
    return grp.join(label.select(F.col("node").alias("grp"), "label"), "grp", "left").select("fp", F.coalesce("label", "grp").alias("label"))


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, text_key, fp, grp, component_id) for each row of ``docs`` (doc_id, text)."""
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"))
    seen = written(fingerprints(keyed, "doc_id", "text_key"), "fingerprints")
    first = written(seen.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = written(link_components(first.select("fp"), max_distance), "found")
    named = written(found.join(first, "fp"), "named")
    # only labels of several fingerprints have another smallest id; a large component is one row of theirs
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    of_fp = named.join(bounded(written(lowest, "lowest")), "label", "left").select("fp", F.col("label").alias("grp"), F.coalesce("component_id", "first").alias("component_id"))
    of_fp = written(of_fp, "components")
    return seen.join(of_fp, "fp").select("doc_id", "text_key", "fp", "grp", "component_id")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part and get their
    component's smallest doc_id that is not null (null if there is none). Repeated rows each come back. Other columns
    of ``docs`` are not used. An empty table gives an empty result.
    """
    out = groups(docs, max_distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, S.Words]]:
    """(ids, words) of some rows (id, text) at a time."""
    for b in batches:
        for at, to in S.slices(b.column(1), 1 << 20):  # half the default: working memory counts where joins run beside
            part = b.slice(at, to - at)
            yield part.column(0), S.words(part.column(1))


def _marks(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """(id, fp, n, prefix, sketch) of ``texts`` (id, text), each read once: SimHash, number n of distinct shingles, the
    first n - ceil(4n/5) + 1 of them in global order, and the parity sketch."""
    known, times = frequent
    may = np.zeros(1 << 22, bool)  # by a key's last bits: whether it may be a frequent one
    may[known & (len(may) - 1)] = True

    def ordered(x: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(may[x & (len(may) - 1)])
        if not len(hit):
            return x
        seen = np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(known, x[hit]), len(known) - 1)
        seen[hit] = np.where(known[at] == x[hit], times[at], 0)
        return x[np.argsort(seen, kind="stable")]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in _texts(batches):
            ns, prefixes, sketches = [], [], []
            for x in S.shingle_keys(w, width):
                sketches.append(np.packbits(np.bincount(x & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1).view(np.int64))
                prefixes.append(ordered(x)[: len(x) - -(-SIMILAR[0] * len(x) // SIMILAR[1]) + 1])
                ns.append(len(x))
            fps = pa.array(S.fingerprints(w, WIDTH, SEED).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, fps, pa.array(ns, pa.int32()), _lists(prefixes), _lists(sketches)], ["id", "fp", "n", "prefix", "sketch"])

    return texts.select("id", "text").mapInArrow(mark, "id long, fp long, n int, prefix array<long>, sketch array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, keys): the shingle keys of ``texts`` (id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, _lists(S.shingle_keys(w, width))], ["id", "keys"])

    return texts.select("id", "text").mapInArrow(cut, "id long, keys array<long>")


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ascending, and their counts) of the shingles that several texts of a sample hold."""
    some = _sets(texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), width).select(F.explode_outer("keys").alias("key"))
    count = some.groupBy("key").count().where(f"key IS NOT NULL AND count >= {FREQUENT}").orderBy(F.desc("count"), "key").limit(MOST_FREQUENT)
    got = count.toPandas().sort_values("key")  # MOST_FREQUENT rows at most
    return got["key"].to_numpy(np.int64), got["count"].to_numpy(np.int64)


#: A sketch folded to 256 bits, which rows carry into joins: classes that fall together add up, so their parities do.
_FOLDED = [" ^ ".join(f"sketch[{i}]" for i in range(k, SKETCH // 64, 4)) + f" AS s{k}" for k in range(4)]


def _near(p: str, q: str) -> str:
    """Whether the folded sketches and numbers of shingles, with these prefixes to their names, allow the similarity."""
    a, b = SIMILAR
    apart = " + ".join(f"bit_count({p}s{k} ^ {q}s{k})" for k in range(4))
    return f"({apart}) * {a + b} <= ({p}n + {q}n) * {b - a}"


def _verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Those of ``pairs`` (p, pg, q, qg) whose texts' shingles have the similarity asked for.

    Sketches come first: bits that differ stand for one shingle at least that only one of the texts has, and similar
    texts have few of those. What is left is verified on whole shingle sets.
    """
    a, b = SIMILAR
    pairs = written(pairs, "candidates")

    def ids(rows: DataFrame) -> DataFrame:
        return bounded(written(rows.select(F.explode(F.array("p", "q")).alias("id")).distinct(), "ids"))

    def sides(rows: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        for end in ("p", "q"):
            rows = rows.join(of.select(F.col("id").alias(end), *[F.col(c).alias(end + c) for c in columns]), end)
        return rows

    apart = "aggregate(zip_with(psketch, qsketch, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = sides(pairs, bounded(marks.join(ids(pairs), "id", "left_semi").select("id", "n", "sketch")), "n", "sketch").where(f"{apart} * {a + b} <= (pn + qn) * {b - a}").select("p", "pg", "q", "qg")
    near = written(near, "near")
    whole = bounded(written(_sets(texts.join(ids(near), "id", "left_semi"), width), "sets"))
    both = f"size(array_intersect(pkeys, qkeys)) * {a + b} >= {a} * (size(pkeys) + size(qkeys))"
    return sides(near, whole, "keys").where(both).select("pg", "qg")


def similar_components(texts: DataFrame, marks: DataFrame, groups_of: DataFrame, width: int = SIMILAR_WIDTH) -> DataFrame:
    """(grp, label) of the groups in ``groups_of`` (id, grp) that links between similar texts join to others.

    ``texts`` (id, text) has each text once. Groups are kept whole; label is one of those reachable over texts with a
    shingle similarity of 4/5 or more.
    """
    a, b = SIMILAR
    fits = f"n * {b} >= {a} * qn AND qn * {b} >= {a} * n AND least(n - place, qn - qplace) * {a + b} >= {a} * (n + qn)"

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one label."""
        keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return rows.join(bounded(written(keys, "keys"), 2_000_000), "key", "left_semi")  # 8 bytes each

    rows = marks.join(bounded(groups_of), "id").select("id", "n", F.col("grp").alias("label"), F.posexplode_outer("prefix").alias("place", "key")).where("key IS NOT NULL")
    met = written(mixed(rows).withColumnRenamed("label", "grp"), "met")
    moved = groups_of.select("grp", F.col("grp").alias("label")).limit(0)
    released(marks.sparkSession)

    def now() -> DataFrame:
        return met.join(bounded(moved), "grp", "left").select("key", "id", "n", "place", F.coalesce("label", "grp").alias("label"))

    def contracted(links: DataFrame) -> DataFrame:
        reached = components(links.select(F.col("pg").alias("a"), F.col("qg").alias("b")))
        old = moved.join(reached.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("grp", F.coalesce("to", "label").alias("label"))
        new = reached.select(F.col("node").alias("grp"), "label").join(moved.select("grp"), "grp", "left_anti")
        return written(old.unionByName(new), "moved")

    folded = bounded(written(marks.selectExpr("id", "n", *_FOLDED), "folded"))
    # one member a bucket, by two orders: a large group of near copies becomes one label here
    for seed in (1, 2):
        rows = now()
        hubs = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id", "n", "place", "label")).alias("hub"))
        star = rows.join(hubs, "key").select(
            F.col("id").alias("p"), F.col("label").alias("pg"), "n", "place", F.col("hub.id").alias("q"), F.col("hub.label").alias("qg"),
            F.col("hub.n").alias("qn"), F.col("hub.place").alias("qplace"),
        )
        star = star.where("pg <> qg").where(fits).select("p", "pg", "q", "qg").distinct()
        for end in ("p", "q"):
            star = star.join(folded.withColumnsRenamed({c: end + c for c in folded.columns if c != "id"}).withColumnRenamed("id", end), end)
        # one hub for each text, the first by the same order that its sketch allows; other pairs are left to the last comparison
        star = star.where(_near("p", "q")).groupBy("p").agg(F.min(F.struct(F.xxhash64("q", F.lit(seed)).alias("h"), "pg", "q", "qg")).alias("x")).select("p", "x.pg", "x.q", "x.qg")
        moved = contracted(_verified(star, marks, texts, width))
        released(marks.sparkSession)
    rows = written(mixed(now()).join(folded.drop("n"), "id"), "left")
    # a bucket's most frequent label is never compared with itself: each pair has an end outside it
    main = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", "count").alias("main"))
    one = rows.join(main, "key").where("label <> main").select("key", "main", F.col("id").alias("p"), F.col("label").alias("pg"), "n", "place", *[F.col(f"s{k}").alias(f"ps{k}") for k in range(4)])
    two = rows.select("key", F.col("id").alias("q"), F.col("label").alias("qg"), F.col("n").alias("qn"), F.col("place").alias("qplace"), *[F.col(f"s{k}").alias(f"qs{k}") for k in range(4)])
    close = _near("p", "q").replace("(pn + qn)", "(n + qn)")
    pairs = one.join(two.hint("merge"), (one["key"] == two["key"]) & F.expr(f"pg <> qg AND (p < q OR qg = main) AND {fits} AND {close}")).select("p", "pg", "q", "qg").distinct()
    moved = contracted(_verified(pairs, marks, texts, width))
    released(marks.sparkSession)
    return moved


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE, similar: bool = False, width: int = SIMILAR_WIDTH) -> DataFrame:
    """``docs``, all its columns, with one row of each component: that of the smallest doc_id, then text hash.

    With ``similar`` texts whose shingles of ``width`` words have a Jaccard similarity of 0.8 or more are linked as well,
    at whatever distance their fingerprints are. Null and empty texts are one text without words. Null doc_ids come
    last. Of rows with the same doc_id and text that of the smallest hash of all its columns stays. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(whole.cast("binary")))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    mine, other, hashed = free_names(docs, "_id", "_key", "_text_key")
    path = fresh_path(spark, "gone")
    with scratch(spark):  # all else that is written on the way is deleted
        seen = docs.select("doc_id", key.alias("text_key"))
        if similar:
            texts = written(docs.groupBy(whole.alias("text")).agg(F.lit(1).alias("_")).select(F.monotonically_increasing_id().alias("id"), "text"), "texts")
            marks = written(_marks(texts, _frequent(texts, width), width), "marks")
            found = written(link_components(marks.select("fp").distinct(), max_distance), "found")
            released(spark)
            of = written(marks.select("id", "fp").join(bounded(found), "fp").select("id", F.col("label").alias("grp")), "groups-of")
            label = bounded(similar_components(texts, marks, of, width))
            of = of.join(label, "grp", "left").select("id", F.coalesce("label", "grp").alias("grp"))
            of = written(texts.select("id", key.alias("text_key")).join(of, "id").select("text_key", "grp"), "grouped-texts")
            seen = written(seen.join(bounded(of), "text_key").select("grp", rank.alias("rank")), "grouped")
        else:
            seen = written(groups(docs, max_distance).select("grp", rank.alias("rank")), "grouped")
        # only groups of several rows lose any; a large group is one row of theirs
        best = seen.groupBy("grp").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
        gone = seen.join(bounded(written(best, "best")), "grp").where("rank <> best").select("rank.doc_id", "rank.text_key").distinct()
        gone.select(F.col("doc_id").alias(mine), F.col("text_key").alias(other)).write.parquet(path)
        repeated = not seen.groupBy("rank").count().where("count > 1").isEmpty()
    gone = bounded(spark.read.schema(docs.select(F.col("doc_id").alias(mine), key.alias(other)).schema).parquet(path))
    rows = docs.withColumn(hashed, key)
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(hashed) == F.col(other)), "left_anti")
    if repeated:
        rows = first_rows(rows, ["doc_id", hashed])
    return rows.select(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
