"""Running sums over a whole table."""

from pyspark.sql import functions as F

from marlstone.shared import running_sum

BIG = 2**53


def test_ids_beside_nulls_stay_exact(spark):
    rows = [(BIG + 1, "a", 3), (None, "a", 1), (BIG + 3, None, 4), (BIG + 5, "b", None), (BIG + 7, "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").coalesce(1)
    got = {(r.doc_id, r.source): r.upto for r in running_sum(df, ["source", "doc_id"], "size", "upto", within="source").collect()}
    assert got == {(BIG + 1, "a"): 3, (BIG + 7, "a"): 5, (None, "a"): 6, (BIG + 5, "b"): 0, (BIG + 3, None): 4}
    assert sorted(r.upto for r in running_sum(df, ["doc_id"], "size", "upto").collect()) == [3, 7, 7, 9, 10]


def test_sums_over_many_partitions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.s for r in running_sum(df, ["g", "id"], "v", "s", within="g").collect()}
    total = {}
    for i in range(5000):
        total[i % 3] = total.get(i % 3, 0) + i % 7
        assert got[i] == total[i % 3]
