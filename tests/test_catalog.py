"""Every query against the SQL it must agree with, on the smallest tables."""

import os

import pytest

from marlstone import catalog

TABLES = "documents embeddings events benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_admissions_keep_only_admitted(spark):
    from pyspark.sql import functions as F

    from marlstone.operators.limits import admissions

    times = [0.0, 1.0, 2.0, 60.0, 61.0, 61.5, 63.0]
    df = spark.createDataFrame([("a", t) for t in times], "ip string, t double")
    got = admissions(df, "ip", F.col("t"), 2, 60.0).first()
    recent, n = [], 0
    for t in times:
        recent = [r for r in recent if r >= t - 60]
        if len(recent) < 2:
            recent.append(t)
            n += 1
    assert (got["n_events"], got["n_admitted"]) == (7, n)


def test_entry_reads_without_training_operators():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
