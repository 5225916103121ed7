"""Every registered query against its SQL twin, on the smallest tables."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from iolens.operators.metadata import neighbours
from iolens.plans.queries import QUERIES, SQL, log

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(x[names.index(c)] for c in cols)) for x in r.fetchall())


def test_long_texts_are_stitched(spark):
    """Documents of more than 4096 characters are in the result, with their own digest."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(len(t or "") > 4096 for t in docs.values()) > 20
    got = {r.seq: r.content for r in QUERIES["stitched_texts"](spark, SF).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in docs.items() if t}


def test_neighbours_of_all_blocks(spark):
    """Every block of the log has a row, also those divisible by 5, and meets its neighbours."""
    seen = {(r.vol, r.blk): r.seen for r in log(spark, SF).groupBy("vol", "blk").agg(F.max("seq").alias("seen")).collect()}
    got = {(r.vol, r.blk): (r.seen, r.prev_seen, r.next_seen) for r in QUERIES["block_neighbours"](spark, SF).collect()}
    assert any(b % 5 == 0 for _, b in got)
    assert got == {(v, b): (s, seen.get((v, b - 1)), seen.get((v, b + 1))) for (v, b), s in seen.items()}


def test_neighbours_over_gaps(spark):
    b = spark.createDataFrame([(0, 4, 10), (0, 5, 11), (0, 7, 12), (1, 6, 13), (1, 7, 14)], "vol int, blk long, seen long")
    got = sorted(tuple(r) for r in neighbours(b, ("seen",)).select("vol", "blk", "prev_seen", "next_seen").collect())
    assert got == [(0, 4, None, 11), (0, 5, 10, None), (0, 7, None, None), (1, 6, None, 14), (1, 7, 13, None)]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
