import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from iolens.llm import queries as Q
from iolens.llm import vector_search as V
from iolens.llm.common import UNITS, sample_units, sampled


def brute(rows, asked, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in [(i, v) for i, v in ok if i in asked]:
        near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in ok if i != q)[:k]
        out[q] = near
    return out


def vectors(n=600, d=20):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, d))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.standard_normal((n - n // 2, d))
    x[100:160] = x[100]
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


ODD = [(700, None), (800, [0.0] * 20), (900, [float("nan")] + [1.0] * 19), (1000, [None] + [1.0] * 19), (None, [1.0] * 20), (1100, [float("inf")] * 20), (1200, [])]


@pytest.mark.parametrize("opts", [{"recall": None}, {"piece": 37, "block": 2, "lists": 5, "recall": None}, {"lists": 1, "sample_rows": 50}, {"lists": 20, "probe": 19}])
def test_against_brute_force(spark, opts):
    rows = vectors() + ODD
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in V.search(df, df.where("vec_id % 100 = 0"), k=10, **opts).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 10)
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.98 * sum(map(len, want.values()))
    exact = {(q, i): s for q, near in brute(rows, set(want), 10_000).items() for s, i in near}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12, abs_tol=1e-12) for q, near in got.items() for s, i in near)
    assert got[100] == want[100]  # sixty equal vectors: ties go to the smaller id


@pytest.mark.filterwarnings("ignore:.*take no part")
def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [2.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = V.search(df, df.where("vec_id = 0"), k=10).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 1.0)]
    assert V.search(df, df.limit(0)).count() == 0
    assert V.search(df.limit(0), df).count() == 0
    assert V.search(df.where("vec_id = 0"), df).where("query_id = 0").count() == 0


def test_estimates_and_bounds():
    rng = np.random.default_rng(3)
    x, q, c = rng.standard_normal((3000, 64)), rng.standard_normal(64), rng.standard_normal(64) / 8
    turn = V.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    est, low = (b[0] for b in V.Codes.of(x, c[None], turn).bounds(q[None], c, turn, V.EPSILON))
    true = V.exact(x, np.broadcast_to(q, x.shape)) ** 2
    assert (low <= true).mean() > 0.98 and abs((est - true).mean()) < 0.05 * true.mean()
    assert np.corrcoef(est, true)[0, 1] > 0.8


def test_registered_query_on_the_table(spark):
    """As registered, over the whole table: rows of the contract, exact scores and a recall of 0.95 at least."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = Q.op2_vector_search(spark, "/root/testdata/sf0.1").collect()
    want = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    at = dict(rows)
    assert len(got) == 10 * len(want) and {r.query_id for r in got} == set(want)
    assert all(r.score == float(np.sqrt(((np.array(at[r.vec_id], float) - np.array(at[r.query_id], float)) ** 2).sum())) or math.isclose(r.score, V.exact(np.array([at[r.vec_id]], float), np.array([at[r.query_id]], float))[0], rel_tol=1e-14) for r in got)
    hit = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_one_row_many_times(spark):
    """Copies of one row, id and all, spread over pieces, do not fill the sample, and each counts as a candidate."""
    base = spark.createDataFrame([(i, v) for i, v in vectors()[:80] + vectors()[333:334]], "vec_id long, embedding array<float>")
    hot = spark.range(3000).select(F.lit(33).cast("long").alias("vec_id"), F.array(*(F.lit(float(x)).cast("float") for x in vectors()[33][1])).alias("embedding"))
    df = base.union(hot)
    assert sampled(V.usable(df, "vec_id", "embedding"), 50).where("id = 33").count() <= 1
    got = V.search(df, base.where("vec_id in (0, 33, 333)"), piece=200, recall=None).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 33, 333)}
    assert 33 not in by[33] and len(by[33]) == 10 and by[333].count(33) == 10


def test_samples_never_vanish(spark):
    for rows in (1, 20_000, 10**6, 10**11, 10**15, 10**18):
        assert 0 < sample_units(rows, 20_000) <= UNITS
        assert sample_units(rows, 20_000) / UNITS >= 0.999 * min(1, 20_000 / rows)
    df = spark.range(50_000).select(F.lit(1).alias("id"), F.col("id").alias("x"))
    assert 900 < sampled(df, 1000).count() < 1100
    assert sampled(df.select("id"), 1000).count() == 1 and sampled(df.limit(0), 1000).count() == 0


def test_probes_follow_the_recall():
    rng = np.random.default_rng(8)
    clustered = np.repeat(rng.standard_normal((40, 16)), 50, axis=0) + 0.01 * rng.standard_normal((2000, 16))
    even = rng.standard_normal((2000, 16))
    few, many = (V.probes_for(x, V.fit_centres(x, 30), 10, 0.98) for x in (clustered, even))
    assert few <= 4 < many <= 30 and V.probes_for(even, V.fit_centres(even, 30), 10, None) == 30


def test_few_are_reranked():
    """With a limit from near rows most candidates are ruled out by their codes."""
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((4000, 128)), rng.standard_normal((20, 128))
    centre, turn = x.mean(0), V.rotation(128)
    piece = V.Piece(np.arange(4000), x, V.Codes.of(x, centre[None], turn), centre, turn, V.EPSILON)
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    of, ids, dist = piece.nearest(q, np.full(20, -1), np.sort(true, 1)[:, 9], 10)
    assert piece.reranked < 0.2 * true.size
    assert sum(len(set(ids[of == k]) & set(np.argsort(true[k])[:10])) for k in range(20)) >= 190 and np.allclose(dist, true[of, ids])
