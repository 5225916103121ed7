"""Edge cases of the relational operators."""

import random

import pytest
from pyspark.sql import functions as F

from iolens.operators import dedup as D
from iolens.operators import metadata as M
from iolens.operators import pieces as P
from iolens.operators import requests as R
from iolens.operators import volumes as V
from iolens.operators.sequence import with_seq
from iolens.plans.replay import simulate
from iolens.model import CacheConfig
from iolens.sinks import reports

from .test_replay import ROW, log


def test_sequence_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(30)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "t long, i long").repartition(5)
    for parts in (None, 1, 13):
        got = with_seq(df, F.col("t"), F.col("i"), partitions=parts).orderBy("seq").collect()
        assert [r.seq for r in got] == list(range(500))
        assert [(r.t, r.i) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert with_seq(df.limit(0), F.col("t")).count() == 0


def test_requests(spark):
    df = spark.createDataFrame([(0, 1, 10, "aaaabbbbcc", True), (1, 1, 50, "", True), (2, 1, 60, None, False)], "seq long, vol int, blk long, content string, is_read boolean")
    got = R.explode_blocks(df, 4, nbytes=None).orderBy("seq", "part").collect()
    assert [(r.blk, r.content) for r in got] == [(10, "aaaa"), (11, "bbbb"), (12, "cc")]
    assert R.enabled(df, writes=False).count() == 2 and R.enabled(df, reads=False).count() == 1 and R.enabled(df).count() == 3 and R.enabled(df, False, False).count() == 0
    z = spark.createDataFrame([(1, bytes(4096)), (2, b"x"), (3, None)], "i int, content binary")
    assert [r.i for r in R.drop_zero_blocks(z).orderBy("i").collect()] == [2, 3]
    twice = R.repeated(df, 3)
    assert sorted(r.seq for r in twice.collect()) == list(range(9))
    w = R.with_warmup(df.select("seq"), df.select("seq")).orderBy("seq").collect()
    assert [(r.seq, r.is_warmup) for r in w] == [(0, True), (1, True), (2, True), (3, False), (4, False), (5, False)]
    vol, blk = R.split_key(F.lit("a:b:17"))
    assert tuple(df.limit(1).select(vol, blk).first()) == ("a:b", 17)


def test_volumes(spark):
    v = spark.createDataFrame([(0, 10, 0), (1, 5, 10), (2, 3, 8), (3, 0, 9), (4, 100, 14)], "vol int, cap long, base long")
    assert sorted(tuple(r) for r in V.overlaps(v).collect()) == [(0, 2, 8, 9), (1, 2, 10, 10), (1, 4, 14, 14)]
    assert V.overlaps(v.limit(0)).count() == 0
    known = spark.createDataFrame([("web", 4)], "vm string, vol int")
    req = spark.createDataFrame([(5, "b"), (3, "a"), (1, "web"), (9, None)], "seq long, vm string")
    assert sorted(tuple(r) for r in V.assign_volumes(req, known).collect()) == [("a", 5), ("b", 6), ("web", 4)]
    a = spark.createDataFrame([(0, 0, 9), (1, 0, 10), (2, 77, 1)], "seq long, vol int, blk long")
    assert [r.ioblk for r in V.to_physical(a, v).orderBy("seq").collect()] == [9, 10, None]
    with pytest.raises(Exception, match="beyond its volume"):
        V.to_physical(a, v, check=True).collect()


def test_disk_view(spark):
    rows = [(0, True, "a"), (1, True, "b"), (2, False, "c"), (3, True, None), (4, True, "d")]
    df = spark.createDataFrame([(s, 0, 1, r, c) for s, r, c in rows], "seq long, vol int, blk long, is_read boolean, content string")
    got = M.disk_view(df).orderBy("seq").collect()
    assert [r.content for r in got] == ["a", "a", "c", "c", "c"]
    assert [r.was_inconsistent for r in got] == [False, True, False, False, True]


def test_intervals_without_write_updates(spark):
    df = spark.createDataFrame([(0, 0, 1, True, "a"), (1, 0, 1, False, "b"), (2, 0, 1, False, "c"), (3, 0, 1, True, "c"), (4, 0, 1, True, "c")], "seq long, vol int, blk long, is_read boolean, content string")
    got = M.map_intervals(df, write_updates=False).orderBy("from_seq").collect()
    assert [(r.from_seq, r.to_seq) for r in got] == [(0, 1), (3, None)]


def test_pieces(spark):
    p = spark.createDataFrame([(0, 0, 5, 0, 10), (0, 1, 5, 10, 20), (0, 2, 6, 20, 30), (0, 3, 5, 30, 40), (1, 0, 5, 20, 30)], 'seq long, part int, ioblk long, start long, end long')
    got = P.merge_pieces(p).orderBy("seq", "part").collect()
    assert [(r.seq, r.ioblk, r.start, r.end, r.merged) for r in got] == [(0, 5, 0, 20, 2), (0, 6, 20, 30, 1), (0, 5, 30, 40, 1), (1, 5, 20, 30, 1)]
    s = P.split_at_blocks(spark.createDataFrame([(1, 7, 4000, 5000), (2, 7, 0, 0)], "seq long, blk long, start long, nbytes long")).orderBy("blk").collect()
    assert [(r.blk, r.start, r.nbytes) for r in s] == [(7, 4000, 96), (8, 0, 4096), (9, 0, 808)]
    parts = spark.createDataFrame([(1, 1, b"cd"), (1, 0, b"ab"), (2, 0, b"x")], "seq long, part int, content binary")
    whole = spark.createDataFrame([(1, b"abcd".ljust(8, b"\0")), (2, b"y".ljust(8, b"\0"))], "seq long, content binary")
    assert [r.seq for r in P.stitch_check(parts, whole, block_size=8).collect()] == [2]


def test_bunches(spark):
    times = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 25, 35, 36]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(times)], "vol int, seq long, at long")
    got = P.bunches(df, size=8, ns=10).orderBy("seq").collect()
    assert [r.bunch for r in got] == [0] * 8 + [8, 8, 10, 10, 12]
    rng = random.Random(3)
    for ns in (3, 50):
        rows = [(v, 1000 * v + i, t) for v in range(3) for i, t in enumerate(sorted(rng.choices(range(400), k=150)))]
        df2, want, now = spark.createDataFrame(rows, "vol int, seq long, at long"), {}, None
        for v, q, t in rows:
            if now is None or now[0] != v or now[3] >= 8 or t - now[2] > ns:
                now = [v, q, t, 0]
            now[3] += 1
            want[q] = now[1]
        for span in (8, 20, 1 << 16):
            assert {r.seq: r.bunch for r in P.bunches(df2, size=8, ns=ns, span=span).collect()} == want
    with pytest.raises(Exception, match="before its predecessor"):
        P.bunches(spark.createDataFrame([(0, 0, 5), (0, 1, 4)], "vol int, seq long, at long")).collect()
    assert P.bunches(df.limit(0)).count() == 0


def test_bunches_of_a_long_log(spark):
    """A stretch of a stream whose rows lie in many parts of the log stays whole, whatever join the plan takes (as at 6,000,000 events)."""
    rng = random.Random(4)
    rows = [(v, 7 * 40_000 * i + v, t) for v in range(2) for i, t in enumerate(sorted(rng.choices(range(3000), k=400)))]
    want, now = {}, None
    for v, q, t in rows:
        if now is None or now[0] != v or now[3] >= 8 or t - now[2] > 30:
            now = [v, q, t, 0]
        now[3] += 1
        want[q] = now[1]
    df = spark.createDataFrame(rows, "vol int, seq long, at long")
    # as with large tables: shuffles of several parts, and joins planned with them on both sides turn out to have a small side
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        assert {r.seq: r.bunch for r in P.bunches(df, size=8, ns=30, span=150).collect()} == want
    finally:
        for k in large:
            spark.conf.unset(k)


def test_live_items_and_factors(spark):
    rng = random.Random(2)
    live, rows, want, counts = [], [], [], {}
    for seq in range(200):
        if live and rng.random() < 0.4:
            c, d = live.pop(rng.randrange(len(live))), -1
        else:
            c, d = f"c{rng.randrange(5)}", 1
            live.append(c)
        counts[c] = counts.get(c, 0) + d
        rows.append((seq, c, d))
        want.append((seq, len(live), sum(v > 0 for v in counts.values())))
    got = D.live_items(spark.createDataFrame(rows, "seq long, content string, d int")).orderBy("seq").collect()
    assert [(r.seq, r.total, r.uniques) for r in got] == want


def test_reports(spark):
    df = spark.createDataFrame(log(4, 300), ROW)
    out = simulate(df, [CacheConfig("fixed", 5, write_updates=True), CacheConfig("content", 9, 4)]).cache()
    assert reports.disk_requests(out).count() == out.where("disk").count()
    assert reports.dedup_events(out).where("kind = 'new'").count() + reports.dedup_events(out).where("kind = 'dup'").count() == out.where("duplicate is not null").count()
    assert reports.access_log(out).where("component = 'block cache'").count() == 600
    from iolens.operators.counters import counters

    assert reports.report(counters(out, ("config", "mode"))).where("counter = 'reads'").count() == 2


def test_stretches(spark):
    from iolens.operators.running import last_before, running_sum

    rng = random.Random(6)
    rows = [(rng.randrange(300), rng.choice("aaab"), rng.choice([None, 1, 2, 3])) for _ in range(250)]
    df = spark.createDataFrame(rows, "seq long, k string, v int").dropDuplicates(["seq", "k"])
    rows = [tuple(r) for r in df.collect()]
    for span in (1 << 18, 16):
        for r in last_before(df, ("k",), F.col("v"), span=span).collect():
            past = [x for x in rows if x[1] == r.k and x[0] < r.seq and x[2] is not None]
            assert r["last"] == (max(past)[2] if past else None)
        for r in running_sum(df, ("k",), {"s": F.coalesce("v", F.lit(0))}, span=span).collect():
            assert r.s == sum(x[2] or 0 for x in rows if x[1] == r.k and x[0] <= r.seq)
        for r in running_sum(df, (), {"s": F.coalesce("v", F.lit(0))}, ("seq", "k"), span=span).collect():
            assert r.s == sum(x[2] or 0 for x in rows if x[:2] <= (r.seq, r.k))


def test_overlaps_of_all_sizes(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([1, 2, 3, 7, 64, 65, 900, 40_000]), rng.randrange(60_000)) for i in range(150)]
    want = {(a, b, max(x, y), min(x + c, y + d) - 1) for a, c, x in rows for b, d, y in rows if a < b and x < y + d and y < x + c}
    got = [tuple(r) for r in V.overlaps(spark.createDataFrame(rows, "vol int, cap long, base long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_latest_live_interval(spark):
    """One content, hot or not, in stretches of 8 places: against all intervals."""
    from iolens.operators.live import latest_live

    rng = random.Random(12)
    maps, asks = [], []
    for seq in range(400):
        key = rng.choice("aaab")
        if rng.random() < 0.5:
            asks.append((seq, key))
        else:
            maps.append((key, seq, rng.randrange(9), rng.choice([None, seq + rng.randrange(1, 30), seq + rng.randrange(1, 300)])))
    m = spark.createDataFrame([(k, (s, b, e)) for k, s, b, e in maps], "content string, m struct<seq: long, blk: long, end: long>")
    q = spark.createDataFrame(asks, "seq long, content string")
    want = {s: max(((f, b) for k, f, b, e in maps if k == c and f < s and (e is None or e > s)), default=None) for s, c in asks}
    for span in (8, 64, 1 << 18):
        assert {r.seq: r.o and (r.o.seq, r.o.blk) for r in latest_live(q, m, ("content",), span).collect()} == want
    assert latest_live(q.limit(0), m, ("content",)).count() == 0 and latest_live(q, m.limit(0), ("content",)).where("o is not null").count() == 0


def test_hot_rows_spread_over_stretches(spark):
    """One volume, block and content with half the log: no window or group holds more than a stretch of it."""
    import re

    rows = spark.range(4000).select(F.col("id").alias("seq"), F.lit(0).alias("vol"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("blk"), (F.col("id") % 3 != 0).alias("is_read"), F.lit("c").alias("content"), F.col("id").alias("at"))
    for df in (M.disk_view(rows), M.touches(rows), M.map_intervals(rows), M.mapped_state(rows), R.scan_layout(rows), R.inversions(rows), V.capacity_over_time(rows)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # windows that read rows, not one row a stretch, are dealt out by the stretch too
        for over in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[__(?!s#)", plan):
            assert "__s#" in over
