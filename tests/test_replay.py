"""The state machines against a plain, list-based model, the plans against the machines, counters against their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from iolens.functions.rabin import ChunkRule, chunk_block
from iolens.model import CacheConfig
from iolens.operators import counters as C
from iolens.operators import metadata as M
from iolens.operators import reuse as U
from iolens.operators.policies import Arc, Lru
from iolens.operators.requests import with_warmup
from iolens.plans.replay import Chunked, Fixed, has_plan, loaded, planned_outcomes, replay, simulate, snapshot, sweep


class ListLru:
    """Least recently used last; nothing but a list."""

    def __init__(self, n):
        self.n, self.l = n, []

    def get(self, k):
        if k in self.l:
            self.l.remove(k)
            self.l.insert(0, k)
            return True
        return False

    def put(self, k):
        had = self.get(k)
        if not had:
            self.l.insert(0, k)
            del self.l[self.n :]
        return had


class ListArc:
    def __init__(self, n, unit=32):
        self.c, self.u, self.p = n * unit, unit, n * unit // 2
        self.t = {"r": [], "f": [], "gr": [], "gf": []}

    def size(self, x):
        return len(self.t[x]) * self.u

    def where(self, k):
        return next((n for n, l in self.t.items() if any(e[0] == k for e in l)), None)

    def get(self, k):
        n = self.where(k)
        if n in ("r", "f"):
            e = next(e for e in self.t[n] if e[0] == k)
            self.t[n].remove(e)
            self.t["f"].insert(0, e)
            return e
        return None

    def add(self, k, v):
        e = self.get(k)
        if e:
            return e[1]
        n = self.where(k)
        if n == "gr":
            self.p = min(self.c, self.p + max(self.size("gf") // self.size("gr"), 1))
        if n == "gf":
            self.p = max(0, self.p - max(self.size("gr") // self.size("gf"), 1))
        if n:
            self.t[n] = [e for e in self.t[n] if e[0] != k]
        while self.size("r") + self.size("f") + self.u > self.c:
            if self.size("r") > self.p:
                self.t["gr"].insert(0, (self.t["r"].pop()[0], None))
            elif self.t["f"]:
                self.t["gf"].insert(0, (self.t["f"].pop()[0], None))
            else:
                break
        while self.size("gr") + self.size("gf") > self.c:
            if self.size("gf") > self.p:
                self.t["gf"].pop()
            elif self.t["gr"]:
                self.t["gr"].pop()
            else:
                break
        self.t["f" if n else "r"].insert(0, (k, v))
        return None


def test_policies():
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randint(1, 9)
        a, b, c, d = Arc(n), ListArc(n), Lru(n), ListLru(n)
        for _ in range(400):
            k = rng.randrange(1, 18)
            if rng.random() < 0.5:
                got = b.get(k)
                assert a.lookup(k) == (got[1] if got else None)
                assert (c.lookup(k) is not None) == d.get(k)
            else:
                v = rng.randrange(1, 1000)
                assert a.insert(k, v) == b.add(k, v)
                assert (c.insert(k) is not None) == d.put(k)
            assert a.target == b.p


def log(seed, n=300, blocks=25, contents=6, vols=3):
    rng = random.Random(seed)
    disk, out = {}, []
    for seq in range(n):
        vol, blk, r = rng.randrange(vols), rng.randrange(blocks), rng.random() < 0.6
        key = (vol, blk)
        if r:
            disk.setdefault(key, f"c{rng.randrange(contents)}")
        else:
            disk[key] = f"c{rng.randrange(contents)}"
        out.append((seq, vol, blk, vol * 100 + blk, r, disk[key], False))
    return out


def plain_model(rows, c):
    """The rules of the modes written out once more, with lists only."""
    lru, arc = ListLru(c.cache_blocks), ListArc(c.content_blocks or 1)
    maps, lists, entry = {}, {}, {}

    def insert(b, g):
        l = lists.setdefault(g, [])
        if b not in l:
            l.insert(0, b)
        maps[b] = (g, False)

    def invalidate(b):
        if b in maps and not maps[b][1]:
            g = maps[b][0]
            lists[g].remove(b)
            if not lists[g]:
                del lists[g]
                entry.pop(g, None)
        maps[b] = (None, True)

    for seq, vol, _, b, r, h, _ in rows:
        g = (h, vol) if c.intra_only else (h,)
        st = "absent" if b not in maps else "dirty" if maps[b][1] else "clean"
        if r:
            key = lists[maps[b][0]][0] if c.mode == "fixed" and st == "clean" else b
            hit, cc, slf = lru.get(key), None, None
            disk = not hit
            if c.mode == "content" and not hit and st == "clean":
                slf = entry[maps[b][0]] == b
                got = arc.get(maps[b][0])
                cc, disk = got is not None, got is None
            if not hit:
                if c.mode == "fixed" and st != "clean":
                    insert(b, g)
                if c.mode == "content" and disk:
                    held = arc.add(g, b)
                    if st != "clean":
                        insert(b, g)
                    entry[g] = b if held is None else held
                lru.put(key)
            yield seq, key, hit, disk, cc
        else:
            found, cc = lru.put(b), None
            if c.mode != "plain":
                invalidate(b)
                if c.updates:
                    if c.mode == "content":
                        held = arc.add(g, b)
                        cc = None if found else held is not None
                    insert(b, g)
                    if c.mode == "content":
                        entry[g] = b if held is None else held
            yield seq, b, found, True, cc


CONFIGS = [
    CacheConfig("plain", 7), CacheConfig("fixed", 7), CacheConfig("fixed", 7, write_updates=True), CacheConfig("fixed", 12, write_updates=True, intra_only=True), CacheConfig("content", 9, 4),
    CacheConfig("content", 30, 20), CacheConfig("content", 12, 3, write_updates=False),
]


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: c.name)
def test_machines_follow_the_model(config):
    for seed in range(25):
        rows = log(seed)
        got = [(o["seq"], o["key"], o["hit"], o["disk"], o.get("cc_hit")) for o in replay(rows, config)]
        assert got == list(plain_model(rows, config))


def test_names_tell_configurations_apart():
    kinds = [CacheConfig(m, 8, 4 if m == "content" else 0, w, i, reads=r, writes=x, iterations=n) for m in ("plain", "fixed", "content", "chunk") for w in (False, True) for i in ((False, True) if m == "fixed" else (False,)) for r, x in ((True, True), (True, False), (False, True)) for n in (1, 2)]
    assert len({c.name for c in kinds}) == len(kinds) - 6  # in plain mode updates of maps mean nothing


ROW = "seq bigint, vol int, blk bigint, ioblk bigint, is_read boolean, content string, is_warmup boolean"


def test_sweep_and_invariants(spark):
    df = spark.createDataFrame(log(5, 2000), ROW)
    rows = sweep(df, CONFIGS)
    assert rows.count() == len(CONFIGS)
    for c in CONFIGS:
        one = rows.where(F.col("config") == c.name)
        assert C.broken_invariants(one, c.mode).collect() == []
    wrong = rows.where("mode = 'fixed'").limit(1).withColumn("map_hits", F.col("map_hits") + 1)
    assert C.broken_invariants(wrong, "fixed").count() > 0


def test_reads_writes_and_iterations_are_configurations(spark):
    rows = log(6, 300)
    df = spark.createDataFrame(rows, ROW)
    some = [CacheConfig(m, 12, 5 if m == "content" else 0, **kw) for m in ("plain", "fixed", "content") for kw in ({}, {"writes": False}, {"reads": False}, {"iterations": 3})]
    some += [CacheConfig("fixed", 12, write_updates=True, **kw) for kw in ({}, {"writes": False}, {"iterations": 3})]
    got = {r.config: r for r in sweep(df, some + some).collect()}
    assert len(got) == len(some)
    n = sum(r[4] for r in rows)
    for c in some:
        mine = [(i * 300 + r[0], *r[1:]) for i in range(c.iterations) for r in rows]
        out = list(replay(mine, c))
        r = got[c.name]
        assert (r.reads, r.writes) == (c.reads * c.iterations * n, c.writes * c.iterations * (300 - n))
        assert (r.bcache_hits_r, r.bcache_hits_w) == tuple(sum(o["hit"] for o in out if o["is_read"] == k) for k in (True, False))
        assert C.broken_invariants(sweep(df, [c]), c.mode).count() == 0


def test_plans_equal_the_machines(spark):
    rows = [(*r[:6], r[0] < 80) for r in log(10, 500)]
    df = spark.createDataFrame(rows, ROW)
    some = [CacheConfig("plain", 9), CacheConfig("fixed", 9, write_updates=True), CacheConfig("fixed", 9, write_updates=True, intra_only=True), CacheConfig("plain", 9, writes=False), CacheConfig("fixed", 20, write_updates=True, iterations=2)]
    by = lambda d: {tuple(r) for r in C.counters(d, ("config", "mode")).collect()}
    assert all(map(has_plan, some)) and by(planned_outcomes(df, some)) == by(simulate(df, some))


def test_replay_from_a_dump(spark, tmp_path):
    """Maps written after one log and loaded before another: as if both were one, with a cold cache in between."""
    first, second = log(13, 200), [(r[0], r[1], r[2], r[3], False if i < 40 else r[4], r[5], False) for i, r in enumerate(log(14, 200))]
    snapshot(spark, spark.createDataFrame(first, ROW), str(tmp_path))
    back = loaded(spark, str(tmp_path)).withColumn("ioblk", F.col("vol") * 100 + F.col("blk"))
    both = with_warmup(back, spark.createDataFrame(second, ROW).drop("is_warmup"))
    config = CacheConfig("fixed", 12, write_updates=True)
    machine = Fixed(config)
    list(replay([(*r[:6], True) for r in first], config, machine))
    want = [(o["key"], o["hit"]) for o in replay(second, config, machine)]
    got = simulate(both, [config]).where("not is_warmup").orderBy("seq").collect()
    assert [(r.key, r.hit) for r in got] == want


def test_plan_of_fixed_mode_equals_the_machine(spark):
    for intra in (False, True):
        df = spark.createDataFrame(log(8, 900), ROW)
        k = M.redirected(df, intra)
        plan = U.lru_hits(U.reuse_distances(k, ("key_vol", "key_blk"), cell=128), 12)
        config = CacheConfig("fixed", 12, write_updates=True, intra_only=intra)
        want = {o["seq"]: (o["key"], o["hit"]) for o in replay(log(8, 900), config)}
        got = {r.seq: (r.key_vol * 100 + r.key_blk, r.hit) for r in plan.collect()}
        assert got == want


def test_reuse_distances_on_a_grid(spark):
    df = spark.createDataFrame(log(9, 700), ROW)
    want = {r.seq: r.distance for r in U.reuse_distances_joined(df).collect()}
    for cell in (64, 100, 1 << 18):
        assert {r.seq: r.distance for r in U.reuse_distances(df, cell=cell).collect()} == want
    assert U.reuse_distances(df.limit(0)).count() == 0


def test_warmup_fills_no_cache(spark):
    warm = [(*r[:6], True) for r in log(1, 50)]
    rows = warm + [(r[0] + 50, *r[1:]) for r in log(2, 100)]
    out = simulate(spark.createDataFrame(rows, ROW), [CacheConfig("fixed", 5, write_updates=True)]).collect()
    first = [r for r in out if not r.is_warmup][0]
    assert not first.hit and sum(not r.is_warmup for r in out) == 100
    n = C.counters(spark.createDataFrame(out, simulate(spark.createDataFrame(rows, ROW), [CacheConfig()]).schema)).first()
    assert n.reads + n.writes == 100


def test_chunk_mode():
    rng = random.Random(4)
    rule = ChunkRule(smallest=40, largest=200, mask=0xF, value=8)
    parts = [bytes(rng.choices(b"01234", k=512)) for _ in range(5)]
    contents = [b"".join(rng.choices(parts, k=8)) for _ in range(6)]
    m = Chunked(CacheConfig("chunk", 6), rule)
    disk, seen = {}, set()
    for seq in range(400):
        b, r = rng.randrange(20), rng.random() < 0.7
        if not r:
            disk[b] = rng.choice(contents)
            m.write(b, 0, disk[b], True)
            seen.add(b)
            continue
        disk.setdefault(b, rng.choice(contents))
        mapped = b in m.chunks
        if mapped:
            # the pieces put the block together
            pieces = m.pieces(b)
            assert b"".join(disk[x][at : at + n] for x, at, n in pieces) == disk[b]
        o = m.read(b, 0, disk[b], True)
        assert (o["meta"] == "clean") == mapped and o["hit"] == (o["misses"] == 0)
    assert any(len(m.pieces(b)) > 1 for b in m.chunks)
    assert all(sum(n for _, _, n in chunk_block(c, rule)) == 4096 for c in contents)


def test_configs():
    for bad in ({"mode": "x"}, {"mode": "content", "ram_blocks": 5, "content_blocks": 5}, {"content_blocks": 3}, {"reads": False, "writes": False}, {"ram_blocks": 0}, {"intra_only": True}):
        with pytest.raises(ValueError):
            CacheConfig(**bad)
    assert CacheConfig.of_mb("content", 1024, 200).cache_blocks == 824 * 256 and CacheConfig("content", 9, 4).updates and not CacheConfig("fixed").updates


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame(log(3, 200), ROW)
    snapshot(spark, df, str(tmp_path))
    machine = __import__("iolens.plans.replay", fromlist=["Fixed"]).Fixed(CacheConfig("fixed", 10_000, write_updates=True))
    list(replay(log(3, 200), machine.c, machine))
    blocks = {(r.vol * 100 + r.blk): r.content for r in spark.read.parquet(f"{tmp_path}/block_map").collect()}
    assert blocks == {b: g[0] for b, g in machine.content.items()}
    lead = {r.content: r.leader.vol * 100 + r.leader.blk for r in spark.read.parquet(f"{tmp_path}/content_map").collect()}
    assert lead == {g[0]: next(reversed(of)) for g, of in machine.blocks.items()}
