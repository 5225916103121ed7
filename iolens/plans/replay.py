"""Order-dependent replays: one pass over a log for one configuration, its state in memory.

Each mode is a small state machine that maps an access to its outcome. A configuration is inherently sequential, so parallelism is over
configurations and traces: the runner sends one copy of the log (hashes, never blocks) to each and reads it in order, batch by batch. State grows
with the blocks touched, not with the log.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.rabin import ChunkRule, chunk_block
from ..model import CacheConfig
from ..operators.metadata import disk_view, redirected
from ..operators.policies import Arc, Lru
from ..operators.requests import enabled
from ..operators.reuse import reuse_distances
from ..operators.sequence import dense, kept, with_seq

OUTCOME_DDL = (
    "config string, mode string, seq bigint, vol int, blk bigint, ioblk bigint, is_read boolean, is_warmup boolean, key bigint, hit boolean, meta string, self boolean, "
    "cc_hit boolean, cc_self boolean, disk boolean, pieces int, misses int, duplicate boolean, factor int"
)


class Plain:
    def __init__(self, c: CacheConfig):
        self.c, self.lru = c, Lru(c.cache_blocks)

    def read(self, b: int, vol: int, content: str | None, counted: bool) -> dict:
        hit = self.lru.lookup(b) is not None
        if not hit and counted:
            self.lru.insert(b)
        return {"key": b, "hit": hit, "disk": not hit}

    def write(self, b: int, vol: int, content: str | None, counted: bool) -> dict:
        return {"key": b, "hit": counted and self.lru.insert(b) is not None, "disk": True}


class Fixed(Plain):
    """Reads of mapped blocks go to the leader of their content: the block mapped to it last."""

    def __init__(self, c: CacheConfig):
        super().__init__(c)
        self.content: dict[int, tuple] = {}  # mapped blocks; unmapped ones that were written are in ``dirty``
        self.blocks: dict[tuple, dict[int, None]] = {}  # by content, in the order they were mapped
        self.dirty: set[int] = set()

    def group(self, vol: int, content: str | None) -> tuple:
        return (content, vol) if self.c.intra_only else (content,)

    def map(self, b: int, vol: int, content: str | None) -> dict:
        g = self.group(vol, content)
        of = self.blocks.setdefault(g, {})
        known = bool(of)
        of.pop(b, None)
        of[b] = None
        self.content[b] = g
        self.dirty.discard(b)
        return {"duplicate": known, "factor": len(of)}

    def unmap(self, b: int) -> None:
        g = self.content.pop(b, None)
        if g is not None:
            of = self.blocks[g]
            del of[b]
            if not of:
                del self.blocks[g]
        self.dirty.add(b)

    def state(self, b: int) -> str:
        return "clean" if b in self.content else "dirty" if b in self.dirty else "absent"

    def read(self, b: int, vol: int, content: str | None, counted: bool) -> dict:
        meta = self.state(b)
        key = next(reversed(self.blocks[self.content[b]])) if meta == "clean" else b
        hit = self.lru.lookup(key) is not None
        out = {"key": key, "hit": hit, "meta": meta, "self": key == b if meta == "clean" else None, "disk": not hit}
        if not hit:
            if meta != "clean":
                out |= self.map(b, vol, content)
            if counted:
                self.lru.insert(key)
        return out

    def write(self, b: int, vol: int, content: str | None, counted: bool) -> dict:
        self.unmap(b)
        out = super().write(b, vol, content, counted)
        return out | self.map(b, vol, content) if self.c.updates else out


class Content(Fixed):
    """Block-cache misses of mapped blocks look their content up in a second cache, keyed by content."""

    def __init__(self, c: CacheConfig):
        super().__init__(c)
        self.arc = Arc(c.content_blocks)
        self.home: dict[tuple, int] = {}  # the block recorded for a content

    def unmap(self, b: int) -> None:
        g = self.content.get(b)
        super().unmap(b)
        if g is not None and g not in self.blocks:
            self.home.pop(g, None)

    def settle(self, b: int, vol: int, content: str | None, counted: bool, remap: bool) -> tuple[bool, dict]:
        g = self.group(vol, content)
        held = self.arc.insert(g, b) if counted else None
        out = self.map(b, vol, content) if remap else {}
        self.home[g] = b if held is None else held
        return held is not None, out

    def read(self, b: int, vol: int, content: str | None, counted: bool) -> dict:
        if self.lru.lookup(b) is not None:
            return {"key": b, "hit": True, "disk": False}
        meta = self.state(b)
        out = {"key": b, "hit": False, "meta": meta, "disk": True}
        if meta == "clean":
            g = self.content[b]
            out["self"] = self.home[g] == b
            block = self.arc.lookup(g)
            out["cc_hit"] = block is not None
            if block is not None:
                out |= {"cc_self": block == b, "disk": False}
        if out["disk"]:
            out |= self.settle(b, vol, content, counted, meta != "clean")[1]
        if counted:
            self.lru.insert(b)
        return out

    def write(self, b: int, vol: int, content: str | None, counted: bool) -> dict:
        out = Plain.write(self, b, vol, content, counted)
        self.unmap(b)
        if self.c.updates:
            held, more = self.settle(b, vol, content, counted, True)
            out |= more
            if not out["hit"]:
                out["cc_hit"] = held
        return out


class Chunked(Plain):
    """Like fixed, by content-defined chunks: a mapped block is put together from the leaders of its chunks."""

    def __init__(self, c: CacheConfig, rule: ChunkRule | None = None):
        super().__init__(c)
        self.rule = rule or ChunkRule()
        self.chunks: dict[int, list[tuple]] = {}  # of a block: (key, offset, length)
        self.places: dict[object, dict[tuple[int, int], None]] = {}  # of a chunk: (block, offset), the leader last
        self.dirty: set[int] = set()
        self.cut: dict[object, list[tuple]] = {}

    def map(self, b: int, content) -> None:
        parts = self.cut.get(content)
        if parts is None:
            if len(self.cut) > 100_000:
                self.cut.clear()
            parts = self.cut[content] = chunk_block(content, self.rule)
        self.chunks[b] = parts
        self.dirty.discard(b)
        for key, at, _ in parts:
            self.lead(key, (b, at))

    def lead(self, key, place: tuple[int, int]) -> None:
        of = self.places.setdefault(key, {})
        of.pop(place, None)
        of[place] = None

    def unmap(self, b: int) -> None:
        for key, at, _ in self.chunks.pop(b, ()):
            of = self.places.get(key, {})
            of.pop((b, at), None)
            if not of:
                self.places.pop(key, None)
        self.dirty.add(b)

    def pieces(self, b: int) -> list[tuple[int, int, int]]:
        """(block, offset, length) of what a mapped block is made of, neighbours of one block joined."""
        out: list[tuple[int, int, int]] = []
        for key, _, n in self.chunks[b]:
            block, at = next(reversed(self.places[key]))
            if out and out[-1][0] == block and out[-1][1] + out[-1][2] == at:
                out[-1] = (block, out[-1][1], out[-1][2] + n)
            else:
                out.append((block, at, n))
        return out

    def read(self, b: int, vol: int, content, counted: bool) -> dict:
        meta = "clean" if b in self.chunks else "dirty" if b in self.dirty else "absent"
        blocks = [p[0] for p in self.pieces(b)] if meta == "clean" else [b]
        missed = []
        for x in blocks:
            if self.lru.lookup(x) is None:
                missed.append(x)
                if counted:
                    self.lru.insert(x)
        out = {"key": blocks[0], "hit": not missed, "meta": meta, "disk": bool(missed), "pieces": len(blocks), "misses": len(missed), "self": blocks == [b] if meta == "clean" else None}
        if meta == "clean":
            for x in blocks:  # a block that was fetched leads its chunks from now on
                for key, at, _ in self.chunks.get(x, ()):
                    self.lead(key, (x, at))
        elif missed:
            self.map(b, content)
        return out

    def write(self, b: int, vol: int, content, counted: bool) -> dict:
        self.unmap(b)
        out = super().write(b, vol, content, counted)
        if self.c.updates:
            self.map(b, content)
        return out


MACHINES = {"plain": Plain, "fixed": Fixed, "content": Content, "chunk": Chunked}


def replay(rows, config: CacheConfig, machine=None) -> Iterator[dict]:
    """Outcomes of accesses (seq, vol, blk, ioblk, is_read, content, is_warmup) in order.

    Warm-up accesses teach the maps but fill no cache.
    """
    m = machine or MACHINES[config.mode](config)
    for seq, vol, blk, ioblk, is_read, content, warm in rows:
        if not (config.reads if is_read else config.writes):
            continue
        got = (m.read if is_read else m.write)(ioblk, vol, content, not warm)
        yield {"seq": seq, "vol": vol, "blk": blk, "ioblk": ioblk, "is_read": is_read, "is_warmup": warm} | got


def _by_name(configs: list[CacheConfig]) -> list[CacheConfig]:
    return list({c.name: c for c in configs}.values())


def simulate(accesses: DataFrame, configs: list[CacheConfig], partitions: int | None = None) -> DataFrame:
    """Outcomes of every configuration over one log (seq, vol, blk, ioblk, is_read, content; is_warmup optional).

    Each configuration is a task of its own: the log is replicated to them by hash and sorted by ``seq`` with spilling. No row of a log is held longer than its batch.
    The accesses of a second iteration are numbered on from the log's last; warm-up accesses are not repeated. Equal configurations count once.
    """
    configs = _by_name(configs)
    rows = repeated_by(_prepared(accesses).withColumn("config", F.explode(F.array(*(F.lit(i) for i in range(len(configs)))))), [c.iterations for c in configs])
    packed = pickle.dumps(configs)
    arrow = to_arrow_schema(StructType.fromDDL(OUTCOME_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, now, machine = pickle.loads(packed), None, None
        for b in batches:
            out = []
            *cols, which = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(which):
                end = at
                while end < len(which) and which[end] == which[at]:
                    end += 1
                if which[at] != now:
                    now = which[at]
                    machine = MACHINES[mine[now].mode](mine[now])
                c = mine[now]
                for o in replay(zip(*(x[at:end] for x in cols), strict=True), c, machine):
                    o["config"], o["mode"] = c.name, c.mode
                    out.append(o)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([o.get(f.name) for o in out], f.type) for f in arrow], schema=arrow)

    n = partitions or max(1, len(configs))
    spread = rows.repartitionById(n, F.col("config") % n).sortWithinPartitions("config", "seq")
    return spread.mapInArrow(run, OUTCOME_DDL)


def _prepared(accesses: DataFrame) -> DataFrame:
    warm = F.coalesce("is_warmup", F.lit(False)) if "is_warmup" in accesses.columns else F.lit(False)
    return accesses.select("seq", "vol", "blk", "ioblk", "is_read", "content", warm.alias("is_warmup"))


def repeated_by(rows: DataFrame, times: list[int]) -> DataFrame:
    """``rows`` with ``config``, the index of a number of ``times`` that their log is to come in a row."""
    if max(times, default=1) == 1:
        return rows
    n = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    last = F.when(F.col("is_warmup"), F.lit(0)).otherwise(F.element_at(F.array(*map(F.lit, times)), F.col("config") + 1) - 1)
    rows = rows.withColumn("__round", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("seq", F.col("seq") + F.col("__round") * n).drop("__round")


def has_plan(c: CacheConfig) -> bool:
    """Whether outcomes follow from reuse distances: in plain mode, and in fixed mode where every write maps its block, so that the maps do not depend on the cache."""
    return c.mode == "plain" or c.mode == "fixed" and c.updates


def planned_outcomes(accesses: DataFrame, configs: list[CacheConfig]) -> DataFrame:
    """What :func:`simulate` says of configurations that have a plan, as DataFrame operations: (config, mode, seq, vol, blk, is_read, is_warmup, hit, meta, self, disk).

    Configurations that differ only in the memory's size share one pass of reuse distances. Warm-up accesses are left out, having taught the maps.
    """
    groups: dict[CacheConfig, list[CacheConfig]] = {}
    for c in _by_name(configs):
        groups.setdefault(replace(c, ram_blocks=1), []).append(c)
    out = []
    for like, some in groups.items():
        rows = enabled(_prepared(accesses), like.reads, like.writes)
        if like.iterations > 1:
            rows = repeated_by(rows.withColumn("config", F.lit(0)), [like.iterations]).drop("config")
        if like.mode == "fixed":
            # a mapped block is led by what it was mapped to, whatever the log says that a read found
            rows = redirected(disk_view(rows).drop("trace_content", "was_inconsistent"), like.intra_only)
            meta = F.when(F.col("is_read"), F.when(F.col("clean"), "clean").otherwise("absent"))
            rows = rows.withColumns({"meta": meta, "self": F.col("self_leader")})
            key = ("key_vol", "key_blk")
        else:
            rows = rows.withColumns({"meta": F.lit(None).cast("string"), "self": F.lit(None).cast("boolean")})
            key = ("vol", "blk")
        rows = rows.select("seq", "vol", "blk", "is_read", "meta", "self", *(k for k in key if k not in ("vol", "blk")), "is_warmup").where("not is_warmup")
        if "is_warmup" in accesses.columns or not (like.reads and like.writes):
            rows = dense(rows)
        rows = reuse_distances(rows, key)
        sizes = F.explode(F.array(*(F.struct(F.lit(c.name).alias("config"), F.lit(c.ram_blocks).cast("bigint").alias("ram")) for c in some)))
        rows = rows.withColumn("c", sizes).withColumn("hit", F.coalesce(F.col("distance") < F.col("c.ram"), F.lit(False)))
        out.append(rows.select("c.config", F.lit(like.mode).alias("mode"), "seq", "vol", "blk", "is_read", "is_warmup", "hit", "meta", "self", (~F.col("is_read") | ~F.col("hit")).alias("disk")))
    return reduce(DataFrame.union, out)


def sweep(accesses: DataFrame, configs: list[CacheConfig]) -> DataFrame:
    """A row of counters for each configuration: those that have a plan by it, the others by their machines."""
    from ..operators.counters import counters

    planned, others = ([c for c in configs if has_plan(c) == p] for p in (True, False))
    accesses = kept(accesses) if planned and others else accesses
    parts = ([planned_outcomes(accesses, planned)] if planned else []) + ([simulate(accesses, others)] if others else [])
    return reduce(DataFrame.unionByName, [counters(p, ("config", "mode")) for p in parts])


def snapshot(spark: SparkSession, accesses: DataFrame, path: str) -> None:
    """The maps after a log with write updates, as Parquet: ``block_map`` (vol, blk, content) and ``content_map`` (content, leader, blocks)."""
    from ..operators.metadata import map_intervals

    live = map_intervals(accesses).where("to_seq is null")
    live.select("vol", "blk", "content", "from_seq").write.mode("overwrite").parquet(f"{path}/block_map")
    lead = F.max_by(F.struct("vol", "blk"), "from_seq")
    live.groupBy("content").agg(lead.alias("leader"), F.count("*").alias("blocks")).write.mode("overwrite").parquet(f"{path}/content_map")


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """The block map that :func:`snapshot` wrote as accesses (seq, vol, blk, ioblk, is_read, content) that map it again, leaders last.

    Put in front of a log by ``requests.with_warmup``, a replay starts from the maps of the dump with an empty cache.
    """
    rows = spark.read.parquet(f"{path}/block_map").withColumnsRenamed({"from_seq": "__from"})
    rows = with_seq(rows, F.col("__from"), F.col("vol"), F.col("blk")).drop("__from")
    return rows.select("seq", "vol", "blk", F.col("ioblk") if "ioblk" in rows.columns else F.lit(None).cast("bigint").alias("ioblk"), F.lit(True).alias("is_read"), "content")
