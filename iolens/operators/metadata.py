"""What is known of a block at the time of an access: content on disk, first touch, dirtiness, mapping intervals, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .live import latest_live
from .running import first_after, last_before
from .sequence import kept

BLOCK = ("vol", "blk")


def disk_view(accesses: DataFrame) -> DataFrame:
    """Accesses with the disk's content: ``content`` of a read becomes what was last written, or first read, at its block.

    ``trace_content`` keeps the log's own, ``was_inconsistent`` tells reads that the disk overrules.
    """
    out = accesses.withColumnRenamed("content", "trace_content")
    first = out.where("is_read and trace_content is not null").groupBy(*BLOCK).agg(F.min(F.struct("seq", "trace_content")).alias("__f"))
    out = last_before(out, BLOCK, F.when(~F.col("is_read"), F.col("trace_content")), name="__w").join(first, list(BLOCK), "left")
    read = F.coalesce("__w", F.when(F.col("__f.seq") <= F.col("seq"), F.col("__f.trace_content")))
    out = out.withColumn("content", F.when(F.col("is_read"), read).otherwise(F.col("trace_content"))).drop("__w", "__f")
    return out.withColumn("was_inconsistent", F.coalesce(F.col("is_read") & (F.col("trace_content") != F.col("content")), F.lit(False)))


def touches(accesses: DataFrame) -> DataFrame:
    """Accesses with ``first_touch`` and ``dirty``: a read whose block was written after it was last mapped by a read.

    This is the map of a log without write updates and without a cache in front: every read that is not clean maps its block.
    """
    out = last_before(accesses, BLOCK, F.col("is_read"), name="__b")
    return out.withColumns({"first_touch": F.col("__b").isNull(), "dirty": F.coalesce(F.col("is_read") & ~F.col("__b"), F.lit(False))}).drop("__b")


def map_intervals(accesses: DataFrame, write_updates: bool = True) -> DataFrame:
    """(vol, blk, content, from_seq, to_seq): when a block was mapped to a content, until the next write or (null) for good.

    With write updates every write maps, and a read maps the block it touches first. Then the cache has no say: what was never
    touched cannot be cached. Without write updates writes only end intervals, and the next read maps again.
    """
    rows = last_before(accesses.select(*BLOCK, "seq", "is_read", "content"), BLOCK, F.col("is_read"), name="__prev")
    rows = first_after(rows, BLOCK, F.when(~F.col("is_read"), F.col("seq")), name="to_seq")
    maps = F.col("__prev").isNull() | ~F.col("is_read") if write_updates else F.col("is_read") & (F.col("__prev").isNull() | ~F.col("__prev"))
    return rows.where(maps).select(*BLOCK, "content", F.col("seq").alias("from_seq"), "to_seq")


def leaders(reads: DataFrame, intervals: DataFrame, within: tuple[str, ...] = ("content",)) -> DataFrame:
    """Reads with the leader of their content: the block that was mapped to it last and still is (lead_vol, lead_blk, lead_seq; null if none).

    ``within`` = ("content", "vol") looks at the own volume only. Most reads follow a mapping that still holds, which windows over stretches of a content's
    events find, however often it occurs; the others look among the mappings alive in their stretch (:func:`latest_live`). No read meets a list of mappings.
    """
    keys = list(within)
    maps = intervals.select(*keys, *(c for c in BLOCK if c not in keys), "from_seq", "to_seq")
    maps = maps.select(*keys, F.struct(F.col("from_seq").alias("seq"), F.col("vol").alias("vol"), F.col("blk").alias("blk"), F.col("to_seq").alias("end")).alias("m"))
    events = reads.select(*keys, "seq", F.lit(None).cast(maps.schema["m"].dataType).alias("m")).unionByName(maps.select(*keys, F.col("m.seq").alias("seq"), "m"))
    last = kept(last_before(events, tuple(keys), F.col("m"), name="l").where("m is null").select("seq", *keys, "l"))
    alive = F.col("l").isNull() | F.col("l.end").isNull() | (F.col("l.end") > F.col("seq"))
    older = latest_live(last.where(~alive).select("seq", *keys), maps, tuple(keys)).select("seq", "o")
    found = last.withColumn("l", F.when(alive, F.col("l"))).join(older, "seq", "left").select("seq", F.coalesce("l", "o").alias("l"))
    out = reads.join(found, "seq", "left")
    return out.withColumns({"lead_vol": F.col("l.vol"), "lead_blk": F.col("l.blk"), "lead_seq": F.col("l.seq")}).drop("l")


def redirected(accesses: DataFrame, intra_only: bool = False) -> DataFrame:
    """Accesses of a log with write updates with the block that serves them in fixed mode: (key_vol, key_blk), ``clean``, ``self_leader``.

    A clean read goes to the leader of its content, everything else to its own block.
    """
    accesses = kept(accesses)
    rows = last_before(accesses, BLOCK, F.col("seq"), name="__p").withColumn("clean", F.col("is_read") & F.col("__p").isNotNull()).drop("__p")
    clean = rows.where("clean")
    led = leaders(clean.select("seq", "vol", "content"), map_intervals(accesses), ("content", "vol") if intra_only else ("content",))
    out = rows.join(led.select("seq", "lead_vol", "lead_blk"), "seq", "left")
    out = out.withColumns({"key_vol": F.coalesce("lead_vol", "vol"), "key_blk": F.coalesce("lead_blk", "blk")})
    return out.withColumn("self_leader", F.when(F.col("clean"), (F.col("key_vol") == F.col("vol")) & (F.col("key_blk") == F.col("blk")))).drop("lead_vol", "lead_blk")


def mapped_state(accesses: DataFrame, write_updates: bool = False) -> DataFrame:
    """Accesses with ``state``, what the map says of their block just before them: absent, dirty or clean.

    Without write updates a write leaves its block dirty and the next read maps it; with them every access leaves it clean. No cache stands in front.
    """
    before = last_before(accesses, BLOCK, F.col("is_read"), name="__b")
    state = F.when(F.col("__b").isNull(), "absent").when(F.col("__b") | F.lit(write_updates), "clean").otherwise("dirty")
    return before.withColumn("state", state).drop("__b")


def members(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Of probes (seq, vol, blk, content): with ``is_member``, whether the block was mapped to that content just before ``seq``.

    A block has one mapping at a time, the last that began: no interval join is needed.
    """
    maps = intervals.select(*BLOCK, F.col("from_seq").alias("seq"), F.struct(F.col("content").alias("c"), F.col("to_seq").alias("end")).alias("m"), F.lit(None).cast("string").alias("content"))
    rows = probes.select(*BLOCK, "seq", F.lit(None).cast(maps.schema["m"].dataType).alias("m"), "content").unionByName(maps)
    rows = last_before(rows, BLOCK, F.col("m"), name="__l").where("m is null")
    alive = F.col("__l.end").isNull() | (F.col("__l.end") >= F.col("seq"))
    return rows.select("seq", *BLOCK, "content", F.coalesce((F.col("__l.c") == F.col("content")) & alive, F.lit(False)).alias("is_member"))


def leader_content(led: DataFrame, disk: DataFrame) -> DataFrame:
    """Reads with a leader (seq, content, lead_vol, lead_blk) and ``lead_content``, what the disk held at the leader then: a check for colliding hashes."""
    # of equal places what the disk got comes first
    asks = led.where("lead_blk is not null").select("seq", F.col("lead_vol").alias("vol"), F.col("lead_blk").alias("blk"), F.lit(None).cast("string").alias("c"), (F.col("seq") * 2 + 1).alias("at"))
    rows = asks.unionByName(disk.select("seq", "vol", "blk", F.col("content").alias("c"), (F.col("seq") * 2).alias("at")))
    got = last_before(rows, BLOCK, F.col("c"), "at", "lead_content").where("at % 2 = 1").select("seq", "lead_content")
    return led.join(got, "seq", "left")


def neighbours(blocks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Blocks (vol, blk, ...; each once) with ``prev_`` and ``next_`` of columns from the blocks right before and after them; null where these are missing. Equi-joins on the block's number."""
    out = blocks
    for side, step in (("prev", 1), ("next", -1)):
        other = blocks.select("vol", (F.col("blk") + step).alias("blk"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        out = out.join(other, list(BLOCK), "left")
    return out
