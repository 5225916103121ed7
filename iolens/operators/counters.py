"""Counters of a replay, and what must hold between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def counters(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (a group) of counters from outcomes: seq, is_read, hit, meta (absent, dirty, clean or null), self, cc_hit, cc_self, disk, is_warmup.

    Warm-up accesses do not count. ``cc_hit`` is the content cache's answer (null where it was not asked), ``cc_self`` whether the block it
    holds the content for is the one asked for. ``meta`` of content mode is looked up on block-cache misses only.
    """
    df = outcomes.where(~F.coalesce(F.col("is_warmup"), F.lit(False))) if "is_warmup" in outcomes.columns else outcomes
    for name in ("meta", "self", "cc_hit", "cc_self", "mode"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string" if name in ("meta", "mode") else "boolean"))
    r, w = F.col("is_read"), ~F.col("is_read")
    hit, miss = F.col("hit"), ~F.col("hit")
    clean, dirty, absent = (F.col("meta") == x for x in ("clean", "dirty", "absent"))
    cc, no_cc = F.col("cc_hit"), ~F.col("cc_hit")
    content = F.col("mode") == "content"
    return df.groupBy(*by).agg(
        _n(r).alias("reads"), _n(w).alias("writes"),
        _n(r & hit).alias("bcache_hits_r"), _n(r & miss).alias("bcache_misses_r"), _n(w & hit).alias("bcache_hits_w"), _n(w & miss).alias("bcache_misses_w"),
        _n(r & miss & absent).alias("compulsory_misses"), _n(r & miss & (dirty | F.when(content, clean & no_cc).otherwise(clean))).alias("capacity_misses"),
        _n(r & clean).alias("map_hits"), _n(r & (absent | dirty)).alias("map_misses"), _n(r & dirty).alias("map_dirties"),
        _n(r & clean & F.col("self")).alias("self_is_leader"), _n(r & clean & ~F.col("self")).alias("self_not_leader"),
        _n(r & clean & F.col("self") & hit).alias("self_hits"), _n(r & clean & F.col("self") & miss).alias("self_misses"),
        _n(r & clean & ~F.col("self") & hit).alias("dedup_hits"), _n(r & clean & ~F.col("self") & miss).alias("dedup_misses"),
        _n(r & (absent | dirty) & hit).alias("mapmiss_cachehits"), _n(r & dirty & hit).alias("mapdirty_cachehits"), _n(r & (absent | dirty) & miss).alias("mapmiss_cachemisses"),
        _n(r & cc).alias("ccache_hits_r"), _n(r & no_cc).alias("ccache_misses_r"), _n(w & cc).alias("ccache_hits_w"), _n(w & no_cc).alias("ccache_misses_w"),
        _n(r & cc & ~F.col("cc_self")).alias("ccache_dedup_hits"), _n(r & cc & F.col("cc_self")).alias("ccache_nondedup_hits"),
        _n(r & no_cc & ~F.col("self")).alias("ccache_dedup_misses"), _n(r & no_cc & F.col("self")).alias("ccache_nondedup_misses"),
        _n(r & F.col("disk")).alias("disk_reads"), _n(w & F.col("disk")).alias("disk_writes"),
    )


#: What must hold between counters: name, modes, equation.
INVARIANTS = [
    ("reads are accounted for", ("fixed", "content"), "reads = compulsory_misses + bcache_hits_r + ccache_hits_r + capacity_misses"),
    ("every read meets the block cache", ("plain", "fixed", "content"), "reads = bcache_hits_r + bcache_misses_r"),
    ("every write meets the block cache", ("plain", "fixed", "content"), "writes = bcache_hits_w + bcache_misses_w and writes = disk_writes"),
    ("misses read the disk", ("plain", "fixed"), "disk_reads = bcache_misses_r"),
    ("misses are compulsory or of capacity", ("fixed",), "bcache_misses_r = compulsory_misses + capacity_misses"),
    ("clean reads split", ("fixed",), "map_hits = dedup_hits + self_hits + dedup_misses + self_misses"),
    ("leaders split", ("fixed",), "self_is_leader = self_hits + self_misses and self_not_leader = dedup_hits + dedup_misses"),
    ("compulsory misses", ("fixed",), "compulsory_misses = map_misses - map_dirties - mapmiss_cachehits + mapdirty_cachehits"),
    ("capacity misses", ("fixed",), "capacity_misses = dedup_misses + self_misses + map_dirties - mapdirty_cachehits"),
    ("map hits", ("fixed",), "map_hits = capacity_misses - (map_dirties - mapdirty_cachehits) + bcache_hits_r - mapmiss_cachehits"),
    ("content cache splits", ("content",), "map_hits = ccache_dedup_hits + ccache_nondedup_hits + ccache_dedup_misses + ccache_nondedup_misses"),
    ("content misses", ("content",), "ccache_misses_r + map_dirties = capacity_misses and compulsory_misses + map_dirties = map_misses"),
    ("content capacity", ("content",), "capacity_misses = ccache_dedup_misses + ccache_nondedup_misses + map_dirties and map_hits = capacity_misses - map_dirties + ccache_hits_r"),
    ("content leaders", ("content",), "self_is_leader = ccache_nondedup_hits + ccache_nondedup_misses and self_not_leader = ccache_dedup_hits + ccache_dedup_misses"),
    ("content disk reads", ("content",), "disk_reads = compulsory_misses + capacity_misses"),
]


def broken_invariants(counted: DataFrame, mode: str) -> DataFrame:
    """(invariant) of those that do not hold for a counter row of ``mode``: empty if all do."""
    checks = [F.when(~F.expr(f"({cond})"), F.lit(name)) for name, modes, cond in INVARIANTS if mode in modes]
    return counted.select(F.explode(F.array_compact(F.array(*checks))).alias("invariant")) if checks else counted.select(F.lit("").alias("invariant")).limit(0)
