"""The latest of the intervals alive at a place, by key, whatever a key's weight.

An interval begins with a mapping and ends with an overwriting. For a place in a stretch of the order there are three kinds of intervals: those that begin in the stretch, those that end in it, and those that hold all
through it. The first two are bounded by the stretch's own length. Of the last only the one that began last matters: one row a key and stretch. To find it, the stretches an interval
holds through are put together from few aligned runs of 1, 2, 4 ... stretches, as in a segment tree; the latest interval of each run is pre-aggregated, and a stretch looks at the runs it lies in.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .running import SPAN


def _runs(lo, hi, levels: int):
    """Aligned runs (level, number) that make up the stretches from ``lo`` to before ``hi``."""
    half = lambda x, n: F.floor(x / F.pow(F.lit(2.0), n)).cast("bigint")

    def at(n):
        a, b = -half(-lo, n), half(hi, n)
        run = lambda c, x: F.when(c & (a < b), F.struct(n.cast("int").alias("level"), x.alias("run")))
        return F.array(run(a % 2 == 1, a), run(b % 2 == 1, b - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def latest_live(asks: DataFrame, maps: DataFrame, keys: tuple[str, ...], span: int = SPAN) -> DataFrame:
    """``asks`` (seq, keys) with ``o``, of the intervals ``m`` (seq, ..., end) of their key that began before and have not ended at ``seq`` the one that began last; null if none."""
    asks = asks.withColumn("__s", F.floor(F.col("seq") / span))
    begun, ended = F.floor(F.col("m.seq") / span), F.floor(F.col("m.end") / span)
    last = asks.agg(F.max("__s")).first()[0]
    kind = maps.schema["m"].dataType
    if last is None:
        return asks.drop("__s").withColumn("o", F.lit(None).cast(kind))
    levels = int(last + 2).bit_length()
    wanted = asks.select(*keys, "__s").distinct()
    # the latest interval that holds all through a stretch
    runs = maps.select(*keys, "m", F.explode(_runs(begun + 1, F.coalesce(ended, F.lit(last + 1)), levels)).alias("__r"))
    runs = runs.groupBy(*keys, F.col("__r.level").alias("__level"), F.col("__r.run").alias("__run")).agg(F.max("m").alias("m"))
    looks = wanted.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("__run", F.floor(F.col("__s") / F.pow(F.lit(2.0), "__level")))
    through = looks.join(runs, [*keys, "__level", "__run"]).groupBy(*keys, "__s").agg(F.max("m").alias("m"))
    # what begins or ends in a stretch that is asked for
    inside = maps.select(*keys, begun.alias("__s"), "m").union(maps.where(ended > begun).select(*keys, ended.alias("__s"), "m")).join(wanted, [*keys, "__s"], "left_semi")
    rows = inside.unionByName(through).select(*keys, "__s", F.col("m.seq").alias("__at"), F.lit(True).alias("__is_map"), "m")
    rows = rows.unionByName(asks.select(*keys, "__s", F.col("seq").alias("__at"), F.lit(False).alias("__is_map"), F.lit(None).cast(kind).alias("m")))
    rows = rows.withColumn("__end", F.col("m.end")).repartition(*keys, "__s").sortWithinPartitions(*keys, "__s", "__at", "__is_map")
    rows = rows.select(*keys, "__s", "__at", "__is_map", "__end", "m")
    out = asks.select("seq").withColumn("o", F.lit(None).cast(kind)).schema
    arrow, n = to_arrow_schema(out), len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            seqs, found = [], []
            for key, at, is_map, end, m in zip(zip(*cols[:n], strict=True), *cols[n:], strict=True):
                if key != now:
                    now, live = key, []
                if is_map:
                    heapq.heappush(live, (-at, float("inf") if end is None else end, id(m), m))
                    continue
                while live and live[0][1] <= at:  # it ended; places only grow
                    heapq.heappop(live)
                seqs.append(at)
                found.append(live[0][3] if live else None)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(found, arrow.field("o").type)], schema=arrow)

    return rows.mapInArrow(run, out)
