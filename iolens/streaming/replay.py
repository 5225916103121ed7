"""Replays and bunches over streams of accesses.

The state of a configuration, its whole machine, is one binary value of Spark's state store, so a query restarts where its checkpoint is. Rows of a micro-batch
are taken in the order of ``seq``; a row that comes after a later one has been replayed cannot be replayed any more and comes out with ``late``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import CacheConfig
from ..plans.replay import MACHINES, OUTCOME_DDL, replay

NAMES = [c.strip().split()[0] for c in OUTCOME_DDL.split(",")]
KINDS = [c.strip().split()[1] for c in OUTCOME_DDL.split(",")]
PANDAS = {"string": "object", "bigint": "Int64", "int": "Int32", "boolean": "boolean"}


def stream_replay(accesses: DataFrame, configs: list[CacheConfig]) -> DataFrame:
    """Outcomes (as of a batch replay, with ``late``) of a stream (seq, vol, blk, ioblk, is_read, content), in append mode."""
    packed = pickle.dumps(configs)
    rows = accesses.select("seq", "vol", "blk", "ioblk", "is_read", "content").withColumn("config", F.explode(F.array(*(F.lit(i) for i in range(len(configs))))))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = pickle.loads(packed)[int(key[0])]
        machine, last = pickle.loads(state.get[0]) if state.exists else (MACHINES[c.mode](c), -1)
        got = pd.concat(list(frames)).sort_values("seq", kind="stable")
        late, due = got[got.seq <= last], got[got.seq > last]
        cols = [due[n].astype(object).where(due[n].notna(), None).tolist() for n in ("seq", "vol", "blk", "ioblk", "is_read", "content")]
        out = [o | {"late": False} for o in replay(zip(*cols, [False] * len(due), strict=True), c, machine)]
        out += [{"seq": r.seq, "vol": r.vol, "blk": r.blk, "ioblk": r.ioblk, "is_read": r.is_read, "is_warmup": False, "late": True} for r in late.itertuples()]
        if len(due):
            last = int(due.seq.max())
        state.update((pickle.dumps((machine, last)),))
        frame = pd.DataFrame({n: pd.Series([o.get(n) for o in out], dtype=PANDAS[k]) for n, k in zip([*NAMES, "late"], [*KINDS, "boolean"], strict=True)})
        frame["config"], frame["mode"] = c.name, c.mode
        yield frame

    return rows.groupBy("config").applyInPandasWithState(step, OUTCOME_DDL + ", late boolean", "machine binary", "append", GroupStateTimeout.NoTimeout)


def stream_counters(accesses: DataFrame, window: str = "1 minute", lateness: str = "1 minute", time: str = "ts") -> DataFrame:
    """(start, vol, reads, writes, contents) by tumbling windows of event time, with a watermark for late rows."""
    w = accesses.withWatermark(time, lateness).groupBy(F.window(time, window), "vol")
    out = w.agg(F.count_if("is_read").alias("reads"), F.count_if(~F.col("is_read")).alias("writes"), F.approx_count_distinct("content").alias("contents"))
    return out.select(F.col("window.start").alias("start"), "vol", "reads", "writes", "contents")
