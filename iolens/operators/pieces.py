"""Pieces of blocks: merging neighbours, stitching them together, splitting at block borders, bunches of requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import BLOCK_BYTES
from .running import running_sum
from .sequence import kept

#: A bunch holds this many requests and lasts this many nanoseconds.
BUNCH_SIZE, BUNCH_NS = 8, 10_000_000


def merge_pieces(pieces: DataFrame, order: tuple[str, ...] = ("seq", "part")) -> DataFrame:
    """Pieces (seq, part, ioblk, start, end) of an access, a piece that continues the one before it in the same block joined to it.

    ``end`` is exclusive; the result has the ``part`` of the first piece and ``merged``, how many pieces it holds.
    """
    access, *rest = order
    w = Window.partitionBy(access).orderBy(*rest)
    new = ~((F.lag("ioblk").over(w) == F.col("ioblk")) & (F.lag("end").over(w) == F.col("start")))
    rows = pieces.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(access, "__run").agg(F.min(rest[0]).alias(rest[0]), F.first("ioblk").alias("ioblk"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged"))
    return out.drop("__run")


def split_at_blocks(pieces: DataFrame, block_size: int = BLOCK_BYTES) -> DataFrame:
    """Pieces (blk, start, nbytes) that may run over the end of their block, cut into one row a block with start and nbytes inside it."""
    first = F.col("blk") + F.floor(F.col("start") / block_size)
    last = F.col("blk") + F.floor((F.col("start") + F.col("nbytes") - 1) / block_size)
    rows = pieces.where("nbytes > 0").withColumn("__b", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start"), (F.col("__b") - F.col("blk")) * block_size)
    hi = F.least(F.col("start") + F.col("nbytes"), (F.col("__b") - F.col("blk") + 1) * block_size)
    return rows.withColumns({"start": F.pmod(lo, F.lit(block_size)), "nbytes": hi - lo, "blk": F.col("__b")}).drop("__b")


def stitched(pieces: DataFrame, by: str = "seq", content: str = "content", block_size: int = BLOCK_BYTES, pad: Column | None = None) -> DataFrame:
    """(by, content): pieces in the order of ``part`` put together and padded with zeros to a block."""
    zeros = F.lit(bytes(block_size)) if pad is None else pad
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", F.col(content).alias("c")))), lambda p: p["c"])
    whole = F.aggregate(parts, F.lit(b"") if pad is None else F.lit(""), lambda a, c: F.concat(a, c))
    return pieces.groupBy(by).agg(whole.alias(content)).withColumn(content, F.concat(F.col(content), F.substring(zeros, F.lit(1), F.lit(block_size) - F.length(content))))


def stitch_check(pieces: DataFrame, blocks: DataFrame, by: str = "seq", content: str = "content", block_size: int = BLOCK_BYTES) -> DataFrame:
    """Accesses whose pieces do not put their block together; empty if all is well."""
    got = stitched(pieces, by, content, block_size).withColumnRenamed(content, "__got")
    return blocks.join(got, by, "full_outer").where(~F.col("__got").eqNullSafe(F.col(content))).select(by)


def bunches(requests: DataFrame, size: int = BUNCH_SIZE, ns: int = BUNCH_NS, stream: str = "vol", span: int = 1 << 16) -> DataFrame:
    """Requests (stream, seq, at) with ``bunch``, the ``seq`` of the first request of their bunch.

    A bunch of a stream ends when it holds ``size`` requests or when the next comes more than ``ns`` after its first. Where bunches begin follows from the one
    before; but the first to begin in a stretch of a stream is one of its first ``size`` requests, so each stretch tells for each of these where the next stretch's first begins. These small tables, a row a
    stretch, are followed in order; then every stretch is marked by itself. A request earlier than its predecessor fails the job.
    """
    kind = requests.schema[stream].dataType.simpleString()
    rows = running_sum(requests.select(stream, "seq", "at"), (stream,), {"i": F.lit(1)}).withColumn("i", F.col("i").cast("bigint") - 1)
    rows = kept(rows.withColumn("stretch", F.floor(F.col("i") / span)))
    # the first requests of a stretch are also seen by the one before
    ahead = rows.where((F.col("stretch") > 0) & (F.col("i") % span < size)).withColumn("stretch", F.col("stretch") - 1)
    seen = rows.withColumn("own", F.lit(True)).union(ahead.withColumn("own", F.lit(False)))

    def ordered(table: pa.Table, *names: str) -> list[np.ndarray]:
        """Columns of a stretch, its rows in their order."""
        place = np.argsort(table.column("i").to_numpy())
        return [table.column(n).to_numpy()[place] for n in names]

    def following(at: np.ndarray, n: int) -> list[int]:
        """For each of the first n requests, were it the first of a bunch, the one that the next bunch begins with."""
        return np.minimum(np.arange(n) + size, np.searchsorted(at, at[:n] + ns, side="right")).tolist()

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        seq, at, own = ordered(table, "seq", "at", "own")
        if (late := np.flatnonzero(np.diff(at) < 0)).size:
            raise ValueError(f"request {seq[late[0] + 1]} comes before its predecessor")
        n = int(own.sum())
        after = following(at, n)
        leave, last = [0] * n, [0] * n
        for j in range(n - 1, -1, -1):
            to = after[j]
            leave[j], last[j] = (to - n, int(seq[j])) if to >= n else (leave[to], last[to])
        name, stretch = (k.as_py() for k in key)
        return pa.Table.from_pylist([{stream: name, "stretch": stretch, "leave": leave[:size], "last": last[:size]}], schema=told)

    # grouped, not dealt out by hand: a plan may leave out a repartition after a join and then read the join's input in other parts, but what groups require it keeps
    told = to_arrow_schema(T.StructType.fromDDL(f"`{stream}` {kind}, stretch bigint, leave array<int>, last array<bigint>"))
    tables = seen.groupBy(stream, "stretch").applyInArrow(tell, f"`{stream}` {kind}, stretch bigint, leave array<int>, last array<bigint>")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, enter, open_ = object(), 0, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r[stream] != now:
                    now, enter, open_ = r[stream], 0, None
                out.append({stream: now, "stretch": r["stretch"], "enter": enter, "open": open_})
                if enter < len(r["leave"]):
                    enter, open_ = r["leave"][enter], r["last"][enter]
            yield pa.RecordBatch.from_pylist(out, schema=followed)

    followed = to_arrow_schema(T.StructType.fromDDL(f"`{stream}` {kind}, stretch bigint, enter int, open bigint"))
    entries = tables.repartition(stream).sortWithinPartitions(stream, "stretch").mapInArrow(follow, f"`{stream}` {kind}, stretch bigint, enter int, open bigint")

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        seq, at, own = ordered(table, "seq", "at", "own")
        enter, open_ = table.column("enter")[0].as_py(), table.column("open")[0].as_py()
        n = int(own.sum())
        after, j, first = following(at, n), enter, []
        while j < n:
            first.append(j)
            j = after[j]
        which = np.searchsorted(first, np.arange(n), side="right") - 1
        bunch = seq[first][which] if first else np.zeros(n, np.int64)
        bunch = np.where(which >= 0, bunch, 0 if open_ is None else open_)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, marked_as.field(0).type), pa.array(seq[:n]), pa.array(bunch.astype(np.int64))], schema=marked_as)

    marked_as = to_arrow_schema(T.StructType.fromDDL(f"`{stream}` {kind}, seq bigint, bunch bigint"))
    marked = seen.join(entries, [stream, "stretch"]).groupBy(stream, "stretch").applyInArrow(mark, f"`{stream}` {kind}, seq bigint, bunch bigint")
    return requests.join(marked, [stream, "seq"])
