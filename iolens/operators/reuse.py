"""LRU caches of every size from reuse distances.

The reuse distance of an access is the number of different keys since the last access of its key; an LRU cache of ``c`` blocks hits exactly if
it is below ``c`` (Mattson et al. 1970). With p the place of the previous access of the same key, it equals

    #{j < i : prev(j) <= p}  -  (p + 1)

for every place up to p has its own previous access before p. That is a count of points left of and below another, which is split over the cells of
a grid: whole cells by prefix sums of a small matrix, the rest within a column (places) and a row (previous places) of the grid, each of
bounded size. So any log is handled by two shuffles, whatever its hot keys are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import last_before
from .sequence import kept

#: Places of a column of the grid, at least, and columns at most.
CELL, COLUMNS = 1 << 18, 1 << 14


def previous(accesses: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Accesses with ``prev_seq``, the place of the previous access of the same key."""
    return last_before(accesses, key, F.col("seq"), name="prev_seq")


def dominated(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the number of points with x < qx and y <= qy: points in blocks by x, each block sorted by y."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    at = np.searchsorted(x, qx)
    out = np.zeros(len(qx), np.int64)
    step = max(64, int(len(x) ** 0.5))
    by = np.argsort(at, kind="stable")
    for lo in range(0, len(x), step):
        hi = min(lo + step, len(x))
        later = by[np.searchsorted(at[by], hi) :]
        out[later] += np.searchsorted(np.sort(y[lo:hi]), qy[later], side="right")
    # what is left of each query's own block
    base = at // step * step
    for k in range(step):
        some = np.flatnonzero(at - base > k)
        if not len(some):
            break
        out[some] += y[base[some] + k] <= qy[some]
    return out


def _grouped(rows: DataFrame, group: str) -> DataFrame:
    """(seq, n) of the queries of rows (group, x, y, qx, qy, seq): points have x, queries qx."""
    schema = pa.schema([("seq", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> pa.RecordBatch:
            t = np.concatenate(parts)
            p, q = t[t[:, 2] == 0], t[t[:, 2] == 1]
            n = dominated(p[:, 0], p[:, 1], q[:, 0], q[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(q[:, 3]), pa.array(n)], schema=schema)

        for b in batches:
            if not len(b):
                continue
            g, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            t = np.stack(rest, 1).astype(np.int64)
            cut = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if g[lo] != now:
                    if parts:
                        yield close()
                    now, parts = g[lo], []
                parts.append(t[lo:hi])
        if parts:
            yield close()

    rows = rows.select(group, "x", "y", "asks", "seq").repartition(group).sortWithinPartitions(group)
    return rows.mapInArrow(run, "seq bigint, n bigint")


def _whole_cells(grid: DataFrame, columns: int, cell: int) -> DataFrame:
    """(col, row, n): points in all cells of smaller columns and rows, by sums along columns and then along rows of the grid.

    A previous place is smaller than its own, so the grid is a triangle: rows do not exceed their column, and columns before a row lie below it in full.
    """
    cells = grid.sparkSession.range(columns).select(F.col("id").alias("col"), F.explode(F.sequence(F.lit(-1).cast("bigint"), F.col("id"))).alias("row"))
    cells = cells.join(grid, ["col", "row"], "left")
    low = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("n", F.coalesce(F.sum("n").over(low), F.lit(0)))
    full = F.greatest(F.col("row"), F.lit(0)) * cell
    return cells.withColumn("n", F.coalesce(F.sum("n").over(left), F.lit(0)) + full).select("col", "row", "n")


def reuse_distances(accesses: DataFrame, key: tuple[str, ...] = ("vol", "blk"), cell: int = CELL) -> DataFrame:
    """Accesses (``seq`` dense from 0) with ``distance``; null for the first access of a key."""
    rows = kept(previous(accesses, key))
    length = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    cell = max(cell, -(-length // COLUMNS))
    points = rows.select("seq", F.coalesce("prev_seq", F.lit(-1)).cast("bigint").alias("prev")).withColumn("col", F.floor(F.col("seq") / cell)).withColumn("row", F.floor(F.col("prev") / cell))
    before = _whole_cells(points.groupBy("col", "row").agg(F.count("*").alias("n")), -(-length // cell), cell)
    asks = points.where("prev >= 0")
    lit = lambda v: F.lit(v).cast("int")
    in_col = points.select(F.col("col").alias("g"), F.col("seq").alias("x"), F.col("prev").alias("y"), lit(0).alias("asks"), "seq")
    in_col = in_col.union(asks.select("col", "seq", "prev", lit(1), "seq"))
    # in a row of the grid: points of earlier columns only, so columns are compared
    in_row = points.select(F.col("row").alias("g"), F.col("col").alias("x"), F.col("prev").alias("y"), lit(0).alias("asks"), "seq").where("y >= 0")
    in_row = in_row.union(asks.select("row", "col", "prev", lit(1), "seq"))
    counts = _grouped(in_col, "g").union(_grouped(in_row, "g"))
    whole = asks.join(before, ["col", "row"]).select("seq", "n")
    # first touches of earlier columns lie below every row
    total = counts.union(whole).groupBy("seq").agg(F.sum("n").alias("n"))
    return rows.join(total, "seq", "left").withColumn("distance", F.col("n") - F.col("prev_seq") - 1).drop("n")


def reuse_distances_joined(accesses: DataFrame, key: tuple[str, ...] = ("vol", "blk")) -> DataFrame:
    """The same by the definition, as an interval self-join: for short logs and as a check."""
    rows = previous(accesses, key)
    j = rows.select(F.col("seq").alias("j"), F.coalesce("prev_seq", F.lit(-1)).alias("j_prev"))
    n = rows.where("prev_seq is not null").join(j, (F.col("j") > F.col("prev_seq")) & (F.col("j") < F.col("seq")) & (F.col("j_prev") <= F.col("prev_seq")), "left")
    n = n.groupBy("seq").agg(F.count("j").alias("distance"))
    return rows.join(n, "seq", "left")


def lru_hits(accesses: DataFrame, capacity: int, key: tuple[str, ...] = ("vol", "blk")) -> DataFrame:
    out = accesses if "distance" in accesses.columns else reuse_distances(accesses, key)
    return out.withColumn("hit", F.coalesce(F.col("distance") < capacity, F.lit(False)))


def lru_curve(distances: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, hits, misses, read_hits, write_hits) for many sizes in one pass: a histogram of distances, then sums over it."""
    h = distances.groupBy(F.coalesce("distance", F.lit(-1)).alias("d"), "is_read").agg(F.count("*").alias("n"))
    h = h.withColumn("capacity", F.explode(F.array(*map(F.lit, sorted(set(capacities))))))
    hit = (F.col("d") >= 0) & (F.col("d") < F.col("capacity"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return h.groupBy("capacity").agg(n(hit).alias("hits"), n(~hit).alias("misses"), n(hit & F.col("is_read")).alias("read_hits"), n(hit & ~F.col("is_read")).alias("write_hits"))
