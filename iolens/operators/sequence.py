"""A dense total order over a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` for several uses: a checkpoint in the shared folder if the session has one, else kept by the executors, spilling to their disks.

    Kept partitions that are lost with an executor are computed anew.
    """
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def with_seq(df: DataFrame, first: Column, *ties: Column, name: str = "seq", partitions: int | None = None) -> DataFrame:
    """Number rows from 0 in the order of ``first`` and ``ties``, without a global sort in one task. Nulls come first.

    The table is dealt out by ranges of the order and sorted within them, one row's place being its partition and its position there. It is kept in that state, so that places and the
    partitions' counts, the offsets, are of one and the same deal. A row that is equal to another in the whole order may swap places with it. Only one row a partition meets in one task.
    """
    order = [first.asc_nulls_first(), *(t.asc_nulls_first() for t in ties)]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = kept(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    out = placed.withColumn("__part", part).join(offsets, "__part")
    return out.withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__offset")


def dense(df: DataFrame, name: str = "seq", span: int | None = None) -> DataFrame:
    """``df`` with its order ``name`` (whole numbers, each once) numbered anew from 0 without gaps, by counts of stretches."""
    from .running import SPAN, running_sum

    return running_sum(df.withColumnRenamed(name, "__old"), (), {name: F.lit(1)}, ("__old",), span or SPAN).withColumn(name, F.col(name).cast("bigint") - 1).drop("__old")
