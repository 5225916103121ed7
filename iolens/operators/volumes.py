"""Volumes: names, capacities, physical placement, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running_max


def capacities(accesses: DataFrame) -> DataFrame:
    """(vol, cap): one more than the highest block seen of each volume."""
    return accesses.groupBy("vol").agg((F.max("blk") + 1).alias("cap"))


def capacity_over_time(accesses: DataFrame) -> DataFrame:
    return running_max(accesses, ("vol",), {"cap": F.col("blk")}).withColumn("cap", F.col("cap") + 1)


def place(caps: DataFrame) -> DataFrame:
    """(vol, cap, base): volumes one after the other. The number of volumes is that of machines, so one task numbers them."""
    w = Window.partitionBy(F.lit(0)).orderBy("vol").rowsBetween(Window.unboundedPreceding, -1)
    return caps.withColumn("base", F.coalesce(F.sum("cap").over(w), F.lit(0)))


def assign_volumes(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(vm, vol): known names keep their number, others get the next ones in the order they first appear."""
    first = requests.groupBy("vm").agg(F.min("seq").alias("first")).where("vm is not null")
    start = F.lit(0)
    if known is not None:
        first = first.join(known.select("vm"), "vm", "left_anti")
        start = F.lit((known.agg(F.max("vol")).first()[0] if known.take(1) else -1) + 1)
    new = first.select("vm", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first", "vm")) - 1 + start).cast("int").alias("vol"))
    return new if known is None else known.select("vm", F.col("vol").cast("int").alias("vol")).unionByName(new)


def to_physical(accesses: DataFrame, volumes: DataFrame, check: bool = False) -> DataFrame:
    """Accesses with ``ioblk = base + blk``. Volumes of one site are few; adaptive execution broadcasts them when they are small.

    With ``check`` a block beyond its volume's capacity fails the job. Accesses of unknown volumes have a null ``ioblk``.
    """
    out = accesses.join(volumes.select("vol", "base", *(["cap"] if check else [])), "vol", "left")
    io = F.col("base") + F.col("blk")
    if check:
        io = F.when(F.assert_true(F.coalesce(F.col("blk") < F.col("cap"), F.lit(True)), F.lit("block beyond its volume")).isNull(), io)
    return out.withColumn("ioblk", io).drop("base", "cap")


def overlaps(volumes: DataFrame) -> DataFrame:
    """Pairs (a, b, lo, hi) of volumes whose physical ranges overlap, each once.

    Volumes have classes by size, powers of two. Those of a class are cut into cells of that size, two at most a volume, and so are smaller volumes for every larger class there
    is (64 at most). Two ranges that overlap share a cell of the larger one's class, so this is an equi-join, and one huge volume does not make the cells of the others large.
    """
    v = volumes.where("cap > 0").select("vol", "base", (F.col("base") + F.col("cap") - 1).alias("last"), F.ceil(F.log2(F.col("cap"))).cast("int").alias("own"))
    levels = sorted(r["own"] for r in v.select("own").distinct().collect())  # 64 at most
    if not levels:
        return v.selectExpr("vol as a", "vol as b", "base as lo", "last as hi")
    cells = lambda d: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("base") / F.pow(F.lit(2.0), "level")), F.floor(F.col("last") / F.pow(F.lit(2.0), "level")))))
    large = cells(v.withColumn("level", F.col("own"))).toDF("a", "a_lo", "a_hi", "a_own", "level", "cell")
    small = v.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("own"))))
    small = cells(small).toDF("b", "b_lo", "b_hi", "b_own", "level", "cell")
    met = large.join(small, ["level", "cell"]).where("(b_own < a_own or a < b) and a_lo <= b_hi and b_lo <= a_hi")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi")).distinct()
