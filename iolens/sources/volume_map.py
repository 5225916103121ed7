"""Volume maps as text: a name, a capacity and a base a line, ``#`` begins a comment line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_volume_map(spark: SparkSession, path: str) -> DataFrame:
    """(vol, vm, cap, base) of a map file; volumes are numbered in the order of their lines. Lines without three fields fail the job.

    A map has a line a machine; it is read whole.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    rows = rows.select("line", F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\\s+")
    f = F.when(F.assert_true(F.size(f) == 3, F.lit("a volume map line has a name, a capacity and a base")).isNull(), f)
    from pyspark.sql import Window

    vol = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line")) - 1).cast("int")
    return rows.select(vol.alias("vol"), f[0].alias("vm"), f[1].cast("bigint").alias("cap"), f[2].cast("bigint").alias("base"))


def write_volume_map(volumes: DataFrame, path: str) -> None:
    """One text file in the order of volumes, at a new path: the map that was read is never overwritten."""
    line = F.concat_ws(" ", "vm", F.col("cap").cast("string"), F.col("base").cast("string"))
    volumes.orderBy("vol").select(line.alias("value")).coalesce(1).write.text(path)
