"""How often contents repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sum


def content_hash(content: Column) -> Column:
    """MD5 in hex of a block's bytes (of text: of its UTF-8)."""
    return F.md5(content)


def seen_before(insertions: DataFrame, content: str = "content", order: str = "seq") -> DataFrame:
    """Insertions with ``is_duplicate``: whether their content was inserted before."""
    first = insertions.groupBy(content).agg(F.min(order).alias("__first"))
    return insertions.join(first, content, "left").withColumn("is_duplicate", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__first")


def unique_and_total(insertions: DataFrame, content: str = "content", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., total, uniques, duplicates) of known contents; contents are summed before their groups are."""
    per = insertions.where(F.col(content).isNotNull()).groupBy(*by, content).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("uniques")).withColumn("duplicates", F.col("total") - F.col("uniques"))


def live_factor(intervals: DataFrame) -> DataFrame:
    """Mapping intervals with ``factor``: blocks that map their content when they do, themselves included."""
    ends = intervals.where("to_seq is not null").select("content", F.col("to_seq").alias("seq"), F.lit(-1).alias("d"))
    starts = intervals.select("content", F.col("from_seq").alias("seq"), F.lit(1).alias("d"))
    # at equal places the overwritten mapping goes first
    live = running_sum(starts.union(ends), ("content",), {"factor": F.col("d")}, ("seq", "d")).where("d = 1").select("content", F.col("seq").alias("from_seq"), "factor")
    return intervals.join(live, ["content", "from_seq"])


def factor_histogram(factors: DataFrame, top: int = 9) -> DataFrame:
    """(factor, insertions) for factors 1 to ``top``, larger ones under ``top + 1``."""
    return factors.groupBy(F.least("factor", F.lit(top + 1)).alias("factor")).agg(F.count("*").alias("insertions"))


def live_items(changes: DataFrame) -> DataFrame:
    """Of rows (seq, content, d = 1 inserted or -1 deleted): each with ``total`` and ``uniques`` then live.

    Uniques change when a content's own count leaves or reaches 0. Both counts are running sums in stretches, offset by the sums before them.
    """
    rows = running_sum(changes, ("content",), {"__n": F.col("d")}, ("seq", "d"))
    new = F.when((F.col("__n") == 1) & (F.col("d") == 1), 1).when((F.col("__n") == 0) & (F.col("d") == -1), -1).otherwise(0)
    return running_sum(rows, (), {"total": F.col("d"), "uniques": new}, ("seq", "d")).drop("__n")


def cross_and_own_duplicates(accesses: DataFrame) -> DataFrame:
    """(vol, inserts, own_duplicates, cross_duplicates): contents first seen in the volume itself, or in another, before."""
    first = accesses.groupBy("content").agg(F.min("seq").alias("any"))
    own = accesses.groupBy("content", "vol").agg(F.min("seq").alias("own"), F.count("*").alias("n"))
    per = own.join(first, "content")
    later = F.when(F.col("any") < F.col("own"), 1).otherwise(0)
    return per.groupBy("vol").agg(F.sum("n").alias("inserts"), F.sum(F.col("n") - 1).alias("own_duplicates"), F.sum(later).alias("cross_duplicates"))
