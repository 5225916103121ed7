"""Windows over keys of any weight: last values and running sums by key, in stretches of the order.

A plain window puts all rows of a key into one task. Here rows are grouped by (key, stretch of the order); what a stretch inherits from those before it is one
pre-aggregated row a key and stretch, over which a second, small window runs. A key with a third of a log spreads over its stretches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a stretch.
SPAN = 1 << 18


def last_before(df: DataFrame, keys: tuple[str, ...], value: Column, order: str = "seq", name: str = "last", span: int = SPAN) -> DataFrame:
    """``df`` with ``name``, the last known ``value`` among rows of its key with a smaller ``order``.

    ``value`` is a column that is null where a row says nothing. Rows of one key with equal ``order`` do not see each other.
    """
    rows = df.withColumn("__v", value).withColumn("__s", F.floor(F.col(order) / span))
    latest = rows.groupBy(*keys, "__s").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__l"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    inherited = latest.withColumn("__i", F.last("__l", ignorenulls=True).over(before)).where("__i is not null").select(*keys, "__s", "__i")
    here = Window.partitionBy(*keys, "__s").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    # the frame ends one place earlier: rows of equal order are out
    rows = rows.withColumn("__o", F.last("__v", ignorenulls=True).over(here)).join(inherited, [*keys, "__s"], "left")
    return rows.withColumn(name, F.coalesce("__o", "__i")).drop("__v", "__s", "__o", "__i")


def first_after(df: DataFrame, keys: tuple[str, ...], value: Column, order: str = "seq", name: str = "next", span: int = SPAN) -> DataFrame:
    """The same from the other end: the first known ``value`` among rows of its key with a larger ``order``."""
    return last_before(df.withColumn("__back", -F.col(order)), keys, value, "__back", name, span).drop("__back")


def _running(df: DataFrame, keys: tuple[str, ...], values: dict[str, Column], order: tuple[str, ...], span: int, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    rows = df.withColumns({f"__x_{n}": v for n, v in values.items()}).withColumn("__s", F.floor(F.col(order[0]) / span))
    sums = rows.groupBy(*keys, "__s").agg(*(fold(F.col(f"__x_{n}")).alias(f"__b_{n}") for n in values))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__s", *(fold(F.col(f"__b_{n}")).over(before).alias(f"__b_{n}") for n in values))
    here = Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, [*keys, "__s"])
    out = out.withColumns({n: join(F.col(f"__b_{n}"), fold(F.col(f"__x_{n}")).over(here)) for n in values})
    return out.drop("__s", *(f"__{k}_{n}" for k in "xb" for n in values))


def running_sum(df: DataFrame, keys: tuple[str, ...], values: dict[str, Column], order: tuple[str, ...] = ("seq",), span: int = SPAN) -> DataFrame:
    """``df`` with the running sums of ``values`` by key in the order of ``order`` (the first of it a whole number), the own row included. Without keys over all rows."""
    return _running(df, keys, values, order, span, F.sum, lambda b, x: F.coalesce(b, F.lit(0)) + x)


def running_max(df: DataFrame, keys: tuple[str, ...], values: dict[str, Column], order: tuple[str, ...] = ("seq",), span: int = SPAN) -> DataFrame:
    """The same with running maxima."""
    return _running(df, keys, values, order, span, F.max, F.greatest)
