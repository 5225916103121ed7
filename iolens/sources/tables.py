"""Access logs out of ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import with_seq

VOLUMES = 7
CONTENTS = 40


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without or with time zone (then in the session's)."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def events_accesses(events: DataFrame) -> DataFrame:
    """The events table as a log: a volume for every seventh user, the block from ``props``, contents from a small domain.

    Views, clicks and errors read, everything else writes. Order is time, then event id.
    """
    rows = events.select(
        micros("ts").alias("at"),
        "event_id",
        (F.col("user_id") % VOLUMES).cast("int").alias("vol"),
        F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("bigint").alias("blk"),
        F.col("event_type").isin("view", "click", "error").alias("is_read"),
        F.md5((F.col("event_id") % CONTENTS).cast("string")).alias("content"),
    )
    return with_seq(rows, F.col("at"), F.col("event_id")).select("seq", "at", "vol", "blk", "is_read", "content")


def lineitem_accesses(lineitem: DataFrame) -> DataFrame:
    """The lineitem table as a longer log: volume by supplier, block by part; orders before 1997 read."""
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    rows = lineitem.select("*", micros("l_shipdate").alias("at"))
    rows = with_seq(rows, F.col("at"), *order)
    return rows.select("seq", "at", (F.col("l_suppkey") % VOLUMES).cast("int").alias("vol"), F.col("l_partkey").alias("blk"), (F.col("l_returnflag") != "N").alias("is_read"), F.md5((F.col("l_partkey") % 997).cast("string")).alias("content"))
