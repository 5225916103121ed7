"""What a replay leaves behind: event logs, printed records, the final report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_events(outcomes: DataFrame) -> DataFrame:
    """(config, seq, kind, is_read, vol, blk, factor) of insertions: ``new`` contents and ``dup`` ones, which found their content mapped already."""
    rows = outcomes.where(F.col("duplicate").isNotNull())
    return rows.select("config", "seq", F.when(F.col("duplicate"), "dup").otherwise("new").alias("kind"), "is_read", "vol", "blk", "factor")


def access_log(outcomes: DataFrame) -> DataFrame:
    """(config, seq, component, outcome): what each component an access passed through said of it."""
    parts = [
        F.struct(F.lit("map").alias("component"), F.col("meta").alias("outcome")),
        F.struct(F.lit("block cache").alias("component"), F.when(F.col("hit"), "success").otherwise("fail").alias("outcome")),
        F.struct(F.lit("content cache").alias("component"), F.when(F.col("cc_hit"), "success").when(~F.col("cc_hit"), "fail").alias("outcome")),
        F.struct(F.lit("disk").alias("component"), F.when(F.col("disk"), "reached").alias("outcome")),
    ]
    rows = outcomes.select("config", "seq", F.explode(F.array(*parts)).alias("p"))
    return rows.where("p.outcome is not null").select("config", "seq", "p.component", "p.outcome")


def disk_requests(outcomes: DataFrame) -> DataFrame:
    """(config, seq, ioblk, is_read) of what is left for the disk."""
    return outcomes.where(F.col("disk")).select("config", "seq", F.col("key").alias("ioblk"), "is_read")


def record_lines(records: DataFrame) -> DataFrame:
    """Trace records as text, the content in hex."""
    names = ["event", "ptime", "host", "block", "nbytes", "digest", "content_flag", "process", "pid", "major", "minor"]
    return records.select("seq", F.concat_ws(" ", *(F.col(n).cast("string") for n in names), F.lower(F.hex("data"))).alias("value"))


def processed(records: DataFrame) -> DataFrame:
    """Records as after preprocessing: SFD becomes SFN and OFDW becomes OFNW, with their content flagged."""
    event = F.when(F.col("event") == "SFD", "SFN").when(F.col("event") == "OFDW", "OFNW").otherwise(F.col("event"))
    flag = F.when(F.col("event").isin("SFD", "OFDW", "SFN", "OFNW"), F.lit(1)).otherwise(F.col("content_flag"))
    return records.withColumn("content_flag", flag.cast("int")).withColumn("event", event)


def report(counted: DataFrame) -> DataFrame:
    """Counter rows as (config, counter, value), the shape of a printed report."""
    names = [c for c, kind in counted.dtypes if kind == "bigint"]
    rest = [c for c in counted.columns if c not in names]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("counter"), F.col(n).alias("value")) for n in names))).alias("p")
    return counted.select(*rest, pairs).select(*rest, "p.counter", "p.value")
