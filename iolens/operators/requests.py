"""From requests to block accesses: filters, splitting, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES
from .running import last_before, running_sum

READ_EVENTS = ("DFR", "CFR", "OFR")
WRITE_EVENTS = ("CFNW", "OFNW", "OFDW")


def is_read(event: Column) -> Column:
    return F.when(event.isin(*READ_EVENTS), True).when(event.isin(*WRITE_EVENTS), False)


def replayable(records: DataFrame) -> DataFrame:
    """Records that a replay can use: reads, and writes that carry content or its hash."""
    return records.where(F.col("event").isin("OFR", "CFR", "DFR", "CFNW", "OFNW") | ((F.col("event") == "OFDW") & (F.col("content_flag") == 1)))


def requests_of(records: DataFrame, sector_bits: int = 3) -> DataFrame:
    """Requests (seq, vm, at, blk, nbytes, is_read, content) of trace records.

    Block numbers of records with content are sectors and are shifted; those of records with hashes are blocks. A request without a positive whole
    number of blocks fails the job.
    """
    rows = replayable(records)
    by_hash = F.col("event").isin("CFR", "CFNW")
    sound = (F.col("nbytes") > 0) & (F.col("nbytes") % BLOCK_BYTES == 0)
    size = F.when(F.assert_true(sound, F.lit("request size must be a positive multiple of a block")).isNull(), F.col("nbytes"))
    return rows.select(
        "seq", F.col("host").alias("vm"), F.col("ptime").alias("at"),
        F.when(by_hash, F.col("block")).otherwise(F.shiftright("block", sector_bits)).alias("blk"),
        size.alias("nbytes"), is_read(F.col("event")).alias("is_read"), F.col("data").alias("content"),
    )


def enabled(df: DataFrame, reads: bool = True, writes: bool = True) -> DataFrame:
    if reads and writes:
        return df
    return df.where(F.col("is_read") if reads else ~F.col("is_read")) if reads or writes else df.where(F.lit(False))


def explode_blocks(df: DataFrame, block_size: int = BLOCK_BYTES, content: str = "content", nbytes: str | None = "nbytes") -> DataFrame:
    """A row for each block of a request: ``blk + i`` with the i-th slice of its content, and ``part`` = i.

    Without ``nbytes`` the content's own length counts, and a shorter last slice stays short. Empty requests have no block.
    """
    if nbytes is None and df.schema[content].dataType.simpleString() == "string":
        # one pass over the characters; substring() would count them from the start for every slice
        slices = F.regexp_extract_all(F.col(content), F.lit(f"(?s).{{1,{block_size}}}"), F.lit(0))
        rest = [c for c in df.columns if c not in (content, "blk")]
        out = df.select(*rest, "blk", F.posexplode(slices).alias("part", content))
        return out.select(*(F.col("blk") + F.col("part") if c == "blk" else F.col(c) for c in df.columns), "part").toDF(*df.columns, "part")
    n = F.col(nbytes) / block_size if nbytes else F.ceil(F.length(content) / block_size)
    parts = F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1), lambda i: i < n.cast("int"))
    out = df.withColumn("part", F.explode(parts))
    out = out.withColumn("blk", F.col("blk") + F.col("part"))
    return out.withColumn(content, F.substring(F.col(content), F.col("part") * block_size + 1, F.lit(block_size)))


def drop_zero_blocks(df: DataFrame, content: str = "content", zero: Column | None = None) -> DataFrame:
    """Without blocks of zero bytes; unknown content stays."""
    zero = F.lit(bytes(BLOCK_BYTES)) if zero is None else zero
    return df.where(F.col(content).isNull() | (F.col(content) != zero))


def block_key(vol: Column, blk: Column) -> Column:
    return F.concat_ws(":", vol.cast("string"), blk.cast("string"))


def split_key(key: Column) -> tuple[Column, Column]:
    """(volume or host, block) of a key; hosts may hold colons."""
    at = F.regexp_extract(key, "^(.*):([0-9]+)$", 1), F.regexp_extract(key, "^(.*):([0-9]+)$", 2)
    return at[0], at[1].cast("bigint")


def repeated(df: DataFrame, times: int) -> DataFrame:
    """The log several times in a row, numbered on."""
    n = df.agg(F.max("seq")).first()[0]
    if times == 1 or n is None:
        return df
    rounds = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return df.withColumn("__round", rounds).withColumn("seq", F.col("seq") + F.col("__round") * (n + 1)).drop("__round")


def with_warmup(warmup: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` after ``warmup``, with ``is_warmup``."""
    n = warmup.agg(F.max("seq")).first()[0]
    return warmup.withColumn("is_warmup", F.lit(True)).unionByName(df.withColumn("seq", F.col("seq") + (0 if n is None else n + 1)).withColumn("is_warmup", F.lit(False)))


def scan_layout(df: DataFrame) -> DataFrame:
    """A log read as a scan: every record is a read of the next block of its volume. Blocks are counted in stretches, so a volume is not one task."""
    rows = df.drop("blk", "is_read")
    return running_sum(rows, ("vol",), {"blk": F.lit(1)}).withColumn("blk", F.col("blk").cast("bigint") - 1).withColumn("is_read", F.lit(True))


def mark_last(df: DataFrame) -> DataFrame:
    """A scan with ``is_last`` for the last block of each volume."""
    last = df.groupBy("vol").agg(F.max("seq").alias("__last"))
    return df.join(last, "vol").withColumn("is_last", F.col("seq") == F.col("__last")).drop("__last")


def inversions(df: DataFrame, stream: str = "vol", at: str = "at") -> DataFrame:
    """Rows that come before the first time of their stream, or before the row in front of them: empty for a sound log."""
    return last_before(df.where(F.col(at).isNotNull()), (stream,), F.col(at), name="__p").where(F.col("__p") > F.col(at)).drop("__p")
