"""Disk images as blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES
from .trace import _files


def read_image(spark: SparkSession, path: str, blocks_per_task: int = 16_384, with_content: bool = False) -> DataFrame:
    """(file, blk, is_zero, content) of the images at ``path``: content is the block's MD5 in hex, or its bytes.

    Images are cut into ranges that tasks read side by side. A short last block is filled with zeros.
    """
    ranges = []
    for f in _files(path):
        fs, name = pafs.FileSystem.from_uri(f) if "://" in f else (pafs.LocalFileSystem(), f)
        size = fs.get_file_info(name).size
        ranges += [(f, k) for k in range(0, -(-size // BLOCK_BYTES), blocks_per_task)]
    kind = "binary" if with_content else "string"
    ddl = f"file string, blk bigint, is_zero boolean, content {kind}"
    if not ranges:
        return spark.createDataFrame([], ddl)
    schema = pa.schema([("file", pa.string()), ("blk", pa.int64()), ("is_zero", pa.bool_()), ("content", pa.binary() if with_content else pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for i in b.column(0).to_pylist():
                f, first = ranges[i]
                fs, name = pafs.FileSystem.from_uri(f) if "://" in f else (pafs.LocalFileSystem(), f)
                with fs.open_input_file(name) as g:
                    for k in range(first, first + blocks_per_task, 256):
                        data = g.read_at(min(256, first + blocks_per_task - k) * BLOCK_BYTES, k * BLOCK_BYTES)
                        if not data:
                            break
                        blocks = [data[j : j + BLOCK_BYTES].ljust(BLOCK_BYTES, b"\0") for j in range(0, len(data), BLOCK_BYTES)]
                        cols = [[name.rsplit("/", 1)[-1]] * len(blocks), list(range(k, k + len(blocks))), [not any(x) for x in blocks], blocks if with_content else [hashlib.md5(x).hexdigest() for x in blocks]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, ddl)


def scan_counts(blocks: DataFrame) -> DataFrame:
    """(file, blocks, zeros, uniques) of scanned images."""
    per = blocks.groupBy("file", "content").agg(F.count("*").alias("n"), F.first("is_zero").alias("z"))
    return per.groupBy("file").agg(F.sum("n").alias("blocks"), F.coalesce(F.sum(F.when(F.col("z"), F.col("n"))), F.lit(0)).alias("zeros"), F.count_if(~F.col("z")).alias("uniques"))
