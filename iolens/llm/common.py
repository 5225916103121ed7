"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that Spark hands to Python at once; texts can be long, so batches stay small.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches at ``rows`` rows or fewer, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give the free memory of a Python worker back to the system: it goes on to other tasks, and their like need what it does not use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def map_rows(
    df: DataFrame, schema: T.StructType | str, start: Callable[[], Callable[..., Sequence]]
) -> DataFrame:
    """Apply ``start()(col1, col2, ...) -> [out1, out2, ...]`` (lists of equal length) to each Arrow batch.

    ``start`` runs once a task and returns the function for batches: it is where models are loaded. What it holds is freed when the task ends.
    """
    bound_batches(df.sparkSession)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, b, cols = start(), None, None
        for b in batches:
            cols = f(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(cols, arrow, strict=True)],
                schema=arrow,
            )
        del f, b, cols
        release()

    return df.mapInArrow(run, schema)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing (local tests) a folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.gettempdir() + "/iolens-work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends at durable files."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`saved` that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df._saved_at)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Hash values that samples are drawn by.
UNITS = 1 << 50


def sample_units(rows: int, wanted: int) -> int:
    """How many of the UNITS hash values are taken of so many rows: never none, whatever their number."""
    return UNITS if rows <= wanted else max(1, -(-UNITS * wanted // rows))


def sampled(df: DataFrame, wanted: int) -> DataFrame:
    """About ``wanted`` of the different rows of ``df``, or all if they are fewer, chosen by a hash of all columns.

    Rows that are equal in every column count once, so one row with any number of copies neither fills nor empties the sample. What is left is small:
    a table of about ``wanted`` rows, whatever the size of ``df``.
    """
    code = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(UNITS))
    n = df.agg(F.approx_count_distinct(code, 0.02).alias("n")).first()["n"]
    units = sample_units(n, wanted)
    return (df if units == UNITS else df.where(code < units)).distinct()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer file ``name`` lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
