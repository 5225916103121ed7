from pyspark.sql import functions as F

from iolens.model import CacheConfig
from iolens.plans.replay import simulate
from iolens.streaming.replay import stream_counters, stream_replay

from .test_replay import ROW, log


def drain(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(log(11, 300), ROW)
    for k in range(3):
        rows.where((F.col("seq") >= 100 * k) & (F.col("seq") < 100 * k + 100)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    late = rows.where("seq = 5").coalesce(1)
    configs = [CacheConfig("fixed", 6), CacheConfig("content", 9, 4)]
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {(r.config, r.seq): (r.hit, r.disk, r.meta, r.cc_hit) for r in drain(spark, stream_replay(src, configs), "replayed", tmp_path)}
    want = {(r.config, r.seq): (r.hit, r.disk, r.meta, r.cc_hit) for r in simulate(rows, configs).collect()}
    assert got == want
    # the query goes on where its checkpoint is: what comes too late is said so
    late.write.parquet(str(tmp_path / "in/9"))
    q = stream_replay(src, configs).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp-replayed2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out")).where("late").count() == 2


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, i, i % 3 > 0, f"c{i % 4}") for i in range(240)], "sec long, vol int, blk long, is_read boolean, content string").withColumn("ts", F.timestamp_seconds("sec"))
    rows.coalesce(1).write.parquet(str(tmp_path / "w"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "w"))
    got = drain(spark, stream_counters(src), "windows", tmp_path, "complete")
    assert sum(r.reads + r.writes for r in got) == 240 and len(got) == 8
