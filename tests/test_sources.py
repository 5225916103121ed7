import hashlib
import io
import struct

import pytest
from pyspark.sql import functions as F

from iolens.operators import requests as R
from iolens.sinks import reports
from iolens.sources import trace as T
from iolens.sources.images import read_image, scan_counts
from iolens.sources.volume_map import read_volume_map, write_volume_map

ROWS = [
    {"event": "CFR", "ptime": 5, "host": "web", "block": 7, "nbytes": 4096, "process": "my odd proc", "pid": 12, "major": 8, "minor": 1, "data": b"a" * 32},
    {"event": "OFNW", "ptime": 6, "host": "web", "block": 16, "nbytes": 8192, "digest": "d", "content_flag": 1, "process": "p", "pid": 3, "major": 8, "minor": 0, "data": b"x\n y" * 2048},
    {"event": "OFR", "ptime": 7, "host": "db", "block": 8, "nbytes": 4096, "process": "q", "pid": 4, "major": 8, "minor": 0},
    {"event": "SZ", "ptime": 8, "host": "db", "block": 0, "nbytes": 4096, "process": "zero"},
    {"event": "SFD", "ptime": 9, "host": "db", "block": 1, "nbytes": 4, "digest": "d", "content_flag": 0, "data": b"wxyz"},
]


def encoded(rows, order="<", trailer=False):
    out = b""
    for r in rows:
        body = T.format_event(r)
        out += struct.pack(order + "II", T.MAGIC, len(body)) + body
    return out + (b"%d\n" % len(out) if trailer else b"")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("trailer", [False, True])
def test_records(order, trailer):
    got = list(T.trace_records(io.BytesIO(encoded(ROWS, order, trailer))))
    assert [{k: v for k, v in g.items() if k in w} for g, w in zip(got, ROWS, strict=True)] == ROWS


def test_damage_and_continuation():
    data = encoded(ROWS)
    for bad in (data[:-3], b"xxxx" + data[4:], data + b"123"):
        with pytest.raises(ValueError):
            list(T.trace_records(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        T.parse_event(b"ZZZ 1 2\n")
    body = T.format_event(ROWS[4] | {"nbytes": 10, "content_flag": 1})
    whole = struct.pack("<II", T.MAGIC, len(body)) + body + b"123456\n" + encoded(ROWS[:1])
    got = list(T.trace_records(io.BytesIO(whole)))
    assert got[0]["data"] == b"wxyz123456" and got[1]["host"] == "web"


def test_trace_files(spark, tmp_path):
    T.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.trace").write_bytes(encoded(ROWS))
    (tmp_path / "in" / "b.trace").write_bytes(encoded(ROWS[:2], ">", True))
    (tmp_path / "in" / "c.trace").write_bytes(b"")
    df = spark.read.format("io_trace").load(str(tmp_path / "in"))
    assert df.count() == 7 and df.select("seq").distinct().count() == 7
    req = R.requests_of(df).orderBy("seq").collect()
    assert [(r.vm, r.blk, r.is_read) for r in req][:3] == [("web", 7, True), ("web", 2, False), ("db", 1, True)]
    blocks = R.explode_blocks(R.requests_of(df)).where("not is_read").orderBy("seq", "part").collect()
    assert [r.blk for r in blocks] == [2, 3, 2, 3] and bytes(blocks[0].content) == (b"x\n y" * 2048)[:4096]
    reports.processed(df).orderBy("seq").write.format("io_trace").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("io_trace").load(str(tmp_path / "out"))
    assert sorted(r.event for r in back.collect()) == sorted(["CFR", "OFNW", "OFR", "SZ", "SFN", "CFR", "OFNW"])
    assert reports.record_lines(df).where("value like 'CFR 5 web 7 4096 my odd proc%'").count() == 2
    bad = df.withColumn("nbytes", F.lit(100))
    with pytest.raises(Exception, match="multiple of a block"):
        R.requests_of(bad).collect()


def test_bunch_files(spark, tmp_path):
    T.register(spark)
    rows = [(i // 3, 100 + i // 3, f"vm{i % 2}", i, 4096, i % 4 > 0, (b"%032d" % i)) for i in range(10)]
    df = spark.createDataFrame(rows, "bunch bigint, at bigint, host string, block bigint, nbytes bigint, is_read boolean, data binary")
    df.coalesce(1).orderBy("bunch").write.format("io_bunches").mode("append").save(str(tmp_path / "b"))
    back = spark.read.format("io_bunches").load(str(tmp_path / "b")).orderBy("seq").collect()
    assert [(r.bunch, r.at, r.host, r.block, r.nbytes, r.is_read, bytes(r.data)) for r in back] == rows
    with pytest.raises(ValueError):
        list(T.bunch_records(io.BytesIO(struct.pack("<4Q", 1, 0, 1, 1))))
    assert list(T.bunch_records(io.BytesIO(b""))) == []


def test_volume_maps(spark, tmp_path):
    (tmp_path / "map.txt").write_text("# vm cap base\nweb 100 0\n\n  mail   50 100\n")
    v = read_volume_map(spark, str(tmp_path / "map.txt"))
    assert [tuple(r) for r in v.orderBy("vol").collect()] == [(0, "web", 100, 0), (1, "mail", 50, 100)]
    write_volume_map(v, str(tmp_path / "out"))
    assert read_volume_map(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.txt").write_text("web 100\n")
    with pytest.raises(Exception, match="volume map line"):
        read_volume_map(spark, str(tmp_path / "bad.txt")).collect()


def test_images(spark, tmp_path):
    data = b"a" * 4096 + bytes(8192) + b"a" * 4096 + b"tail"
    (tmp_path / "disk.img").write_bytes(data)
    df = read_image(spark, str(tmp_path), blocks_per_task=2)
    got = df.orderBy("blk").collect()
    assert [r.is_zero for r in got] == [False, True, True, False, False]
    assert got[0].content == hashlib.md5(b"a" * 4096).hexdigest()
    c = scan_counts(df).first()
    assert (c.blocks, c.zeros, c.uniques) == (5, 2, 2)
