import hashlib
import hmac

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from iolens.functions import codec, hashing, rabin
from iolens.functions.expand import expand
from iolens.functions.rabin import ChunkRule


def plain_cuts(data, rule):
    """Byte by byte, from the definition: the window's bytes as a polynomial, reduced bit by bit."""
    out, start = [], 0
    while start < len(data):
        end = len(data)
        for i in range(1, len(data) - start + 1):
            if i >= rule.largest:
                end = start + i
                break
            if i > rule.window and i >= rule.smallest:
                x = int.from_bytes(data[start + i - rule.window : start + i], "big")
                if rabin.remainder(x, 1 << rule.bits | rule.poly) & rule.mask == rule.value:
                    end = start + i
                    break
        out.append(end)
        start = end
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 700), st.sampled_from([ChunkRule(40, 200, 0xF, 8), ChunkRule(10, 90, 0x7, 0), ChunkRule.of_average(5)]))
def test_cuts(seed, n, rule):
    data = np.random.default_rng(seed).bytes(n)
    assert rabin.cuts(data, rule) == plain_cuts(data, rule)


def test_chunks_of_shifted_data_meet_again():
    data = np.random.default_rng(1).bytes(200_000)
    rule = ChunkRule(512, 61440, 0xFFF, 8)
    a, b = ({h for _, _, h in rabin.chunks(x, rule)} for x in (data, b"inserted" + data))
    assert len(a & b) >= len(a) - 2 and len(a) > 20
    assert rabin.cuts(b"", rule) == [] and rabin.cuts(b"x" * 100) == [100] and rabin.cuts(bytes(130_000)) == [61440, 122880, 130000]


def test_polynomials():
    assert rabin.irreducible(ChunkRule.of_average().poly, 63)
    assert not rabin.irreducible(rabin.POLY_32, 32)  # it only is a prime as a number; cuts must follow it all the same
    assert not rabin.irreducible(0x4, 8) and rabin.irreducible(0x1B, 8)
    assert rabin.multiply(0x57, 0x83, 0x1B, 8) == 0xC1
    assert rabin.gcd(0b110, 0b11) == 0b11


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"abc" * 40, b"\xfe\xff" * 30, b"0123456789" * 9, bytes(200)]), max_size=12).map(b"".join) | st.binary(max_size=400))
def test_codec(data):
    assert codec.extract(codec.compress(data)) == data


def test_codec_saves_and_checks():
    part = np.random.default_rng(2).bytes(20_000)
    assert len(codec.compress(part * 4)) < 1.3 * len(part)
    assert codec.get_number(codec.put_number(300), 0) == (300, 2)
    for bad in (b"\xfe\x05", b"\xff", b"\xfe"):
        with pytest.raises(ValueError):
            codec.extract(bad)


def test_columns(spark):
    df = spark.createDataFrame([("abc", 1_500_000_123, 0x01020304), (None, None, None)], "s string, ns bigint, x bigint")
    key = b"k" * 80
    r = df.select(
        hashing.hex_text(hashing.md5_key(F.col("s"))), hashing.hmac_md5(F.col("s"), key), hashing.hmac_md5(F.col("s"), b"Jefe"), hashing.sha1_hex(F.col("s")),
        hashing.seconds(F.col("ns")), hashing.nanoseconds(F.col("ns")), hashing.to_ns(hashing.seconds(F.col("ns")), hashing.nanoseconds(F.col("ns"))), hashing.swap32(F.col("x")),
    ).collect()
    assert list(r[0]) == [
        "900150983cd24fb0d6963f7d28e17f72", hmac.new(key, b"abc", "md5").hexdigest(), hmac.new(b"Jefe", b"abc", "md5").hexdigest(), hashlib.sha1(b"abc").hexdigest(), 1, 500_000_123, 1_500_000_123, 0x04030201,
    ]
    assert list(r[1]) == [None] * 8


def test_expansion():
    a, b = expand("0" * 32), expand("0" * 31 + "1")
    assert a == expand("0" * 32) and a != b and len(a) == 4096 and set(a) <= set(b"01234")


def test_chunk_columns(spark):
    rule = ChunkRule(64, 2048, 0x3F, 8)
    texts = ["ab" * 3000 + "é", "", None, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in rabin.with_chunks(df, "text", rule).collect():
        want = None if r.text is None else [tuple(c) for c in rabin.chunks(r.text.encode(), rule)]
        assert (None if r.chunks is None else [tuple(c) for c in r.chunks]) == want
    by_block = rabin.with_chunks(df, "text", rule, block_size=100).first().chunks
    assert all(c.off // 100 == (c.off + c.len - 1) // 100 for c in by_block)
    rng = np.random.default_rng(3)
    blocks = [(1, k, rng.bytes(4096) if k not in (3, 6) else bytes(4096)) for k in range(9) if k != 7] + [(2, 0, rng.bytes(4096))]
    got = rabin.volume_chunks(spark.createDataFrame(blocks, "vol int, blk bigint, content binary"), rule).where("vol = 1").orderBy("off").collect()
    runs = [(0, 3), (4, 6), (8, 9)]
    want = [(lo * 4096 + a, n, h) for lo, hi in runs for a, n, h in rabin.chunks(b"".join(c for v, k, c in blocks if v == 1 and lo <= k < hi), rule)]
    assert [(r.off, r.len, r.md5) for r in got] == want
    back = codec.back_distance(spark.createDataFrame([(1, k, h) for k, h in enumerate("abacb")], "id int, k int, md5 string"), ("id",), F.col("k"))
    assert [r.back for r in back.orderBy("k").collect()] == [None, None, 2, None, 3]
