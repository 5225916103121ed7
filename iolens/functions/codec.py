"""Compression by repeated chunks.

A chunk that occurred before is written as 0xFE and the distance back to it, counted in chunks, in groups of seven bits (lowest first, the high bit says that more follow).
Every other chunk is written as it is, with 0xFF in front of each byte 0xFE or 0xFF. Reading cuts what it has put together by the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rabin import ChunkRule, cuts

REPEAT, ESCAPE = 0xFE, 0xFF


def put_number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_number(data: bytes, at: int) -> tuple[int, int]:
    """(number, place behind it)."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("number cut off")
        n |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return n, at


def compress(data: bytes, rule: ChunkRule = ChunkRule.of_average()) -> bytes:
    out, seen, start = [], {}, 0
    for k, end in enumerate(cuts(data, rule)):
        chunk = data[start:end]
        start = end
        if chunk in seen:
            out.append(bytes([REPEAT]) + put_number(k - seen[chunk]))
        else:
            out.append(chunk.replace(b"\xff", b"\xff\xff").replace(b"\xfe", b"\xff\xfe"))
        seen[chunk] = k
    return b"".join(out)


def extract(data: bytes, rule: ChunkRule = ChunkRule.of_average()) -> bytes:
    parts: list[bytes] = []
    plain, at = bytearray(), 0

    def cut() -> None:
        start = 0
        for end in cuts(bytes(plain), rule):
            parts.append(bytes(plain[start:end]))
            start = end
        plain.clear()

    while at < len(data):
        if data[at] == REPEAT:
            cut()
            back, at = get_number(data, at + 1)
            if not 0 < back <= len(parts):
                raise ValueError("repeat of a chunk that is not there")
            parts.append(parts[-back])
            continue
        if data[at] == ESCAPE:
            at += 1
            if at == len(data):
                raise ValueError("escape cut off")
        plain.append(data[at])
        at += 1
    cut()
    return b"".join(parts)


def back_distance(chunks: DataFrame, by: tuple[str, ...], order: Column, chunk: str = "md5") -> DataFrame:
    """Chunks with ``back``, how many chunks of their stream lie between them and their last occurrence, plus one; null for the first one."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    rows = chunks.withColumn("__place", place)
    return rows.withColumn("back", F.col("__place") - F.lag("__place").over(Window.partitionBy(*by, chunk).orderBy("__place"))).drop("__place")
