"""Content-defined chunking by rolling Rabin fingerprints.

The fingerprint of a window is linear over GF(2) in its bytes, so all windows of a buffer are computed at once: one table look-up for each place
of the window, XORed together as arrays. Cuts then only visit the few places whose fingerprint matches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES

# Polynomials and window sizes of the two chunkers in use. The first has a leading term t**32 besides, the top bit of the other is its t**63.
POLY_32, WINDOW_32 = 0x4D964885, 32
POLY_63, WINDOW_63 = 0xBFE6B8A5BF378D83, 16


@dataclass(frozen=True)
class ChunkRule:
    """A cut follows the byte after which a chunk has ``largest`` bytes, or ``smallest`` at least and a fingerprint with ``fp & mask == value``."""

    smallest: int = 512
    largest: int = 61440
    mask: int = 0x7FFF
    value: int = 0x008
    window: int = WINDOW_32
    bits: int = 32
    poly: int = POLY_32

    @classmethod
    def of_average(cls, bits: int = 7, window: int = WINDOW_63) -> ChunkRule:
        """Chunks of about 2**bits bytes, at least a quarter of that (16 or more) and at most four times."""
        return cls(max(16, 1 << max(bits - 2, 0)), 4 << bits, (1 << bits) - 1, 0, window, 63, POLY_63 ^ 1 << 63)


def multiply(a: int, b: int, poly: int, bits: int) -> int:
    """a * b modulo t**bits + poly, over GF(2)."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        b >>= 1
        a <<= 1
        if a >> bits:
            a ^= 1 << bits | poly
    return out


def remainder(a: int, b: int) -> int:
    n = b.bit_length()
    while a.bit_length() >= n:
        a ^= b << (a.bit_length() - n)
    return a


def gcd(a: int, b: int) -> int:
    while b:
        a, b = b, remainder(a, b)
    return a


def irreducible(poly: int, bits: int) -> bool:
    """Whether t**bits + poly has no factor: t**(2**k) - t shares none with it for k up to bits / 2."""
    whole, x = 1 << bits | poly, 2
    for _ in range(bits // 2):
        x = multiply(x, x, poly, bits)
        if gcd(whole, x ^ 2) != 1:
            return False
    return True


@lru_cache(maxsize=8)
def _tables(poly: int, bits: int, window: int) -> np.ndarray:
    """For each place of the window (the newest first) what each byte value adds."""
    kind = np.uint32 if bits <= 32 else np.uint64
    shift, out = 1, np.zeros((window, 256), kind)
    for k in range(window):
        for b in range(8):
            out[k, 1 << b] = multiply(1 << b, shift, poly, bits)
        for v in range(1, 256):
            low = v & -v
            out[k, v] = out[k, low] ^ out[k, v ^ low] if v != low else out[k, v]
        shift = multiply(shift, 256, poly, bits)
    return out


def fingerprints(data: bytes, rule: ChunkRule) -> np.ndarray:
    """The fingerprint after each byte of the window that ends there; of what there is at the start."""
    x = np.frombuffer(data, np.uint8)
    t = _tables(rule.poly, rule.bits, rule.window)
    out = t[0][x]
    for k in range(1, min(rule.window, len(x))):
        out[k:] ^= t[k][x[:-k]]
    return out


def cuts(data: bytes, rule: ChunkRule = ChunkRule()) -> list[int]:
    """Ends of the chunks of a buffer; the last one is its length, where a chunk is forced."""
    n = len(data)
    if not n:
        return []
    fit = np.flatnonzero((fingerprints(data, rule) & rule.mask) == rule.value) + 1 if n >= rule.smallest else np.zeros(0, np.int64)
    out, start = [], 0
    first = max(rule.smallest, rule.window + 1)
    while start < n:
        at = int(np.searchsorted(fit, start + first))
        end = min(start + rule.largest, n)
        if at < len(fit):
            end = min(end, int(fit[at]))
        out.append(end)
        start = end
    return out


def chunks(data: bytes, rule: ChunkRule = ChunkRule()) -> list[tuple[int, int, str]]:
    """(offset, length, MD5 in hex) of each chunk."""
    out, start = [], 0
    for end in cuts(data, rule):
        out.append((start, end - start, hashlib.md5(data[start:end]).hexdigest()))
        start = end
    return out


def chunk_block(content, rule: ChunkRule) -> list[tuple[str, int, int]]:
    """(hash, offset, length) of a block's chunks. Unknown content is one chunk of its own kind; a hash is expanded to a block first."""
    if content is None:
        return [("", 0, BLOCK_BYTES)]
    if isinstance(content, str):
        from .expand import expand

        content = expand(content)
    return [(h, at, n) for at, n, h in chunks(bytes(content), rule)]


CHUNKS_DDL = "array<struct<off: bigint, len: bigint, md5: string>>"


def with_chunks(df: DataFrame, content: str = "content", rule: ChunkRule = ChunkRule(), block_size: int | None = None, name: str = "chunks") -> DataFrame:
    """``df`` with the chunks of a text or binary column; with ``block_size`` each block is cut by itself and its rest is a chunk.

    Null gives null, empty content no chunk. Offsets are in bytes of the whole content. A narrow map in Arrow batches.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` {CHUNKS_DDL}"
    at = df.columns.index(content)

    def one(data):
        if data is None:
            return None
        data = data.encode() if isinstance(data, str) else data
        step = block_size or len(data) or 1
        return [{"off": k + a, "len": n, "md5": h} for k in range(0, len(data), step) for a, n, h in chunks(data[k : k + step], rule)]

    def run(batches):
        kind = pa.list_(pa.struct([("off", pa.int64()), ("len", pa.int64()), ("md5", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(x) for x in b.column(at).to_pylist()], kind)], names=[*b.schema.names, name])

    return df.select(*map(F.col, df.columns)).mapInArrow(run, ddl)


def volume_chunks(blocks: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """(vol, off, len, md5) of chunks that run across the blocks of a volume, in the order of ``blk``; a block of zeros or a gap ends a chunk and is left out.

    A volume is read in order by one task, which holds one chunk and one block at a time.
    """
    ddl = "vol int, off bigint, len bigint, md5 string"
    schema = pa.schema([("vol", pa.int32()), ("off", pa.int64()), ("len", pa.int64()), ("md5", pa.string())])

    def run(batches):
        vol, start, rest = None, 0, b""
        for b in batches:
            out = []

            def take(final: bool) -> None:
                nonlocal start, rest
                parts = chunks(rest, rule)
                done = 0
                for a, n, h in parts if final else parts[:-1]:
                    out.append((vol, start + a, n, h))
                    done = a + n
                start, rest = start + done, rest[done:]

            for v, blk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if v != vol or start + len(rest) != blk * BLOCK_BYTES or not any(data):
                    take(True)
                    vol, start, rest = v, blk * BLOCK_BYTES, b""
                if any(data):
                    rest += data
                    take(False)
                else:
                    start = (blk + 1) * BLOCK_BYTES
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out = []
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(vol, start + a, n, h) for a, n, h in chunks(rest, rule)], strict=True), schema, strict=True)], schema=schema)

    return blocks.select(F.col("vol").cast("int"), "blk", "content").repartition("vol").sortWithinPartitions("vol", "blk").mapInArrow(run, ddl)
