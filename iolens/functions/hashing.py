"""Hashes and times as columns: everything runs in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(content: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.md5(content))


def hex_text(key: Column) -> Column:
    return F.lower(F.hex(key))


def sha1_hex(content: Column) -> Column:
    return F.sha1(content)


def hmac_md5(content: Column, key: bytes) -> Column:
    """HMAC-MD5 in hex of a text or binary column under a constant key."""
    key = hashlib.md5(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner = F.concat(F.lit(bytes(b ^ 0x36 for b in key)), content.cast("binary"))
    return F.md5(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(F.md5(inner))))


def seconds(ns: Column) -> Column:
    return F.floor(ns / 1_000_000_000).cast("bigint")


def nanoseconds(ns: Column) -> Column:
    """What is left of whole seconds."""
    return F.pmod(ns, F.lit(1_000_000_000))


def to_ns(sec: Column, ns: Column) -> Column:
    return sec * 1_000_000_000 + ns


def event_time(ns: Column) -> Column:
    return F.timestamp_micros(F.floor(ns / 1000).cast("bigint"))


def swap32(x: Column) -> Column:
    """A 32-bit number with its bytes in reverse order."""
    parts = (F.shiftleft(x.bitwiseAND(0xFF), 24), F.shiftleft(x.bitwiseAND(0xFF00), 8), F.shiftright(x.bitwiseAND(0xFF0000), 8), F.shiftright(x, 24).bitwiseAND(0xFF))
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])
