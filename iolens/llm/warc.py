"""WARC records and the resolution of not-modified revisits.

A revisit that records a 304 answer has no payload. It is resolved by an as-of join: among the records of the same canonical URL the
latest earlier full response (status 200; of equal times the one with the larger record id) is what the server spoke of, provided that both have a validator and it agrees. The resolved record
has the response's payload and headers, updated by those headers of the 304 answer that such an answer may change.

The join is a window over (canonical URL, hour), so that a URL with a third of all records spreads over its hours. What an hour
inherits is the last full response of the hours before it: one pre-aggregated row an hour and URL, followed by a window over these. Payloads
do not travel: the result refers to them by record id, digest and length.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Seconds of a stretch of the window.
STRETCH = 3600
# Headers of a 304 answer that describe the message or connection and never replace stored ones.
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
#: Query parameters that do not choose a page.
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, ``http`` as ``https``, no ``www.``, user, default port, fragment, tracking parameters or closing slash; parameters sorted.

    Null stays null; what is no URL with a host is only trimmed and loses its fragment.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    head = F.regexp_replace(head, "^https?://", "https://")
    head = F.regexp_replace(head, "^(https://)([^@]*@)?(www[.])?", "$1")
    head = F.regexp_replace(head, "^(https://[^:]*):(80|443)?$", "$1")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(rest, "^[^?]*[?](.*)$", 1), "&")
    params = F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(f"^(?i){TRACKING}(=|$)")))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(head == "", u).otherwise(F.concat(head, path, query))


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve the 304 revisits of ``records``.

    ``records`` has record_id, warc_type, uri, at (seconds), status, headers (map, names in lower case), digest and n_bytes of the payload.
    A row for each record of type ``revisit`` with status 304: record_id, uri, canonical, at, outcome, refers_to, digest, n_bytes, headers.
    ``outcome`` is ``resolved``, ``no response`` (none earlier; also where URL or time is null), ``changed`` (both name an entity tag and they differ, weak ones
    compared like strong; or, without such a pair, both name a modification time and they differ) or ``unchecked`` (they have no validator in common). Only resolved rows have the columns of the response;
    the headers of others stay their own. Repeated records stay rows of their own.
    """
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    asks = (F.col("warc_type") == "revisit") & (F.col("status") == 304)
    # a null URL or time is alone: it has nothing to follow, so it needs no place in the order
    rows = records.select("record_id", "uri", canonical_url(F.col("uri")).alias("canonical"), F.col("at").cast("bigint").alias("at"), "headers", full.alias("full"), asks.alias("asks"), "digest", "n_bytes")
    rows = rows.where("full or asks")
    placed = rows.where("canonical is not null and at is not null").withColumn("stretch", F.floor(F.col("at") / STRETCH))
    latest = placed.where("full").groupBy("canonical", "stretch").agg(F.max_by(F.struct("at", "record_id", "digest", "n_bytes", "headers"), F.struct("at", "record_id")).alias("last"))
    waits = placed.where("asks").select("canonical", "stretch").distinct()
    before = Window.partitionBy("canonical").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    inherited = (
        latest.join(waits, ["canonical", "stretch"], "full_outer")
        .withColumn("inherited", F.last("last", ignorenulls=True).over(before))
        .where("inherited is not null")
        .select("canonical", "stretch", "inherited")
    )
    # of equal times responses come first, but only earlier ones count: frames are ranges of time
    earlier = Window.partitionBy("canonical", "stretch").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    own = F.max(F.when(F.col("full"), F.struct("at", "record_id", "digest", "n_bytes", F.map_entries("headers").alias("headers")))).over(earlier)
    met = placed.withColumn("own", own).where("asks").drop("full", "asks", "digest", "n_bytes").join(inherited, ["canonical", "stretch"], "left")
    listed = F.col("inherited").withField("headers", F.map_entries("inherited.headers"))
    met = met.withColumn("was", F.coalesce("own", listed)).drop("own", "inherited", "stretch")
    alone = rows.where("asks and (canonical is null or at is null)").select("record_id", "uri", "canonical", "at", "headers")
    met = met.unionByName(alone, allowMissingColumns=True)
    mine, old = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce(F.map_from_entries("was.headers"), F.create_map().cast("map<string,string>"))
    met = met.withColumn("mine", mine).withColumn("old", old)
    tags = _etag(F.col("mine")).isNotNull() & _etag(F.col("old")).isNotNull()
    same = F.when(tags, _etag(F.col("mine")) == _etag(F.col("old"))).otherwise(F.col("mine")["last-modified"] == F.col("old")["last-modified"])
    met = met.withColumn("outcome", F.when(F.col("was").isNull(), "no response").when(same, "resolved").when(~same, "changed").otherwise("unchecked"))
    ok = F.col("outcome") == "resolved"
    new = F.map_filter("mine", lambda k, v: ~k.isin(NOT_MERGED))
    kept = F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return met.select(
        "record_id",
        "uri",
        "canonical",
        "at",
        "outcome",
        F.when(ok, F.col("was.record_id")).alias("refers_to"),
        F.when(ok, F.col("was.digest")).alias("digest"),
        F.when(ok, F.col("was.n_bytes")).alias("n_bytes"),
        F.when(ok, F.map_concat(kept, new)).otherwise(F.col("mine")).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


# -- reading -------------------------------------------------------------------


#: Bytes of a file that are read at once.
READ = 1 << 20


class _Members:
    """A file's bytes in order, plain or a gzip member a record; what cannot be unpacked ends it with ``damage``."""

    def __init__(self, f):
        self.f, self.damage = f, None
        self.rest = f.read(READ)
        self.packed = self.rest[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bytes:
        while self.rest and not self.damage:
            if not self.packed:
                out, self.rest = self.rest, self.f.read(READ)
                return out
            try:
                out = self.unpack.decompress(self.rest, READ)
            except zlib.error as e:
                self.damage = f"gzip: {e}"
                return b""
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:  # the next member, past any zeros between them
                left = self.unpack.unused_data or self.f.read(READ)
                while left and not left.strip(b"\0"):
                    left = self.f.read(READ)
                self.rest, self.unpack = left.lstrip(b"\0"), zlib.decompressobj(31)
            elif not self.rest:
                self.rest = self.f.read(READ)
                if not self.rest and not out:
                    self.damage = "gzip: cut off"
            if out:
                return out
        return b""


def parse_records(f) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, damage) of the records of an open WARC file (or of bytes), plain or a gzip member a record, one in memory at a time.

    A record with a length that is no number, one that is cut off and what cannot be unpacked come out with ``damage`` and what there is of their block; after a bad length the next
    record is looked for.
    """
    source = _Members(io.BytesIO(f) if isinstance(f, bytes) else f)
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            got = source.more()
            if not got:
                return False
            held.extend(got)
        return True

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]
            if not fill(len(held) + 1):
                if source.damage:
                    yield {}, b"", source.damage
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                yield {}, b"", source.damage or "cut off in its headers"
                return
        headers = _headers(bytes(held[:end]).split(b"\r\n")[1:])
        del held[: end + 4]
        length = headers.get("content-length") or "0"
        if not re.fullmatch("[0-9]{1,18}", length):
            yield headers, b"", "content-length is no number"
            continue
        if not fill(int(length)):
            yield headers, bytes(held), source.damage or "cut off"
            return
        block = bytes(held[: int(length)])
        del held[: int(length)]
        yield headers, block, None


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def http_message(block: bytes) -> tuple[int | None, dict[str, str], bytes, str | None]:
    """(status, headers, payload, damage) of an HTTP answer; chunked and gzip encodings are undone as far as they go."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    m = re.match(rb"HTTP/\S+ (\d{3})", first)
    headers, damage = _headers(lines), None
    if headers.get("transfer-encoding", "").lower() == "chunked":
        parts, at = [], 0
        while True:
            end = body.find(b"\r\n", at)
            size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
            if not re.fullmatch(b"[0-9A-Fa-f]{1,15}", size):
                damage = "cut off between chunks" if end < 0 else "chunk size is no number"
                break
            n = int(size, 16)
            parts.append(body[end + 2 : end + 2 + n])
            if len(parts[-1]) < n:
                damage = "cut off in a chunk"
            if not n or damage:
                break
            at = end + 4 + n
        body = b"".join(parts)
    if headers.get("content-encoding", "").lower() == "gzip":
        d = zlib.decompressobj(31)
        try:
            body = d.decompress(body)
        except zlib.error as e:
            body, damage = b"", damage or f"gzip: {e}"
        if not d.eof and body:
            damage = damage or "gzip: cut off"
    return int(m[1]) if m else None, headers, body, damage


def _seconds(date: str | None) -> int | None:
    try:
        return int(datetime.fromisoformat(date.replace("Z", "+00:00")).astimezone(UTC).timestamp()) if date else None
    except (ValueError, OverflowError):
        return None


RECORDS = "record_id string, warc_type string, uri string, at bigint, status int, headers map<string,string>, digest string, n_bytes bigint, payload binary, damage string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path`` in the form :func:`resolve_revisits` takes, with ``payload`` and ``damage`` (null for sound ones).

    A file is read by one task as a stream, a record at a time, so it can have any size. Empty files have no record; missing fields, and dates that are none, are null; damaged records stay, with what
    there is of them, and never fail the job.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(RECORDS))
    files = spark.read.format("binaryFile").load(path).select("path")

    def rows(f) -> Iterator[list]:
        for h, block, damage in parse_records(f):
            status, headers, body, bad = http_message(block) if h.get("warc-type") in ("response", "revisit") else (None, {}, block, None)
            uri = (h.get("warc-target-uri") or "").strip("<>") or None
            yield [h.get("warc-record-id"), h.get("warc-type"), uri, _seconds(h.get("warc-date")), status, list(headers.items()), hashlib.md5(body).hexdigest(), len(body), body, damage or bad]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with fs.open_input_stream(at, compression=None) as f:
                    for row in rows(f):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORDS)
