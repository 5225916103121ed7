import gzip
import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from iolens.llm import queries as Q
from iolens.llm import warc as R

URLS = {
    "HTTP://www.Example.com:80/a/?b=2&utm_source=x&a=1#top": "https://example.com/a?a=1&b=2",
    "https://user:pw@example.com:443/": "https://example.com",
    "https://example.com/A?ref=x": "https://example.com/A",
    "https://example.com:8080/x//": "https://example.com:8080/x",
    " not a url#x": "not a url",
    "": "",
}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, None]], "u string")
    assert [r[0] for r in df.select(R.canonical_url(F.col("u"))).collect()] == [*URLS.values(), None]


def plain(rows):
    out = []
    for r in rows:
        if r["warc_type"] != "revisit" or r["status"] != 304:
            continue
        c = re.sub("#.*", "", r["uri"]) if r["uri"] is not None else None
        full = [x for x in rows if x["warc_type"] == "response" and x["status"] == 200 and None not in (c, r["at"], x["uri"], x["at"]) and re.sub("#.*", "", x["uri"]) == c and x["at"] < r["at"]]
        was = max(full, key=lambda x: (x["at"], x["record_id"]), default=None)
        mine, outcome = r["headers"] or {}, "no response"
        if was:
            old = was["headers"] or {}
            tags = [x.get("etag", "").removeprefix("W/") for x in (mine, old)]
            times = [x.get("last-modified") for x in (mine, old)]
            same = tags[0] == tags[1] if all(tags) else None if None in times else times[0] == times[1]
            outcome = {True: "resolved", False: "changed", None: "unchecked"}[same]
            if same:
                mine = old | {k: v for k, v in mine.items() if k not in R.NOT_MERGED}
        out.append((r["record_id"], outcome, was["record_id"] if outcome == "resolved" else None, was["digest"] if outcome == "resolved" else None, sorted(mine.items())))
    return sorted(out, key=str)


DDL = "record_id string, warc_type string, uri string, at bigint, status int, headers map<string,string>, digest string, n_bytes bigint, canonical string"


def test_against_a_plain_version(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        kind, status = rng.choice([("response", 200), ("response", 404), ("revisit", 304), ("revisit", 304), ("revisit", 200), ("request", None)])
        h = {k: v for k, v in {"etag": rng.choice(['"a"', 'W/"a"', '"b"']), "last-modified": rng.choice("xy"), "content-length": "9", "date": str(i), "x": "y"}.items() if rng.random() < 0.6}
        url = "https://hot.example/" if rng.random() < 0.4 else f"https://e.example/{rng.randrange(6)}#{i}"
        rows.append({"record_id": f"{i:04d}", "warc_type": kind, "uri": url if rng.random() < 0.97 else None, "at": rng.randrange(20_000) if rng.random() < 0.97 else None, "status": status, "headers": h if rng.random() < 0.9 else None, "digest": f"d{i}", "n_bytes": i, "canonical": "clash"})
    df = spark.createDataFrame(rows, DDL)
    norm = df.withColumn("uri", F.when(F.col("uri").startswith("https://hot"), "https://hot.example").otherwise(F.col("uri")))
    for r in rows:
        r["uri"] = "https://hot.example" if r["uri"] == "https://hot.example/" else r["uri"]
    got = [(r.record_id, r.outcome, r.refers_to, r.digest, sorted(r.headers.items())) for r in R.resolve_revisits(norm).collect()]
    assert sorted(got, key=str) == plain(rows)
    twice = R.resolve_revisits(df.union(df)).collect()
    assert len(twice) == 2 * len(got)
    assert R.resolve_revisits(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.01"
    got = sorted(map(tuple, Q.op6_warc_revisits(spark, path).select("record_id", "uri", "canonical", "at", "outcome", "refers_to", "digest", "n_bytes", "headers").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    assert got == sorted(con.execute(Q.OP6_SQL).fetchall(), key=str)
    assert {r[4] for r in got} >= {"resolved", "changed", "unchecked"} and {r[5][0] for r in got if r[5]} == set("rs")


def record(kind, uri, date, block):
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{date}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_files(spark, tmp_path):
    a = record("response", "http://x.example/", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"q\"\r\nTransfer-Encoding: chunked\r\nX: a\r\n b\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")
    b = record("revisit", "https://www.x.example", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: \"q\"\r\nX: new\r\n\r\n")
    c = record("response", "http://y.example/", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"body"))
    (tmp_path / "a.warc").write_bytes(a + b + c[:-30])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(c) + gzip.compress(record("warcinfo", "", "2024-01-01T00:00:00Z", b"x: y")))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = R.read_warc(spark, str(tmp_path))
    assert [r.damage for r in rows.collect() if r.damage] == ["cut off"]
    rows = rows.where("damage is null")
    assert sorted((r.warc_type, bytes(r.payload)) for r in rows.collect()) == [("response", b"abcde"), ("response", b"body"), ("revisit", b""), ("warcinfo", b"x: y")]
    r = R.resolve_revisits(rows).collect()
    assert len(r) == 1 and r[0].outcome == "resolved" and r[0].n_bytes == 5 and r[0].headers["x"] == "new"


def test_damage_is_told_and_never_fails(spark, tmp_path):
    date = "2024-01-01T00:00:00Z"
    chunked = record("response", "http://a.example/", date, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nabc")
    zipped = record("response", "http://b.example/", date, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"body" * 99)[:-9])
    length = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n"
    sound = record("response", "http://c.example/", "no date", b"HTTP/1.1 200 OK\r\n\r\nfine")
    (tmp_path / "a.warc").write_bytes(chunked + zipped + length + sound)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(sound) + b"\0" * 7 + gzip.compress(sound)[:-20])
    (tmp_path / "c.warc").write_bytes(b"noise" * 1000 + b"WARC/1.1\r\nWARC-Ty")
    got = R.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.damage or "", bytes(r.payload)[:8]) for r in got if (r.damage or "").startswith(("chunk", "content", "cut off in its"))) == [("chunk size is no number", b""), ("content-length is no number", b""), ("cut off in its headers", b"")]
    assert sum(r.damage is None and bytes(r.payload) == b"fine" and r.at is None for r in got) == 2
    assert [bytes(r.payload) for r in got if r.uri == "http://b.example/"] == [b"body" * 99]
    assert any((r.damage or "").startswith("gzip") for r in got)
    assert R.resolve_revisits(R.read_warc(spark, str(tmp_path))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 400), st.integers(0, 400))
def test_any_bytes(noise, a, b):
    data = record("response", "http://c.example/", "x", b"HTTP/1.1 200 OK\r\n\r\nfine" * 5)
    for x in (data, gzip.compress(data)):
        for h, block, damage in R.parse_records(x[: min(a, b)] + noise + x[max(a, b) :]):
            R.http_message(block)
