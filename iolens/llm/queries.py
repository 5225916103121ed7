"""The registered queries of this subpackage: thin uses of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .html_extract import extract
from .language_id import fit, identify
from .mixing import ANCHOR, EVEN, WEIGHTS, label_domain, mix_rates
from .neardup import near_duplicates
from .sentencepieces import encode_texts
from .token_counts import count_tokens
from .token_records import records_of
from .vector_search import search
from .warc import header_lines, resolve_revisits
from .webp import decode_media, store_texts


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(
        common.table(spark, sf_dir, "documents"),
        common.tokenizer_file("piece_bpe_32k.model"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(common.table(spark, sf_dir, "documents"), common.tokenizer_file("word_bpe_49k.json"), end_id=2)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Crawls of the pages: up to three responses each, minutes apart or most of a day, and after a day a 304 answer at another spelling of the URL.

    The first response is a 404 answer for one page in three, the last fails for three in four, so that the latest full one is now this, now that. One answer in five
    has no entity tag and goes by its modification time, which one last response in eight does not have; some tags are of another version.
    """
    html = F.coalesce("html", F.lit(""))
    n, text = F.col("page_id"), lambda c: c.cast("string")
    tag = lambda digest: F.concat(F.lit('"'), F.substring(digest, 1, 8), F.lit('"'))

    def response(name: str, digest, at, status, modified):
        fields = {"cache-control": F.lit("max-age=60"), "content-length": text(F.octet_length(html)), "content-type": F.lit("text/html"), "date": text(at), "etag": tag(digest), "last-modified": modified}
        headers = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
        return F.struct(
            F.concat(F.lit(name), n).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("uri"), at.alias("at"), status.alias("status"),
            headers.alias("headers"), digest.alias("digest"), F.octet_length(html).cast("bigint").alias("n_bytes"),
        )

    when = n * 60 + 86_400
    first, second, third = F.md5(F.concat(html, F.lit("0"))), F.md5(html), F.md5(F.concat(html, F.lit("2")))
    mine = F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.when(n % 4 == 0, tag(third)).otherwise(tag(second))))
    asked = F.map_filter(
        F.create_map(
            F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("date"), text(when), F.lit("x-cache"), F.lit("HIT"), F.lit("etag"), mine, F.lit("last-modified"), text(n % 1000)
        ), lambda k, v: v.isNotNull(),
    )
    revisit = F.struct(
        F.concat(F.lit("n"), n).alias("record_id"), F.lit("revisit").alias("warc_type"), F.concat(F.col("url"), F.lit("#again")).alias("uri"), when.alias("at"), F.lit(304).alias("status"),
        asked.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("n_bytes"),
    )
    rows = F.array(
        response("q", first, n * 60 - 900, F.when(n % 3 == 1, 404).otherwise(200), text(n % 1000)),
        response("r", second, n * 60, F.lit(200), text(n % 1000)),
        response("s", third, n * 60 + 80_000, F.when(n % 4 == 0, 200).otherwise(503), F.when(n % 8 != 0, text(n % 1000))),
        revisit,
    )
    return pages.select(F.explode(rows).alias("x")).select("x.*")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(captures(common.table(spark, sf_dir, "pages"))).withColumn("headers", header_lines(F.col("headers")))


#: The same in SQL: captures, canonical URLs, the latest earlier response, validators, merged headers.
OP6_SQL = r"""
WITH base AS (
  SELECT page_id n, url, coalesce(html, '') html FROM pages
), parts AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') u FROM base
), heads AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) head FROM parts
), cut AS (
  SELECT *, substr(u, length(head) + 1) rest,
    regexp_replace(regexp_replace(regexp_replace(head, '^https?://', 'https://'), '^(https://)([^@]*@)?(www[.])?', '\1'), '^(https://[^:]*):(80|443)?$', '\1') host
  FROM heads
), listed AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1), '&'), lambda p : p <> '' AND NOT regexp_matches(p, '^(?i)(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) params FROM cut
), canon AS (
  SELECT n, url, html, strlen(html) n_bytes, CASE WHEN head = '' THEN u ELSE host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical FROM listed
), versions AS (
  SELECT canonical, n * 60 - 900 AS t, 'q' || n AS id, md5(html || '0') AS digest, n_bytes, n % 1000 AS modified FROM canon WHERE n % 3 <> 1
  UNION ALL SELECT canonical, n * 60, 'r' || n, md5(html), n_bytes, n % 1000 FROM canon
  UNION ALL SELECT canonical, n * 60 + 80000, 's' || n, md5(html || '2'), n_bytes, CASE WHEN n % 8 <> 0 THEN n % 1000 END FROM canon WHERE n % 4 = 0
), full_ AS (
  SELECT *, '"' || substr(digest, 1, 8) || '"' AS tag FROM versions
), asked AS (
  SELECT *, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN '"other"' ELSE '"' || substr(md5(html || CASE WHEN n % 4 = 0 THEN '2' ELSE '' END), 1, 8) || '"' END AS mine FROM canon
), met AS (
  SELECT a.n, a.url, a.canonical, a.mine, max(struct_pack(t := b.t, id := b.id, digest := b.digest, n_bytes := b.n_bytes, tag := b.tag, modified := b.modified)) was
  FROM asked a LEFT JOIN full_ b ON a.canonical = b.canonical AND b.t < a.n * 60 + 86400 GROUP BY ALL
), judged AS (
  SELECT *, CASE WHEN was IS NULL THEN 'no response' WHEN mine IS NOT NULL THEN CASE WHEN mine = was.tag THEN 'resolved' ELSE 'changed' END
    WHEN was.modified IS NULL THEN 'unchecked' WHEN n % 1000 = was.modified THEN 'resolved' ELSE 'changed' END AS outcome FROM met
)
SELECT 'n' || n AS record_id, url || '#again' AS uri, canonical, n * 60 + 86400 AS "at", outcome,
  CASE WHEN outcome = 'resolved' THEN was.id END AS refers_to, CASE WHEN outcome = 'resolved' THEN was.digest END AS digest, CASE WHEN outcome = 'resolved' THEN was.n_bytes END AS n_bytes,
  'cache-control: max-age=600' || chr(10) || 'content-length: ' || CASE WHEN outcome = 'resolved' THEN CAST(was.n_bytes AS VARCHAR) || chr(10) || 'content-type: text/html' ELSE '0' END || chr(10)
  || 'date: ' || CAST(n * 60 + 86400 AS VARCHAR) || chr(10) || CASE WHEN mine IS NOT NULL THEN 'etag: ' || CASE WHEN mine = '"other"' THEN mine ELSE 'W/' || mine END || chr(10) WHEN outcome = 'resolved' THEN 'etag: ' || was.tag || chr(10) ELSE '' END
  || 'last-modified: ' || CAST(n % 1000 AS VARCHAR) || chr(10) || 'x-cache: HIT' AS headers
FROM judged
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), label_domain(), WEIGHTS, anchor=ANCHOR, others={"even": EVEN})


def held_out(doc_id: str = "doc_id"):
    """A quarter of all documents, by their id: never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out())), {"doc_id": F.col("doc_id"), "held_out": held_out()})


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(
        store_texts(common.table(spark, sf_dir, "documents")),
        outputs=("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_vector_search": op2_vector_search,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_token_records": op4_token_records,
        "op5_minhash_neardup": op5_minhash_neardup,
        "op6_warc_revisits": op6_warc_revisits,
        "op7_mixing": op7_mixing,
        "op8_language_id": op8_language_id,
        "op9_webp": op9_webp,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_revisits": OP6_SQL}
