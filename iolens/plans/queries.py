"""The registered queries over block-access logs, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rabin import ChunkRule, with_chunks
from ..model import CacheConfig
from ..operators import counters as C
from ..operators import dedup as D
from ..operators import metadata as M
from ..operators import pieces as P
from ..operators import requests as R
from ..operators import reuse as U
from ..operators import volumes as V
from ..operators.sequence import with_seq
from ..sources.tables import CONTENTS, VOLUMES, events_accesses
from .replay import simulate, sweep

CAPACITIES = [16, 64, 256]
BLOCK_CHARS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_accesses(table(spark, sf_dir, "events"))


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = log(spark, sf_dir)
    return V.to_physical(a, V.place(V.capacities(a)))


def consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as the disk would have it."""
    return M.disk_view(physical(spark, sf_dir)).drop("trace_content", "was_inconsistent")


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as contents cut into blocks of characters: a volume a source, a document's blocks from doc_id * 1000 on."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    d = d.select(F.col("doc_id").alias("seq"), F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("vol"), (F.col("doc_id") * 1000).alias("blk"), F.col("text").alias("content"))
    return R.explode_blocks(d, BLOCK_CHARS, nbytes=None)


LOG = f"""
a AS (
  SELECT row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS seq, epoch_us(ts) AS tick, CAST(user_id % {VOLUMES} AS INTEGER) AS vol,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS blk, event_type IN ('view', 'click', 'error') AS is_read, md5(CAST(event_id % {CONTENTS} AS VARCHAR)) AS content
  FROM events
), caps AS (SELECT vol, max(blk) + 1 AS cap FROM a GROUP BY vol),
placed AS (SELECT vol, cap, coalesce(CAST(sum(cap) OVER (ORDER BY vol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS base FROM caps)"""
DISK = (
    LOG
    + """,
d AS (
  SELECT seq, tick, vol, blk, is_read, content AS trace_content,
    CASE WHEN is_read THEN coalesce(
      last_value(CASE WHEN NOT is_read THEN content END IGNORE NULLS) OVER (PARTITION BY vol, blk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      first_value(CASE WHEN is_read THEN content END IGNORE NULLS) OVER (PARTITION BY vol, blk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) ELSE content END AS content,
    row_number() OVER (PARTITION BY vol, blk ORDER BY seq) AS touch, lag(is_read) OVER (PARTITION BY vol, blk ORDER BY seq) AS prev_read
  FROM a)"""
)
INTERVALS = (
    DISK
    + """,
m AS (
  SELECT vol, blk, content, seq AS from_seq, to_seq FROM (
    SELECT *, min(CASE WHEN NOT is_read THEN seq END) OVER (PARTITION BY vol, blk ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS to_seq FROM d)
  WHERE touch = 1 OR NOT is_read)"""
)


def leaders_sql(within: str = "", tag: str = "") -> str:
    return f"""
l{tag} AS (
  SELECT d.seq, arg_max(struct_pack(v := m.vol, b := m.blk), m.from_seq) AS lead FROM d JOIN m ON d.content = m.content {within} AND m.from_seq < d.seq AND (m.to_seq IS NULL OR m.to_seq > d.seq)
  WHERE d.is_read AND d.touch > 1 GROUP BY d.seq),
k{tag} AS (
  SELECT d.seq, d.vol, d.blk, d.is_read, d.is_read AND d.touch > 1 AS clean, coalesce(l.lead.v, d.vol) AS key_vol, coalesce(l.lead.b, d.blk) AS key_blk FROM d LEFT JOIN l{tag} l ON d.seq = l.seq)"""


LEADERS = REDIRECTED = INTERVALS + "," + leaders_sql()


def distances_sql(source: str, key: str, tag: str = "") -> str:
    return f"""
p{tag} AS (SELECT *, lag(seq) OVER (PARTITION BY {key} ORDER BY seq) AS prev_seq FROM {source}),
r{tag} AS (
  SELECT p.seq, count(j.seq) AS distance FROM p{tag} p LEFT JOIN p{tag} j ON j.seq > p.prev_seq AND j.seq < p.seq AND coalesce(j.prev_seq, -1) <= p.prev_seq WHERE p.prev_seq IS NOT NULL GROUP BY p.seq),
u{tag} AS (SELECT p.*, r.distance FROM p{tag} p LEFT JOIN r{tag} r ON p.seq = r.seq)"""


# -- queries -------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"WITH {LOG}, {distances_sql('a', 'vol, blk')} SELECT c.capacity, count(*) FILTER (WHERE coalesce(distance < c.capacity, false)) AS hits, count(*) FILTER (WHERE NOT coalesce(distance < c.capacity, false)) AS misses, "
    "count(*) FILTER (WHERE coalesce(distance < c.capacity, false) AND is_read) AS read_hits, count(*) FILTER (WHERE coalesce(distance < c.capacity, false) AND NOT is_read) AS write_hits "
    "FROM u CROSS JOIN (SELECT unnest([16, 64, 256]) AS capacity) c GROUP BY c.capacity"
)
def lru_curve(spark, sf_dir):
    return U.lru_curve(U.reuse_distances(log(spark, sf_dir)), CAPACITIES)


@query(f"WITH {LOG}, {distances_sql('a', 'vol, blk')} SELECT seq, vol, blk, prev_seq, distance FROM u")
def reuse_distance(spark, sf_dir):
    return U.reuse_distances(log(spark, sf_dir)).select("seq", "vol", "blk", "prev_seq", "distance")


@query(
    f"WITH {LOG}, {distances_sql('a', 'vol, blk')} SELECT count(*) FILTER (WHERE is_read) AS reads, count(*) FILTER (WHERE NOT is_read) AS writes, "
    "count(*) FILTER (WHERE is_read AND coalesce(distance < 64, false)) AS bcache_hits_r, count(*) FILTER (WHERE is_read AND NOT coalesce(distance < 64, false)) AS bcache_misses_r, "
    "count(*) FILTER (WHERE NOT is_read AND coalesce(distance < 64, false)) AS bcache_hits_w, count(*) FILTER (WHERE NOT is_read AND NOT coalesce(distance < 64, false)) AS bcache_misses_w, "
    "count(*) FILTER (WHERE is_read AND NOT coalesce(distance < 64, false)) AS disk_reads, count(*) FILTER (WHERE NOT is_read) AS disk_writes FROM u"
)
def plain_counters(spark, sf_dir):
    hits = U.lru_hits(log(spark, sf_dir), 64)
    out = C.counters(hits.withColumn("disk", ~F.col("is_read") | ~F.col("hit")))
    return out.select("reads", "writes", "bcache_hits_r", "bcache_misses_r", "bcache_hits_w", "bcache_misses_w", "disk_reads", "disk_writes")


@query(f"WITH {LOG} SELECT a.seq, a.vol, a.blk, placed.base + a.blk AS ioblk FROM a JOIN placed ON a.vol = placed.vol")
def v2p_map(spark, sf_dir):
    return physical(spark, sf_dir).select("seq", "vol", "blk", "ioblk")


@query(f"WITH {LOG} SELECT vol, cap, base FROM placed")
def volume_capacity(spark, sf_dir):
    return V.place(V.capacities(log(spark, sf_dir))).select("vol", "cap", "base")


@query(f"WITH {LOG} SELECT seq, vol, max(blk) OVER (PARTITION BY vol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS cap FROM a")
def volume_growth(spark, sf_dir):
    return V.capacity_over_time(log(spark, sf_dir)).select("seq", "vol", "cap")


@query(
    "WITH v AS (SELECT s_suppkey AS vol, CAST(floor(abs(s_acctbal)) AS BIGINT) % 500 + 1 AS cap, s_suppkey * 300 AS base FROM supplier) "
    "SELECT a.vol AS a, b.vol AS b, greatest(a.base, b.base) AS lo, least(a.base + a.cap, b.base + b.cap) - 1 AS hi FROM v a JOIN v b ON a.vol < b.vol AND a.base <= b.base + b.cap - 1 AND b.base <= a.base + a.cap - 1"
)
def volume_overlap(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return V.overlaps(s.select(F.col("s_suppkey").alias("vol"), (F.floor(F.abs("s_acctbal")).cast("bigint") % 500 + 1).alias("cap"), (F.col("s_suppkey") * 300).alias("base")))


@query(f"WITH {LOG}, f AS (SELECT vol AS old, min(seq) AS first FROM a GROUP BY vol) SELECT 'vm' || old AS vm, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS vol FROM f")
def volume_assignment(spark, sf_dir):
    return V.assign_volumes(log(spark, sf_dir).withColumn("vm", F.concat(F.lit("vm"), "vol")))


BLOCKS_SQL = f"""
b AS (
  SELECT doc_id AS seq, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS vol, doc_id * 1000 + i AS blk, CAST(i AS INTEGER) AS part, substr(text, CAST(i * {BLOCK_CHARS} + 1 AS BIGINT), {BLOCK_CHARS}) AS content
  FROM documents, range(0, 100000) t(i) WHERE text IS NOT NULL AND i * {BLOCK_CHARS} < length(text))"""


@query(f"WITH {BLOCKS_SQL} SELECT seq, vol, blk, part, md5(content) AS content FROM b")
def request_explode(spark, sf_dir):
    return doc_blocks(spark, sf_dir).select("seq", "vol", "blk", "part", D.content_hash(F.col("content")).alias("content"))


@query(f"WITH {LOG} SELECT seq, vol, blk, content FROM a WHERE is_read AND content <> md5('0')")
def enable_and_zero_filter(spark, sf_dir):
    return R.drop_zero_blocks(R.enabled(log(spark, sf_dir), writes=False), zero=F.md5(F.lit("0"))).select("seq", "vol", "blk", "content")


@query(f"WITH {LOG} SELECT vol || ':' || blk AS key, CAST(count(*) AS BIGINT) AS n, vol AS vol_back, blk AS blk_back FROM a GROUP BY vol, blk")
def block_keys(spark, sf_dir):
    k = log(spark, sf_dir).groupBy(R.block_key(F.col("vol"), F.col("blk")).alias("key")).agg(F.count("*").alias("n"))
    vol, blk = R.split_key(F.col("key"))
    return k.select("key", "n", vol.cast("int").alias("vol_back"), blk.alias("blk_back"))


@query(f"WITH {BLOCKS_SQL} SELECT md5(content) AS content, CAST(count(*) AS BIGINT) AS n, min(seq) AS first_doc FROM b GROUP BY ALL")
def content_hash(spark, sf_dir):
    b = doc_blocks(spark, sf_dir)
    return b.groupBy(D.content_hash(F.col("content")).alias("content")).agg(F.count("*").alias("n"), F.min("seq").alias("first_doc"))


@query(f"WITH {BLOCKS_SQL}, p AS (SELECT vol, md5(content) AS content, count(*) AS n FROM b GROUP BY ALL) SELECT vol, CAST(sum(n) AS BIGINT) AS total, count(*) AS uniques, CAST(sum(n) AS BIGINT) - count(*) AS duplicates FROM p GROUP BY vol")
def unique_vs_total(spark, sf_dir):
    b = doc_blocks(spark, sf_dir).withColumn("content", F.md5("content"))
    return D.unique_and_total(b, by=("vol",))


@query(f"WITH {LOG} SELECT seq, content, row_number() OVER (PARTITION BY content ORDER BY seq) > 1 AS is_duplicate FROM a")
def duplicate_insertions(spark, sf_dir):
    return D.seen_before(log(spark, sf_dir)).select("seq", "content", "is_duplicate")


@query(
    f"WITH {INTERVALS}, f AS (SELECT x.from_seq, count(*) AS factor FROM m x JOIN m y ON x.content = y.content AND y.from_seq <= x.from_seq AND (y.to_seq IS NULL OR y.to_seq > x.from_seq) GROUP BY x.from_seq) "
    "SELECT least(factor, 10) AS factor, count(*) AS insertions FROM f GROUP BY 1"
)
def dedup_factor_histogram(spark, sf_dir):
    return D.factor_histogram(D.live_factor(M.map_intervals(consistent(spark, sf_dir))))


@query(
    f"WITH {INTERVALS}, c AS (SELECT from_seq AS seq, content, 1 AS d FROM m UNION ALL SELECT to_seq, content, -1 FROM m WHERE to_seq IS NOT NULL), "
    "n AS (SELECT *, sum(d) OVER (PARTITION BY content ORDER BY seq, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM c), "
    "x AS (SELECT *, CASE WHEN own = 1 AND d = 1 THEN 1 WHEN own = 0 AND d = -1 THEN -1 ELSE 0 END AS e FROM n) "
    "SELECT seq, content, CAST(d AS INTEGER) AS d, CAST(sum(d) OVER w AS BIGINT) AS total, CAST(sum(e) OVER w AS BIGINT) AS uniques FROM x WINDOW w AS (ORDER BY seq, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def live_items_over_time(spark, sf_dir):
    m = M.map_intervals(consistent(spark, sf_dir))
    changes = m.select(F.col("from_seq").alias("seq"), "content", F.lit(1).alias("d")).union(m.where("to_seq is not null").select("to_seq", "content", F.lit(-1)))
    return D.live_items(changes)


@query(f"WITH {DISK} SELECT seq, vol, blk, touch = 1 AS first_touch, coalesce(is_read AND NOT prev_read, false) AS dirty FROM d")
def first_touch_and_dirty(spark, sf_dir):
    return M.touches(log(spark, sf_dir)).select("seq", "vol", "blk", "first_touch", "dirty")


@query(f"WITH {DISK} SELECT seq, vol, blk, content, trace_content, coalesce(is_read AND trace_content <> content, false) AS was_inconsistent FROM d")
def disk_view_repair(spark, sf_dir):
    return M.disk_view(log(spark, sf_dir)).select("seq", "vol", "blk", "content", "trace_content", "was_inconsistent")


@query(f"WITH {INTERVALS} SELECT vol, blk, content, from_seq, to_seq FROM m")
def map_intervals(spark, sf_dir):
    return M.map_intervals(consistent(spark, sf_dir))


@query(f"WITH {LEADERS} SELECT d.seq, d.vol, d.blk, l.lead.v AS lead_vol, l.lead.b AS lead_blk FROM d LEFT JOIN l ON d.seq = l.seq WHERE d.is_read AND d.touch > 1")
def leader_lookup(spark, sf_dir):
    a = consistent(spark, sf_dir)
    reads = M.mapped_state(a, True).where("is_read and state = 'clean'")
    return M.leaders(reads, M.map_intervals(a)).select("seq", "vol", "blk", "lead_vol", "lead_blk")


FIXED_COUNTS = (
    "count(*) FILTER (WHERE is_read) AS reads, count(*) FILTER (WHERE NOT is_read) AS writes, count(*) FILTER (WHERE is_read AND h) AS bcache_hits_r, count(*) FILTER (WHERE is_read AND NOT h) AS bcache_misses_r, "
    "count(*) FILTER (WHERE is_read AND NOT h AND NOT clean) AS compulsory_misses, count(*) FILTER (WHERE is_read AND NOT h AND clean) AS capacity_misses, count(*) FILTER (WHERE clean) AS map_hits, "
    "count(*) FILTER (WHERE is_read AND NOT clean) AS map_misses, count(*) FILTER (WHERE clean AND s) AS self_is_leader, count(*) FILTER (WHERE clean AND NOT s) AS self_not_leader, "
    "count(*) FILTER (WHERE clean AND s AND h) AS self_hits, count(*) FILTER (WHERE clean AND s AND NOT h) AS self_misses, count(*) FILTER (WHERE clean AND NOT s AND h) AS dedup_hits, count(*) FILTER (WHERE clean AND NOT s AND NOT h) AS dedup_misses"
)
FIXED_NAMES = ["reads", "writes", "bcache_hits_r", "bcache_misses_r", "compulsory_misses", "capacity_misses", "map_hits", "map_misses", "self_is_leader", "self_not_leader", "self_hits", "self_misses", "dedup_hits", "dedup_misses"]


def fixed_outcomes(spark: SparkSession, sf_dir: str, capacity: int = 64, intra_only: bool = False) -> DataFrame:
    """Fixed mode with write updates as a plan: leaders by windows, then one reuse-distance pass over the blocks they serve."""
    k = M.redirected(consistent(spark, sf_dir), intra_only)
    hits = U.lru_hits(U.reuse_distances(k, ("key_vol", "key_blk")), capacity)
    meta = F.when(F.col("is_read"), F.when(F.col("clean"), "clean").otherwise("absent"))
    return hits.withColumns({"meta": meta, "self": F.col("self_leader"), "disk": ~F.col("is_read") | ~F.col("hit"), "mode": F.lit("fixed")})


@query(f"WITH {REDIRECTED}, {distances_sql('k', 'key_vol, key_blk')}, o AS (SELECT *, coalesce(distance < 64, false) AS h, key_vol = vol AND key_blk = blk AS s FROM u) SELECT {FIXED_COUNTS} FROM o")
def fixed_mode_counters(spark, sf_dir):
    return C.counters(fixed_outcomes(spark, sf_dir)).select(*FIXED_NAMES)


@query(f"WITH {REDIRECTED}, {distances_sql('k', 'key_vol, key_blk')} SELECT vol, coalesce(key_vol = vol AND key_blk = blk, false) AS is_self, coalesce(distance < 64, false) AS hit, count(*) AS n FROM u WHERE clean GROUP BY ALL")
def self_vs_dedup_split(spark, sf_dir):
    o = fixed_outcomes(spark, sf_dir).where("clean")
    return o.groupBy("vol", F.col("self").alias("is_self"), "hit").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT seq, vol, row_number() OVER (PARTITION BY vol ORDER BY seq) - 1 AS blk, true AS is_read FROM a")
def sequential_scan_layout(spark, sf_dir):
    return R.scan_layout(log(spark, sf_dir)).select("seq", "vol", "blk", "is_read")


@query(
    f"WITH {LOG}, f AS (SELECT content, min(seq) AS any_seq FROM a GROUP BY content), o AS (SELECT content, vol, min(seq) AS own, count(*) AS n FROM a GROUP BY content, vol) "
    "SELECT vol, CAST(sum(n) AS BIGINT) AS inserts, CAST(sum(n - 1) AS BIGINT) AS own_duplicates, CAST(sum(CASE WHEN any_seq < own THEN 1 ELSE 0 END) AS BIGINT) AS cross_duplicates FROM o JOIN f ON o.content = f.content GROUP BY vol"
)
def cross_vs_own_duplicates(spark, sf_dir):
    return D.cross_and_own_duplicates(log(spark, sf_dir))


@query(
    "WITH s AS (SELECT l_orderkey AS seq, CAST(l_linenumber AS BIGINT) AS part, min(l_partkey) % 3 AS ioblk, CAST(l_linenumber AS BIGINT) * 10 AS start, CAST(l_linenumber AS BIGINT) * 10 + 10 - min(l_suppkey) % 2 AS stop FROM lineitem GROUP BY l_orderkey, l_linenumber), "
    "n AS (SELECT *, CASE WHEN lag(ioblk) OVER w = ioblk AND lag(stop) OVER w = start THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY seq ORDER BY part)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n) "
    'SELECT seq, min(part) AS part, min(ioblk) AS ioblk, min(start) AS start, max(stop) AS "end", count(*) AS merged FROM r GROUP BY seq, run'
)
def piece_merge(spark, sf_dir):
    n = F.col("l_linenumber").cast("bigint")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), n.alias("part"))
    s = s.agg((F.min("l_partkey") % 3).alias("ioblk"), (F.min("l_suppkey") % 2).alias("odd"))
    return P.merge_pieces(s.select("seq", "part", "ioblk", (F.col("part") * 10).alias("start"), (F.col("part") * 10 + 10 - F.col("odd")).alias("end")))


@query(
    "SELECT o_orderkey AS seq, b AS blk, greatest(o_custkey % 4096, (b - o_custkey) * 4096) % 4096 AS start, least(o_custkey % 4096 + o_orderkey % 9000 + 1, (b - o_custkey + 1) * 4096) - greatest(o_custkey % 4096, (b - o_custkey) * 4096) AS nbytes "
    "FROM (SELECT *, unnest(range(o_custkey, o_custkey + (o_custkey % 4096 + o_orderkey % 9000) // 4096 + 1)) AS b FROM orders)"
)
def piece_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("blk"), (F.col("o_custkey") % 4096).alias("start"), (F.col("o_orderkey") % 9000 + 1).alias("nbytes"))
    return P.split_at_blocks(s).select("seq", "blk", "start", "nbytes")


@query("SELECT doc_id AS seq, md5(text) AS content FROM documents WHERE text IS NOT NULL AND text <> ''")
def stitched_texts(spark, sf_dir):
    return P.stitched(doc_blocks(spark, sf_dir), pad=F.lit("")).select("seq", F.md5("content").alias("content"))


BUNCH_NS = 10_000_000_000


@query(
    f"""WITH RECURSIVE {LOG}, o AS (SELECT vol, seq, tick * 1000 AS tick, row_number() OVER (PARTITION BY vol ORDER BY seq) AS i FROM a),
g AS (
  SELECT vol, i, seq, tick, tick AS began, 1 AS held, seq AS bunch FROM o WHERE i = 1
  UNION ALL
  SELECT o.vol, o.i, o.seq, o.tick, CASE WHEN g.held >= 8 OR o.tick - g.began > {BUNCH_NS} THEN o.tick ELSE g.began END, CASE WHEN g.held >= 8 OR o.tick - g.began > {BUNCH_NS} THEN 1 ELSE g.held + 1 END,
    CASE WHEN g.held >= 8 OR o.tick - g.began > {BUNCH_NS} THEN o.seq ELSE g.bunch END FROM g JOIN o ON o.vol = g.vol AND o.i = g.i + 1
) SELECT vol, bunch, count(*) AS n, min(tick) AS began FROM g GROUP BY vol, bunch"""
)
def bunch_summary(spark, sf_dir):
    r = log(spark, sf_dir).withColumn("at", F.col("at") * 1000)
    return P.bunches(r, ns=BUNCH_NS).groupBy("vol", "bunch").agg(F.count("*").alias("n"), F.min("at").alias("began"))


COUNTERS = (
    "CAST(count(*) FILTER (WHERE is_read) AS BIGINT) AS reads, count(*) FILTER (WHERE NOT is_read) AS writes, count(*) FILTER (WHERE is_read AND h) AS bcache_hits_r, count(*) FILTER (WHERE is_read AND NOT h) AS bcache_misses_r, "
    "count(*) FILTER (WHERE NOT is_read AND h) AS bcache_hits_w, count(*) FILTER (WHERE NOT is_read AND NOT h) AS bcache_misses_w, count(*) FILTER (WHERE is_read AND NOT h AND NOT clean) AS compulsory_misses, "
    "count(*) FILTER (WHERE is_read AND NOT h AND clean) AS capacity_misses, count(*) FILTER (WHERE clean) AS map_hits, count(*) FILTER (WHERE is_read AND NOT clean) AS map_misses, CAST(0 AS BIGINT) AS map_dirties, "
    "count(*) FILTER (WHERE clean AND s) AS self_is_leader, count(*) FILTER (WHERE clean AND NOT s) AS self_not_leader, count(*) FILTER (WHERE clean AND s AND h) AS self_hits, count(*) FILTER (WHERE clean AND s AND NOT h) AS self_misses, "
    "count(*) FILTER (WHERE clean AND NOT s AND h) AS dedup_hits, count(*) FILTER (WHERE clean AND NOT s AND NOT h) AS dedup_misses, count(*) FILTER (WHERE is_read AND NOT clean AND h) AS mapmiss_cachehits, "
    "CAST(0 AS BIGINT) AS mapdirty_cachehits, count(*) FILTER (WHERE is_read AND NOT clean AND NOT h) AS mapmiss_cachemisses, "
    + ", ".join(f"CAST(0 AS BIGINT) AS {n}" for n in "ccache_hits_r ccache_misses_r ccache_hits_w ccache_misses_w ccache_dedup_hits ccache_nondedup_hits ccache_dedup_misses ccache_nondedup_misses".split())
    + ", count(*) FILTER (WHERE is_read AND NOT h) AS disk_reads, count(*) FILTER (WHERE NOT is_read) AS disk_writes"
)


def swept_sql(source: str, sizes: list[int], name: str, fixed: bool) -> str:
    clean = "clean, key_vol = vol AND key_blk = blk AS s" if fixed else "CAST(NULL AS BOOLEAN) AS clean, CAST(NULL AS BOOLEAN) AS s"
    return f"SELECT {name} AS config, '{'fixed' if fixed else 'plain'}' AS mode, is_read, coalesce(distance < c, false) AS h, {clean} FROM {source} CROSS JOIN (SELECT unnest({sizes}) AS c)"


def configs() -> list[CacheConfig]:
    out = [CacheConfig("plain", n) for n in CAPACITIES] + [CacheConfig("plain", 64, writes=False), CacheConfig("plain", 64, iterations=2)]
    return out + [CacheConfig("fixed", n, write_updates=True) for n in CAPACITIES] + [CacheConfig("fixed", 64, write_updates=True, intra_only=True)]


def machine_configs() -> list[CacheConfig]:
    return [CacheConfig("fixed", n) for n in CAPACITIES] + [CacheConfig("content", n, n * s // 4) for n in CAPACITIES for s in (1, 2, 3)]


TWICE = "w AS (SELECT seq, vol, blk, is_read FROM a UNION ALL SELECT seq + (SELECT max(seq) + 1 FROM a), vol, blk, is_read FROM a)"


@query(
    f"WITH {REDIRECTED}, {leaders_sql('AND d.vol = m.vol', '_i')}, {TWICE}, {distances_sql('a', 'vol, blk', '_p')}, {distances_sql('(SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, vol, blk, is_read FROM a WHERE is_read)', 'vol, blk', '_r')}, "
    f"{distances_sql('w', 'vol, blk', '_w')}, {distances_sql('k', 'key_vol, key_blk', '_f')}, {distances_sql('k_i', 'key_vol, key_blk', '_fi')}, o AS ("
    + " UNION ALL ".join([
        swept_sql("u_p", CAPACITIES, "'plain-' || c", False), swept_sql("u_r", [64], "'plain-' || c || '-reads'", False), swept_sql("u_w", [64], "'plain-' || c || '-x2'", False),
        swept_sql("u_f", CAPACITIES, "'fixed-' || c || '-w'", True), swept_sql("u_fi", [64], "'fixed-' || c || '-w-intra'", True),
    ])
    + f") SELECT config, mode, {COUNTERS} FROM o GROUP BY config, mode"
)
def mode_sweep(spark, sf_dir):
    """Configurations whose outcomes follow from reuse distances, in one pass for each mode."""
    return sweep(consistent(spark, sf_dir), configs())


@query()
def machine_sweep(spark, sf_dir):
    """Configurations whose maps depend on their cache: state machines, tested against a model of lists."""
    return sweep(consistent(spark, sf_dir), machine_configs())


SCANNED = (
    LOG.replace("a AS (", "a0 AS (", 1).replace("FROM a GROUP BY vol)", "FROM a0 GROUP BY vol)")
    + """, scan AS (SELECT vol, unnest(range(cap)) AS blk FROM caps),
a AS (
  SELECT row_number() OVER (ORDER BY vol, blk) - 1 AS seq, CAST(0 AS BIGINT) AS tick, vol, blk, true AS is_read, md5(CAST(blk % 40 AS VARCHAR)) AS content FROM scan
  UNION ALL SELECT seq + (SELECT count(*) FROM scan), tick, vol, blk, is_read, content FROM a0)"""
)


@query(
    f"WITH {(REDIRECTED).replace(LOG, SCANNED, 1)}, n AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, vol, blk, is_read, clean, key_vol, key_blk FROM k WHERE seq >= (SELECT count(*) FROM scan)), {distances_sql('n', 'key_vol, key_blk')}, "
    f"o AS ({swept_sql('u', CAPACITIES, chr(39) + 'fixed-' + chr(39) + ' || c || ' + chr(39) + '-w' + chr(39), True)}) SELECT config, mode, {COUNTERS} FROM o GROUP BY config, mode"
)
def scan_then_replay(spark, sf_dir):
    """A scan of all volumes fills the maps before the log is replayed; its contents are made up, a read of the log finds what the scan found."""
    a = log(spark, sf_dir)
    caps = V.capacities(a)
    blocks = caps.select("vol", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cap") - 1)).alias("blk"))
    scan = with_seq(blocks, F.col("vol"), F.col("blk")).select("seq", F.lit(0).cast("bigint").alias("at"), "vol", "blk", F.lit(True).alias("is_read"), F.md5((F.col("blk") % CONTENTS).cast("string")).alias("content"))
    both = M.disk_view(V.to_physical(R.with_warmup(scan, a), V.place(caps))).drop("trace_content", "was_inconsistent")
    return sweep(both, [CacheConfig("fixed", n, write_updates=True) for n in CAPACITIES])


@query()
def content_mode_counters(spark, sf_dir):
    return sweep(consistent(spark, sf_dir), [CacheConfig("content", 128, 64)])


@query()
def fixed_mode_outcomes(spark, sf_dir):
    return simulate(consistent(spark, sf_dir), [CacheConfig("fixed", 64)])


@query()
def chunk_mode_outcomes(spark, sf_dir):
    return simulate(consistent(spark, sf_dir), [CacheConfig("chunk", 64)])


@query()
def chunk_boundaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = with_chunks(d, "text", ChunkRule(smallest=64, largest=2048, mask=0x7F, value=0x08))
    return d.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.off", "c.len", "c.md5")


@query()
def chunk_dedup(spark, sf_dir):
    """Bytes that content-defined chunks of pages save: by chunk, how often it occurs and how long it is."""
    p = with_chunks(table(spark, sf_dir, "pages").select("page_id", "html"), "html", ChunkRule.of_average(9))
    c = p.select(F.explode("chunks").alias("c")).groupBy("c.md5").agg(F.count("*").alias("n"), F.max("c.len").alias("len"))
    return c.agg(F.sum(F.col("n") * F.col("len")).alias("bytes"), F.sum("len").alias("unique_bytes"), F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"))


@query(f"WITH {DISK} SELECT seq, vol, blk, CASE WHEN touch = 1 THEN 'absent' WHEN prev_read THEN 'clean' ELSE 'dirty' END AS state FROM d")
def map_state_lookup(spark, sf_dir):
    return M.mapped_state(log(spark, sf_dir)).select("seq", "vol", "blk", "state")


@query(
    f"WITH {INTERVALS} SELECT p.seq, p.vol, p.blk, p.content, EXISTS (SELECT 1 FROM m WHERE m.vol = p.vol AND m.blk = p.blk AND m.content = p.content AND m.from_seq < p.seq AND (m.to_seq IS NULL OR m.to_seq >= p.seq)) AS is_member "
    "FROM (SELECT seq, vol, blk, trace_content AS content FROM d) p"
)
def mapping_membership(spark, sf_dir):
    return M.members(log(spark, sf_dir).select("seq", "vol", "blk", "content"), M.map_intervals(consistent(spark, sf_dir)))


@query(
    f"WITH {INTERVALS}, l AS (SELECT d.seq, arg_max(m.blk, m.from_seq) AS lead_blk FROM d JOIN m ON d.content = m.content AND d.vol = m.vol AND m.from_seq < d.seq AND (m.to_seq IS NULL OR m.to_seq > d.seq) WHERE d.is_read AND d.touch > 1 GROUP BY d.seq) "
    "SELECT d.seq, d.vol, d.blk, l.lead_blk FROM d LEFT JOIN l ON d.seq = l.seq WHERE d.is_read AND d.touch > 1"
)
def intra_volume_leaders(spark, sf_dir):
    a = consistent(spark, sf_dir)
    reads = M.mapped_state(a, True).where("is_read and state = 'clean'")
    return M.leaders(reads, M.map_intervals(a), ("content", "vol")).select("seq", "vol", "blk", "lead_blk")


@query(f"WITH {LEADERS} SELECT d.seq, d.content, d.content AS lead_content FROM d JOIN l ON d.seq = l.seq")
def leader_content_check(spark, sf_dir):
    a = consistent(spark, sf_dir)
    reads = M.mapped_state(a, True).where("is_read and state = 'clean'")
    led = M.leaders(reads, M.map_intervals(a)).where("lead_blk is not null")
    return M.leader_content(led, a).select("seq", "content", "lead_content")


@query(
    f"WITH {LOG}, b AS (SELECT vol, blk, max(seq) AS seen FROM a GROUP BY vol, blk), n AS (SELECT *, lag(blk) OVER w AS pb, lag(seen) OVER w AS ps, lead(blk) OVER w AS nb, lead(seen) OVER w AS ns FROM b WINDOW w AS (PARTITION BY vol ORDER BY blk)) "
    "SELECT vol, blk, seen, CASE WHEN pb = blk - 1 THEN ps END AS prev_seen, CASE WHEN nb = blk + 1 THEN ns END AS next_seen FROM n"
)
def block_neighbours(spark, sf_dir):
    return M.neighbours(log(spark, sf_dir).groupBy("vol", "blk").agg(F.max("seq").alias("seen")), ("seen",))


@query(f"WITH {LOG} SELECT seq, vol, row_number() OVER (PARTITION BY vol ORDER BY seq) - 1 AS blk, lead(seq) OVER (PARTITION BY vol ORDER BY seq) IS NULL AS is_last FROM a")
def scan_last_block(spark, sf_dir):
    return R.mark_last(R.scan_layout(log(spark, sf_dir))).select("seq", "vol", "blk", "is_last")


@query(
    f"WITH {LOG}, s AS (SELECT event_id, CAST(user_id % {VOLUMES} AS INTEGER) AS vol, CAST(floor(value * 100) AS BIGINT) AS tick FROM events), n AS (SELECT *, lag(tick) OVER (PARTITION BY vol ORDER BY event_id) AS p FROM s WHERE tick IS NOT NULL) "
    "SELECT event_id AS seq, vol, tick AS \"at\" FROM n WHERE p > tick"
)
def time_inversions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.inversions(e.select(F.col("event_id").alias("seq"), (F.col("user_id") % VOLUMES).cast("int").alias("vol"), F.floor(F.col("value") * 100).cast("bigint").alias("at")))


@query(
    f"WITH {LOG}, {TWICE}, {distances_sql('w', 'vol, blk')} SELECT count(*) FILTER (WHERE is_read) AS reads, count(*) FILTER (WHERE is_read AND coalesce(distance < 64, false)) AS hits "
    "FROM u WHERE seq > (SELECT max(seq) FROM a)"
)
def second_iteration(spark, sf_dir):
    """The log twice in a row: reads and hits of the second time, in a cache of 64 blocks."""
    a = log(spark, sf_dir).select("seq", "vol", "blk", "is_read")
    n = a.count()
    hits = U.lru_hits(U.reuse_distances(R.repeated(a, 2)), 64).where(F.col("seq") >= n)
    return hits.agg(F.count_if("is_read").alias("reads"), F.count_if(F.col("is_read") & F.col("hit")).alias("hits"))


@query()
def chunk_mode_counters(spark, sf_dir):
    o = simulate(consistent(spark, sf_dir), [CacheConfig("chunk", n) for n in CAPACITIES])
    return C.counters(o, ("config", "mode"))
