"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are rotated by a random orthogonal matrix and, taken relative to a centre, kept as one sign bit a dimension, packed, with two correction scalars: the
distance from the centre and the inner product of the unit vector with its code. The inner product of a query with a code, divided by the second
scalar, is an unbiased estimate of the inner product with the vector itself, whose error stays within ``epsilon`` times a bound that the scalars give.
A candidate is reranked with exact distances unless its lower bound exceeds a distance within which k neighbours are known.

Layout: a bounded sample gives the centres of inverted lists. Every vector goes to its nearest centre's list and each list is cut into
pieces of bounded size, so hot lists spread; a piece is the codes and vectors of its rows. A query goes to all pieces of its ``probe`` nearest lists, where
blocks of queries meet a piece as one product of matrices. Two passes:

1. *Ahead*: each query meets the first piece of its nearest few lists. Its k-th exact distance there is a limit that all its lists share.
2. *Search*: each query meets its lists with that limit. Few candidates of a list are below it, and only these are reranked.

No row is copied for several queries; what a piece returns are at most k rows a query within its limit, merged by rank. How many lists are probed follows from ``recall``,
measured on the sample: the lists that hold that share of its true neighbours. As neighbours among all rows are nearer than among a sample, the true
share is higher. With ``recall = None`` all lists are searched and only the error bound can miss a neighbour.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, sampled, saved

#: Rows that centres and probes are fitted on, about: a documented bound.
SAMPLE = 20_000
#: Vectors of a piece, at most about, and queries that meet it at once.
PIECE, BLOCK = 8192, 256
#: Lists whose first piece gives a query its limit.
AHEAD = 8
#: The bound holds with a probability of about 1 - 2 exp(-epsilon**2 / 2), each side half of it.
EPSILON = 2.2
#: Of the true neighbours in the sample the probed lists hold at least this share.
RECALL = 0.98
SEED = 11
#: Pairs whose exact distances are computed at once.
PAIRS = 1 << 16


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of vectors relative to a centre: packed signs, distances from the centre, agreements of unit vectors with their codes."""

    def __init__(self, packed: np.ndarray, norm: np.ndarray, agree: np.ndarray, d: int):
        self.packed, self.norm, self.agree, self.d = packed, norm, agree, d
        self.signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1

    @classmethod
    def of(cls, vectors: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> Codes:
        """Codes of vectors, each relative to its own row of ``centres`` (or all to one)."""
        d = vectors.shape[1]
        rest = (vectors - centres) @ turn.T
        norm = np.linalg.norm(rest, axis=1)
        unit = np.divide(rest, norm[:, None], out=np.zeros_like(rest), where=norm[:, None] > 0)
        return cls(np.packbits(rest > 0, axis=1), norm, np.abs(unit).sum(1) / math.sqrt(d), d)

    def bounds(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, lower bounds) of the squared distances, a row a query."""
        q = (queries - centre) @ turn.T
        norm = np.linalg.norm(q, axis=1)
        unit = np.divide(q, norm[:, None], out=np.zeros_like(q), where=norm[:, None] > 0)
        agree = np.where(self.agree > 0, self.agree, 1)
        error = epsilon * np.sqrt(np.maximum(1 - agree**2, 0)) / agree / math.sqrt(max(self.d - 1, 1))
        single = lambda x: x.astype(np.float32)
        estimate = single(unit) @ self.signs.T
        estimate *= single(-2 * self.norm / (agree * math.sqrt(self.d)))
        estimate *= single(norm)[:, None]
        estimate += single(self.norm**2)
        estimate += single(norm**2)[:, None]
        return estimate, estimate - single(norm)[:, None] * single(2 * self.norm * error)


def exact(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances of row to row in double precision."""
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), PAIRS):
        diff = vectors[at : at + PAIRS] - queries[at : at + PAIRS]
        out[at : at + PAIRS] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


class Piece:
    """The rows of a piece, ready for blocks of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, turn: np.ndarray, epsilon: float):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.centre, self.turn, self.epsilon = centre, turn, epsilon
        self.reranked = 0

    def distances(self, queries: np.ndarray, of: np.ndarray, row: np.ndarray) -> np.ndarray:
        self.reranked += len(row)
        out = np.empty(len(row))
        for at in range(0, len(row), PAIRS):
            out[at : at + PAIRS] = exact(self.vectors[row[at : at + PAIRS]], queries[of[at : at + PAIRS]])
        return out

    def nearest(self, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the k nearest rows within each query's limit, ties to the smaller id, without rows of the query's own id."""
        estimate, low = self.codes.bounds(queries, self.centre, self.turn, self.epsilon)
        limit = limit.copy()
        open_ = np.flatnonzero(np.isinf(limit))
        some = min(4 * k, len(self.ids))
        if len(open_) and len(self.ids) > some:  # no limit yet: one from the rows that look nearest
            near = np.argpartition(estimate[open_], some - 1, axis=1)[:, :some]
            of, row = np.repeat(open_, some), near.ravel()
            dist = self.distances(queries, of, row)
            dist[self.ids[row] == own[of]] = np.inf
            limit[open_] = np.partition(dist.reshape(-1, some), k - 1, axis=1)[:, k - 1]
        wide = 1e-5 * (self.codes.norm.max() + np.linalg.norm(queries - self.centre, axis=1)) ** 2  # more than single precision can lose
        reach = np.where(np.isinf(limit), np.inf, limit**2 + wide).astype(np.float32)
        of, row = np.nonzero(low <= reach[:, None])
        keep = self.ids[row] != own[of]
        of, row = of[keep], row[keep]
        dist = self.distances(queries, of, row)
        keep = dist <= limit[of]
        of, row, dist = of[keep], row[keep], dist[keep]
        order = np.lexsort((self.ids[row], dist, of))
        of, row, dist = of[order], row[order], dist[order]
        first = np.searchsorted(of, of)
        keep = np.arange(len(of)) - first < k
        return of[keep], self.ids[row[keep]], dist[keep]


def fit_centres(sample: np.ndarray, n: int, seed: int = SEED, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's algorithm from a random start."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:n]]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * sample @ c.T).argmin(1)
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=len(c))
        first = np.cumsum(count) - count
        on = count > 0
        sums = np.zeros_like(c)
        sums[on] = np.add.reduceat(sample[order], first[on], axis=0)
        c = np.where(on[:, None], sums / np.maximum(count, 1)[:, None], c)
    return c


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float | None, asked: int = 256) -> int:
    """The least number of nearest lists that hold the share ``recall`` of the k nearest sample rows of some sample rows."""
    if recall is None or len(sample) <= k:
        return len(centres)
    some = sample[np.random.default_rng(SEED).permutation(len(sample))[:asked]]
    far = lambda a, b: (b * b).sum(1) - 2 * a @ b.T
    at = far(sample, centres).argmin(1)
    rank = far(some, centres).argsort(1, kind="stable").argsort(1)
    near = np.argpartition(far(some, sample), k, axis=1)[:, : k + 1]  # the row itself, in the first list, is one of them
    place = np.sort(np.take_along_axis(rank, at[near], 1).ravel())
    return int(place[min(len(place) - 1, math.ceil(recall * len(place)))]) + 1


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that take part: a vector with an id, not zero, all components known and finite. Single precision stays so."""
    kind = df.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~odd & F.exists("v", lambda x: x != 0))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)


def _meet(stored: DataFrame, sent: DataFrame, centres: np.ndarray, turn: np.ndarray, k: int, epsilon: float, block: int) -> DataFrame:
    """``stored`` (list, piece, id, code, norm, agree, v) and the queries ``sent`` to their pieces (list, piece, id, v, reach) -> (query_id, vec_id, score)."""
    d = len(turn)
    nothing = {"code": "binary", "norm": "double", "agree": "double"}
    a = stored.select("list", "piece", F.lit(False).alias("asks"), "id", "code", "norm", "agree", F.lit(None).cast("double").alias("reach"), "v")
    b = sent.select("list", "piece", F.lit(True).alias("asks"), "id", *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()), "reach", "v")
    both = a.union(b).repartition("list", "piece").sortWithinPartitions("list", "piece", "asks")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, piece = None, [], None
        asked: list[tuple] = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal piece
            if asked and held:
                if piece is None:
                    ids, code, norm, agree, v = (np.concatenate(c) for c in zip(*held, strict=True))
                    piece = Piece(ids, v, Codes(code, norm, agree, d), centres[now[0]], turn, epsilon)
                own, limit, v = (np.concatenate(c) for c in zip(*asked, strict=True))
                for at in range(0, len(own), block):
                    of, ids, dist = piece.nearest(v[at : at + block], own[at : at + block], limit[at : at + block], k)
                    if len(of):
                        yield pa.RecordBatch.from_arrays([pa.array(own[at : at + block][of]), pa.array(ids), pa.array(dist)], schema=schema)
            asked.clear()

        for b in batches:
            if not len(b):
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(2)], 1)
            asks = b.column(2).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if tuple(key[lo]) != now:
                    yield from answer()
                    now, held, piece = tuple(key[lo]), [], None
                q = lo + int(np.count_nonzero(~asks[lo:hi]))
                if q > lo:
                    part = b.slice(lo, q - lo)
                    code = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(q - lo, -1)
                    held.append((part.column(3).to_numpy(), code, part.column(5).to_numpy(), part.column(6).to_numpy(), _rows(part.column(8), d)))
                if q < hi:
                    part = b.slice(q, hi - q)
                    asked.append((part.column(3).to_numpy(), part.column(7).to_numpy(), _rows(part.column(8), d)))
                    if sum(len(x[0]) for x in asked) >= block:
                        yield from answer()
        yield from answer()

    return both.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def search(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lists: int | None = None,
    probe: int | None = None,
    recall: float | None = RECALL,
    epsilon: float = EPSILON,
    sample_rows: int = SAMPLE,
    piece: int = PIECE,
    block: int = BLOCK,
) -> DataFrame:
    """The k nearest rows of ``df`` to each row of ``queries``: (query_id, rank, vec_id, score), score the Euclidean distance.

    Rows of the query's own id are no candidates. Vectors that are null, zero, or hold a null or non-finite component take no part on either side, nor
    do vectors of another dimension than most rows have (of equals the smallest), of which a warning tells the number. Fewer candidates than k are all returned. Repeated rows of an
    id count once each on the candidates' side (a repeated id may then take several ranks) and once in all on the queries' side (with the smallest vector).
    ``lists`` defaults to half the square root of the number of rows, with 32 sample rows a list at least; ``probe`` to what ``recall`` asks for.
    """
    spark = df.sparkSession
    bound_batches(spark, 4096)
    rows = usable(df, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    out = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # one number a dimension
    if not sizes:
        return spark.createDataFrame([], out)
    total, d = max((n, -d) for d, n in sizes.items())
    d = -d
    if len(sizes) > 1:
        warnings.warn(f"{sum(sizes.values()) - total} vectors do not have {d} components and take no part", stacklevel=2)
    rows, asked = rows.where(F.size("v") == d), asked.where(F.size("v") == d)
    sample = _rows(sampled(rows, sample_rows).select("v").toArrow()["v"].combine_chunks(), d)
    n = lists or max(1, min(round(math.sqrt(total) / 2), len(sample) // 32))
    centres = fit_centres(sample, min(n, len(sample)))
    turn = rotation(d)
    square = (centres * centres).sum(1)
    wanted = min(probe or probes_for(sample, centres, k, recall), len(centres))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = _rows(b.column(1), d)
                near = (square - 2 * v @ centres.T).argmin(1)
                codes = Codes.of(v, centres[near], turn)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(near.astype(np.int32)), pa.array([x.tobytes() for x in codes.packed], pa.binary()), pa.array(codes.norm), pa.array(codes.agree), b.column(1)],
                    names=["id", "list", "code", "norm", "agree", "v"],
                )

    def nearest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = np.argsort(square - 2 * _rows(b.column(1), d) @ centres.T, axis=1, kind="stable")[:, :wanted].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(near), pa.list_(pa.int32()))], names=["id", "v", "near"])

    kind = rows.schema["v"].dataType.simpleString()
    stored = rows.mapInArrow(placed, f"id bigint, list int, code binary, norm double, agree double, v {kind}")
    # rows are dealt to pieces by where they were read, so that copies of one row spread, too; the table is written before it is used
    salt = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    stored = stored_table = saved(stored.withColumn("salt", salt), "lists")
    by_list = {r["list"]: r["n"] for r in stored.groupBy("list").agg(F.ceil(F.count("*") / piece).cast("int").alias("n")).collect()}  # one number a list
    pieces = F.element_at(F.create_map(*[x for p in sorted(by_list.items()) for x in map(F.lit, p)]), F.col("list"))
    stored = stored.withColumn("piece", F.pmod("salt", pieces).cast("int"))
    sent = sent_table = saved(asked.mapInArrow(nearest_lists, f"id bigint, v {kind}, near array<int>"), "queries")
    first = sent.select("id", "v", F.explode(F.slice("near", 1, AHEAD)).alias("list"), F.lit(0).alias("piece"), F.lit(float("inf")).alias("reach"))
    ahead = _meet(stored.where("piece = 0"), first, centres, turn, k, epsilon, block)
    known = F.array_sort(F.collect_list("score"))
    limits = ahead.groupBy(F.col("query_id").alias("id")).agg(F.when(F.size(known) >= k, known[k - 1]).alias("reach"))
    sent = sent.join(limits, "id", "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"), F.explode("near").alias("list"))
    sent = sent.where(pieces.isNotNull()).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    found = _meet(stored, sent, centres, turn, k, epsilon, block)
    # Spark keeps the k smallest of each query before the shuffle, too
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    # at most k rows a query: written, so that the lists need not stay
    out = saved(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(stored_table, sent_table)
    return out
