"""MinHash near-duplicate detection with tensored banding, confirmed on full sets.

Each text is a set of word shingles. A few small *collections* of minhashes are drawn from it. Instead of fresh minhashes for every
table, each pair of collections is a table whose key combines both: with ``c`` collections of ``r`` hashes there are c(c-1)/2 tables of
2r hashes for only c*r minhashes. Two sets meet in a table as soon as two of their collections agree, so with 16 collections of 4
hashes sets of similarity 0.85 miss each other with a probability of 0.00014. The number of collections follows the threshold and a bound on that
probability, 1e-5 at the threshold itself (20 collections for 0.85) and far less above it.

Steps, each of them a shuffle on keys with pre-aggregation:

1. A map computes set size, a 128-bit class of the set and the collections. Equal sets form a class and go on as one row.
2. Collection values that occur once can be part of no common table; only the others are paired into table keys.
3. In each table a row is tied to the smallest id under its key, never to every other. The ties' components are *families*.
4. Links are confirmed on full sets, read anew from the texts. First each row meets the one row it shares most tables with, in streams of bounded
   length: that joins most of a group of near copies, however large, by one comparison a row. What can still be missing are links between the parts
   of a family, so only rows outside its largest part go on to meet the others: both are cut into blocks of bounded size, every block of the former
   meets every block in a group of its own, and no task holds more than two blocks. Within a group rarest-first prefixes find
   every pair that can reach the threshold, their intersections are counted in full, and only links that join two so far separate
   parts leave the task. No pair is listed and none is dropped.
5. The components of the links, brought back to all rows over their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, saved
from .components import connected_components

WORDS = 5
#: A link: LINK_NUM * |union| <= 100 * |intersection|.
LINK_NUM = 85
COLLECTIONS, HASHES = 16, 4
#: The probability with which two sets just at the threshold may miss each other.
MISS = 1e-5
#: Of one block of a family at most about this many sets and shingles (a single set may be larger).
BLOCK_SETS, BLOCK_SHINGLES = 2048, 400_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    KEPT = 250_000

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh64_intdigest(w)
        if len(w) <= 64:
            if len(self) >= self.KEPT:
                self.clear()
            self[w] = h
        return h


def shingles(text: str | None, words: dict, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; all words as one if they are fewer; none without words.

    Words are what lies between the bytes 9-13 and 32; A-Z are lower-cased.
    """
    ws = text.encode().lower().split() if text else ()
    if not ws:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    k = min(n, len(a))
    h = np.full(len(a) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ a[i : len(a) - k + 1 + i]) * _STEP
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _multipliers(n: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(0, 2**64, (2, n), np.uint64) | np.uint64(1)


def signature(s: np.ndarray, collections: int = COLLECTIONS, hashes: int = HASHES) -> np.ndarray:
    """One 64-bit value for each collection of minhashes of a set."""
    add, mul = _multipliers(collections * hashes)
    low = np.fromiter((((s ^ x) * y).min() for x, y in zip(add, mul, strict=True)), np.uint64, len(mul)).reshape(collections, hashes)
    h = np.zeros(collections, np.uint64)
    for k in range(hashes):
        h = (h ^ low[:, k]) * _STEP
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def prepared(df: DataFrame, id_col: str, text_col: str, n_words: int = WORDS, collections: int = COLLECTIONS) -> DataFrame:
    """(id, n_shingles, class, collections) of every row; class and collections are null for empty sets."""

    def start():
        words = _Words()

        def batch(ids, texts):
            n, cls, sig, last = [], [], [], {}
            for t in texts:
                got = last.get(t)
                if got is None:
                    s = shingles(t, words, n_words)
                    got = (len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, collections)) if len(s) else (0, None, None)
                    last[t] = got
                n.append(got[0])
                cls.append(got[1])
                sig.append(got[2])
            return [ids, n, cls, sig]

        return batch

    return map_rows(
        df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")),
        "id bigint, n_shingles bigint, cls binary, sig array<bigint>",
        start,
    )


class Links:
    """Which sets of a group are linked: exact, by rarest-first prefixes and full counts."""

    def __init__(self, link_num: int = LINK_NUM):
        self.num = link_num

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(a) + len(b) - len(np.union1d(a, b)) if 100 * min(len(a), len(b)) >= self.num * max(len(a), len(b)) else 0
        return 100 * common >= self.num * (len(a) + len(b) - common)

    def forest(self, sets: list[np.ndarray], side: list[int] | None = None, part: list[int] | None = None) -> list[tuple[int, int]]:
        """Links (i, j) that join all linked sets; with ``side`` only links between unequal sides count, sets of one ``part`` are joined already."""
        n = len(sets)
        size = np.fromiter(map(len, sets), np.int64, n)
        order = np.argsort(size, kind="stable")
        first = np.concatenate([[0], np.cumsum(size)])
        _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        token = rank[token]  # tokens in the order of their frequency
        df = np.sort(df)
        # rarest tokens of each set first
        token = token[np.lexsort((token, np.repeat(np.arange(n), size)))]
        need = -(-self.num * size // 100)  # an intersection has this many at least
        keep = size - need + 1
        pos = np.arange(len(token)) - np.repeat(first[:-1], size)
        index = (pos < np.repeat(keep, size)) & (df[token] > 1)
        owner = np.repeat(np.arange(n), size)[index]
        key = token[index]
        by = np.lexsort((size[owner], key))
        owner, key = owner[by], key[by]
        starts = np.searchsorted(key, np.arange(len(df) + 1))
        prefix_first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        own_tokens = token[index]  # by set
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sides = np.zeros(n, np.int64) if side is None else np.asarray(side)
        parent = list(range(n))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        first_of: dict[int, int] = {}
        for i, x in enumerate(part or ()):
            parent[i] = first_of.setdefault(x, i)
        mark = np.zeros(len(df), bool)
        out = []
        for i in order.tolist():
            own = own_tokens[prefix_first[i] : prefix_first[i + 1]]
            if not len(own):
                continue
            near = np.unique(np.concatenate([owner[starts[t] : starts[t + 1]] for t in own]))
            near = near[(place[near] < place[i]) & (100 * size[near] >= self.num * size[i])]
            if side is not None:
                near = near[sides[near] != sides[i]]
            if not len(near):
                continue
            root = find(i)
            near = near[[find(j) != root for j in near.tolist()]]
            mark[token[first[i] : first[i + 1]]] = True
            for at in range(0, len(near), 256):
                some = near[at : at + 256]
                flat = np.concatenate([token[first[j] : first[j + 1]] for j in some])
                common = np.add.reduceat(mark[flat], np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
                for j in some[100 * common >= self.num * (size[i] + size[some] - common)].tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        parent[b] = a
                        out.append((i, j))
            mark[token[first[i] : first[i + 1]]] = False
        return out


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(got: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], pa.int64()) for k in (0, 1)], schema=_EDGES)


def _confirm_stars(rows: DataFrame, n_words: int, link_num: int) -> DataFrame:
    """``rows`` (center, salt, arm, id, text), a center (arm 0) followed by the rows to compare with it -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, links = _Words(), Links(link_num)
        now, centers = None, []
        for b in batches:
            got = []
            for center, salt, arm, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (center, salt) != now:
                    now, centers = (center, salt), []
                s = shingles(text, words, n_words)
                if not arm:
                    centers.append(s)
                elif any(len(s) and len(c) and links.linked(c, s) for c in centers):
                    got.append((center, i))
            yield _edges(got)

    return rows.select("center", "salt", "arm", "id", "text").mapInArrow(run, "a bigint, b bigint")


def _confirm_blocks(rows: DataFrame, n_words: int, link_num: int) -> DataFrame:
    """``rows`` (family, x, y, id, block, part, text), dealt out and sorted by (family, x, y) -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, links = _Words(), Links(link_num)
        now, ids, sets, blocks, parts = None, [], [], [], []

        def close() -> pa.RecordBatch:
            got = links.forest(sets, None if now[1] == now[2] else blocks, parts) if len(set(parts)) > 1 else []
            return _edges([(ids[i], ids[j]) for i, j in got])

        for b in batches:
            for fam, x, y, i, block, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (fam, x, y) != now:
                    if now:
                        yield close()
                    now, ids, sets, blocks, parts = (fam, x, y), [], [], [], []
                s = shingles(text, words, n_words)
                if len(s):
                    ids.append(i)
                    sets.append(s)
                    blocks.append(block)
                    parts.append(part)
        if now:
            yield close()

    return rows.select("family", "x", "y", "id", "block", "part", "text").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = WORDS,
    link_num: int = LINK_NUM,
    block_sets: int = BLOCK_SETS,
    block_shingles: int = BLOCK_SHINGLES,
    miss: float = MISS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Rows are linked if ``100 * intersection >= link_num * union`` of their shingle sets; ``component_id`` is the smallest id reachable over
    links, the own id included, and ``kept`` tells whether it is the own one. Null, empty and wordless texts have an empty set and no link.
    The number of collections follows ``link_num`` and ``miss``, the share of links just at the threshold that may be lost (:func:`collections_for`); the smaller it is, the more minhashes.
    Rows that share an id count as one document: a link of one is a link of all. A null id takes no part: its component is null and it is kept.
    """
    df = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = saved(prepared(df, "id", "text", n_words, collections_for(link_num, miss)), "shingles")
    classes = saved(
        docs.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")),
        "classes",
    )
    # collection values that another class has too
    entries = classes.select("rep", F.posexplode("sig").alias("c", "v"))
    shared = entries.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1").select("c", "v")
    mine = entries.join(shared, ["c", "v"]).groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("c", "v"))).alias("l")).where("size(l) > 1")
    # a row has at most as many as there are collections: their pairs are the table keys
    pairs = F.flatten(
        F.transform("l", lambda p, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda q: F.xxhash64(p["c"], p["v"], q["c"], q["v"])))
    )
    keys = mine.select("rep", F.explode(pairs).alias("k"))
    center = keys.groupBy("k").agg(F.min("rep").alias("center"), F.max("rep").alias("far")).where("center < far").select("k", "center")
    # of the rows it could be compared with, the one that it shares most tables with
    ties = keys.join(center, "k").where("rep > center").groupBy("rep", "center").agg(F.count("*").alias("n"))
    ties = saved(ties, "ties")
    family = connected_components(ties, "rep", "center", name="families")
    stars = saved(ties.groupBy("rep").agg(F.max_by("center", F.struct("n", -F.col("center"))).alias("center")), "stars")
    salts = stars.groupBy("center").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("salts"))
    # the texts of all that could be linked, once: every later step reads this table
    texts = saved(df.where("id is not null").join(stars.select("rep").union(salts.select("center")).distinct().withColumnRenamed("rep", "id"), "id"), "texts")
    arms = stars.join(salts, "center").select("center", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("arm"), F.col("rep").alias("id"))
    heads = salts.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("arm"), F.col("center").alias("id"))
    met = arms.union(heads).join(texts, "id")
    near = saved(_confirm_stars(met.repartition("center", "salt").sortWithinPartitions("center", "salt", "arm"), n_words, link_num), "near")
    parts_of = connected_components(near, name="parts")
    joined = parts_of.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    sized = classes.groupBy("rep").agg(F.sum("n_shingles").alias("n")).join(family, F.col("rep") == F.col("node")).select("rep", "n", F.col("component").alias("family"))
    sized = saved(sized.join(joined, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "members")
    # the largest part of each family only meets the rows of the others
    parts = sized.groupBy("family", "part").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    main = parts.groupBy("family").agg(F.max_by("part", F.struct("sets", -F.col("part"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    need = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("sets"))) / block_sets), F.ceil(F.sum(F.when(c, F.col("shingles"))) / block_shingles)).cast("int")
    is_main = F.col("part") == F.col("main")
    blocks = parts.join(main, "family").groupBy("family", "main").agg(need(~is_main).alias("others"), need(is_main).alias("mains"))
    members = sized.join(blocks, "family").withColumn("is_main", is_main)
    # blocks of the others are numbered first
    block = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("others"))).cast("int")
    members = members.withColumn("block", block).withColumn("last", F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    met = members.select(F.col("rep").alias("id"), "family", "part", "block", "last").join(texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = met.select("family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", "part", "text")
    links = _confirm_blocks(met.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y"), n_words, link_num).union(near)
    # rows of one id tie the classes of their texts together
    same = docs.where("cls is not null and id is not null").join(classes.select("cls", "rep"), "cls").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    repeated = same.join(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    found = connected_components(links.union(repeated), name="links")
    part = classes.join(found, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("of_class"))
    part = docs.where("cls is not null").join(part, "cls", "left").unionByName(docs.where("cls is null"), allowMissingColumns=True)
    own = part.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.least(F.coalesce("of_class", "id"), "id")).alias("component_id"),
    )
    # the result is a table of its own, so that nothing else has to stay
    out = saved(own.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "near-duplicates")
    discard(docs, classes, ties, family, stars, texts, near, parts_of, sized, found)
    return out


def miss_probability(similarity: float, collections: int = COLLECTIONS, hashes: int = HASHES) -> float:
    """That two sets of this similarity agree in fewer than two collections."""
    p = similarity**hashes
    return (1 - p) ** collections + collections * p * (1 - p) ** (collections - 1)


def collections_for(link_num: int, miss: float = MISS) -> int:
    """The least number of collections, 4 at least, by which sets at the threshold miss each other with no more than this probability."""
    n = 4
    while miss_probability(link_num / 100, n) > miss:
        n += 1
    return n
