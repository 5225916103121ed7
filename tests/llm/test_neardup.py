import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from iolens.llm import neardup as N
from iolens.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    """{row number: (set size, component)}: every pair of rows is compared."""
    sets = [plain_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            linked = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
            if None not in (rows[i][0], rows[j][0]) and (linked or rows[i][0] == rows[j][0]):
                part[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(s), low.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, n=60, family=40):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    texts = [None, "", " \n", "one two", "one Two", "three", "a b c d e", "A B C D E"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]
    base = rng.choices(words, k=100)
    for _ in range(family):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(100)] = f"new{rng.random()}"
        texts.append("\t".join(w))
    texts += rng.choices(texts, k=30)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)]
    return rows + [(None, texts[10]), (None, None), (ids[12], texts[12]), (ids[13], texts[14])]


def test_all_links(spark):
    for seed, size in ((1, N.BLOCK_SETS), (2, 7)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
        got = N.near_duplicates(df, block_sets=size).collect()
        assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute(rows)))
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert N.near_duplicates(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=14), st.booleans(), st.sampled_from([50, 70, 85]))
def test_forest_joins_exactly_the_linked(sets, two, num):
    side = [i % 2 for i in range(len(sets))] if two else None
    got = N.Links(num).forest([np.array(sorted(s), np.uint64) for s in sets], side)

    def parts(links):
        p = list(range(len(sets)))
        for a, b in links:
            p = [p[a] if x == p[b] else x for x in p]
        return [[p[i] == p[j] for j in range(len(sets))] for i in range(len(sets))]

    want = [(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert parts(got) == parts(want)
    assert set(map(frozenset, got)) <= set(map(frozenset, want)) and len(got) < len(sets)


def test_miss_probability():
    assert N.miss_probability(0.85) < 2e-4 and N.miss_probability(0.95) < 1e-8 and N.miss_probability(0.1) > 0.99999


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000, 1000 + i) for i in range(1, 50)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        for a, b in edges:
            if None not in (a, b):
                part[a] = part[b] = min(part[a], part[b])
    ends = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    assert got == {x: part[x] for x in ends}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
