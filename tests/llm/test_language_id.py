import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from iolens.llm import language_id as L
from iolens.llm import queries as Q


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.floats(-30, 0).map(lambda x: round(x, 2))] * 3), min_size=1, max_size=6), min_size=1, max_size=4), st.sampled_from([0.5, 4.0, 12.0]))
def test_paths_are_the_best_of_all(texts, switch):
    lab = L.Labeller(L.Model(["a", "b", "c"], np.zeros((L.BUCKETS, 3)), np.ones((1, 3), bool), switch))
    names = [[f"{k}-{i}" for i in range(len(t))] for k, t in enumerate(texts)]
    flat = [n for t in names for n in t]
    lab.place = {n: i for i, n in enumerate(flat)}
    lab.scores = np.array([s for t in texts for s in t])
    lab.letters = np.ones(len(flat), np.int64)
    value = lambda t, p: sum(t[i][c] for i, c in enumerate(p)) - switch * sum(x != y for x, y in zip(p, p[1:], strict=False))
    for t, (path, _, _) in zip(texts, lab.paths(names), strict=True):
        assert np.isclose(value(t, path), max(value(t, p) for p in itertools.product(range(3), repeat=len(t))))


LANGS = {"xx": "tha ing er the and of onth re".split(), "yy": "öber sch ung über ß ein der zu".split(), "ru": "при ове ста это как ный ого".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(LANGS[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_fit_and_label(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang) for i in range(300) for lang in [rng.choice(list(LANGS))]]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "", "xx"), (902, "no language here", None)], "doc_id long, text string, lang string")
    model = L.fit(df.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    assert model.languages == sorted(LANGS)
    odd = [(1, None), (2, ""), (3, "123 $$$ --"), (4, text(rng, "xx", 40) + " " + text(rng, "yy", 20)), (5, "при" * 50_000), (6, "Καλημέρα κόσμε"), (7, text(rng, "yy", 1))]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(odd, "doc_id long, text string"), model, with_spans=True).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [got[k].score for k in (1, 2, 3)] == [0.0] * 3
    assert got[4].lang_pred == "xx" and 0.4 < got[4].score < 0.9
    assert [s.lang for s in got[4].spans] == ["xx", "yy"] and got[4].spans[1].words == 20
    assert got[5].lang_pred == "ru" and got[7].lang_pred == "yy"
    assert got[6].lang_pred in LANGS and 0 <= got[6].score <= 1
    held = df.where("doc_id < 900").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    right = L.identify(held, model, {"doc_id": F.col("doc_id"), "lang": F.col("lang")}).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    none = L.fit(df.limit(0))
    assert none.languages == [] and {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.identify(df.limit(0), model).count() == 0


def test_scripts():
    assert [L.script_of(c) for c in "aéжλ中かあ한ع"] == ["Latin", "Latin", "Cyrillic", "Greek", "Han", "Kana", "Kana", "Hangul", "Arabic"]


def test_registered_query_on_held_out_rows(spark):
    """Over the whole table: all rows, the held-out ones as defined, nine in ten of their languages right."""
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = Q.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    some = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang is not None and docs[r.doc_id].text]
    assert len(some) > 100 and sum(some) > 0.9 * len(some)


def test_odd_labels_and_scripts(spark):
    rows = [(i, "the and of", f"odd{i}") for i in range(L.MOST_LANGUAGES + 40)] + [(1000 + i, "the and of those " * 9, "xx") for i in range(20)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == L.MOST_LANGUAGES and "xx" in model.languages
    assert [L.SCRIPT_NAMES[k] if k >= 0 else None for k in L.grams(["aжжж", "aaж", "12", "中"])[3]] == ["Cyrillic", "Latin", None, "Han"]
