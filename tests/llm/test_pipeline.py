import random

import sentencepiece

import corpus_pipeline as P
from iolens.llm.common import saved, tokenizer_file

from .test_neardup import brute, plain_set

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123 $$", None, None, None)], docs.schema)
    docs = saved(docs.union(extra), "test")
    kept = saved(P.language(spark, docs, SF), "test")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9001, 9002, 9003}
    assert kept.columns == P.COLUMNS
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = saved(P.near_duplicate_removal(spark, kept, SF, 85), "test")
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in brute(rows) if d == c)
    mixed = saved(P.mix(spark, single, SF), "test")
    ids = {r.doc_id for r in single.collect()}
    assert {r.doc_id for r in mixed.collect()} <= ids and mixed.columns == P.COLUMNS
    assert mixed.count() > 0.8 * len(ids)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in mixed.collect()}
    out = P.tokenize(spark, mixed, SF).collect()
    assert len(out) == mixed.count() and all(r.n_tokens == len(sp.encode(text[r.doc_id])) for r in out)


def test_run_and_empty(spark):
    assert P.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(5)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60))
    foreign = ["Все люди рождаются свободными и равными", "人人生而自由 在尊严和权利上一律平等", "يولد جميع الناس أحرارا متساوين", noise, "xqzj kwvbt"]
    by = {}
    for r in docs.orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    mixed = [" ".join(t[0][:400] for t in by.values()), by["en"][1][:300] + " " + by["fr"][1][:300], by["en"][2][:600] + " " + foreign[0]]
    rows = [(9100 + i, t, "en", "s", len(t)) for i, t in enumerate(foreign)] + [(9200 + i, t, "en", "s", len(t)) for i, t in enumerate(mixed)]
    got = P.language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), SF)
    new = {r.doc_id for r in got.where("doc_id >= 9000").collect()}
    assert new == {9200, 9201, 9202}
    assert got.where("doc_id < 9000").count() == docs.count()


def test_repeated_rows_and_rows_without_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, long), (5, long), (None, long), (None, long + " end"), (None, other), (None, other), (8, ""), (None, ""), (None, ""), (None, None), (9, None), (7, other + " more"), (3, "a b")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicate_removal(spark, docs, SF)
    assert got.columns == P.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, long), (8, ""), (None, ""), (None, None), (9, None), (7, other + " more"), (3, "a b")], key=str)


def test_near_duplicates_between_80_and_85_are_removed(spark):
    """Pairs with 100 shingles in common and tails of their own: similarities of 0.806, 0.826 and 0.787."""
    tails, rows = [(12, 12), (10, 11), (14, 13)], []
    for i in range(30):
        for j, n in enumerate(tails[i % 3]):
            rows.append((10 * i + j, " ".join([f"d{i}w{k}" for k in range(104)] + [f"d{i}t{j}x{k}" for k in range(n)])))
    sets = [plain_set(t) for _, t in rows]
    assert [round(len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]), 3) for k in (0, 2, 4)] == [0.806, 0.826, 0.787]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    gone = {i for i, _ in rows} - {r.doc_id for r in dict(P.STAGES)["minhash_neardup"](spark, docs, SF).collect()}
    assert gone == {10 * i + 1 for i in range(30) if i % 3 != 2}
