import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from iolens.llm.common import tokenizer_file
from iolens.llm.sentencepieces import BYTE, MARK, NORMAL, PieceFile
from iolens.llm.token_counts import UnigramCounter, count_tokens, counter

PATH = tokenizer_file("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    vocab = [("<unk>", 0.0), *pieces.items()]
    if byte_fallback:  # ids for the bytes; their strings are kept out of the texts
        vocab += [(f"<0x{b:02X}>", min(pieces.values())) for b in range(256)]
    return Tokenizer(models.Unigram(vocab, 0, byte_fallback))


M = PieceFile(open(PATH, "rb").read())
FULL = {p: s for p, s, k in M.pieces if k == NORMAL}
LIB = library(FULL, True)
PARTS = ["a", "e", "th", "in", " ", "  ", "\n", "▁", "é", "中", "😀", "aaaa", "ll", "22", "...", "ри", "\r", "zzzq"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=30)))
def test_counts_are_the_librarys(text):
    want = LIB.encode(MARK + text.replace(" ", MARK)).ids if text else []
    assert counter(PATH).count(text)[1] == len(want)


@settings(max_examples=300, deadline=None)
@given(
    st.dictionaries(st.text("abc▁", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -0.5, -4.25]), min_size=1, max_size=12),
    st.text("abcd ", max_size=14),
    st.booleans(),
)
def test_ties_and_unknowns(pieces, text, fallback):
    c = UnigramCounter(pieces, fallback)
    ids = library(pieces, fallback).encode(MARK + text.replace(" ", MARK)).ids if text else []
    assert c.count(text)[1] == len(ids)


def every_path(pieces, s):
    if not s:
        return [0.0]
    return [pieces[s[:k]] + x for k in range(1, len(s) + 1) if s[:k] in pieces for x in every_path(pieces, s[k:])]


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=8))
def test_score_is_the_best_of_all_paths(text):
    pieces = {MARK: -1.0, "a": -3.0, "b": -4.0, "ab": -5.0, "ba": -2.0, "aab": -6.0, MARK + "a": -2.0}
    assert UnigramCounter(pieces, True).count(text)[0] == max(every_path(pieces, MARK + text))


def test_rows(spark):
    texts = [None, "", "the the\nthe", "a  b", "x" * 60_000, "the the\nthe", "<0x0A> <s>"]
    df = spark.createDataFrame([(i if i != 2 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = count_tokens(df, PATH).collect()
    c = counter(PATH)
    assert [(r.n_tokens, r.score) for r in rows] == [c.count(t)[::-1] for t in texts]
    assert rows[0].n_tokens == 0 and rows[0].score == 0.0
    assert count_tokens(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        UnigramCounter({}, True)
