import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from iolens.llm import sentencepieces
from iolens.llm.common import tokenizer_file
from iolens.llm.sentencepieces import encode_texts, encoder

PATH = tokenizer_file("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "e", "th", "in", " ", "  ", "\n", "▁", "é", "中", "😀", "\x00", "<s>", "<0x0A>", "aaaa", "ll", "ss", "22", "...", "́", "ри", "\r\n"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=30)))
def test_ids_and_text_are_the_librarys(text):
    e = encoder(PATH)
    ids = SP.encode(text)
    assert e.encode(text) == ids
    assert e.decode(ids) == SP.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(3, 258), max_size=12))
def test_decodes_any_ids(ids):
    assert encoder(PATH).decode(ids) == SP.decode(ids)


def test_long_units():
    e = encoder(PATH)
    for text in ("ab" * 20_000, " " * 5_000 + "x", "é" * 3_000 + "\n" * 500, "thth" * 999):
        assert e.encode(text) == SP.encode(text)


def test_rows(spark):
    texts = [None, "", "the the\nthe", "a  b", " lead", "the the\nthe", "x" * 100_000]
    df = spark.createDataFrame([(None if i == 3 else i % 5, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = encode_texts(df, PATH, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        ids = SP.encode(t or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == SP.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert encode_texts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        encode_texts(df, PATH, outputs=("nope",))


def test_full_tables(monkeypatch):
    """Tables of units and pairs that are full all the time change no id."""
    texts = [" ".join(f"w{(i * k) % 23} {chr(97 + k % 26)}{i}x" for i in range(60)) for k in range(30)]
    monkeypatch.setattr(sentencepieces, "KEPT", 5)
    monkeypatch.setattr(sentencepieces, "KEPT_PAIRS", 3)
    with open(PATH, "rb") as f:
        small = sentencepieces.PieceEncoder(f.read())
    assert [small.encode(t) for t in texts] == [SP.encode(t) for t in texts]
    assert len(small.units) <= 5 and len(small.units.older) <= 5 and len(small.fits) <= 3
