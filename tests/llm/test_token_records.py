import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from iolens.llm import token_records as R
from iolens.llm.common import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=6))
def test_checksums(parts):
    assert R.crc32c(parts).tolist() == [plain_crc32c(p) for p in parts]
    assert R.unframe(R.frame(parts)) == parts


def test_known_checksum_and_damage():
    assert R.crc32c([b"123456789"]).tolist() == [0xE3069283]
    r = bytearray(R.frame([b"hello"])[0])
    assert struct.unpack("<Q", r[:8]) == (5,)
    for at in (0, 9, 13, len(r) - 1):
        bad = bytearray(r)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.unframe([bytes(bad)])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(["Ab", "é", "e", "́", " ", "\n", "  ", "\t", "<|endoftext|>", "'S", "12", "$%", "\x1c", "Σ", "İ", "　", " ", "\r"]), max_size=14).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=20)))
def test_ids_are_the_librarys(text):
    got = R.encode_payloads([text], R.tokenizer(PATH, "<u2"), b"")[0]
    assert np.frombuffer(got, "<u2").tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=33, max_codepoint=255), min_size=1, max_size=12) | st.sampled_from(["don't", "it'LL", "ÀÉß", "a's1", "'", "<|startoftext|>x"]), max_size=8).map(" ".join))
def test_plain_words_are_the_librarys(text):
    got = R.encode_payloads([text], R.tokenizer(PATH, "<u2"), b"")[0]
    assert np.frombuffer(got, "<u2").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    texts = {9: "Hello there", 3: None, 5: "", 7: "a b " * 40_000, 1: "x\ny", 4: "same", 6: "same"}
    rows = [(i, t, 0) for i, t in texts.items()] + [(None, "lost", 0), (3, None, 0), (9, "Hello there", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = f"file://{tmp_path}/r"
    files = R.write_records(df, out, PATH, 2, file_bytes=1)
    back = R.read_records(spark, out, files, outputs=("ids", "ids_crc32")).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in back] == [r[0] for r in want]
    start = 0
    for r, (_, text, _) in zip(back, want, strict=True):
        ids = LIB.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    mixed = R.read_records(spark, out, files, shuffle=5).collect()
    assert sorted(map(str, ((r.doc_id, r.ids) for r in mixed))) == sorted(map(str, ((r.doc_id, r.ids) for r in back)))
    assert [r.doc_id for r in mixed] != [r.doc_id for r in back]
    assert R.records_of(df.limit(0), PATH, 2).count() == 0
    fs = pafs.LocalFileSystem()
    one = f"{tmp_path}/r/{files[0]['file']}.rec"
    data = bytearray(fs.open_input_stream(one).read())
    data[-6] ^= 1
    with fs.open_output_stream(one) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        R.read_records(spark, out, files).collect()
