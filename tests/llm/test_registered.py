"""The queries as registered, over whole tables, against the libraries or brute force. Those of op2 and op6 to op9 are in the tests of their operators."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from iolens.llm import neardup as N
from iolens.llm import queries as Q
from iolens.llm.common import tokenizer_file
from iolens.llm.token_counts import counter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = Q.op1_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id].html
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        assert r.url == pages[r.page_id].url and r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split()) and r.n_chars == len(r.text)


def test_op3(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in docs.items():
        ids = sp.encode(t)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op3_sentencepiece(spark, SF).collect()} == want


def test_op4(spark, docs):
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want, start = {}, 0
    for i in sorted(docs):
        ids = [*t.encode(docs[i], add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op4_token_records(spark, SF).collect()} == want


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_op5(spark, sf):
    """Every link between full sets, by a prefix join over all of them at once, is in the result: none is lost."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    words = N._Words()
    sets = {i: N.shingles(t, words) for i, t in rows}
    some = [i for i, s in sets.items() if len(s)]
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for a, b in N.Links(85).forest([sets[i] for i in some]):
        a, b = sorted((find(some[a]), find(some[b])))
        part[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op5_minhash_neardup(spark, sf).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert sum(not k for _, _, k in got.values()) > 0.02 * len(got)


def test_op10(spark, docs):
    c = counter(tokenizer_file("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in Q.op10_token_counts(spark, SF).collect()} == {i: c.count(t)[1] for i, t in docs.items()}
