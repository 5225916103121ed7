import base64
import hashlib
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from iolens.llm import queries as Q
from iolens.llm import webp as W

#: The one-pixel file that the format's public page gives for detecting support of lossless images.
PUBLIC = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")


def test_public_file():
    img = W.decode_frame(PUBLIC)
    assert img.shape == (1, 1) and img[0, 0] >> 24 == 0


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_round_trip_of_images(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**9)))
    h, w = data.draw(st.integers(1, 21)), data.draw(st.integers(1, 21))
    few = data.draw(st.sampled_from([1, 2, 3, 5, 16, 40, 0]))
    img = rng.integers(0, 2**32, (h, w), np.uint32) if not few else rng.choice(rng.integers(0, 2**32, few, np.uint32), (h, w))
    if data.draw(st.booleans()):
        img[h // 2 :] = img[: h - h // 2]
    transforms = []
    bits = data.draw(st.integers(2, 4))
    side = ((h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits)
    if few and data.draw(st.booleans()):
        transforms.append(("palette",))
    else:
        if data.draw(st.booleans()):
            transforms.append(("predictor", bits, rng.integers(0, 14, side)))
        if data.draw(st.booleans()):
            transforms.append(("cross", bits, rng.integers(0, 256, (*side, 4))))
        if data.draw(st.booleans()):
            transforms.append(("subtract",))
        transforms = data.draw(st.permutations(transforms))
    regions = None
    if data.draw(st.booleans()) and not transforms:
        regions = rng.integers(0, 4, side)
    out = W.encode_frame(img, tuple(transforms), data.draw(st.sampled_from([0, 0, 1, 4, 11])), data.draw(st.booleans()), regions, bits)
    assert (W.decode_frame(out) == img).all()


def test_every_predictor():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 2**32, (9, 9), np.uint32)
    for mode in range(14):
        assert (W.decode_frame(W.encode_frame(img, (("predictor", 2, np.full((3, 3), mode)),))) == img).all()


def test_predictions_by_hand():
    v = lambda *x: np.array(x)
    left, top, right, corner = v(10, 20, 30, 40), v(50, 60, 70, 80), v(90, 100, 110, 120), v(200, 200, 200, 200)
    want = {0: [255, 0, 0, 0], 1: [10, 20, 30, 40], 5: [50, 60, 70, 80], 7: [30, 40, 50, 60], 10: [87, 95, 102, 110], 11: [10, 20, 30, 40], 12: [0, 0, 0, 0], 13: [0, 0, 0, 0]}
    for mode, x in want.items():
        assert np.asarray(W.predicted(mode, left, top, right, corner)).tolist() == x, mode


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=300), st.lists(st.sampled_from(["a line that is long enough\n", "é\n", "other words that repeat here\n"]), max_size=30).map("".join)))
def test_payloads(text):
    p, n = W.payload_of(text)
    assert p[:n] == text.encode() and len(p) % 64 == 0 and len(p) >= 64 and not any(p[n:])
    assert W.decode_bytes(W.encode_bytes(p)) == p


def test_long_payloads_and_all_bytes():
    rng = np.random.default_rng(2)
    for p in (bytes(range(256)), bytes(64), rng.bytes(64 * 777), bytes(range(250)) * 64 + b"\n" + bytes(63), W.payload_of("word and line\n" * 200_000)[0]):
        media = W.encode_bytes(p)
        assert W.decode_bytes(media) == p
    assert len(W.frames(media)) == 3
    line = bytes(rng.integers(65, 105, 5000, np.uint8))
    p = W.payload_of((line + b"\n").decode() * 3)[0]
    assert W.decode_bytes(W.encode_bytes(p)) == p and len(W.encode_bytes(p)) < 5000


def test_damage():
    media = bytearray(W.encode_bytes(W.payload_of("hello " * 50)[0]))
    for bad in (media[:30], b"RIFX" + media[4:], media[:20] + b"\0" + media[21:]):
        with pytest.raises(ValueError):
            W.decode_frame(bytes(bad))


def test_rows(spark):
    texts = [None, "", "Grüße\nGrüße", "x" * 5000, "Grüße\nGrüße"]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    outputs = ("width", "height", "pixels", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    rows = W.decode_media(W.store_texts(df), outputs=outputs).collect()
    for r, t in zip(rows, texts, strict=True):
        p, n = W.payload_of(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.width == 64 and r.height * 64 == len(p) and [x >> 8 & 255 for x in r.pixels] == list(p)
    assert rows[2][1:] == rows[4][1:] and rows[2].feature != rows[3].feature
    assert W.decode_media(W.store_texts(df.limit(0))).count() == 0
    assert W.decode_media(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().pixels is None


def test_every_style_of_stored_files():
    rng = np.random.default_rng(5)
    text = "".join(chr(x) for x in rng.integers(32, 127, 700)) + "a line that comes again and again\n" * 20
    payload = W.payload_of(text)[0]
    for style in W.STYLES:
        media = W.styled(payload, style)
        assert W.decode_bytes(media) == payload and media != W.encode_bytes(payload)


def test_registered_query(spark):
    """Whole table: every value from the text itself, some files of each style, equal texts equal values."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = Q.op9_webp(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        payload, n = W.payload_of(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.feature == W.feature_of(payload)
    assert len({zlib.crc32(W.payload_of(t)[0]) % W.STYLED for t in docs.values()} & set(range(len(W.STYLES)))) == len(W.STYLES)


def test_damage_in_a_column(spark):
    media = W.encode_bytes(W.payload_of("some text")[0])
    df = spark.createDataFrame([(1, media), (2, media[:30]), (3, b"x" * 40), (4, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in W.decode_media(df, outputs=("payload_bytes",), error_col="error").collect()}
    assert (got[1].payload_bytes, got[1].error) == (64, None) and (got[4].payload_bytes, got[4].error) == (None, None)
    assert got[2].payload_bytes is got[3].payload_bytes is None and got[2].error and got[3].error


def test_every_stored_file_is_coded_in_full(spark):
    """Each way of writing has its share of the files, and no file has codes of one length only."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    kinds, unequal = [], 0
    codes = []
    read = W.read_code
    try:
        W.read_code = lambda b, size: codes.append(read(b, size)) or codes[-1]
        for t in texts:
            media = W.encode_bytes(W.payload_of(t)[0])
            b = W.Bits(media[20:])
            b.at = 40
            kinds.append(b.read(2) if b.read(1) else None)
            codes.clear()
            assert W.decode_bytes(media) == W.payload_of(t)[0]
            unequal += len(set(codes[-5].n.tolist())) > 1
    finally:
        W.read_code = read
    assert all(kinds.count(k) > 30 for k in (W.PREDICTOR, W.CROSS, W.PALETTE, None))
    assert unequal > 290


def test_damaged_bits():
    rng = np.random.default_rng(7)
    payload = W.payload_of("".join(chr(x) for x in rng.integers(32, 127, 900)) + "a line that comes again and again\n" * 9)[0]
    for style in W.STYLES:
        media = W.styled(payload, style, W._repeats(payload))
        assert W.decode_bytes(media) == payload
        for _ in range(40):
            bad = bytearray(media)
            bad[int(rng.integers(26, len(bad)))] ^= 1 << int(rng.integers(8))
            try:
                assert len(W.decode_bytes(bytes(bad))) == len(payload) or bad[21:25] != media[21:25]
            except (ValueError, IndexError, KeyError):
                pass
        for n in rng.integers(27, len(media) - 2, 20).tolist():
            with pytest.raises((ValueError, IndexError, KeyError)):
                W.decode_frame(media[:n])


def test_work_for_a_file(spark):
    """Calls for writing and reading a file, which most of its time goes by, and the stored bytes, which are what they were with twice as many calls."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(200).collect()
    payloads = [W.payload_of(r.text)[0] for r in rows]
    calls, stored, wrong = 0, hashlib.sha256(), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        for p in payloads:
            media = W.encode_bytes(p)
            wrong += W.decode_bytes(media) != p
            stored.update(media)
    finally:
        sys.setprofile(before)
    assert not wrong and calls < 1800 * len(payloads)
    assert stored.hexdigest() == "0a82a164604df837e75eed95aeb6f00a565517b229778a8084b10699ba0934c0"


def test_predictors_of_green_alone():
    """Rows at once or pixel by pixel: the same as by the channels of every pixel."""
    rng = np.random.default_rng(11)
    for h, w in ((9, 64), (5, 7), (1, 9), (9, 1), (2, 2)):
        for mode in [*(np.full((1, 1), m) for m in range(14)), rng.integers(0, 14, (3, 16))]:
            bits = 2 if mode.size > 1 else 6
            img = rng.integers(0, 256, (h, w, 1)).astype(np.int16)
            left = W._predict(img, mode, bits, True)
            assert (W._unpredict_one(left[..., 0].astype(np.uint8), W._modes(mode, bits, h, w)) == img[..., 0]).all()
            full = np.concatenate([np.full_like(img, 255), np.zeros_like(img), img, np.zeros_like(img)], -1)
            alike = W._predict(full, mode, bits, True)
            assert (alike[..., 2:3] == left).all() and (W._predict(alike, mode, bits, False) == full).all()


def test_references_cover_the_first_and_longest_runs():
    rng = np.random.default_rng(13)
    for n, few in ((300, 2), (300, 5), (9000, 1), (200, 200)):
        x = rng.integers(0, few, n).astype(np.uint32)
        x[n // 2 :] = x[: n - n // 2]
        at = 0
        reach = lambda i, d: next((k for k in range(min(4096, n - i)) if x[i + k] != x[i + k - d]), min(4096, n - i))
        refs = W._references(x, 64)
        for i in range(n):
            if i < at:
                continue
            best = max(((reach(i, d), k, d) for k, d in enumerate((1, 64, 65, 135)) if d <= i), default=(0, 0, 0))
            if best[0] >= 4:
                assert refs.pop(0) == (i, best[0], best[2])
                at = i + best[0]
        assert not refs
