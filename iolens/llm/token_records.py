"""Token ids as length-delimited binary records with checksums and an offset index.

Record: length of the payload (unsigned 64-bit), masked CRC-32C of these 8 bytes, payload, masked CRC-32C of the payload; all
little-endian. The payload is the ids, 2 bytes each where the vocabulary allows it, else 4. Beside each ``.rec`` file lies an
``.idx`` file with 24 bytes a record: document id (signed 64-bit), 1 if the id is known or 0 if it is null, and the record's offset, so that
records can be read in any order without a scan.

Texts are dealt out by ranges of document id and sorted within, so files follow each other in ascending id order (null ids first, equal ids
by text). A task writes under names of its own and reports them in its result; only reported files are in the manifest, so
what a lost or repeated task leaves behind is never read. The manifest has a row a file, hence the first token of each file follows
from a sum over files, not over documents.
"""

from __future__ import annotations

import random
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, delete, saved, work_dir
from .sentencepieces import local_file

#: A file ends with the record that reaches this size.
FILE_BYTES = 256 << 20
INDEX = np.dtype([("id", "<i8"), ("known", "<u8"), ("offset", "<u8")])

# -- CRC-32C -------------------------------------------------------------------

_POLY = np.uint32(0x82F63B78)  # Castagnoli, reflected
_BLOCK = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ _POLY, t >> 1).astype(np.uint32)
    return t


_T = np.empty((8, 256), np.uint32)
_T[0] = _byte_table()
for _k in range(1, 8):
    _T[_k] = _T[0][_T[_k - 1] & 255] ^ (_T[_k - 1] >> 8)


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given as a table for each of the 4 bytes."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shift_by_one() -> np.ndarray:
    b = np.arange(256, dtype=np.uint32)
    step = lambda x: _T[0][x & 255] ^ (x >> 8)
    return np.stack([step(b << np.uint32(8 * k)) for k in range(4)])


@lru_cache(maxsize=64)
def _shift(power: int) -> np.ndarray:
    """The map that feeds 2**power zero bytes."""
    if power == 0:
        return _shift_by_one()
    half = _shift(power - 1)
    return np.stack([_apply(half, row) for row in half])


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string, over all of them at once.

    With a zero start value zeros in front change nothing, so strings are padded in front to whole blocks; blocks are
    run side by side and joined by shifts; what the usual start value adds depends on the length only.
    """
    n = len(parts)
    size = np.fromiter(map(len, parts), np.int64, n)
    blocks = -(-size // _BLOCK)
    out = np.zeros(n, np.uint32)
    if blocks.sum():
        data = b"".join(x for p, k in zip(parts, blocks.tolist(), strict=True) for x in (bytes(k * _BLOCK - len(p)), p))
        words = np.frombuffer(data, "<u4").reshape(-1, _BLOCK // 4)
        crc = np.zeros(len(words), np.uint32)
        for j in range(0, _BLOCK // 4, 2):
            a, b = words[:, j] ^ crc, words[:, j + 1]
            crc = _T[7][a & 255] ^ _T[6][(a >> 8) & 255] ^ _T[5][(a >> 16) & 255] ^ _T[4][a >> 24]
            crc ^= _T[3][b & 255] ^ _T[2][(b >> 8) & 255] ^ _T[1][(b >> 16) & 255] ^ _T[0][b >> 24]
        first = np.cumsum(blocks) - blocks
        longest = np.argsort(-blocks, kind="stable")
        over = _shift(_BLOCK.bit_length() - 1)
        left = np.searchsorted(-blocks[longest], -np.arange(blocks.max()), side="left")  # strings with more than k blocks
        for k, m in enumerate(left.tolist()):
            at = longest[:m]
            out[at] = _apply(over, out[at]) ^ crc[first[at] + k]
    start = np.full(n, 0xFFFFFFFF, np.uint32)
    for bit in range(int(size.max(initial=0)).bit_length()):
        on = (size >> bit) & 1 == 1
        start[on] = _apply(_shift(bit), start[on])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and offset, so that a checksum of data that holds checksums stays sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    sums = zip(masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4"), strict=True)
    return [b"".join((h, a.tobytes(), p, b.tobytes())) for h, p, (a, b) in zip(heads, payloads, sums, strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """Payloads of whole records; raises ValueError where a length or checksum is wrong."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    for r, h, p in zip(records, heads, payloads, strict=True):
        if len(r) < 16 or int.from_bytes(h, "little") != len(p):
            raise ValueError("record with a wrong length")
    said = np.frombuffer(b"".join(r[8:12] + r[-4:] for r in records), "<u4").reshape(-1, 2)
    if (said[:, 0] != masked(crc32c(heads))).any() or (said[:, 1] != masked(crc32c(payloads))).any():
        raise ValueError("record with a wrong checksum")
    return payloads


# -- tokenizing ----------------------------------------------------------------


#: Text without white space in which letters, digits and lower case mean the same to Python as to the tokenizer, and which is composed.
_PLAIN = re.compile("[!-~À-ÖØ-öø-þ]+").fullmatch
# The tokenizer's pattern, for such text in lower case.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-þ]+|[0-9]|[^a-zß-öø-þ0-9]+").findall


class WordIds(dict):
    """Text between spaces -> its ids' bytes, from the tokenizer itself.

    Sound for tokenizers that end tokens at white space and drop it, as checked by :func:`tokenizer`: the ids of a text are then those
    of its parts between spaces, one after the other. Parts of plain letters skip the tokenizer's normalizer and splitter, which are most of its
    time, and go to its model; all others take the whole way.
    """

    KEPT = 800_000
    LONGEST_KEPT = 64

    def __init__(self, t, dtype: str):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.t, self.dtype, self.model = t, dtype, t.model
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, w: str) -> bytes:
        if len(w) > self.LONGEST_KEPT:
            return np.array(self.t.encode(w, add_special_tokens=False).ids, self.dtype).tobytes()
        if w.isalpha() and w.isascii():
            p = w.lower()
            out = self.pieces.get(p) or self.piece(p)
        elif _PLAIN(w) and "<|" not in w:
            out = b"".join([self.pieces.get(p) or self.piece(p) for p in _PLAIN_SPLIT(w.lower())])
        else:
            out = np.array(self.t.encode(w, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self) >= self.KEPT:
            self.clear()
        self[w] = out
        return out

    def piece(self, p: str) -> bytes:
        ids = array(self.code, [x.id for x in self.model.tokenize(p if p.isascii() else p.translate(self.spelling))])
        if sys.byteorder != "little":
            ids.byteswap()
        out = ids.tobytes()
        if len(self.pieces) >= self.KEPT:
            self.pieces.clear()
        self.pieces[p] = out
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str, dtype: str) -> WordIds:
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    splits = [p for p in (said["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    norms = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (said["normalizer"] or {}).get("normalizers", [])]
    if norms != [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)] or len(splits) != 1 or splits[0]["pattern"] != {"Regex": _SPLIT} or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or said["post_processor"] or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in said["added_tokens"]):
        raise ValueError("only tokenizers that drop white space are supported")
    return WordIds(Tokenizer.from_file(path), dtype)


def encode_payloads(texts: list[str | None], words: WordIds, end: bytes) -> list[bytes]:
    get = words.__getitem__
    return [(b"".join(map(get, t.replace("\n", " ").split(" "))) if t else b"") + end for t in texts]


# -- files ---------------------------------------------------------------------

_MANIFEST = "part int, seq int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"


class _Writer:
    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.at, self.docs, self.tokens = fs, path, 0, 0, 0
        self.rec, self.index = fs.open_output_stream(path + ".rec"), []

    def add(self, ids: list[int | None], payloads: list[bytes], width: int) -> None:
        for i, p, r in zip(ids, payloads, frame(payloads), strict=True):
            self.rec.write(r)
            self.index.append((i or 0, i is not None, self.at))
            self.at += len(r)
            self.tokens += len(p) // width
        self.docs += len(ids)

    def close(self) -> None:
        self.rec.close()
        with self.fs.open_output_stream(self.path + ".idx") as f:
            f.write(np.array(self.index, INDEX).tobytes())


def write_records(
    df: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    end_id: int | None = None,
    id_width: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> list[dict]:
    """Tokenize ``df`` and write record files below ``out_dir`` (a URI that all machines reach), in ascending id order.

    Null and empty texts give a record with the end id alone. Repeated ids and rows are all written. An empty table gives no file.
    Returns the manifest in file order: a dict a file, with ``first_doc`` and ``first_token``, the counts of all before it.
    """
    if df.schema[id_col].dataType not in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()):
        raise TypeError("document ids must be whole numbers")
    bound_batches(df.sparkSession)
    pafs.FileSystem.from_uri(out_dir)[0].create_dir(pafs.FileSystem.from_uri(out_dir)[1], recursive=True)
    dtype = f"<u{id_width}"
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # copies of one id, even of one row, spread over ranges: equal rows may come in any order
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    docs = docs.repartitionByRange("id", "h", "row").sortWithinPartitions("id", "h", "text", "row").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        words = tokenizer(local_file(tokenizer_path), dtype)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        w, done = None, []

        def finish(w: _Writer, seq: int) -> None:
            w.close()
            done.append({"part": part, "seq": seq, "file": w.path.rsplit("/", 1)[1], "n_docs": w.docs, "n_tokens": w.tokens, "n_bytes": w.at})

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not ids:
                continue
            w = w or _Writer(fs, f"{root}/{part:06d}-{len(done):04d}-{name}")
            w.add(ids, encode_payloads(texts, words, end), id_width)
            if w.at >= file_bytes:
                finish(w, len(done))
                w = None
        if w:
            finish(w, len(done))
        for d in done:
            yield pa.RecordBatch.from_pylist([d], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    files = sorted((r.asDict() for r in docs.mapInArrow(write, _MANIFEST).collect()), key=lambda r: (r["part"], r["seq"]))
    doc = token = 0
    for f in files:
        f |= {"first_doc": doc, "first_token": token}
        doc, token = doc + f["n_docs"], token + f["n_tokens"]
    return files


def read_file(fs: pafs.FileSystem, path: str, shuffle: int | None = None, group: int = 256) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(index entries, payloads) of a file by groups of records; ``shuffle`` is the seed of another order, read by offsets."""
    with fs.open_input_stream(path + ".idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    size = fs.get_file_info(path + ".rec").size
    ends = np.append(index["offset"][1:], size).astype(np.int64)
    if shuffle is None:
        with fs.open_input_stream(path + ".rec") as f:
            for k in range(0, len(index), group):
                some = slice(k, k + group)
                yield index[some], unframe([f.read(n) for n in (ends[some] - index["offset"][some].astype(np.int64)).tolist()])
        return
    order = list(range(len(index)))
    random.Random(shuffle).shuffle(order)
    with fs.open_input_file(path + ".rec") as f:
        for k in range(0, len(order), group):
            some = order[k : k + group]
            yield index[some], unframe([f.read_at(int(ends[i]) - int(index["offset"][i]), int(index["offset"][i])) for i in some])


def read_records(
    spark: SparkSession,
    out_dir: str,
    files: list[dict],
    id_width: int = 2,
    outputs: tuple[str, ...] = ("ids",),
    shuffle: int | None = None,
) -> DataFrame:
    """Read the files of a manifest back, a task a file, and check every length and checksum.

    Columns: doc_id, start (tokens of all documents before it), n_tokens and those named in ``outputs``: ``ids`` or ``ids_crc32`` (of the ids
    as little-endian unsigned 32-bit numbers). With ``shuffle`` (a seed) files and the records in them come in another order and start is null.
    """
    kinds = {"ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *((k, kinds[k]) for k in outputs)])
    ddl = ", ".join(["doc_id bigint, start bigint, n_tokens bigint", *(f"{k} {'array<int>' if k == 'ids' else 'bigint'}" for k in outputs)])
    listed = [(f["file"], f["first_token"]) for f in files]
    if shuffle is not None:
        random.Random(shuffle).shuffle(listed)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for b in batches:
            for k in b.column(0).to_pylist():
                file, token = listed[k]
                for index, payloads in read_file(fs, f"{root}/{file}", None if shuffle is None else shuffle + k):
                    n = [len(p) // id_width for p in payloads]
                    starts = (token + np.cumsum([0, *n[:-1]])).tolist() if shuffle is None else [None] * len(n)
                    token += sum(n)
                    cols = [[i if known else None for i, known in zip(index["id"].tolist(), index["known"].tolist(), strict=True)], starts, n]
                    ids = [np.frombuffer(p, f"<u{id_width}") for p in payloads]
                    for name in outputs:
                        cols.append([i.astype("<i4") for i in ids] if name == "ids" else [zlib.crc32(i.astype("<u4").tobytes()) for i in ids])
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    if not files:
        return spark.createDataFrame([], ddl)
    return spark.range(0, len(listed), 1, len(listed)).mapInArrow(read, ddl)


def records_of(df: DataFrame, tokenizer_path: str, end_id: int | None, **kw) -> DataFrame:
    """Write ``df`` to a new folder of the shared one and read it back: (doc_id, start, n_tokens, ids_crc32). What was read is kept as a table, the files are deleted."""
    out = work_dir(df.sparkSession, "token-records")
    files = write_records(df, out, tokenizer_path, end_id, **kw)
    got = saved(read_records(df.sparkSession, out, files, kw.get("id_width", 2), ("ids_crc32",)), "records")
    delete(df.sparkSession, out)
    return got
