"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A text is cut where no piece can reach across: in front of every run of the space mark that follows another
character, and in front of line feeds (no piece holds one). Each of these units is encoded by itself and kept in a bounded
table, so that a word that occurs again costs one look-up.

A unit is encoded without a merge queue. An Aho-Corasick automaton lists the pieces that begin at each
position; the encoder takes the longest one that is *compatible* with the piece before it, and steps back when
none is. Two neighbouring pieces are compatible if merging the characters of both from scratch gives back just
these two. A bit for each position says that no compatible tail starts there, so each position fails once.
Units with several space marks in a row are merged plainly: the pieces for runs of space marks share one score,
and only the leftmost rule decides among them, which compatibility of neighbours does not express.

Defined results: null and empty texts give no ids and decode to the empty text. Characters without a piece become
their UTF-8 bytes' pieces where the model has them, else the unknown piece.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
#: A worker keeps the units met last, in two tables of this size; a full one takes the place of the older.
KEPT = 250_000
#: Pairs of pieces kept.
KEPT_PAIRS = 400_000
NEVER = float("inf")
#: Longer units are encoded each time.
LONGEST_KEPT = 64

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
OUTPUTS = {
    "ids": "array<int>",
    "decoded": "string",
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def fields(buf: bytes):
    """(field number, value) of a protobuf message; lengths are bytes, the rest numbers."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = buf[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, struct.unpack_from("<d", buf, at)[0]
            at += 8
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", buf, at)[0]
            at += 4
        elif kind == 2:
            n = varint()
            yield key >> 3, buf[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


class PieceFile:
    """What a model file holds: pieces with scores and kinds, and how texts are normalized."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.byte_fallback = False
        self.dummy_prefix = self.squeeze = self.escape = True
        self.unk_surface = " ⁇ "
        self.model_type = 1
        charsmap = b""
        for n, v in fields(data):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif n == 2:
                t = dict(fields(v))
                self.model_type = t.get(3, 1)
                self.byte_fallback = bool(t.get(35, 0))
                self.unk_surface = t.get(44, self.unk_surface.encode()).decode()
                self.suffix_mark = bool(t.get(24, 0))
            elif n == 3:
                t = dict(fields(v))
                charsmap = t.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(t.get(k, 1)) for k in (3, 4, 5))
        if charsmap or self.squeeze or not self.escape or self.suffix_mark:
            raise ValueError("only models with identity normalization and space marks in front are supported")
        if any(k in (USER_DEFINED, UNUSED) for _, _, k in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")


class PieceEncoder:
    """Exact encoder and decoder of one merge-type model."""

    def __init__(self, data: bytes):
        f = PieceFile(data)
        if f.model_type != 2:
            raise ValueError("not a merge-type model")
        self.prefix = MARK if f.dummy_prefix else ""
        self.unk = next(i for i, p in enumerate(f.pieces) if p[2] == UNKNOWN)
        self.rank = {p: -s for p, s, k in f.pieces if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(f.pieces) if k == BYTE} if f.byte_fallback else {}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece reaches across words")
        self.newline_cuts = not any("\n" in p for p in self.rank)
        self.surface = []
        for p, _, k in f.pieces:
            if k == BYTE:
                self.surface.append(bytes([int(p[3:5], 16)]))
            elif k == CONTROL:
                self.surface.append(b"")
            elif k == UNKNOWN:
                self.surface.append(f.unk_surface.encode())
            else:
                self.surface.append(p.replace(MARK, " ").encode())
        self.byte_ids = set(self.byte_id.values())
        self.control = {i for i, p in enumerate(f.pieces) if p[2] == CONTROL}
        # pieces by number: those of the model first, then characters met that are none
        self.names = list(self.rank)
        self.sizes = list(map(len, self.names))
        self.number = {p: i for i, p in enumerate(self.names)}
        self.ids = [i for i, p in enumerate(f.pieces) if p[2] == NORMAL]
        self.n_pieces = len(self.names)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.names):
            if MARK * 2 in p or self.merge(p) == [p]:  # what merging never reaches is never a piece
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.units = Units(self)
        # texts of pieces from here on need no bytes joined
        self.first_plain = max([*self.byte_ids, *self.control, self.unk]) + 1
        self.plain = [x.decode() if i >= self.first_plain else "" for i, x in enumerate(self.surface)]

    # -- one unit ---------------------------------------------------------

    def merge(self, s: str) -> list[str]:
        """Merge characters plainly: always the pair whose piece scores best, the leftmost of equals."""
        rank, parts = self.rank.get, list(s)
        pairs = [rank(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NEVER)
        return parts

    def merge_long(self, s: str) -> list[str]:
        """The same with a heap, for long runs of space marks."""
        import heapq

        parts: list[str | None] = list(s)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := self.rank.get(p := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, j, p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            offer(left[i], i)
            offer(i, k)
        return [p for p in parts if p is not None]

    def backtrack(self, s: str) -> list[int]:
        """Numbers of the pieces of ``s``: see the module's text."""
        n, names, sizes, fits = len(s), self.names, self.sizes, self.fits
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(s):
            starts[end + 1 - sizes[piece]].append(piece)  # ends ascend, so lengths do
        for i, found in enumerate(starts):
            if not found or sizes[found[0]] != 1:
                found.insert(0, self.lone(s[i]))  # a character without a piece stands for itself
        failed = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []  # for each piece taken, how many shorter ones are left
        at, last, here = 0, -1, starts[0]
        k = len(here)
        while True:
            while k:
                k -= 1
                piece = here[k]
                end = at + sizes[piece]
                if failed[end]:
                    continue
                if last >= 0:
                    ok = fits.get(pair := last << 32 | piece)
                    if ok is None:
                        if len(fits) >= KEPT_PAIRS:
                            fits.clear()
                        a, b = names[last], names[piece]
                        ok = fits[pair] = self.merge(a + b) == [a, b]
                    if not ok:
                        continue
                out.append(piece)
                if end == n:
                    return out
                tried.append(k)
                at, last, here = end, piece, starts[end]
                k = len(here)
                break
            else:
                failed[at] = 1
                at -= sizes[out.pop()]
                k, here, last = tried.pop(), starts[at], out[-1] if out else -1

    def lone(self, c: str) -> int:
        """The number of a character that is no piece."""
        i = self.number.get(c)
        if i is None:
            i = self.number[c] = len(self.names)
            self.names.append(c)
            self.sizes.append(1)
        return i

    def unit_ids(self, unit: str) -> list[int]:
        if not unit:
            return []
        if MARK * 2 in unit:
            numbers = [self.number[p] if p in self.rank else self.lone(p) for p in self.merge_long(unit)]
        else:
            numbers = self.backtrack(unit)
        if max(numbers) < self.n_pieces:
            return [self.ids[i] for i in numbers]
        ids: list[int] = []
        for i in numbers:
            if i < self.n_pieces:
                ids.append(self.ids[i])
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in self.names[i].encode())
            else:
                ids.append(self.unk)
        return ids

    # -- whole texts -------------------------------------------------------

    def unit_keys(self, text: str) -> list[str]:
        """The units of a text: words with one space mark in front have no mark in their key."""
        if not text:
            return []
        if self.newline_cuts and self.prefix and MARK not in text:
            keys = text.replace("\n", " \n").split(" ")
            if "" not in keys and keys[0][0] != "\n":
                return keys
        marked = self.prefix + text.replace(" ", MARK)
        return [u[1:] if u[0] == MARK and u[1:2] not in ("", MARK, "\n") else MARK + u if u[0] == MARK else "\n" + u if u[0] == "\n" else "\r\n" + u for u in _UNITS(marked)]

    def key_unit(self, key: str) -> str:
        if key[0] == "\n":
            return key[1:] if key[1:2] == "\n" else key
        if key[0] == MARK:
            return key[1:]
        if key[:2] == "\r\n":
            return key[2:]
        return MARK + key

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for joined, _ in map(self.units.__getitem__, self.unit_keys(text or "")):
            out.extend(map(int, joined.split(",")))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the mark that encoding puts in front goes, bytes that are no UTF-8 become U+FFFD each."""
        out: list[bytes] = []
        i, n, first = 0, len(ids), bool(self.prefix)
        while i < n:
            if ids[i] in self.byte_ids:
                j = i
                while j < n and ids[j] in self.byte_ids:
                    j += 1
                out.append(_bytes_text(b"".join(self.surface[x] for x in ids[i:j])))
                i, first = j, False
                continue
            s = self.surface[ids[i]]
            if first and ids[i] not in self.control:
                if s[:1] == b" " and ids[i] != self.unk:
                    s = s[1:]
                first = False
            out.append(s)
            i += 1
        return b"".join(out).decode()


#: Space marks with what follows them, cut in front of each further run of marks and in front of line feeds.
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+").findall


def _bytes_text(b: bytes) -> bytes:
    """Well-formed characters as they are; every other byte becomes U+FFFD."""
    try:
        b.decode()
        return b
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(b):
            for k in (1, 2, 3, 4):
                try:
                    out.append(b[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out).encode()


class Units(dict):
    """Unit key -> (its ids in decimal, joined by commas; the text that these ids decode to, with the space in front)."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, tuple[str, str]] = {}

    def __missing__(self, key: str) -> tuple[str, str]:
        got = self.older.get(key) or self.made(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got

    def made(self, key: str) -> tuple[str, str]:
        e = self.encoder
        ids = e.unit_ids(e.key_unit(key))
        if max(ids) >= e.first_plain and min(ids) >= e.first_plain:
            text = "".join([e.plain[i] for i in ids])
        else:
            # the space that decoding takes from the start of a text belongs to this unit here
            text = (" " if e.prefix and e.surface[ids[0]][:1] == b" " else "") + e.decode(ids)
        return ",".join(map(str, ids)), text


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    with open(path, "rb") as f:
        return PieceEncoder(f.read())


def local_file(path: str) -> str:
    """A model's file on this machine: shipped by ``SparkContext.addFile`` if only its name is given."""
    return path if "/" in path else SparkFiles.get(path)


def encode_texts(
    df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """Encode every text of ``df`` and decode the ids again.

    ``model`` is the model's path on every machine, or the name of a file given to ``SparkContext.addFile``.
    ``outputs`` are columns out of OUTPUTS. Rows stay rows: repeated ids and null ids are kept as they are, other
    columns of ``df`` do not matter. A narrow map: no shuffle, one text in memory at a time beside the batch.
    """
    bad = set(outputs) - set(OUTPUTS)
    if bad:
        raise ValueError(f"unknown outputs {sorted(bad)}")
    need_text = bool({"decoded", "decoded_sha256"} & set(outputs))
    id_type = df.schema[id_col].dataType.simpleString()

    def start():
        e = encoder(local_file(model))

        def batch(ids, texts):
            cols: dict[str, list] = {k: [] for k in outputs}
            for text in texts:
                units = list(map(e.units.__getitem__, e.unit_keys(text or "")))
                joined = ",".join([u[0] for u in units])
                if "n_tokens" in cols:
                    cols["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                if "ids" in cols:
                    cols["ids"].append(list(map(int, joined.split(","))) if joined else [])
                if "ids_sha256" in cols:
                    cols["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                if need_text:
                    back = "".join([u[1] for u in units])
                    if e.prefix and back[:1] == " ":
                        back = back[1:]
                    if "decoded" in cols:
                        cols["decoded"].append(back)
                    if "decoded_sha256" in cols:
                        cols["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            return [ids, *cols.values()]

        return batch

    schema = ", ".join([f"`{id_col}` {id_type}", *(f"`{k}` {OUTPUTS[k]}" for k in outputs)])
    return map_rows(df.select(F.col(id_col), F.col(text_col).cast("string")), schema, start)
