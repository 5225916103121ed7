"""Lossless WebP: a decoder of the whole bitstream, an encoder, and text payloads as pixel columns.

The decoder reads prefix codes (simple, length-coded, with groups by region), backward references, the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Of an image with one group of codes the lengths of symbols are looked up for all bits
at once; images with several groups are read symbol by symbol.

Payloads of text: UTF-8 bytes, zeros up to a positive multiple of 64, stored as grey levels (green samples) of images 64 pixels
wide, with transforms, Huffman codes, a colour cache and backward references, also to a line of 24 bytes or more that occurred before. Payloads beyond
64 x 16384 bytes become several images, one file after the other.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections import Counter
from collections.abc import Callable
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
SIGNATURE, LENGTHS, DISTANCES, CACHE_HASH = 0x2F, 24, 40, 0x1E35A7BD
PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
ALPHABETS = (256 + LENGTHS, 256, 256, 256, DISTANCES)  # green, red, blue, alpha, distance

WIDTH, FRAME_BYTES = 64, 64 * 16384


class BadImage(ValueError):
    pass


# -- prefix codes --------------------------------------------------------------


@lru_cache(maxsize=1)
def _reversed() -> np.ndarray:
    """All numbers of 15 bits, their bits in the opposite order."""
    x = np.arange(1 << 15)
    return sum((x >> k & 1) << (14 - k) for k in range(15))


#: Of the 2^15 windows, how many begin with a symbol of so many bits.
SHARES = 1 << np.arange(15, -1, -1)


@lru_cache(maxsize=512)
def _single(symbol: int) -> Code:
    return Code(_row({symbol: 1}, symbol + 1))


def _row(lengths: dict[int, int], size: int) -> np.ndarray:
    row = np.zeros(size, np.uint8)
    row[list(lengths)] = list(lengths.values())
    return row


class Code:
    """A canonical prefix code by the lengths of its symbols, 0 of those it lacks. ``table`` has symbols by the next ``most`` bits, the first of them the highest."""

    def __init__(self, row: np.ndarray):
        self.row = row
        symbols = row.nonzero()[0]
        if not len(symbols):
            raise BadImage("empty code")
        self.only = int(symbols[0]) if len(symbols) == 1 else None
        if self.only is not None:
            self.most, self.n, self.symbols, self.first = 0, np.zeros(1, np.int64), symbols, np.zeros(1, np.int64)
            return
        n = row[symbols]
        order = n.argsort(kind="stable")
        self.n, self.symbols = n[order].astype(np.int64), symbols[order]
        self.share = SHARES[self.n]
        end = self.share.cumsum()
        if end[-1] != 1 << 15:
            raise BadImage("incomplete code")
        self.first = end - self.share
        self.most = int(self.n[-1])

    def by_window(self, x: np.ndarray) -> np.ndarray:
        """What symbols have, by the next ``most`` bits."""
        return x.repeat(self.share >> (15 - self.most)) if self.most else x

    @cached_property
    def table(self) -> np.ndarray:
        return self.by_window(self.symbols)

    @cached_property
    def sizes(self) -> np.ndarray:
        """Bits used, by the same index."""
        return self.by_window(self.n)

    def written(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits, the first of them the lowest, and their number, by symbol."""
        v, n = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        v[self.symbols], n[self.symbols] = _reversed()[self.first], self.n
        return v, n

    @cached_property
    def looks(self) -> tuple[memoryview, memoryview]:
        return memoryview(self.table), memoryview(self.sizes)


#: Bytes with their bits in the opposite order, and the shifts to the eight windows that begin in a byte.
MIRRORED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
SHIFTS = np.arange(9, 1, -1, dtype=np.uint32)[:, None]


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    @cached_property
    def windows(self) -> np.ndarray:
        """The 15 bits from each place on, the first of them the highest; zeros after the end."""
        x = np.frombuffer((self.data + bytes(4)).translate(MIRRORED), np.uint8).astype(np.uint32)
        x = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        x = (x >> SHIFTS).astype(np.uint16)
        x &= 0x7FFF
        return x.T.ravel()

    @cached_property
    def look(self) -> memoryview:
        return memoryview(self.windows)

    def read(self, n: int) -> int:
        if not n:
            return 0
        a = self.at
        if a + n > self.end:
            raise BadImage("data end early")
        self.at = a + n
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        if self.at >= self.end:
            raise BadImage("data end early")
        x = self.look[self.at] >> (15 - code.most)
        table, sizes = code.looks
        self.at += sizes[x]
        if self.at > self.end:
            raise BadImage("data end early")
        return table[x]


@lru_cache(maxsize=4096)
def _short(window: int) -> tuple[Code, int]:
    """A code of one symbol below 256 by the 11 bits that tell it, with their number."""
    if window >> 8 & 1:
        return _single(int(f"{window & 255:08b}"[::-1], 2)), 11
    return _single(window >> 7 & 1), 4


def read_code(b: Bits, size: int) -> Code:
    if b.at + 11 < b.end and (w := b.look[b.at]) >> 13 == 2:
        code, n = _short(w >> 4)
        if code.only >= size:
            raise BadImage("symbol out of range")
        b.at += n
        return code
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        symbols = [b.read(8 if wide else 1)]
        if two:
            symbols.append(b.read(8))
        if max(symbols) >= size:
            raise BadImage("symbol out of range")
        return Code(_row(dict.fromkeys(symbols, 1), size)) if two else _single(symbols[0])
    n = 4 + b.read(4)
    inner = b.read(3 * n)
    table, sizes, most = _inner([(inner >> 3 * k & 7, s) for k, s in enumerate(CODE_LENGTH_ORDER[:n])])
    left = size if not b.read(1) else 2 + b.read(2 + 2 * b.read(3))
    if left > size:
        raise BadImage("too many code lengths")
    row = bytearray(size)
    s, before, at, look, rest = 0, 8, b.at, b.look, 15 - most
    try:
        while s < size and left:
            left -= 1
            w = look[at] >> rest
            x = table[w]
            at += sizes[w]
            if x < 16:
                if x:
                    row[s] = before = x
                s += 1
                continue
            b.at = at
            times = 3 + b.read(2) if x == 16 else 3 + b.read(3) if x == 17 else 11 + b.read(7)
            at = b.at
            if s + times > size:
                raise BadImage("too many code lengths")
            if x == 16:
                row[s : s + times] = bytes((before,)) * times
            s += times
    except IndexError:
        at = b.end + 1
    if at > b.end:
        raise BadImage("data end early")
    b.at = at
    return Code(np.frombuffer(row, np.uint8))


def _inner(lengths: list[tuple[int, int]]) -> tuple[bytes, bytes, int]:
    """The code of code lengths, by (length, symbol): symbols and bits by the next bits, and how many of these."""
    used = sorted(x for x in lengths if x[0])
    if len(used) == 1:
        return bytes((used[0][1],)), b"\0", 0
    most = used[-1][0] if used else 0
    table = b"".join([bytes((x,)) * (1 << (most - n)) for n, x in used])
    if len(table) != 1 << most:
        raise BadImage("incomplete code" if used else "empty code")
    return table, b"".join([bytes((n,)) * (1 << (most - n)) for n, _ in used]), most


# -- decoder -------------------------------------------------------------------


def _spread(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _number(b: Bits, prefix: int) -> int:
    """A length or distance by its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + b.read(extra) + 1


def read_pixels(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as unsigned 32-bit ARGB."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise BadImage("colour cache too large")
    groups, region, region_bits = 1, None, 0
    if main and b.read(1):
        region_bits = 2 + b.read(3)
        region = read_pixels(b, _spread(width, region_bits), _spread(height, region_bits), False) >> 8 & 0xFFFF
        groups = int(region.max()) + 1
    codes = [[read_code(b, n + ((1 << cache_bits) if cache_bits and not k else 0)) for k, n in enumerate(ALPHABETS)] for _ in range(groups)]
    n = width * height
    out = np.zeros(n, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    if groups == 1 and n >= 128 and (codes[0][0].only is None or all(c.only is not None for c in codes[0][:4]) and codes[0][0].only < 256):
        return _of_one_group(b, codes[0], width, n, cache_bits)
    at = cached = 0

    def remember(upto: int) -> None:
        nonlocal cached
        for v in out[cached:upto].tolist():
            cache[(CACHE_HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        cached = upto

    while at < n:
        g = codes[0] if region is None else codes[int(region[(at // width >> region_bits) * _spread(width, region_bits) + (at % width >> region_bits)])]
        s = b.symbol(g[0])
        if s < 256:
            r, bl, a = b.symbol(g[1]), b.symbol(g[2]), b.symbol(g[3])
            out[at] = a << 24 | r << 16 | s << 8 | bl
            at += 1
        elif s < 256 + LENGTHS:
            length = _number(b, s - 256)
            d = _number(b, b.symbol(g[4]))
            d = d - 120 if d > 120 else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)
            if d > at or at + length > n:
                raise BadImage("reference out of range")
            if d >= length:
                out[at : at + length] = out[at - d : at - d + length]
            else:
                out[at : at + length] = np.resize(out[at - d : at], length)
            at += length
        else:
            remember(at)
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
    return out


def _of_one_group(b: Bits, codes: list[Code], width: int, n: int, cache_bits: int) -> np.ndarray:
    """Pixels by one group of codes: how long a symbol is is looked up for all places of the data at once, then symbols are followed, four at a time."""
    green, *rest = codes[:4]
    base = b.at
    if green.only is not None:
        return np.full(n, rest[2].only << 24 | rest[0].only << 16 | green.only << 8 | rest[1].only, np.uint32)
    refer = any(green.row[256 : 256 + LENGTHS].tobytes())
    longest = max(sum(c.most for c in codes[:4]), green.most + codes[4].most + 40 if refer else 0)
    win = b.windows[base : base + n * longest + 16]
    end = len(win) - 1
    if end < 1:
        raise BadImage("data end early")
    look = (win >> (15 - green.most)).astype(np.int64)
    # references and the end are stops
    places = np.arange(len(win))
    own = (green.by_window(np.where((green.symbols >= 256) & (green.symbols < 256 + LENGTHS), 0, green.n)) if refer else green.sizes).take(look, mode="clip")
    follow = own + places
    if many := [c for c in rest if c.only is None]:
        pixel = follow
        for c in many:
            size = c.sizes.take((win >> (15 - c.most)).astype(np.int64), mode="clip")
            pixel = pixel + size.take(pixel, mode="clip")
        # references and entries of the cache have no other channels
        if cache_bits:
            pixel = np.where((green.table < 256)[look], pixel, follow)
        elif refer:
            stops = (own == 0).nonzero()[0]
            pixel[stops] = stops
        follow = pixel
    near_end = follow[-64:]  # a pixel has 60 bits at most
    np.minimum(near_end, end, out=near_end)
    two = follow.take(follow, mode="clip")
    four = two.take(two, mode="clip")
    ahead = memoryview(four.take(four, mode="clip"))
    steps: list[int] = []
    upto: list[int] = []
    runs: list[int] = []
    found: list[tuple[int, int]] = []
    p, left = 0, n
    while left > 0:
        first = len(steps)
        for _ in range(left // 8 + 2):
            steps.append(p)
            q = ahead[p]
            if q == p:
                break
            p = q
        else:
            p = end
        runs.append(len(steps) - first)
        upto.append(p)
        left -= 8 * max(0, len(steps) - first - 2)
        if p == end:
            break
        b.at = base + p
        try:
            length = _number(b, b.symbol(green) - 256)
            d = _number(b, b.symbol(codes[4]))
        except BadImage:  # behind the image, or the pixels will be too few
            break
        found.append((length, d - 120 if d > 120 else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)))
        left -= length
        p = b.at - base
        if p >= end:
            break
    row = np.empty((len(steps), 8), np.int64)
    row[:, 0] = steps
    row[:, 4] = four.take(row[:, 0])
    row[:, 2::4] = two.take(row[:, ::4])
    row[:, 1::2] = follow.take(row[:, ::2])
    refs, total = [], 0  # references: literals and cached pixels before, length, distance
    if found:
        real = (row < np.repeat(upto, runs)[:, None]).ravel().nonzero()[0]
        ends = real.searchsorted([8 * k for k in accumulate(runs)]).tolist()
        starts = row.ravel().take(real)
    else:
        ends, starts = [], row.ravel()[:n]
        starts = starts[: int(starts.searchsorted(upto[0]))]
    for k, (length, d) in zip(ends, found, strict=False):
        if k + total >= n:
            break
        if d > k + total or k + total + length > n:
            raise BadImage("reference out of range")
        refs.append((k, length, d))
        total += length
    if len(starts) < n - total:
        raise BadImage("data end early")
    last = len(refs) and refs[-1][0] == n - total
    starts = starts[: n - total]
    b.at = base + (_behind(b, base + upto[len(refs) - 1], green, codes[4]) - base if last else int(follow[starts[-1]]))
    if b.at > b.end:
        raise BadImage("data end early")
    x = look.take(starts)
    sym = green.table.take(x)
    value = sym.astype(np.uint32) << 8
    steady = rest[0].only, rest[1].only, rest[2].only
    value |= np.uint32((steady[0] or 0) << 16 | (steady[1] or 0) | (steady[2] or 0) << 24)
    if many:
        at = starts + green.sizes.take(x)
        for c, shift in zip(rest, (16, 0, 24), strict=True):
            if c.only is None:
                x = win.take(at, mode="clip") >> (15 - c.most)
                value |= c.table.take(x).astype(np.uint32) << shift
                at += c.sizes.take(x)
    if not cache_bits or not (cached := sym >= 256 + LENGTHS).any():
        return _copied(value, refs, n)
    # a cached pixel is the last before it with its key that is not cached itself
    kind = np.uint8 if cache_bits <= 8 else np.uint16
    key = _copied(np.where(cached, sym - (256 + LENGTHS), _key(value, cache_bits)).astype(kind), refs, n)
    pixels = np.zeros(n + 1, np.uint32)
    to = np.arange(n + 1)
    if refs:
        fresh = np.ones(n, bool)
        gone = 0
        for k, length, d in refs:
            a = k + gone
            fresh[a : a + length] = False
            to[a : a + length] -= d
            gone += length
        spots = fresh.nonzero()[0]
        pixels[spots] = value
        still = np.zeros(n, bool)
        still[spots] = cached
    else:
        pixels[:n], still = value, cached
    order = key.argsort(kind="stable")
    held = ~still[order]
    source = np.maximum.accumulate(np.where(held, np.arange(n), 0))
    key = key[order]
    there = held[source] & (key[source] == key)
    lost = ~held
    to[order[lost]] = np.where(there, order[source], n)[lost]
    pixels[n] = 0
    if refs:
        loose = (to.take(to) != to).nonzero()[0]
        while len(loose):
            further = to.take(to.take(loose))
            to[loose] = further
            loose = loose[to.take(further) != further]
    return pixels.take(to[:n])


def _behind(b: Bits, at: int, green: Code, distance: Code) -> int:
    """Where the reference that begins at ``at`` ends."""
    b.at = at
    _number(b, b.symbol(green) - 256)
    _number(b, b.symbol(distance))
    return b.at


def _key(argb: np.ndarray, bits: int) -> np.ndarray:
    return (np.asarray(argb, np.uint32) * np.uint32(CACHE_HASH)) >> np.uint32(32 - bits)


def _copied(value: np.ndarray, refs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Values with the references between them carried out."""
    if not refs:
        return value
    out = np.zeros(n, value.dtype)
    at = done = 0
    for k, length, d in refs:
        out[at : at + k - done] = value[done:k]
        at, done = at + k - done, k
        end = at + length
        while d < end - at:  # what is copied doubles
            out[at : at + d] = out[at - d : at]
            at, d = at + d, 2 * d
        out[at:end] = out[at - d : end - d]
        at = end
    out[at:] = value[done:]
    return out


def _split(argb: np.ndarray) -> np.ndarray:
    """(..., 4) channels alpha, red, green, blue."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)[..., ::-1].astype(np.int16)


def _join(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint8)[..., ::-1].copy().view("<u4")[..., 0].astype(np.uint32, copy=False)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int16)


def predicted(mode: int, left, top, top_right, top_left):
    """The prediction of one pixel from its neighbours' channels."""
    mean = lambda x, y: (x + y) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return mean(mean(left, top_right), top)
        case 6:
            return mean(left, top_left)
        case 7:
            return mean(left, top)
        case 8:
            return mean(top_left, top)
        case 9:
            return mean(top, top_right)
        case 10:
            return mean(mean(left, top_left), mean(top, top_right))
        case 11:
            from_left, from_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
            return np.where(from_left < from_top, left, top)
        case 12:
            return np.clip(left + top - top_left, 0, 255)
        case 13:
            a = mean(left, top)
            d = a - top_left
            return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return np.broadcast_to([255, 0, 0, 0], np.shape(left))


def _predict(img: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Add (or, forward, take off) the predictions of an image of channels."""
    h, w = img.shape[:2]
    if not forward:
        return _unpredict(img, _modes(modes, bits, h, w))
    one = img.shape[2] == 1  # green alone: red and blue are 0, alpha 255
    flat = np.ascontiguousarray(img).reshape(-1, img.shape[2])
    out = flat.copy()
    grid = out.reshape(img.shape)
    if h > 1 and w > 1:
        most, others = int(modes[0, 0]), []
        if modes.size > 1:
            mode = _modes(modes, bits, h, w)
            share = np.bincount(mode[1:, 1:].ravel())
            most = int(share.argmax())
            mode[0] = mode[:, 0] = most
            share[most] = 0
            others = share.nonzero()[0].tolist()
        # the most frequent one as if everywhere
        first, end = w + 1, len(flat)
        if most or not one:
            out[first:] -= predicted(most, *(flat[first - d : end - d] for d in (1, w, w - 1, w + 1)))
        for m in others:
            i = (mode.ravel() == m).nonzero()[0]
            out[i] = flat[i] - (0 if one and not m else predicted(m, *(flat[i - d] for d in (1, w, w - 1, w + 1))))
    # first row and column
    grid[0, 1:] = img[0, 1:] - img[0, :-1]
    grid[1:, 0] = img[1:, 0] - img[:-1, 0]
    grid[0, 0] = img[0, 0] - (0 if one else predicted(0, img[0, 0], None, None, None))
    out &= 255
    return grid


def _modes(modes: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    """The predictor of each pixel: those of the first row and column are fixed."""
    mode = np.full((h, w), modes[0, 0], np.int64) if modes.size == 1 else modes.repeat(1 << bits, 0)[:h].repeat(1 << bits, 1)[:, :w].astype(np.int64)
    mode[0], mode[1:, 0], mode[0, 0] = 1, 2, 0
    return mode


def _unpredict(img: np.ndarray, mode: np.ndarray) -> np.ndarray:
    h, w = mode.shape
    out = img.reshape(-1, img.shape[-1]).copy()
    for i, m in enumerate(mode.ravel().tolist()):
        out[i] = (out[i] + predicted(m, *(out[max(i - d, 0)] for d in (1, w, w - 1, w + 1)))) & 255
    return out.reshape(img.shape)


#: Values cut to a byte, from -255 on at the end; halves towards 0, from -255 on at the end.
CLIPPED = [*range(256), *[255] * 255, *[0] * 255]
HALVES = [*(x >> 1 for x in range(256)), *(-(x >> 1) for x in range(255, 0, -1))]


def _unpredict_one(img: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """The same where only green differs from its prediction: red and blue stay 0, alpha 255."""
    h, w = mode.shape
    out = bytearray(img.tobytes())  # at first what predictions left over
    cell = np.frombuffer(out, np.uint8)
    grid = cell.reshape(h, w)
    add = np.add
    add.accumulate(grid[0], out=grid[0])
    add.accumulate(grid[:, 0], out=grid[:, 0])
    if h == 1 or w == 1:
        return grid
    cuts = np.zeros((h, w), bool)
    cuts[1:, 1] = True
    if (mode[1:, 1:] != mode[1, 1]).any():
        cuts[1:, 2:] = mode[1:, 2:] != mode[1:, 1:-1]
    cuts = cuts.ravel().nonzero()[0]
    starts = cuts.tolist()
    for s, n, m in zip(starts, [*starts[1:], h * w + 1], mode.ravel()[cuts].tolist(), strict=True):
        e = min(n, s - s % w + w)
        if m == 0 or m > 13:
            continue
        if m == 1:
            add.accumulate(cell[s - 1 : e], out=cell[s - 1 : e])
        elif m < 5:
            d = (w, w - 1, w + 1)[m - 2]
            add(cell[s:e], cell[s - d : e - d], out=cell[s:e])
        elif m in (8, 9):
            d = w + 1 if m == 8 else w - 1
            mean = add(cell[s - w : e - w], cell[s - d : e - d], dtype=np.uint16)
            mean >>= 1
            add(cell[s:e], mean, out=cell[s:e], casting="unsafe")
        else:
            x, rest, top, corner = out[s - 1], out[s:e], out[s - w : e - w], out[s - w - 1 : e - w - 1]
            match m:
                case 5:
                    got = [x := r + ((x + c >> 1) + t >> 1) & 255 for r, t, c in zip(rest, top, out[s - w + 1 : e - w + 1], strict=True)]
                case 6:
                    got = [x := r + (x + c >> 1) & 255 for r, c in zip(rest, corner, strict=True)]
                case 7:
                    got = [x := r + (x + t >> 1) & 255 for r, t in zip(rest, top, strict=True)]
                case 10:
                    means = add(cell[s - w : e - w], cell[s - w + 1 : e - w + 1], dtype=np.uint16)
                    means >>= 1
                    got = [x := r + ((x + c >> 1) + t >> 1) & 255 for r, t, c in zip(rest, means.tolist(), corner, strict=True)]
                case 11:
                    steps = np.abs(np.subtract(cell[s - w : e - w], cell[s - w - 1 : e - w - 1], dtype=np.int16)).tolist()
                    got = [x := r + (x if d < (x - c if x > c else c - x) else t) & 255 for r, t, c, d in zip(rest, top, corner, steps, strict=True)]
                case 12:
                    got = [x := r + CLIPPED[x + t - c] & 255 for r, t, c in zip(rest, top, corner, strict=True)]
                case _:
                    got = [x := r + CLIPPED[(a := x + t >> 1) + HALVES[a - c]] & 255 for r, t, c in zip(rest, top, corner, strict=True)]
            out[s:e] = bytes(got)
    return grid


def _cross(img: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    h, w = img.shape[:2]
    if (elements == elements[0, 0]).all():
        e = elements[0, 0]
    else:
        e = elements.repeat(1 << bits, 0)[:h].repeat(1 << bits, 1)[:, :w]
    delta = lambda t, c: _signed(t) * c >> 5
    out, green = img.copy(), _signed(img[..., 2])
    change = np.subtract if forward else np.add
    out[..., 1] = change(img[..., 1], delta(e[..., 3], green)) & 255
    whole = img[..., 1] if forward else out[..., 1]
    out[..., 3] = change(img[..., 3], delta(e[..., 2], green) + delta(e[..., 1], _signed(whole))) & 255
    return out


def decode_frame(data: bytes) -> np.ndarray:
    """One lossless WebP file as an array (height, width) of ARGB."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise BadImage("no lossless WebP file")
    b = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if b.read(8) != SIGNATURE:
        raise BadImage("wrong signature")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise BadImage("unknown version")
    undo: list[tuple] = []
    w = width
    while b.read(1):
        kind = b.read(2)
        if any(k == kind for k, *_ in undo):
            raise BadImage("transform given twice")
        if kind in (PREDICTOR, CROSS):
            bits = 2 + b.read(3)
            side = (_spread(height, bits), _spread(w, bits))
            undo.append((kind, w, bits, _split(read_pixels(b, side[1], side[0], False).reshape(side))))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, w))
        else:
            n = b.read(8) + 1
            colours = _join(np.cumsum(_split(read_pixels(b, n, 1, False)), 0))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, w, bits, colours))
            w = _spread(w, bits)
    img, c = read_pixels(b, w, height, True).reshape(height, w), None
    for kind, w, *rest in reversed(undo):
        if c is not None and kind in (PALETTE, PREDICTOR):
            img, c = _join(c), None
        if kind == PALETTE:
            bits, colours = rest
            index = img >> 8 & 255
            if bits:
                each = 8 >> bits
                index = (index[..., None] >> (each * np.arange(1 << bits)) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            table = np.zeros(256, np.uint32)
            table[: len(colours)] = colours
            img = table[index]
            continue
        if kind == PREDICTOR and not (img & 0xFFFF00FF).any():
            img = _unpredict_one((img >> 8).astype(np.uint8), _modes(rest[1][..., 2], rest[0], height, w)).astype(np.uint32) << 8 | np.uint32(0xFF000000)
            continue
        if c is None:
            c = _split(img)
        if kind == SUBTRACT_GREEN:
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            c &= 255
        elif kind == CROSS:
            c = _cross(c, rest[1], rest[0], False)
        else:
            c = _predict(c, rest[1][..., 2], rest[0], False)
    return img if c is None else _join(c)


def frames(data: bytes) -> list[bytes]:
    """The files in a byte string that holds one after the other."""
    out, at = [], 0
    while at < len(data):
        n = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        out.append(data[at : at + n])
        at += n + (n & 1)
    return out


# -- encoder -------------------------------------------------------------------


@lru_cache(maxsize=1)
def _below() -> np.ndarray:
    """Row n marks the first n of 16."""
    return np.arange(16) < np.arange(17)[:, None]


class Sink:
    """Collects bits, lowest first."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def many(self, v: np.ndarray, n: np.ndarray) -> None:
        """Values of n bits each, 60 at most."""
        widest = int(n.max())
        if widest <= 16 and v.dtype == "<u8":
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8)[:, :2], axis=1, bitorder="little")
            bits = bits[_below().take(n.astype(np.int64), 0)]
            self.put(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), len(bits))
            return
        while widest <= 30 and len(v) > 1:
            # two neighbours are one value
            if len(v) & 1:
                v, n = np.append(v, np.uint64(0)), np.append(n, np.uint64(0))
            v, n, widest = v[::2] | v[1::2] << n[::2], n[::2] + n[1::2], 2 * widest
        end = n.cumsum()
        at = end - n
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        words = np.zeros(int(end[-1]) // 64 + 2, np.uint64)
        first = np.concatenate([[0], (word[1:] != word[:-1]).nonzero()[0] + 1])
        words[word[first]] = np.add.reduceat(v << shift, first)
        over = (shift + n > 64).nonzero()[0]
        words[word[over] + 1] += v[over] >> (np.uint64(64) - shift[over])
        self.put(int.from_bytes(words.astype("<u8", copy=False).tobytes(), "little"), int(end[-1]))

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) >> 3, "little")


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a Huffman code, at most ``most``, for symbols with so many uses. Of equal weights leaves come first, then what was joined first."""
    n = len(counts)
    if n == 1:
        return [1]
    floor, none = 1, 1 << 62
    while True:
        weights = counts if floor == 1 else [max(x, floor) for x in counts]
        order = sorted(range(n), key=weights.__getitem__)
        # leaves and joined nodes both come by weight: the two lightest are at the heads
        leaf, joined = [weights[k] for k in order], [none] * n
        leaf += (none, none)
        leaf_up, up = [0] * n, [0] * n
        i = j = 0
        for k in range(n - 1):
            x, y = leaf[i], joined[j]
            if x <= y:
                leaf_up[i] = k
                i += 1
            else:
                x = y
                up[j] = k
                j += 1
            y, z = leaf[i], joined[j]
            if y <= z:
                leaf_up[i] = k
                i += 1
            else:
                y = z
                up[j] = k
                j += 1
            joined[k] = x + y
        depth = [1] * n
        for k in range(n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if depth[leaf_up[0]] <= most:  # the lightest is the deepest
            out = [0] * n
            for k, x in zip(order, leaf_up, strict=True):
                out[k] = depth[x]
            return out
        floor *= 2


#: Bits of a count by the symbol of a repetition.
EXTRA = {16: 2, 17: 3, 18: 7}


def put_code(s: Sink, symbols: list[int], counts: list[int], size: int) -> Code:
    """The Huffman code of the symbols (ascending) with so many uses."""
    if len(symbols) == 1 and (only := symbols[0]) < 256:
        s.put(1 | (4 | only << 3 if only > 1 else only << 3), 11 if only > 1 else 4)
        return _single(only)
    lengths = code_lengths(counts, 15)
    if len(symbols) == 2 and symbols[1] < 256:
        wide = symbols[0] > 1
        s.put(3 | wide << 2, 3)
        s.put(symbols[0], 8 if wide else 1)
        s.put(symbols[1], 8)
        return Code(_row(dict.fromkeys(symbols, 1), size))
    out: list[int] = []  # symbol, from bit 5 on how often it stands
    row = np.zeros(size, np.uint8)
    row[symbols] = lengths
    turns = [0, *((row[1:] != row[:-1]).nonzero()[0] + 1).tolist()]
    before = 8
    for n, k, end in zip(row[turns].tolist(), turns, [*turns[1:], size], strict=True):
        run = end - k
        if n and n != before:
            out.append(n)
            if run == 1:
                before = n
                continue
            before, run = n, run - 1
        while run >= 3:
            if n:
                m = run if run < 6 else 6
                out.append(16 | (m - 3) << 5)
            elif run <= 10:
                m = run
                out.append(17 | (m - 3) << 5)
            else:
                m = run if run < 138 else 138
                out.append(18 | (m - 11) << 5)
            run -= m
        if run:
            out += [n] * run
    uses = [0] * 19
    parts = Counter(out)
    for x, n in parts.items():
        uses[x & 31] += n
    used = [x for x in range(19) if uses[x]]
    inner = [0] * 19
    for x, n in zip(used, code_lengths([uses[x] for x in used], 7), strict=True):
        inner[x] = n
    last = max(i for i, x in enumerate(CODE_LENGTH_ORDER) if inner[x])
    v = max(0, last - 3) << 1
    at = 5
    for x in CODE_LENGTH_ORDER[: max(4, last + 1)]:
        v |= inner[x] << at
        at += 3
    s.put(v, at + 1)
    bits, first = [""] * 19, 0
    for n, x in sorted((inner[x], x) for x in used):
        if len(used) > 1:
            bits[x] = f"{first:015b}"[:n]
        first += 1 << (15 - n)
    # the first bit is the last of the number
    for x in parts:
        k = x & 31
        parts[x] = bits[k] + f"{x >> 5:0{EXTRA[k]}b}"[::-1] if k > 15 else bits[k]
    text = "".join([parts[x] for x in out])
    s.put(int(text[::-1] or "0", 2), len(text))
    return Code(row)


def _prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and its bits of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


@lru_cache(maxsize=4096)
def _far(d: int, width: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and its bits of the distance ``d``."""
    return _prefix(next((k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d), d + 120))


def _references(pixels: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs of four pixels or more that repeat the pixel or the row before."""
    n = len(pixels)
    runs: list[tuple[int, int, int, int]] = []  # end, start, distance by preference, distance
    for k, d in enumerate((1, width, width + 1, 2 * width + 7)):
        if d + 4 > n:
            continue
        equal = (pixels[d:] == pixels[:-d]).tobytes()
        at = equal.find(FOUR)
        while at >= 0:
            end = equal.find(b"\0", at)
            end = end if end >= 0 else n - d
            runs.append((at + d, end + d, k, d))
            at = equal.find(FOUR, end)
    runs.sort()
    out, at, first = [], 0, 0
    while first < len(runs):
        # the first place from here on that a run of four or more covers, and the longest run there
        while first < len(runs) and runs[first][1] - 4 < at:
            first += 1
        if first == len(runs):
            break
        i, best = max(at, runs[first][0]), (0, 0, 0)
        for j in range(first, len(runs)):
            start, end, k, d = runs[j]
            if start > i:
                break
            if end - 4 >= i and (m := (min(end - i, 4096), k, d)) > best:
                best = m
        out.append((i, best[0], best[2]))
        at = i + best[0]
    return out


#: Four equal pixels in a comparison.
FOUR = b"\1\1\1\1"


def put_pixels(s: Sink, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool | list[tuple[int, int, int]] = False, regions: np.ndarray | None = None, region_bits: int = 2) -> None:
    """An entropy-coded image with Huffman codes; with references, runs that repeat the pixel or the row before, or those that are given as (start, length, distance), become such."""
    pixels = np.asarray(argb, np.uint32)
    refs = _references(pixels, width) if references is True else references or []
    at, far, value = None, [], pixels  # where symbols begin, if not at every pixel; references among them
    if refs:
        start = np.ones(len(pixels), bool)
        for k, n, _ in refs:
            start[k + 1 : k + n] = False
        at = start.nonzero()[0]
        far = at.searchsorted([r[0] for r in refs])
        value = pixels[at]
    differ = int(np.bitwise_or.reduce(value ^ value[0]))
    steady = [not differ >> k & 255 for k in (8, 16, 0, 24)]
    channels = [(value >> k & 255).astype(np.int64) if k == 8 or not same else int(value[0]) >> k & 255 for k, same in zip((8, 16, 0, 24), steady, strict=True)]
    literal = None  # if not all are
    if cache_bits:
        # a pixel is in the cache if the last before it with its key is equal
        key = _key(pixels, cache_bits).astype(np.uint8 if cache_bits <= 8 else np.uint16)
        order = key.argsort(kind="stable")
        hit = np.zeros(len(pixels), bool)
        by_key, by_pixel = key[order], pixels[order]
        hit[order[1:]] = (by_key[1:] == by_key[:-1]) & (by_pixel[1:] == by_pixel[:-1])
        if refs:
            hit, key = hit[at], key[at]
        literal = ~hit
        channels[0] = np.where(hit, key + np.int64(256 + LENGTHS), channels[0])
    lengths, distances = [_prefix(n) for _, n, _ in refs], [_far(d, width) for _, _, d in refs]
    if refs:
        if literal is None:
            literal = np.ones(len(at), bool)
        literal[far] = False
        channels[0][far] = [256 + x for x, _, _ in lengths]
    s.put(bool(cache_bits), 1)
    if cache_bits:
        s.put(cache_bits, 4)
    group, groups = None, 1
    if main:
        s.put(regions is not None, 1)
        if regions is not None:
            places = np.arange(len(pixels)) if at is None else at
            group = np.asarray(regions)[places // width >> region_bits, places % width >> region_bits].astype(np.int64)
            groups = int(group.max()) + 1
            s.put(region_bits - 2, 3)
            put_pixels(s, (regions.astype(np.uint32) << 8).ravel(), regions.shape[1], False)
    v, m = np.zeros(len(value), np.uint64), np.zeros(len(value), np.uint64)
    everywhere = slice(None)

    def append(i: np.ndarray | slice, bits: np.ndarray, n: np.ndarray) -> None:
        v[i] |= bits << m[i]
        m[i] += n

    distance = np.array([x for x, _, _ in distances], np.int64)
    number = lambda rows, k: np.array([r[k] for r in rows], np.uint64)
    for gi in range(groups):
        mine = everywhere if groups == 1 else (group == gi).nonzero()[0]
        plain = mine if literal is None else literal.nonzero()[0] if groups == 1 else mine[literal[mine]]
        there = range(len(far)) if groups == 1 else (group[far] == gi).nonzero()[0]
        for k, (i, x, size) in enumerate(zip((mine, plain, plain, plain, None), (*channels, distance), ALPHABETS, strict=True)):
            if not k:
                size += (1 << cache_bits) if cache_bits else 0
            elif k < 4 and steady[k]:
                put_code(s, [x if plain is everywhere or len(plain) else 0], [1], size)
                continue
            elif k == 4:
                i = far[there] if len(there) else far
                x = x[there] if len(there) else x[:0]
            if k < 4 and i is not everywhere:
                x = x[i]
            if 0 < k < 4 and not len(x):
                put_code(s, [0], [1], size)
                continue
            counts = np.bincount(x, minlength=1)
            some = counts.nonzero()[0]
            code = put_code(s, some.tolist() or [0], counts[some].tolist() or [1], size)
            if k == 4 and len(there):
                append(i, number([lengths[j] for j in there], 1), number([lengths[j] for j in there], 2))
            if code.only is None:
                bits, n = code.written(size)
                if k:
                    append(i, bits[x], n[x])
                else:
                    v[i], m[i] = bits[x], n[x]
        if len(there):
            i = far[there]
            append(i, number([distances[j] for j in there], 1), number([distances[j] for j in there], 2))
    if m.any():
        s.many(v, m)


@lru_cache(maxsize=4096)
def _side(pixels: bytes, width: int) -> tuple[int, int]:
    """Bits of an image that a transform needs: many files have the same."""
    s = Sink()
    put_pixels(s, np.frombuffer(pixels, np.uint32), width, False)
    return s.value, s.n


def _file(body: bytes) -> bytes:
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _head(s: Sink, width: int, height: int, alpha: bool) -> None:
    s.put(SIGNATURE, 8)
    s.put(width - 1, 14)
    s.put(height - 1, 14)
    s.put(alpha, 1)
    s.put(0, 3)


def encode_frame(argb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool | list = False, regions: np.ndarray | None = None, region_bits: int = 2) -> bytes:
    """A lossless WebP file of an array (height, width) of ARGB.

    ``transforms`` in the order they are applied: ("predictor", bits, modes), ("cross", bits, elements as (rows, columns, 4)), ("subtract",), ("palette",).
    """
    s = Sink()
    height, w = argb.shape
    _head(s, w, height, bool((argb >> 24 != 255).any()))
    img = argb.astype(np.uint32)
    for kind, *args in transforms:
        s.put(1, 1)
        if kind == "palette":
            level = (img >> 8 & 255).astype(np.uint8)
            if (img == (level.astype(np.uint32) << 8 | np.uint32(0xFF000000))).all():
                present = np.bincount(level.ravel(), minlength=256) > 0
                colours, index = np.flatnonzero(present).astype(np.uint32) << 8 | np.uint32(0xFF000000), (np.cumsum(present) - 1)[level]
            else:
                colours, index = np.unique(img, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            index = index.reshape(height, w)
            bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            s.put(PALETTE, 2)
            s.put(len(colours) - 1, 8)
            s.put(*_side(_join(np.diff(_split(colours), axis=0, prepend=0)).tobytes(), len(colours)))
            w = _spread(w, bits)
            if bits:
                index = np.pad(index, ((0, 0), (0, (w << bits) - index.shape[1]))).reshape(height, w, 1 << bits)
                index = (index << ((8 >> bits) * np.arange(1 << bits))).sum(-1)
            img = (index.astype(np.uint32) << 8) | np.uint32(0xFF000000)
            continue
        if kind == "predictor" and not ((img & 0xFFFF00FF) ^ 0xFF000000).any():
            c = (img[..., None] >> 8 & 255).astype(np.int16)
        else:
            c = _split(img)
        if kind == "subtract":
            s.put(SUBTRACT_GREEN, 2)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
        else:
            bits, data = args
            s.put(PREDICTOR if kind == "predictor" else CROSS, 2)
            s.put(bits - 2, 3)
            side = np.asarray(data, np.uint32)
            side = (side << 8) | np.uint32(0xFF000000) if kind == "predictor" else _join(side)
            s.put(*_side(side.tobytes(), side.shape[1]))
            c = _predict(c, np.asarray(data), bits, True) if kind == "predictor" else _cross(c, np.asarray(data), bits, True)
        img = _join(c) if c.shape[2] == 4 else c[..., 0].astype(np.uint32) << 8
    s.put(0, 1)
    put_pixels(s, img.ravel(), w, True, cache_bits, references, regions, region_bits)
    return _file(s.bytes())


# -- text payloads -------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 with zeros up to a positive multiple of 64, bytes without them)."""
    raw = (text or "").encode()
    return raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw)), len(raw)


def _repeats(payload: bytes) -> list[tuple[int, int, int]]:
    """(start, length, distance) of lines that occurred before in the payload."""
    if payload.count(b"\n") < 2:
        return []
    seen: dict[bytes, int] = {}
    out, at = [], 0
    for line in payload.split(b"\n"):
        if len(line) >= 24:
            before = seen.get(line)
            if before is not None:
                for k in range(0, len(line), 4096):
                    out.append((at + k, min(4096, len(line) - k), at - before))
            seen[line] = at
        at += len(line) + 1
    return out


#: Every file is written in one of these ways, chosen by a checksum of its bytes, all with prefix codes of unequal lengths and references:
#: stored media hold every part of the format that the decoder knows.
STYLES = ("predictor", "cross", "cache", "palette")
STYLED = len(STYLES)


def styled(payload: bytes, style: str, lines: list[tuple[int, int, int]] | None = None) -> bytes:
    """Bytes, a multiple of 64, as one file with prefix codes of unequal lengths and a transform, or with references and a colour cache.

    With ``lines``, (start, length, distance) of what occurred before, all styles have references.
    """
    img = (np.frombuffer(payload, np.uint8).astype(np.uint32).reshape(-1, WIDTH) << 8) | np.uint32(0xFF000000)
    tiles = lambda bits: (-(-len(img) >> bits), -(-WIDTH >> bits))
    refer = lines is not None
    if style == "predictor":
        bits, at = (6, zlib.crc32(payload) // STYLED) if refer else (4, 0)
        rows, columns = tiles(bits)
        # equal lines need not have equal predictions
        return encode_frame(img, (("predictor", bits, (at + np.arange(rows * columns).reshape(rows, columns)) % 14),), references=refer)
    if style == "cross":
        return encode_frame(img, (("cross", 5, np.full((*tiles(5), 4), 32)), ("subtract",)), references=lines or refer)
    if style == "cache":
        return encode_frame(img, (), 6, lines or True)
    # a palette of 16 colours or fewer joins pixels
    return encode_frame(img, (("palette",),), 4, lines if lines and len(set(payload)) > 16 else True)


def encode_bytes(payload: bytes) -> bytes:
    """Bytes, a multiple of 64, as lossless WebP: one file for each 64 x 16384 of them."""
    if len(payload) > FRAME_BYTES:
        return b"".join(encode_bytes(payload[k : k + FRAME_BYTES]) for k in range(0, len(payload), FRAME_BYTES))
    return styled(payload, STYLES[zlib.crc32(payload) % STYLED], _repeats(payload))


def decode_bytes(media: bytes) -> bytes:
    """The green samples of all files in ``media``, row by row."""
    return b"".join((decode_frame(f) >> 8 & 255).astype(np.uint8).tobytes() for f in frames(media))


def feature_of(samples: bytes) -> str:
    """64 bits in hex: which of 64 equal stretches of the samples are lighter than their mean."""
    means = np.frombuffer(samples, np.uint8).reshape(64, -1).sum(1, dtype=np.int64)
    return np.packbits(64 * means > means.sum()).tobytes().hex()


def _hold_memory() -> None:
    """Let the C library keep what arrays of some hundred kB give back until the task ends: new pages for each of them cost more than the work on them."""
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)  # not every C library has it
    if set_option:
        set_option(-3, 16 << 20)  # M_MMAP_THRESHOLD
        set_option(-1, 64 << 20)  # M_TRIM_THRESHOLD


def _remembering(f: Callable, most: int = 1 << 24) -> Callable:
    """``f`` of bytes, with results for the inputs met lately, up to so many bytes: many rows are copies of others."""
    held: dict[bytes, object] = {}
    size = 0

    def call(x: bytes):
        nonlocal size
        if x not in held:
            if size > most:
                held.clear()
                size = 0
            held[x] = f(x)
            size += 2 * len(x) + 200
        return held[x]

    return call


def store_texts(df: DataFrame, keep: dict[str, Column] | None = None, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``n_bytes`` and ``media``, the payload of its text as lossless WebP.

    Null and empty texts have a payload of 64 zeros. Equal texts have equal media. No shuffle.
    """
    keep = keep or {"doc_id": F.col("doc_id")}
    rows = df.select(*(c.alias(n) for n, c in keep.items()), F.col(text_col).cast("string").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_bytes bigint, media binary"

    def start():
        _hold_memory()
        encode = _remembering(encode_bytes)

        def batch(*cols):
            payloads = [payload_of(t) for t in cols[-1]]
            return [*cols[:-1], [n for _, n in payloads], [encode(p) for p, _ in payloads]]

        return batch

    return map_rows(rows, ddl, start)


def decode_media(df: DataFrame, media_col: str = "media", outputs: tuple[str, ...] = ("width", "height", "pixels"), error_col: str | None = None) -> DataFrame:
    """All columns of ``df`` but the media column, with outputs read from the stored bytes: ``width``, ``height`` and ``pixels`` (ARGB by row, of all
    images one below the other), or digests of the samples: ``payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    Null media give nulls. Damaged media fail the job or, with ``error_col``, give nulls and say there what is wrong.
    """
    kinds = {
        "width": "int", "height": "int", "pixels": "array<bigint>", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint",
        "media_bytes": "bigint", "media_sha256": "string", "feature": "string",
    }
    rest = [f for f in df.schema.fields if f.name != media_col]
    rows = df.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{media_col}`"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{k} {kinds[k]}" for k in outputs), *([f"`{error_col}` string"] if error_col else [])])
    arrays = bool({"width", "height", "pixels"} & set(outputs))

    def one(media: bytes) -> dict:
        images = [decode_frame(f) for f in frames(media)]
        samples = b"".join((i >> 8 & 255).astype(np.uint8).tobytes() for i in images)
        got = {
            "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-64:]),
            "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        }
        if "feature" in outputs:
            got["feature"] = feature_of(samples)
        if arrays:
            got |= {"width": images[0].shape[1], "height": sum(len(i) for i in images), "pixels": np.concatenate([i.ravel() for i in images]).astype(np.int64)}
        return got

    def start():
        _hold_memory()
        read = one if arrays else _remembering(one)

        def safe(media: bytes) -> tuple[dict | None, str | None]:
            try:
                return read(media), None
            except (ValueError, IndexError, KeyError) as e:
                if error_col is None:
                    raise
                return None, f"{type(e).__name__}: {e}"

        def batch(*cols):
            got = [(None, None) if m is None else safe(m) for m in cols[-1]]
            out = [*cols[:-1], *([None if g is None else g[k] for g, _ in got] for k in outputs)]
            return [*out, [e for _, e in got]] if error_col else out

        return batch

    return map_rows(rows, ddl, start)
