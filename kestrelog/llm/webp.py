"""Lossless WebP (VP8L): a decoder of the whole format.

It reads prefix codes (simple and normal, with meta prefix groups), back-references, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms. Many images are
decoded together: every step reads the next code length or decodes the next pixel of each of them
through lookup tables, so that numpy works on whole columns of images. Images with meta prefix groups are decoded one by
one. Pixels are (height, width, 4) arrays of R, G, B, A.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
_CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Reads numbers from bytes, least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return value & ((1 << n) - 1)


_REVERSED = np.zeros(1 << 16, np.int64)
for _k in range(16):
    _REVERSED |= (np.arange(1 << 16) >> _k & 1) << (15 - _k)


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is not 0 or false; np.nonzero of a flat array is much faster."""
    return np.divmod(np.flatnonzero(x), x.shape[1])


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """(codes, symbols) lengths -> the bits of each symbol, first bit lowest; 0 for those without a length."""
    row, symbol = cells(lengths > 0)
    n = lengths[row, symbol].astype(np.int64)
    counts = np.bincount(row * 16 + n, minlength=len(lengths) * 16).reshape(-1, 16)
    first = np.zeros_like(counts)
    for k in range(1, 16):
        first[:, k] = (first[:, k - 1] + counts[:, k - 1]) << 1
    group = row * 16 + n
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    rank[order] = np.arange(len(group)) - (np.cumsum(counts.reshape(-1)) - counts.reshape(-1))[group[order]]
    out = np.zeros(lengths.shape, np.uint64)
    out[row, symbol] = _REVERSED[(first[row, n] + rank) & 0xFFFF] >> (16 - n)
    return out


def lookup_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, symbols) lengths -> one table of length << 12 | symbol for all codes, where each begins, and its mask.

    A symbol alone takes no bits.
    """
    used = (lengths > 0).sum(1)
    if not used.all():
        raise ValueError("a prefix code without symbols")
    kraft = np.where(lengths > 0, 1 << (15 - np.minimum(lengths, 15).astype(np.int64)), 0).sum(1)
    if ((kraft != 1 << 15) & (used > 1)).any():
        raise ValueError("a prefix code that is not complete")
    widest = np.where(used == 1, 0, lengths.max(1)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(1 << widest)])
    row, symbol = cells(lengths > 0)
    n = np.where(used[row] == 1, 0, lengths[row, symbol]).astype(np.int64)
    code = np.where(n > 0, canonical_codes(lengths)[row, symbol].astype(np.int64), 0)
    times = 1 << (widest[row] - n)
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    table = np.zeros(int(base[-1]), np.int32)
    table[np.repeat(base[row] + code, times) + (k << np.repeat(n, times))] = np.repeat(n << 12 | symbol, times)
    return table, base[:-1], (1 << widest) - 1


_SHORT = _REVERSED[:128].tolist()


def short_codes(lengths: list[int]) -> list[int]:
    """canonical_codes of one code of lengths up to 7."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = _SHORT[code & 127] >> (16 - n)
        code += 1
    return out


def _short_table(lengths: list[int]) -> list[int]:
    """The lookup table (length << 12 | symbol) of one code of lengths up to 7."""
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return [used[0]]
    widest = max(lengths)
    if sum(1 << (7 - n) for n in lengths if n) != 128:
        raise ValueError("a prefix code that is not complete")
    table, codes = [0] * (1 << widest), short_codes(lengths)
    for s in used:
        n = lengths[s]
        table[codes[s] :: 1 << n] = [n << 12 | s] * (1 << (widest - n))
    return table


class Code:
    """A prefix code by its lengths, read through a table of its longest code."""

    def __init__(self, lengths: np.ndarray):
        table, _, mask = lookup_tables(np.asarray(lengths)[None])
        self.table, self.mask = table.tolist(), int(mask[0])

    def read(self, bits: Bits) -> int:
        first = bits.at >> 3
        entry = self.table[int.from_bytes(bits.data[first : first + 3], "little") >> (bits.at & 7) & self.mask]
        bits.at += entry >> 12
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
        return entry & 4095


def _read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    """The lengths of a prefix code."""
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    own = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    table, left = _short_table(own), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    mask, data, at = len(table) - 1, bits.data, bits.at
    out: list[int] = []
    previous, held, have = 8, 0, 0
    while len(out) < alphabet and left:
        if have < 14:  # the longest code and its extra bits
            held, have = int.from_bytes(data[at >> 3 : (at >> 3) + 32], "little") >> (at & 7), 256 - (at & 7)
        entry = table[held & mask]
        n, s = entry >> 12, entry & 4095
        left -= 1
        if s < 16:
            out.append(s)
            if s:
                previous = s
        else:
            more, low, value = ((2, 3, previous), (3, 3, 0), (7, 11, 0))[s - 16]
            out += [value] * (low + (held >> n & ((1 << more) - 1)))
            n += more
        held >>= n
        have -= n
        at += n
    if len(out) > alphabet:
        raise ValueError("too many code lengths")
    if at > 8 * len(data):
        raise ValueError("the image ends early")
    bits.at = at
    lengths[: len(out)] = out
    return lengths


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


@dataclass
class Coded:
    """An entropy-coded image: its size and codes, and where its bits begin."""

    width: int
    height: int
    cache_bits: int
    groups: list[list[np.ndarray]]
    meta: np.ndarray | None
    block: int
    data: bytes
    at: int


def _coded(bits: Bits, width: int, height: int, main: bool, later: bool = False) -> Coded:
    """Reads an image's head; with later, a single group of codes is left to _codes_together."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, meta, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = (_image(bits, across, (height + (1 << block) - 1) >> block) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    if later and meta is None:
        return Coded(width, height, cache_bits, [], None, block, bits.data, bits.at)
    codes = [[_read_lengths(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    return Coded(width, height, cache_bits, codes, meta, block, bits.data, bits.at)


def _image(bits: Bits, width: int, height: int) -> np.ndarray:
    """An image inside another's header, as ARGB numbers row by row."""
    return _one_by_one(bits, _coded(bits, width, height, False))


def _one_by_one(bits: Bits, image: Coded) -> np.ndarray:
    """The pixels of one image, symbol by symbol; bits ends behind them."""
    bits.at, width = image.at, image.width
    codes = [[Code(x) for x in group] for group in image.groups]
    total = width * image.height
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << image.cache_bits if image.cache_bits else 0)
    shift = 32 - image.cache_bits

    def remember(pixel: int) -> None:
        if cache:
            cache[(pixel * _CACHE_FACTOR & 0xFFFFFFFF) >> shift] = pixel

    i = 0
    while i < total:
        group = codes[int(image.meta[(i // width) >> image.block, (i % width) >> image.block])] if image.meta is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            remember(int(out[i]))
            i += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            back = _extra(bits, group[4].read(bits))
            if back > 120:
                back -= 120
            else:
                x, y = DISTANCES[back - 1]
                back = max(1, x + y * width)
            if back > i or i + length > total:
                raise ValueError("a reference out of the image")
            for k in range(i, i + length):
                out[k] = out[k - back]
                remember(int(out[k]))
            i += length
        else:
            out[i] = cache[s - 280]
            remember(int(out[i]))
            i += 1
    return out


def hash_of(argb: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The colour cache's slot of pixels, for caches of 2^bits slots."""
    return ((argb.astype(np.int64) * _CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - bits)


_PREFIX = np.arange(40)
_EXTRA_BITS = np.where(_PREFIX < 4, 0, (_PREFIX - 2) >> 1)
_EXTRA_BASE = np.where(_PREFIX < 4, _PREFIX + 1, ((2 + (_PREFIX & 1)) << _EXTRA_BITS) + 1)
_NEAR_X, _NEAR_Y = (np.array([0, *(d[k] for d in DISTANCES)]) for k in (0, 1))


#: Of the symbols of a code of code lengths: extra bits and least repeats.
_MORE = np.array([0] * 16 + [2, 3, 7])
_LEAST = np.array([1] * 16 + [3, 3, 11])


def _windows(images: list[Coded], spare: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64 bits from each byte on of all images' data and spare bytes, and where the data of each begin and end."""
    data = [x.data for x in images]
    begins = np.cumsum([0, *map(len, data)])
    raw = np.frombuffer(b"".join(data) + bytes(spare + 64), np.uint8)
    windows = np.empty(len(raw) - 15, np.int64)
    for k in range(8):
        part = windows[k::8]
        part[:] = raw[k : k + 8 * len(part)].view("<i8")
    return windows, begins


def _lengths_together(windows: np.ndarray, pos: np.ndarray, alphabets: np.ndarray) -> np.ndarray:
    """_read_lengths for many codes at once, each from its pos on, which is moved behind it; (codes, symbols) lengths."""
    bits_at = lambda at: windows[at >> 3] >> (at & 7)
    steps = np.zeros((len(pos), int(alphabets.max()) + 1), np.uint8)  # from one length to the next
    window = bits_at(pos)
    i = np.flatnonzero(window & 1)
    if len(i):
        held = window[i]
        two, wide = held >> 1 & 1, held >> 2 & 1
        n = np.where(wide, 11, 4)
        first, second = held >> 3 & np.where(wide, 255, 1), held >> n & 255
        if (np.maximum(first, second * two) >= alphabets[i]).any():
            raise ValueError("a symbol out of the alphabet")
        steps[i, first] = 1
        steps[i[two > 0], second[two > 0]] = 1
        pos[i] += n + 8 * two
    live = np.flatnonzero(~window & 1)
    lengths = steps.copy()
    if not len(live):
        return lengths[:, :-1]
    steps[:] = 0
    size = 4 + (window[live] >> 1 & 15)
    held = bits_at(pos[live] + 5)
    own = np.zeros((len(live), 19), np.uint8)
    for k, s in enumerate(CODE_LENGTH_ORDER):
        own[:, s] = np.where(k < size, held >> 3 * k & 7, 0)
    table, base, mask = lookup_tables(own)
    at = pos[live] + 5 + 3 * size
    held = bits_at(at)
    n = 2 + 2 * (held >> 1 & 7)
    some = held & 1 == 1
    most = alphabets[live]
    left = np.where(some, 2 + (held >> 4 & ((1 << n) - 1)), most)
    at += np.where(some, 4 + n, 1)
    normal, filled = live, np.zeros(len(live), np.int64)
    previous, written = np.full(len(live), 8), np.zeros(len(live), np.int64)
    while len(live):
        window = bits_at(at)
        entry = table[base + (window & mask)]
        n, s = entry >> 12, entry & 4095
        more = _MORE[s]
        times = _LEAST[s] + (window >> n & ((1 << more) - 1))
        at += n + more
        plain = s < 16
        value = np.where(plain, s, np.where(s == 16, previous, 0))
        previous = np.where(plain & (s > 0), s, previous)
        steps[live, filled] = value - written & 255
        written = value
        filled += times
        left -= 1
        going = (filled < most) & (left > 0)
        if not going.all():
            done = ~going
            if (filled > most).any():
                raise ValueError("too many code lengths")
            steps[live[done], filled[done]] = -written[done] & 255
            pos[live[done]] = at[done]
            live, at, base, mask, previous, written, filled, left, most = (x[going] for x in (live, at, base, mask, previous, written, filled, left, most))
    lengths[normal] = np.cumsum(steps[normal], 1, dtype=np.uint8)
    return lengths[:, :-1]


def _codes_together(images: list[Coded]) -> list[np.ndarray]:
    """Reads the codes of images with one group of them: lengths by kind of code, (images, symbols) each. Images' at is moved behind them."""
    cache_bits = np.array([x.cache_bits for x in images])
    # codes of damaged images may go on behind their data
    windows, begins = _windows(images, 1 << 15)
    pos = 8 * begins[:-1] + np.array([x.at for x in images])
    out = []
    for n in (280 + np.where(cache_bits > 0, 1 << cache_bits, 0), *(np.full(len(images), k) for k in (256, 256, 256, 40))):
        out.append(_lengths_together(windows, pos, n))
        if (pos > 8 * begins[1:]).any():
            raise ValueError("the image ends early")
    for image, at in zip(images, (pos - 8 * begins[:-1]).tolist()):
        image.at = at
    return out


def _together(images: list[Coded], lengths: list[np.ndarray]) -> list[np.ndarray]:
    """The pixels of images with one group of codes each, by kind of code, all decoded pixel by pixel at once."""
    totals = np.array([x.width * x.height for x in images])
    order = np.argsort(-totals, kind="stable")
    images, totals = [images[i] for i in order], totals[order]
    windows, begins = _windows(images, 8 * int(totals[0]))  # damaged images may read on a little
    pos = 8 * begins[:-1] + np.array([x.at for x in images])
    (green, g0, gm), (red, r0, rm), (blue, b0, bm), (alpha, a0, am), (far, d0, dm) = (lookup_tables(x[order]) for x in lengths)
    width = np.array([x.width for x in images])
    out = np.zeros(int(totals.sum()), np.int64)
    at = np.cumsum(totals) - totals
    cache_bits = np.array([x.cache_bits for x in images])
    slots = np.where(cache_bits > 0, 1 << cache_bits, 1)
    c0, cache, caching = np.cumsum(slots) - slots, np.zeros(int(slots.sum()), np.int64), bool(cache_bits.any())
    left, back = np.zeros(len(images), np.int64), np.zeros(len(images), np.int64)
    active = np.searchsorted(-totals, -np.arange(int(totals[0])), side="left")
    copying = 0
    for t, m in enumerate(active.tolist()):
        who = np.flatnonzero(left[:m] == 0) if copying else slice(0, m)
        p = pos[who]
        window = windows[p >> 3] >> (p & 7)
        entry = green[g0[who] + (window & gm[who])]
        taken, s = entry >> 12, entry & 4095
        window >>= taken
        x = red[r0[who] + (window & rm[who])]
        n = x >> 12
        window >>= n
        y = blue[b0[who] + (window & bm[who])]
        k = y >> 12
        window >>= k
        z = alpha[a0[who] + (window & am[who])].astype(np.int64)
        pixel = (z & 255) << 24 | (x & 255) << 16 | s << 8 | y & 255
        literal = s < 256
        taken += np.where(literal, n + k + (z >> 12), 0)
        if not literal.all():
            lanes = np.arange(m) if isinstance(who, slice) else who
            rest = np.flatnonzero(~literal)
            cached = s[rest] >= 280
            hit, refs = rest[cached], rest[~cached]
            pixel[hit] = cache[c0[lanes[hit]] + s[hit] - 280]
            if len(refs):
                q = p[refs] + taken[refs]
                window = windows[q >> 3] >> (q & 7)
                prefix, mine = s[refs] - 256, lanes[refs]
                n = _EXTRA_BITS[prefix]
                length = _EXTRA_BASE[prefix] + (window & ((1 << n) - 1))
                window >>= n
                entry = far[d0[mine] + (window & dm[mine])]
                window >>= entry >> 12
                k = _EXTRA_BITS[entry & 4095]
                code = _EXTRA_BASE[entry & 4095] + (window & ((1 << k) - 1))
                near = np.minimum(code, 120)
                distance = np.where(code > 120, code - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[mine]))
                if (distance > t).any() or (t + length > totals[mine]).any():
                    raise ValueError("a reference out of the image")
                taken[refs] += n + (entry >> 12) + k
                left[mine], back[mine] = length, distance
                copying += len(refs)
        pos[who] = p + taken
        if copying:
            copied = np.flatnonzero(left[:m])
            whole = np.empty(m, np.int64)
            whole[who] = pixel
            whole[copied] = out[at[copied] + t - back[copied]]
            left[copied] -= 1
            copying = int(np.count_nonzero(left[:m]))
            pixel = whole
        out[at[:m] + t] = pixel
        if caching:
            cache[c0[:m] + (((pixel * _CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits[:m]))] = pixel
    if (pos > 8 * begins[1:]).any():
        raise ValueError("the image ends early")
    found: list = [None] * len(images)
    for i, a, n in zip(order.tolist(), at.tolist(), totals.tolist()):
        found[i] = out[a : a + n].astype(np.uint32)
    return found


def channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], -1).astype(np.uint8)


def _predicted(mode: int, left, top, corner, right) -> list[int]:
    """A pixel's prediction by mode from its left, top, top left and top right neighbours."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner))
        by_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if by_left < by_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner)]
    return [0, 0, 0, 255]


def _neighbours(pixels: np.ndarray, y: int, x: int, modes: np.ndarray, block: int) -> list[int]:
    """The prediction at (y, x) from pixels decoded so far."""
    if y == 0:
        return [0, 0, 0, 255] if x == 0 else pixels[0, x - 1].tolist()
    if x == 0:
        return pixels[y - 1, 0].tolist()
    right = pixels[y - 1, x + 1] if x + 1 < pixels.shape[1] else pixels[y, 0]
    return _predicted(int(modes[y >> block, x >> block]), pixels[y, x - 1].tolist(), pixels[y - 1, x].tolist(), pixels[y - 1, x - 1].tolist(), right.tolist())


def _unpredicted(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Adds the predictions; for images of mode 1 (left) or 2 (above) alone by running sums."""
    pixels = pixels.copy()
    height, width, _ = pixels.shape
    pixels[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    used = np.unique(modes).tolist()
    if used == [1]:
        pixels[:, 0] = np.cumsum(pixels[:, 0], 0, dtype=np.uint8)
        return np.cumsum(pixels, 1, dtype=np.uint8)
    if used == [2]:
        pixels[0] = np.cumsum(pixels[0], 0, dtype=np.uint8)
        return np.cumsum(pixels, 0, dtype=np.uint8)
    for y in range(height):
        for x in range(width):
            if x or y:
                pixels[y, x] += np.array(_neighbours(pixels, y, x, modes, block), np.uint8)
    return pixels


def color_delta(factors: np.ndarray, samples: np.ndarray) -> np.ndarray:
    return (factors.astype(np.int8).astype(np.int32) * samples.astype(np.int8).astype(np.int32)) >> 5


def _spread(values: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(values, 1 << block, 0), 1 << block, 1)[:height, :width]


@dataclass
class Parsed:
    """A VP8L chunk's header: its transforms, decoded, and its main image, still coded."""

    height: int
    transforms: list[tuple]
    image: Coded

    @property
    def features(self) -> set[str]:
        """The parts of the format that it uses."""
        groups = self.image.groups
        found = {("predictor", "cross-colour", "subtract-green", "palette")[t[0]] for t in self.transforms}
        found |= {"cache"} if self.image.cache_bits else set()
        found |= {"groups"} if self.image.meta is not None else set()
        found |= {"matches"} if any(group[0][256:280].any() for group in groups) else set()
        found |= {"prefix codes"} if any(len(np.unique(x[x > 0])) > 1 for group in groups for x in group) else set()
        return found


def parsed(data: bytes, later: bool = False) -> Parsed:
    """Reads a chunk up to the pixels of its main image; with later, up to its codes if it has one group of them."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    transforms: list[tuple] = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.read(3) + 2
            across, down = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            transforms.append((kind, width, block, channels(_image(bits, across, down)).reshape(down, across, 4)))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            colors = np.cumsum(channels(_image(bits, size, 1)), 0, dtype=np.uint8)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, width, packed, colors))
            width = (width + (1 << packed) - 1) >> packed
        else:
            transforms.append((kind, width, 0, None))
    return Parsed(height, transforms, _coded(bits, width, height, True, later))


def _restored(head: Parsed, argb: np.ndarray) -> np.ndarray:
    """Undoes the transforms, the last one first."""
    height = head.height
    pixels = channels(argb).reshape(height, head.image.width, 4)
    for kind, wide, block, extra in reversed(head.transforms):
        if kind == PALETTE:
            n = 8 >> block
            index = np.stack([pixels[:, :, 1] >> (n * k) & ((1 << n) - 1) for k in range(1 << block)], -1).reshape(height, -1)[:, :wide]
            padded = np.zeros((256, 4), np.uint8)
            padded[: len(extra)] = extra
            pixels = padded[index]
        elif kind == SUBTRACT_GREEN:
            pixels = pixels + pixels[:, :, 1:2] * np.array([1, 0, 1, 0], np.uint8)
        elif kind == CROSS_COLOR:
            factors = _spread(extra, block, height, wide)
            pixels = pixels.copy()
            red = pixels[:, :, 0] + color_delta(factors[:, :, 2], pixels[:, :, 1])
            blue = pixels[:, :, 2] + color_delta(factors[:, :, 1], pixels[:, :, 1]) + color_delta(factors[:, :, 0], red.astype(np.uint8))
            pixels[:, :, 0], pixels[:, :, 2] = red.astype(np.uint8), blue.astype(np.uint8)
        else:
            pixels = _unpredicted(pixels, extra[:, :, 1] & 15, block)
    return pixels


def decode_many(chunks: list[bytes]) -> list[np.ndarray]:
    """The data of VP8L chunks -> their pixels."""
    heads = [parsed(x, later=True) for x in chunks]
    pixels: list = [None] * len(heads)
    single = [i for i, h in enumerate(heads) if h.image.meta is None]
    if single:
        lengths = _codes_together([heads[i].image for i in single])
        short = sum(x.max(1).astype(np.int64) for x in lengths[:4]) <= 56  # bits that a literal may take
        for k in np.flatnonzero(~short).tolist():
            heads[single[k]].image.groups = [[x[k] for x in lengths]]
        alike = [single[k] for k in np.flatnonzero(short).tolist()]
        if alike:
            for i, argb in zip(alike, _together([heads[i].image for i in alike], [x[short] for x in lengths])):
                pixels[i] = argb
    for i, h in enumerate(heads):
        if pixels[i] is None:
            pixels[i] = _one_by_one(Bits(h.image.data), h.image)
        pixels[i] = _restored(h, pixels[i])
    return pixels


def chunks_of(data: bytes) -> list[bytes]:
    """The VP8L chunks of one or more files, one after the other."""
    out, at = [], 0
    while at < len(data):
        if at + 20 > len(data):
            raise ValueError("not a lossless WebP file")
        mark, size, kind, tag, length = struct.unpack_from("<4sI4s4sI", data, at)
        if (mark, kind, tag) != (b"RIFF", b"WEBP", b"VP8L") or at + 20 + length > len(data):
            raise ValueError("not a lossless WebP file")
        out.append(data[at + 20 : at + 20 + length])
        at += 8 + size + (size & 1)
    return out


def decode(data: bytes) -> list[np.ndarray]:
    """One or more files, one after the other -> their pixels."""
    return decode_many(chunks_of(data))
