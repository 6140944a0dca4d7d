"""A small writer of images that use every part of the format, to test the decoder with."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from kestrelog.llm import webp


class Writer:
    """Collects bits, least significant first."""

    def __init__(self):
        self.parts: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.parts += [int(value) >> k & 1 for k in range(n)]

    def bytes(self) -> bytes:
        return np.packbits(np.array(self.parts, np.uint8), bitorder="little").tobytes()


def put_header(w: Writer, width: int, height: int) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)


def container(chunk: bytes) -> bytes:
    size, chunk = len(chunk), chunk + b"\0" * (len(chunk) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(chunk), b"WEBP", b"VP8L", size) + chunk


def _lengths(counts: Counter, alphabet: int) -> list[int]:
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    out = [0] * alphabet
    heapq.heapify(heap)
    if len(heap) == 1:
        out[heap[0][2][0]] = 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], 1000 + len(heap) + a[1], a[2] + b[2]))
    assert max(out) <= 15
    return out


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (code, n)
        code += 1
    return out


def _put_code(w: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(used[0], 8)
        return {used[0]: (0, 0)}
    w.put(0, 1), w.put(15, 4)
    own = [4] * 16 + [0] * 3  # all lengths at four bits each
    for k in webp.CODE_LENGTH_ORDER:
        w.put(own[k], 3)
    w.put(0, 1)
    for n in lengths:
        _put_symbol(w, (n, 4))
    return _codes(lengths)


def _put_symbol(w: Writer, code: tuple[int, int]) -> None:
    value, n = code
    for k in reversed(range(n)):
        w.put(value >> k & 1, 1)


def _prefix(value: int) -> tuple[int, int, int]:
    n = value - 1
    if n < 4:
        return n, 0, 0
    k = n.bit_length() - 1
    return 2 * k + (n >> (k - 1) & 1), k - 1, n & ((1 << (k - 1)) - 1)


def _tokens(argb: list[int], width: int, cache_bits: int, copies: bool):
    cache, i, out = {}, 0, []
    slot = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(argb):
        best = (0, 0)
        for back in (1, width, 2, width + 1, 5 * width + 3, 130) if copies else ():
            n = 0
            while 0 < back <= i and i + n < len(argb) and argb[i + n] == argb[i + n - back] and n < 4000:
                n += 1
            best = max(best, (n, back))
        if best[0] >= 3:
            n, back = best
            near = [k + 1 for k, (x, y) in enumerate(webp.DISTANCES) if max(1, x + y * width) == back]
            out.append(("copy", i, n, near[0] if near else back + 120))
        elif cache_bits and cache.get(slot(argb[i])) == argb[i]:
            out.append(("cache", i, slot(argb[i]), 0))
            n = 1
        else:
            out.append(("pixel", i, argb[i], 0))
            n = 1
        if cache_bits:
            for p in argb[i : i + n]:
                cache[slot(p)] = p
        i += n
    return out


def _put_image(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False, meta: np.ndarray | None = None) -> None:
    argb = [int(x) for x in argb.reshape(-1)]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    if main:
        w.put(0 if meta is None else 1, 1)
        if meta is not None:
            w.put(0, 3)  # blocks of 4 by 4
            _put_image(w, meta.astype(np.uint32) << 8, meta.shape[1], False)
            groups = int(meta.max()) + 1
    size = 280 + (1 << cache_bits if cache_bits else 0)
    tokens, counts = _tokens(argb, width, cache_bits, copies), [[Counter() for _ in range(5)] for _ in range(groups)]
    of = lambda i: 0 if meta is None else int(meta[(i // width) >> 2, (i % width) >> 2])
    for kind, i, v, d in tokens:
        c = counts[of(i)]
        if kind == "pixel":
            for k, s in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                c[k][s] += 1
        elif kind == "cache":
            c[0][280 + v] += 1
        else:
            c[0][256 + _prefix(v)[0]] += 1
            c[4][_prefix(d)[0]] += 1
    codes = [[_put_code(w, _lengths(c or Counter([0]), n)) for c, n in zip(cs, (size, 256, 256, 256, 40))] for cs in counts]
    for kind, i, v, d in tokens:
        c = codes[of(i)]
        if kind == "pixel":
            for k, s in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                _put_symbol(w, c[k][s])
        elif kind == "cache":
            _put_symbol(w, c[0][280 + v])
        else:
            for code, base, value in ((c[0], 256, v), (c[4], 0, d)):
                p, n, extra = _prefix(value)
                _put_symbol(w, code[base + p])
                w.put(extra, n)


def _argb(p: np.ndarray) -> np.ndarray:
    p = p.astype(np.uint32)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def write(pixels: np.ndarray, transforms=(), cache_bits: int = 0, copies: bool = False, groups: int = 1, seed: int = 0) -> bytes:
    rng = np.random.default_rng(seed)
    height, width, _ = pixels.shape
    w = Writer()
    put_header(w, width, height)
    pixels = pixels.copy()
    for kind in transforms:
        w.put(1, 1), w.put(kind, 2)
        down, across = (height + 3) >> 2, (width + 3) >> 2
        if kind == webp.PREDICTOR:
            w.put(0, 3)
            modes = rng.integers(0, 14, (down, across))
            _put_image(w, modes.astype(np.uint32) << 8, across, False)
            guess = np.array([[webp._neighbours(pixels, y, x, modes, 2) for x in range(width)] for y in range(height)], np.uint8)
            pixels = pixels - guess
        elif kind == webp.CROSS_COLOR:
            w.put(0, 3)
            f = rng.integers(0, 256, (down, across, 4)).astype(np.uint8)
            _put_image(w, _argb(f), across, False)
            s = webp._spread(f, 2, height, width)
            red, green = pixels[:, :, 0].copy(), pixels[:, :, 1]
            pixels[:, :, 2] -= (webp.color_delta(s[:, :, 1], green) + webp.color_delta(s[:, :, 0], red)).astype(np.uint8)
            pixels[:, :, 0] -= webp.color_delta(s[:, :, 2], green).astype(np.uint8)
        elif kind == webp.SUBTRACT_GREEN:
            pixels = pixels - pixels[:, :, 1:2] * np.array([1, 0, 1, 0], np.uint8)
        else:
            colors, index = np.unique(pixels.reshape(-1, 4), axis=0, return_inverse=True)
            w.put(len(colors) - 1, 8)
            _put_image(w, _argb(np.diff(colors, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colors), False)
            packed = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
            wide = (width + (1 << packed) - 1) >> packed
            grid = np.zeros((height, wide << packed), np.uint32)
            grid[:, :width] = index.reshape(height, width)
            green = sum(grid[:, k :: 1 << packed] << ((8 >> packed) * k) for k in range(1 << packed))
            width = wide
            pixels = np.zeros((height, width, 4), np.uint8)
            pixels[:, :, 1], pixels[:, :, 3] = green, 255
    w.put(0, 1)
    meta = rng.integers(0, groups, ((height + 3) >> 2, (width + 3) >> 2)) if groups > 1 else None
    if meta is not None:
        meta.reshape(-1)[:groups] = np.arange(groups)
    _put_image(w, _argb(pixels), width, True, cache_bits, copies, meta)
    return container(w.bytes())
