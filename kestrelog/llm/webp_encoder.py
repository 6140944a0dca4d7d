"""Lossless WebP (VP8L) encoder for many images at once.

Each image gets the transforms that its estimated entropy favours (predictor, cross-colour,
subtract-green or palette, or none), back-references to earlier pixels, a colour cache where it pays
and a prefix code for each channel. Matches, cache hits, codes and bits are worked out
for all images of a call together, trees and code lengths too; only transforms are image by image.
"""

from __future__ import annotations

import struct

import numpy as np

from .webp import CODE_LENGTH_ORDER, CROSS_COLOR, DISTANCES, PALETTE, PREDICTOR, SUBTRACT_GREEN, canonical_codes, cells, color_delta, hash_of

#: Longest prefix code, least pixels of a match and cache hits that make a colour cache worth its codes.
LIMIT, MATCH, HITS = 11, 3, 24
#: Mean difference of neighbouring samples up to which predictors are tried.
SMOOTH = 20
_ORDER = np.array(CODE_LENGTH_ORDER)
#: More than any count of symbols.
_NONE = 1 << 60


def _tree(counts: list[int]) -> list[int]:
    """Code lengths by Huffman's method for two or more positive counts in ascending order."""
    n = len(counts)
    weight, parent = counts + [0] * (n - 1), [0] * (2 * n - 1)
    leaf, inner = 0, n
    for at in range(n, 2 * n - 1):
        for _ in (0, 1):
            if leaf < n and (inner >= at or weight[leaf] <= weight[inner]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, inner = inner, inner + 1
            weight[at] += weight[pick]
            parent[pick] = at
    depth = [0] * (2 * n - 1)
    for at in range(2 * n - 3, -1, -1):
        depth[at] = depth[parent[at]] + 1
    return depth[:n]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a complete prefix code of at most limit bits; a symbol alone has length 1, and without any symbol 0 has."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used if len(used) else 0] = 1
        return out
    n = counts[used]
    order = np.argsort(n, kind="stable")
    sorted_n, least = n[order], 1
    while True:
        depth = _tree(np.maximum(sorted_n, least).tolist())
        if depth[0] <= limit:
            break
        least = max(2 * least, int(n.sum()) >> (limit + 2))
    out[used[order]] = depth
    return out


def _trees(counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """_tree for all columns of counts at once; column i has used[i] counts, two or more, and used descends."""
    most, n = counts.shape
    leaves = np.concatenate([counts, np.full((1, n), _NONE)]).reshape(-1)
    inner = np.full((most, n), _NONE)
    inners = inner.reshape(-1)
    leaf_parent, parent = np.zeros((most + 1) * n, np.int32), np.zeros(most * n, np.int32)
    column = np.arange(n)
    leaf, node = column.copy(), column.copy()  # places of the next leaf and inner node of each
    active = np.searchsorted(-used, -np.arange(1, most), side="left")
    for t, m in enumerate(active.tolist()):
        total = 0
        for _ in (0, 1):
            i, j = leaf[:m], node[:m]
            x, y = leaves[i], inners[j]
            first = x <= y
            total = total + np.minimum(x, y)
            leaf_parent[i[first]] = t
            parent[j[~first]] = t
            leaf[:m] += n * first
            node[:m] += n * ~first
        inner[t, :m] = total
    depth, parent = np.zeros(most * n, np.int32), parent.reshape(most, n)
    for t in range(most - 3, -1, -1):
        m = int(active[t + 1])  # those for which node t is not the root
        depth[t * n : t * n + m] = depth[parent[t, :m] * n + column[:m]] + 1
    return depth[leaf_parent[: most * n].reshape(most, n) * n + column] + 1


def many_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """code_lengths of each row of counts."""
    out = np.zeros(counts.shape, np.uint8)
    row, symbol = cells(counts > 0)
    used = np.bincount(row, minlength=len(counts))
    out[used == 0, 0] = 1
    out[row[used[row] == 1], symbol[used[row] == 1]] = 1
    several = used[row] > 1
    row, symbol = row[several], symbol[several]
    n = counts[row, symbol].astype(np.int64)
    by = np.lexsort((n, -used[row] * len(counts) + row))  # rows of many symbols first, the rarest symbol of each first
    row, symbol, n = row[by], symbol[by], n[by]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(begin, len(row)))
    column = np.repeat(np.arange(len(begin)), size)
    place = np.arange(len(row)) - begin[column]
    total = np.add.reduceat(n, begin) if len(begin) else n
    least = np.ones(len(begin), np.int64)
    left = np.arange(len(begin))  # codes that are still too long
    while len(left):
        held = np.full((int(size[left[0]]), len(left)), _NONE)
        now = np.full(len(begin), -1)
        now[left] = np.arange(len(left))
        mine = np.flatnonzero(now[column] >= 0)
        held[place[mine], now[column[mine]]] = np.maximum(n[mine], least[column[mine]])
        depth = _trees(held, size[left])
        out[row[mine], symbol[mine]] = depth[place[mine], now[column[mine]]]
        left = left[depth[0] > limit]
        least[left] = np.maximum(2 * least[left], total[left] >> (limit + 2))
    return out


class Bits:
    """Collects numbers as bits, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, symbols) lengths -> the runs of equal lengths up to each code's last symbol: code, length, size."""
    cut = lengths.shape[1] - np.argmax(lengths[:, ::-1] > 0, 1)
    begins = np.ones(lengths.shape, bool)
    begins[:, 1:] = (lengths[:, 1:] != lengths[:, :-1]) & (np.arange(1, lengths.shape[1]) < cut[:, None])
    row, at = cells(begins)
    end = np.append(at[1:], 0)
    last = np.append(row[1:] != row[:-1], True)
    return row, lengths[row, at].astype(np.int64), np.where(last, cut[row], end) - at


def _code_numbers(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of some kinds of codes, (images, symbols) each -> the numbers that state them, kind after kind
    for each image in turn: image, number, bits.

    One or two symbols below 256 make a simple code; others are run-length coded under a code of their own.
    """
    kinds = len(tables)
    codes = len(tables[0]) * kinds
    parts = []  # of each kind: code, place, number, bits
    runs = []
    for k, x in enumerate(tables):
        used = (x > 0).sum(1)
        low = np.argmax(x > 0, 1)
        high = x.shape[1] - 1 - np.argmax(x[:, ::-1] > 0, 1)
        simple = (used <= 2) & (high < 256)
        i = np.flatnonzero(simple)
        two, wide = used[i] == 2, low[i] > 1
        size = np.where(wide, 8, 1)
        number = 1 | two << 1 | wide << 2 | low[i] << 3 | np.where(two, high[i], 0) << (3 + size)
        parts.append((i * kinds + k, np.zeros(len(i), np.int64), number, 3 + size + 8 * two))
        i = np.flatnonzero(~simple)
        if len(i):
            row, v, n = _runs(x[i])
            runs.append((i[row] * kinds + k, v, n))
    if runs:
        code, v, n = (np.concatenate(c) for c in zip(*runs))
        by = np.argsort(code, kind="stable")
        code, v, n = code[by], v[by], n[by]
        # a length other than the last one above 0 is written out, then come repeats
        some = np.flatnonzero(v)
        before = np.full(len(v), 8)
        before[some[1:]] = np.where(code[some[1:]] == code[some[:-1]], v[some[:-1]], 8)
        lead = ((v > 0) & (v != before)).astype(np.int64)
        most = np.where(v > 0, 6, 138)
        full, rest = np.divmod(n - lead, most)
        count = lead + full + np.where(rest >= 3, 1, rest)
        run = np.repeat(np.arange(len(v)), count)
        place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        whole = (place >= lead[run]) & (place < (lead + full)[run])
        repeats = whole | (place >= lead[run]) & (rest[run] >= 3)
        size, v = np.where(whole, most[run], rest[run]), v[run]
        symbol = np.where(repeats, np.where(v > 0, 16, np.where(size >= 11, 18, 17)), v)
        extra = np.where(repeats, size - np.where(symbol == 18, 11, 3), 0)
        code = code[run]
        # the code of these symbols
        owner = np.flatnonzero(np.bincount(code, minlength=codes))
        mine = np.searchsorted(owner, code)
        own = many_lengths(np.bincount(mine * 19 + symbol, minlength=len(owner) * 19).reshape(-1, 19), 7)
        bits = np.where(((own > 0).sum(1) == 1)[:, None], 0, own)[mine, symbol].astype(np.int64)
        number = canonical_codes(own)[mine, symbol].astype(np.int64) | extra << bits
        ordered = own[:, _ORDER].astype(np.int64)
        size = np.maximum(4, 19 - np.argmax(ordered[:, ::-1] > 0, 1))
        for k, (a, b) in enumerate(((0, 9), (9, 19))):  # 19 lengths of 3 bits in two numbers
            head = (ordered[:, a:b] << 3 * np.arange(b - a)).sum(1)
            taken = 3 * (np.clip(size, a, b) - a)
            parts.append((owner, np.full(len(owner), k), head << 5 | size - 4 << 1 if k == 0 else head, taken + 5 if k == 0 else taken))
        width = np.bincount(mine) - 2
        need = np.maximum(1, np.frexp(width.astype(np.float64))[1] + 1 >> 1)
        parts.append((owner, np.full(len(owner), 2), 1 | need - 1 << 1 | width << 4, 4 + 2 * need))
        parts.append((code, np.full(len(code), 3), number, bits + np.array([0] * 16 + [2, 3, 7])[symbol]))
    code, place, number, bits = (np.concatenate(c) for c in zip(*parts))
    by = np.argsort(code * 4 + place, kind="stable")
    return code[by] // kinds, number[by], bits[by]


def _put_code(bits: Bits, *lengths: np.ndarray) -> None:
    """Writes the lengths of one or more codes."""
    _, numbers, sizes = _code_numbers([x[None] for x in lengths])
    for v, n in zip(numbers.tolist(), sizes.tolist()):
        bits.put(v, n)


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances -> prefix symbol, number of extra bits, extra bits."""
    v = values.astype(np.int64) - 1
    high = np.where(v >= 2, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 0)
    n = np.maximum(high - 1, 0)
    symbol = np.where(v < 2, v, 2 * high + (v >> n & 1))
    return symbol, np.where(v < 4, 0, n), np.where(v < 4, 0, v & ((1 << n) - 1))


_NEAR = {d: i + 1 for i, d in reversed(list(enumerate(DISTANCES)))}


def _distance_codes(back: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Distances in pixels -> distance codes: the short codes of near pixels, others moved by 120."""
    out = back + 120
    for width in np.unique(widths).tolist():
        short = np.zeros(16 * width, np.int64)
        for (x, y), code in _NEAR.items():
            d = x + y * width
            if 0 < d < len(short) and (short[d] == 0 or code < short[d]):
                short[d] = code
        mine = np.flatnonzero((widths == width) & (back < len(short)))
        found = short[back[mine]]
        out[mine[found > 0]] = found[found > 0]
    return out


def _entropy(samples: np.ndarray) -> float:
    """Estimated bits of (n, 4) samples with a code for each channel."""
    out = 0.0
    for k in range(4):
        n = np.bincount(samples[:, k])
        n = n[n > 0]
        out += float((n * np.log2(len(samples) / n)).sum()) + 3 * len(n)
    return out


def _residual(pixels: np.ndarray, mode: int) -> np.ndarray:
    """Pixels less their prediction from the left (1) or from above (2)."""
    guess = np.empty_like(pixels)
    if mode == 1:
        guess[:, 1:] = pixels[:, :-1]
        guess[1:, 0] = pixels[:-1, 0]
    else:
        guess[1:] = pixels[:-1]
        guess[0, 1:] = pixels[0, :-1]
    guess[0, 0] = (0, 0, 0, 255)
    return pixels - guess


def _factors(pixels: np.ndarray) -> np.ndarray:
    """Cross-colour factors (red to blue, green to blue, green to red) by least squares, in 32nds."""
    s = pixels.reshape(-1, 4).astype(np.int8).astype(np.float64)
    slope = lambda x, y: float(np.clip(np.round(32 * (x @ y) / max(x @ x, 1)), -128, 127))
    to_red = slope(s[:, 1], s[:, 0])
    to_blue = slope(s[:, 1], s[:, 2])
    rest = s[:, 2] - np.floor(to_blue * s[:, 1] / 32)
    return np.array([slope(s[:, 0], rest), to_blue, to_red]).astype(np.int8).view(np.uint8)


def _crossed(pixels: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[..., 0] -= color_delta(factors[2], pixels[..., 1]).astype(np.uint8)
    out[..., 2] -= (color_delta(factors[1], pixels[..., 1]) + color_delta(factors[0], pixels[..., 0])).astype(np.uint8)
    return out


def _flat(bits: Bits, argb: int) -> None:
    """An image of one colour: no colour cache, and codes of a symbol alone."""
    bits.put(0, 1)
    for value in (argb >> 8 & 255, argb >> 16 & 255, argb & 255, argb >> 24, 0):
        wide = int(value > 1)
        bits.put(1 | wide << 2, 3)
        bits.put(value, 8 if wide else 1)


def _put_block_transform(bits: Bits, kind: int, argb: int) -> None:
    """A predictor or cross-colour transform that is the same in blocks of 512 x 512 pixels: one block for any image here."""
    bits.put(1, 1)
    bits.put(kind, 2)
    bits.put(7, 3)
    _flat(bits, argb)


def _put_literals(bits: Bits, samples: np.ndarray) -> None:
    """An image (n, 4) without back-references or colour cache."""
    bits.put(0, 1)
    lengths = [code_lengths(np.bincount(samples[:, k], minlength=a)) for k, a in ((1, 280), (0, 256), (2, 256), (3, 256))]
    _put_code(bits, *lengths, code_lengths(np.zeros(40, np.int64)))
    tables = [(canonical_codes(x[None])[0].tolist(), x.tolist() if (x > 0).sum() > 1 else [0] * len(x)) for x in lengths]
    for row in samples.tolist():
        for (codes, sizes), v in zip(tables, (row[1], row[0], row[2], row[3])):
            bits.put(codes[v] if sizes[v] else 0, sizes[v])


def _smooth(flat: np.ndarray, step: int) -> bool:
    """Whether samples differ little from those step before them."""
    return len(flat) > step and float(np.abs((flat[step:] - flat[:-step]).view(np.int8)).mean(dtype=np.float32)) < SMOOTH


def transformed(pixels: np.ndarray) -> tuple[Bits, np.ndarray]:
    """(height, width, 4) pixels -> the bits that state their transforms, and the transformed pixels."""
    bits = Bits()
    flat = pixels.reshape(-1, 4)
    colors, index = np.unique(flat.view(np.uint32).ravel(), return_inverse=True)
    plans: list[tuple] = [()]
    if _smooth(pixels.reshape(-1), 4) or _smooth(pixels.reshape(-1), 4 * pixels.shape[1]):
        plans += [("sg",)] + [(p, *rest) for p in (1, 2) for rest in ((), ("sg",), ("cc",))]
    best, cost, chosen = pixels, None, ()
    for plan in plans if len(plans) > 1 else []:
        x = pixels
        extra = 0
        for step in plan:
            if step == "cc":
                x, extra = _crossed(x, _factors(x)), extra + 60
            elif step == "sg":
                x = x - x[:, :, 1:2] * np.array([1, 0, 1, 0], np.uint8)
            else:
                x, extra = _residual(x, step), extra + 60
        c = _entropy(x.reshape(-1, 4)) + extra
        if cost is None or c < cost:
            best, cost, chosen = x, c, plan
    if len(colors) <= 256 and len(colors) * 4 <= len(flat):
        n = np.bincount(index)
        c = float((n * np.log2(len(flat) / n)).sum()) + 24 * len(colors)
        if c < (cost if cost is not None else _entropy(flat)):
            return _palette(bits, pixels, colors, index)
    x = pixels
    for step in chosen:
        if step == "cc":
            f = _factors(x)
            _put_block_transform(bits, CROSS_COLOR, 255 << 24 | int(f[0]) << 16 | int(f[1]) << 8 | int(f[2]))
            x = _crossed(x, f)
        elif step == "sg":
            bits.put(1 | SUBTRACT_GREEN << 1, 3)
            x = x - x[:, :, 1:2] * np.array([1, 0, 1, 0], np.uint8)
        else:
            _put_block_transform(bits, PREDICTOR, 255 << 24 | step << 8)
            x = _residual(x, step)
    bits.put(0, 1)
    return bits, best


def _palette(bits: Bits, pixels: np.ndarray, colors: np.ndarray, index: np.ndarray) -> tuple[Bits, np.ndarray]:
    """Pixels as indices in a palette, several to a pixel if there are 16 colours or fewer."""
    height, width, _ = pixels.shape
    bits.put(1 | PALETTE << 1, 3)
    bits.put(len(colors) - 1, 8)
    listed = colors.view(np.uint8).reshape(-1, 4)
    _put_literals(bits, np.diff(listed, axis=0, prepend=np.zeros((1, 4), np.uint8)))
    bits.put(0, 1)
    packed = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
    wide = (width + (1 << packed) - 1) >> packed
    held = np.zeros((height, wide << packed), np.uint8)
    held[:, :width] = index.reshape(height, width)
    out = np.zeros((height, wide, 4), np.uint8)
    for k in range(1 << packed):
        out[:, :, 1] |= held[:, k :: 1 << packed] << np.uint8(k * (8 >> packed))
    out[:, :, 3] = 255
    return bits, out


def _matches(argb: np.ndarray, image: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the length of its match with an earlier place of its image, and the distance; 0 without one.

    The place is the nearest with the same MATCH pixels; a match goes on while the nearest places follow each other.
    """
    n = len(argb)
    length, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n <= MATCH:
        return length, back
    x = argb.astype(np.uint64)
    key = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + image[:-2].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    at, before = order[1:][same], order[:-1][same]
    ok = (image[at] == image[before]) & (at + MATCH <= ends[at])
    for k in range(MATCH):
        ok &= argb[at + k] == argb[before + k]
    back[at[ok]] = at[ok] - before[ok]
    goes_on = np.append((back[:-1] > 0) & (back[1:] == back[:-1]), False)
    stops = np.flatnonzero(~goes_on)
    run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    length = np.where(back > 0, run + MATCH, 0)
    return length, back


def _parse(length: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy choice of matches -> (whether a pixel begins a token, whether that is a match)."""
    begins, is_match = np.ones(len(length), bool), np.zeros(len(length), bool)
    free = 0
    for i, n in zip((at := np.flatnonzero(length)).tolist(), length[at].tolist()):
        if i >= free:
            free = i + n
            begins[i + 1 : free] = False
            is_match[i] = True
    return begins, is_match


def _container(chunk: bytes) -> bytes:
    size, chunk = len(chunk), chunk + b"\0" * (len(chunk) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(chunk), b"WEBP", b"VP8L", size) + chunk


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """(height, width, 4) images of R, G, B, A, of at most 512 x 512 pixels -> their files."""
    if not images:
        return []
    heads, kept = [], []
    for pixels in images:
        bits, left = transformed(np.ascontiguousarray(pixels))
        heads.append(bits)
        kept.append(left)
    widths = np.array([x.shape[1] for x in kept])
    sizes = np.array([x.shape[0] * x.shape[1] for x in kept])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    image = np.repeat(np.arange(len(kept)), sizes)
    ends = np.repeat(starts + sizes, sizes)
    samples = np.concatenate([x.reshape(-1, 4) for x in kept])
    wide = samples.astype(np.uint32)
    argb = wide[:, 3] << np.uint32(24) | wide[:, 0] << np.uint32(16) | wide[:, 1] << np.uint32(8) | wide[:, 2]
    length, back = _matches(argb, image, ends)
    begins, is_match = _parse(length, starts)
    # colour cache: what a slot holds is the last pixel before with the same hash
    cache_bits = np.clip(np.frexp(sizes.astype(np.float64))[1] - 1, 4, 10)
    slot = hash_of(argb, cache_bits[image])
    key = image.astype(np.int64) << 11 | slot
    order = np.argsort(key, kind="stable")
    held = np.zeros(len(argb), bool)
    held[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    held &= begins & ~is_match
    cached = np.bincount(image[held], minlength=len(kept)) >= HITS
    held &= cached[image]
    cache_bits = np.where(cached, cache_bits, 0)
    # tokens and their symbols
    token = np.flatnonzero(begins)
    owner = image[token]
    matched, hit = is_match[token], held[token]
    literal = ~matched & ~hit
    green = samples[token, 1].astype(np.int64)
    m = np.flatnonzero(matched)
    length_symbol, length_bits, length_extra = _prefix(length[token[m]])
    far_symbol, far_bits, far_extra = _prefix(_distance_codes(back[token[m]], widths[owner[m]]))
    green[m] = 256 + length_symbol
    green[hit] = 280 + slot[token[hit]]
    span = int(280 + (1 << cache_bits.max()) if cached.any() else 280)
    # codes
    n = len(kept)
    lit, who = token[literal], owner[literal]
    counts = [np.bincount(owner * span + green, minlength=n * span).reshape(n, span)]
    counts += [np.bincount(who * 256 + samples[lit, k], minlength=n * 256).reshape(n, 256) for k in (0, 2, 3)]
    counts.append(np.bincount(owner[m] * 40 + far_symbol, minlength=n * 40).reshape(n, 40))
    tables = []
    lengths = [many_lengths(c) for c in counts]
    for x in lengths:
        alone = (x > 0).sum(1) == 1
        tables.append((canonical_codes(x).reshape(-1), np.where(alone[:, None], 0, x).reshape(-1).astype(np.int64)))
    for i, bits in enumerate(heads):
        b = int(cache_bits[i])
        bits.put(1 | b << 1 if b else 0, 5 if b else 1)
        bits.put(0, 1)  # one group of codes
    # bits: every token is up to four numbers
    value = np.zeros((len(token), 4), np.uint64)
    taken = np.zeros((len(token), 4), np.int64)
    codes, sizes_of = tables[0]
    value[:, 0], taken[:, 0] = codes[owner * span + green], sizes_of[owner * span + green]
    where = np.flatnonzero(literal)
    for k, ((codes, sizes_of), channel) in enumerate(zip(tables[1:4], (0, 2, 3))):
        at = who * 256 + samples[lit, channel]
        value[where, k + 1], taken[where, k + 1] = codes[at], sizes_of[at]
    codes, sizes_of = tables[4]
    at = owner[m] * 40 + far_symbol
    value[m, 1], taken[m, 1], value[m, 2], taken[m, 2], value[m, 3], taken[m, 3] = length_extra, length_bits, codes[at], sizes_of[at], far_extra, far_bits
    whole, used = value[:, 0], taken[:, 0].copy()
    for k in (1, 2, 3):
        whole = whole | value[:, k] << used.astype(np.uint64)
        used += taken[:, k]
    # codes and tokens one after the other
    of, number, size = _code_numbers(lengths)
    by = np.argsort(np.concatenate([of, owner]), kind="stable")
    owner = np.concatenate([of, owner])[by]
    whole, used = np.concatenate([number.astype(np.uint64), whole])[by], np.concatenate([size, used])[by]
    body = np.bincount(owner, used, n).astype(np.int64)
    before = 40 + np.array([h.n for h in heads])
    bytes_of = (before + body + 7) >> 3
    offset = np.concatenate([[0], np.cumsum(bytes_of)])
    begin = np.cumsum(used) - used
    begin += (8 * offset[:-1] + before - np.concatenate([[0], np.cumsum(body)[:-1]]))[owner]
    out = np.zeros(int(offset[-1]) + 8, np.uint8)
    place, whole = begin >> 3, whole << (begin & 7).astype(np.uint64)
    for k in range(int(used.max(initial=0) + 14) >> 3):
        np.add.at(out, place + k, (whole >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint8))
    files, data = [], out.tobytes()
    for i, (pixels, bits) in enumerate(zip(images, heads)):
        head = 0x2F | pixels.shape[1] - 1 << 8 | pixels.shape[0] - 1 << 22 | 1 << 36 | bits.value << 40
        chunk = data[offset[i] : offset[i + 1]]
        k = (int(before[i]) + 7) >> 3
        joined = int.from_bytes(chunk[:k], "little") | head
        files.append(_container(joined.to_bytes(k, "little") + chunk[k:]))
    return files

