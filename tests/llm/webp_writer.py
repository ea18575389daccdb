"""Writes lossless WebP with every feature of the format, for testing the decoder."""

import numpy as np

from splitbench.llm import webp


class BitList:
    """Collects numbers of a few bits, least significant first, as a list of bits."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]


def code_lengths(used, size):
    """Lengths of a complete code for the used symbols: skewed if they are few, else two neighbouring lengths."""
    used, lengths = sorted(used), [0] * size
    m = len(used)
    if m == 1:
        lengths[used[0]] = 1
    elif m <= 14:
        for i, s in enumerate(used):
            lengths[s] = min(i + 1, m - 1)
    else:
        top = (m - 1).bit_length()
        for i, s in enumerate(used):
            lengths[s] = top - 1 if i < (1 << top) - m else top
    return lengths


def put_code(bits, used, size):
    """Write a normal prefix code; returns symbol -> bits, first bit first."""
    lengths = code_lengths(used, size)
    bits.put(0, 1)
    bits.put(15, 4)
    for k in webp.CODE_LENGTH_ORDER:
        bits.put(4 if k < 16 else 0, 3)
    bits.put(0, 1)
    for n in lengths:
        bits.bits += [n >> b & 1 for b in (3, 2, 1, 0)]
    ordered = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(ordered) == 1:
        return {ordered[0][1]: []}
    out, code, last = {}, 0, ordered[0][0]
    for n, s in ordered:
        code <<= n - last
        last = n
        out[s] = [code >> b & 1 for b in range(n - 1, -1, -1)]
        code += 1
    return out


def prefix_of(value):
    """(code, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << (top - 1)) - 1), top - 1


def tokens_of(pixels, width, cache_bits):
    """Literals, back-references and cache hits for a list of pixels."""
    cache, out, at = {}, [], 0
    key = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(pixels):
        best = (0, 0)
        for far in (1, 2, 3, 7, width - 1, width, width + 1, 2 * width, 130, 200):
            if 0 < far <= at:
                n = 0
                while at + n < len(pixels) and n < 4000 and pixels[at + n] == pixels[at + n - far]:
                    n += 1
                best = max(best, (n, far))
        if best[0] >= 3:
            out.append(("copy", *best))
            step = best[0]
        elif cache_bits and cache.get(key(pixels[at])) == pixels[at]:
            out.append(("cache", key(pixels[at])))
            step = 1
        else:
            out.append(("pixel", pixels[at]))
            step = 1
        if cache_bits:
            for p in pixels[at : at + step]:
                cache[key(p)] = p
        at += step
    return out


def distance_code(far, width):
    for i, (left, up) in enumerate(webp.SHORT_DISTANCES):
        if max(1, left + up * width) == far:
            return i + 1
    return far + 120


def put_image(bits, pixels, width, main=False, cache_bits=0, group_bits=0):
    height = len(pixels) // width
    bits.put(int(cache_bits > 0), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    groups = [0] * len(pixels)
    if main:
        bits.put(int(group_bits > 0), 1)
        if group_bits:
            across, down = -(-width >> group_bits), -(-height >> group_bits)
            bits.put(group_bits - 2, 3)
            number = [(x + y) % 2 for y in range(down) for x in range(across)]
            put_image(bits, [n << 8 for n in number], across)
            groups = [number[(i // width >> group_bits) * across + (i % width >> group_bits)] for i in range(len(pixels))]
    tokens, symbols, at = tokens_of(pixels, width, cache_bits), [], 0
    used = [[set() for _ in range(5)] for _ in range(max(groups) + 1)]
    for t in tokens:
        g = groups[at]
        if t[0] == "pixel":
            a, r, gr, b = webp._parts(t[1])
            parts = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
            at += 1
        elif t[0] == "cache":
            parts = [(0, 280 + t[1], 0, 0)]
            at += 1
        else:
            c, extra, n = prefix_of(t[1])
            dc, dextra, dn = prefix_of(distance_code(t[2], width))
            parts = [(0, 256 + c, extra, n), (4, dc, dextra, dn)]
            at += t[1]
        for k, s, _, _ in parts:
            used[g][k].add(s)
        symbols.append((g, parts))
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[put_code(bits, u or {0}, size) for u, size in zip(us, sizes)] for us in used]
    for g, parts in symbols:
        for k, s, extra, n in parts:
            bits.bits += codes[g][k][s]
            bits.put(extra, n)


def subtract(a, b):
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def signed(x):
    return x - 256 if x & 128 else x


def forward_prediction(pixels, width, block, modes):
    across, out = -(-width >> block), []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        if not y:
            guess = pixels[i - 1] if x else webp.OPAQUE
        elif not x:
            guess = pixels[i - width]
        else:
            mode = modes[(y >> block) * across + (x >> block)]
            guess = webp.predicted(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])
        out.append(subtract(p, guess))
    return out


def forward_cross(pixels, width, block, factors):
    across, out = -(-width >> block), []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        f = factors[(y >> block) * across + (x >> block)]
        a, r, g, b = webp._parts(p)
        delta = lambda t, c: signed(t & 255) * signed(c) >> 5
        out.append(webp._join((a, r - delta(f, g) & 255, g, b - delta(f >> 8, g) - delta(f >> 16, r) & 255)))
    return out


def write(pixels, width, transforms=(), cache_bits=0, group_bits=0, seed=0):
    rng = np.random.default_rng(seed)
    height, full = len(pixels) // width, width
    bits = BitList()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        bits.put(v, n)
    pixels = list(pixels)
    for kind in transforms:
        bits.put(1, 1)
        bits.put(kind, 2)
        if kind in (webp.PREDICT, webp.CROSS):
            block = 2
            n = -(-width >> block) * -(-height >> block)
            bits.put(block - 2, 3)
            if kind == webp.PREDICT:
                modes = [i % 14 for i in range(n)]
                put_image(bits, [webp.OPAQUE | m << 8 for m in modes], -(-width >> block))
                pixels = forward_prediction(pixels, width, block, modes)
            else:
                factors = [int(x) for x in rng.integers(0, 1 << 24, n)]
                put_image(bits, factors, -(-width >> block))
                pixels = forward_cross(pixels, width, block, factors)
        elif kind == webp.GREEN:
            pixels = [p & 0xFF00FF00 | ((p >> 16) - (p >> 8) & 255) << 16 | ((p & 255) - (p >> 8) & 255) for p in pixels]
        else:
            table = sorted(set(pixels))
            bits.put(len(table) - 1, 8)
            put_image(bits, [subtract(p, table[i - 1] if i else 0) for i, p in enumerate(table)], len(table))
            packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            per, size, rows = 1 << packed, 8 >> packed, []
            for y in range(height):
                row = [table.index(p) for p in pixels[y * width : (y + 1) * width]]
                rows += [sum(v << (size * k) for k, v in enumerate(row[x : x + per])) << 8 for x in range(0, width, per)]
            pixels, width = rows, -(-width // per)
    bits.put(0, 1)
    put_image(bits, pixels, width, True, cache_bits, group_bits)
    assert full * height
    return webp._riff(np.packbits(np.array(bits.bits, np.uint8), bitorder="little").tobytes())
