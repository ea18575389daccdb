"""Lossless WebP (VP8L): a decoder for the whole format, and an encoder.

Written from the public format description.  Pixels are 32-bit ARGB numbers.

The encoder weighs the format's tools by the size that they would give: palette
(packed below 17 colours), predictor, cross-colour or subtract-green, colour
cache; it always looks for back-references and writes optimal prefix codes.

The decoder looks symbols up in tables.  Images of which only the green channel
is coded, as grey and palette images are, have a loop of their own, in which a
back-reference is one slice.

A payload of bytes is stored as grey pixels, one byte each.
"""

from __future__ import annotations

import functools
import itertools
import math
import struct

import numpy as np

#: Fixed values of the format: the order in which code lengths of the code length code are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (columns to the left, rows up) of the 120 short distance codes.
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
PREDICT, CROSS, GREEN, PALETTE = range(4)
SIDE = 1 << 14


class WebpError(ValueError):
    """The bytes are not a whole lossless WebP image."""


class Bits:
    """Reads numbers of a few bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise WebpError("the image data end too early")
        first = self.at >> 3
        word = int.from_bytes(self.data[first : (end + 7) >> 3], "little")
        value = word >> (self.at & 7) & ((1 << n) - 1)
        self.at = end
        return value

    def ahead(self, n: int) -> int:
        """The next n bits, zeros after the end."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise WebpError("the image data end too early")


def _bit_reversal(width: int) -> np.ndarray:
    """The numbers of that many bits, each with its bits in reverse order."""
    out = np.zeros(1, np.uint32)
    for _ in range(width):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_REVERSED = functools.lru_cache(maxsize=20)(_bit_reversal)


class Prefix:
    """A canonical prefix code, as a table by the next ``width`` bits. A code of one symbol takes no bits."""

    def __init__(self, symbols: list[int], sizes: list[int]):
        """A code for these symbols, in order, with code lengths that are not 0."""
        self.fast: tuple[list[int], list[int]] | None = None
        self.only, self.width = None, 0
        if len(symbols) < 2:
            if not symbols:
                raise WebpError("a prefix code has no symbol")
            self.only = symbols[0]
            self.symbols, self.bits = np.array(symbols, np.int64), np.zeros(1, np.int64)
            return
        self.width = max(sizes)
        by_size = sorted(zip(sizes, symbols))
        n = np.array([x[0] for x in by_size])
        share = 1 << (self.width - n)
        if share.sum() != 1 << self.width:
            raise WebpError("a prefix code is not complete")
        order = _REVERSED(self.width)
        self.symbols = np.array([x[1] for x in by_size]).repeat(share)[order]
        self.bits = n.repeat(share)[order]

    def tables(self) -> tuple[list[int], list[int]]:
        if self.fast is None:
            self.fast = self.symbols.tolist(), self.bits.tolist()
        return self.fast

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbols, sizes = self.tables()
        ahead = bits.ahead(self.width)
        bits.skip(sizes[ahead])
        return symbols[ahead]


def _read_prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise WebpError("a symbol is outside its alphabet")
        symbols = sorted(set(symbols))
        return Prefix(symbols, [1] * len(symbols))
    given = [(k, n) for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)] if (n := bits.read(3))]
    code = Prefix([k for k, _ in sorted(given)], [n for _, n in sorted(given)])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    outer, widths = code.tables()
    mask, data, place = (1 << code.width) - 1, bits.data, bits.at
    symbols, sizes, at, last = [], [], 0, 8
    while at < size and left:
        left -= 1
        ahead = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        s, wide = outer[ahead & mask], widths[ahead & mask]
        place += wide
        if s < 16:
            if s:
                symbols.append(at)
                sizes.append(s)
                last = s
            at += 1
            continue
        ahead >>= wide
        if s == 16:
            times = 3 + (ahead & 3)
            place += 2
            symbols += range(at, at + times)
            sizes += [last] * times
        elif s == 17:
            times = 3 + (ahead & 7)
            place += 3
        else:
            times = 11 + (ahead & 127)
            place += 7
        at += times
    bits.skip(place - bits.at)
    if at > size:
        raise WebpError("code lengths run past their alphabet")
    return Prefix(symbols, sizes)


def _extended(code: int, bits: Bits) -> int:
    """The length or distance of a prefix code with its extra bits."""
    return LEAST[code] + bits.read(EXTRA[code])


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    n, cached = width * height, (1 << cache_bits if cache_bits else 0)
    block, groups_of, n_groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        groups_of = (_read_pixels(bits, across, -(-height >> block), False) >> 8 & 0xFFFF).tolist()
        n_groups = max(groups_of) + 1
    groups = [[_read_prefix(bits, size) for size in (280 + cached, 256, 256, 256, 40)] for _ in range(n_groups)]
    if n_groups == 1 and not cached and all(c.only is not None for c in groups[0][1:4]):
        red, blue, alpha = (c.only for c in groups[0][1:4])
        return _green_only(bits, groups[0][0], groups[0][4], n, width).astype(np.uint32) << 8 | np.uint32(alpha << 24 | red << 16 | blue)

    out: list[int] = []
    cache, shift = [0] * cached, 32 - cache_bits
    codes = groups[0]
    while len(out) < n:
        at = len(out)
        if groups_of is not None:
            codes = groups[groups_of[(at // width >> block) * across + (at % width >> block)]]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _extended(s - 256, bits)
            far = _extended(codes[4].read(bits), bits)
            if far > 120:
                far -= 120
            else:
                left, up = SHORT_DISTANCES[far - 1]
                far = max(1, left + up * width)
            if far > at or at + length > n:
                raise WebpError("a back-reference leaves the image")
            new = [out[at - far + k % far] for k in range(length)]
        else:
            new = [cache[s - 280]]
        out += new
        if cached:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32)


@functools.lru_cache(maxsize=64)
def _near(width: int) -> list[int]:
    """The distances of the short distance codes in an image of that width, code 1 first."""
    return [max(1, left + up * width) for left, up in SHORT_DISTANCES]


#: A length or distance by its prefix code: the least one, and the extra bits that are added to it.
LEAST = [c + 1 if c < 4 else (2 + (c & 1) << (c - 2 >> 1)) + 1 for c in range(40)]
EXTRA = [0 if c < 4 else c - 2 >> 1 for c in range(40)]


@functools.cache
def _two() -> list[bytes]:
    """All pairs of bytes, by their number, first byte low."""
    return [bytes((i & 255, i >> 8)) for i in range(1 << 16)]


#: In a table of codes, an entry is the bits taken, this flag if it is two literals, and from bit 5 on the symbol or the pair.
PAIR = 16


def _pairs(green: Prefix) -> np.ndarray:
    """By the next bits: a symbol, or two literals if both are there."""
    symbol, size = green.symbols, green.bits
    rest = np.arange(len(symbol)) >> size
    both = size + size[rest]
    double = (symbol < 256) & (symbol[rest] < 256) & (both <= min(green.width, 15))
    return np.where(double, symbol[rest] << 13 | symbol << 5 | PAIR | both, symbol << 5 | size)


def _green_only(bits: Bits, green: Prefix, distance: Prefix, n: int, width: int) -> np.ndarray:
    """n values of the green channel, of an image that codes nothing else."""
    if green.only is not None:
        if green.only > 255:
            raise WebpError("a back-reference leaves the image")
        return np.full(n, green.only, np.uint8)
    raw = np.append(np.frombuffer(bits.data, np.uint8, offset=bits.at >> 3), np.zeros(12, np.uint8)).astype(np.uint32)
    words = (raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24).tolist()  # 32 bits from each byte on
    last = 8 * (len(raw) - 12)
    codes, mask = _pairs(green).tolist(), (1 << green.width) - 1
    far_codes, far_mask = (distance.symbols << 4 | distance.bits).tolist(), (1 << distance.width) - 1
    near, two, out, at = _near(width), _two(), bytearray(), bits.at & 7
    add, left = out.append, n
    while left > 0 and at < last:
        code = codes[words[at >> 3] >> (at & 7) & mask]
        at += code & 15
        if code & PAIR:
            out += two[code >> 5]
            left -= 2
            continue
        code >>= 5
        if code < 256:
            add(code)
            left -= 1
            continue
        code -= 256
        more = EXTRA[code]
        length = LEAST[code] + (words[at >> 3] >> (at & 7) & (1 << more) - 1)
        at += more
        code = far_codes[words[at >> 3] >> (at & 7) & far_mask]
        at += code & 15
        code >>= 4
        more = EXTRA[code]
        far = LEAST[code] + (words[at >> 3] >> (at & 7) & (1 << more) - 1)
        at += more
        far = far - 120 if far > 120 else near[far - 1]
        if far > len(out) or length > left or at > last:
            raise WebpError("a back-reference leaves the image")
        begin = len(out) - far
        out += out[begin : begin + length] if far >= length else (out[begin:] * (length // far + 1))[:length]
        left -= length
    if left < 0:  # the second literal was what comes after the image
        at -= int(green.bits[(green.symbols == out.pop()).argmax()])
        left += 1
    if left or at > last:
        raise WebpError("the image data end too early")
    bits.at = (bits.at & ~7) + at
    return np.frombuffer(out, np.uint8)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def _mean(a: int, b: int) -> int:
    return ((a ^ b) >> 1 & 0x7F7F7F7F) + (a & b)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for l, t, c in zip(_parts(left), _parts(top), _parts(corner)):
        to_left += abs(t - c)
        to_top += abs(l - c)
    return left if to_left < to_top else top


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction of a mode from the pixels left, above, above right and above left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _mean(_mean(left, right), top)
        case 6:
            return _mean(left, corner)
        case 7:
            return _mean(left, top)
        case 8:
            return _mean(corner, top)
        case 9:
            return _mean(top, right)
        case 10:
            return _mean(_mean(left, corner), _mean(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _join(_clamp(l + t - c) for l, t, c in zip(_parts(left), _parts(top), _parts(corner)))
        case 13:
            mean = _mean(left, top)
            return _join(_clamp(m + int((m - c) / 2)) for m, c in zip(_parts(mean), _parts(corner)))
    return OPAQUE


def _add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _undo_prediction(pixels: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    rest, out = pixels.tolist(), []
    across = -(-width >> block)
    mode_of = (modes >> 8 & 15).tolist()
    for y in range(height):
        for x in range(width):
            at = len(out)
            if not y:
                guess = out[at - 1] if x else OPAQUE
            elif not x:
                guess = out[at - width]
            else:
                mode = mode_of[(y >> block) * across + (x >> block)]
                guess = predicted(mode, out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
            out.append(_add(rest[at], guess))
    return np.array(out, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    across = -(-width >> block)
    y, x = np.divmod(np.arange(width * height), width)
    f = factors[(y >> block) * across + (x >> block)]
    delta = lambda factor, colour: _signed(factor & 255) * _signed(colour) >> 5
    green = pixels >> 8 & 255
    red = (pixels >> 16 & 255).astype(np.int32) + delta(f, green) & 255
    blue = (pixels & 255).astype(np.int32) + delta(f >> 8, green) + delta(f >> 16, red) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _undo_green(pixels: np.ndarray) -> np.ndarray:
    parts = pixels.astype("<u4").view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    parts[:, 0] += parts[:, 1]
    parts[:, 2] += parts[:, 1]
    return parts.view("<u4").ravel()


def _undo_palette(pixels: np.ndarray, width: int, height: int, packed: int, table: np.ndarray) -> np.ndarray:
    index = pixels.reshape(height, -1) >> 8 & 255
    if packed:
        size = 8 >> packed
        shifts = np.arange(1 << packed, dtype=np.uint32) * size
        index = (index[:, :, None] >> shifts & ((1 << size) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


def decode_data(data: bytes) -> np.ndarray:
    """The pixels of a VP8L chunk's data: an array of height rows of ARGB numbers."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise WebpError("no VP8L signature")
    full = bits.read(14) + 1
    height = bits.read(14) + 1
    bits.read(1)  # only a hint that alpha is used
    if bits.read(3):
        raise WebpError("unknown VP8L version")
    undo, seen, width = [], set(), full
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICT, CROSS):
            block = bits.read(3) + 2
            table = _read_pixels(bits, -(-width >> block), -(-height >> block), False)
            undo.append((_undo_prediction if kind == PREDICT else _undo_cross_colour, width, height, block, table))
        elif kind == GREEN:
            undo.append((_undo_green,))
        else:
            size = bits.read(8) + 1
            table = _read_pixels(bits, size, 1, False)
            table = np.cumsum(table.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint32).astype(np.uint8).view(np.uint32).ravel()
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((_undo_palette, width, height, packed, table))
            width = -(-width >> packed)
    pixels = _read_pixels(bits, width, height, True)
    for step, *more in reversed(undo):
        pixels = step(pixels, *more)
    return pixels.reshape(height, full)


def decode(data: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file."""
    images = decode_all(data)
    if len(images) != 1:
        raise WebpError(f"{len(images)} images where one is expected")
    return images[0]


def decode_all(data: bytes) -> list[np.ndarray]:
    """The pixels of WebP files one after another."""
    out, at, view = [], 0, memoryview(data)
    while at < len(view):
        head = bytes(view[at : at + 12])
        if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WEBP":
            raise WebpError("no WebP header")
        end = at + 8 + int.from_bytes(head[4:8], "little")
        if end > len(view):
            raise WebpError("the file ends too early")
        chunk, found = at + 12, None
        while chunk + 8 <= end:
            size = int.from_bytes(view[chunk + 4 : chunk + 8], "little")
            if bytes(view[chunk : chunk + 4]) == b"VP8L":
                found = bytes(view[chunk + 8 : chunk + 8 + size])
            chunk += 8 + size + (size & 1)
        if found is None:
            raise WebpError("no lossless image")
        out.append(decode_data(found))
        at = end + (end - at & 1)
    return out


class BitWriter:
    """Collects numbers of a few bits, least significant first."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Put arrays of numbers, each of fewer than 64 bits, by way of 64-bit words."""
        ends = widths.cumsum()
        place = ends - widths + (self.size & 63)
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        own = word[first]
        # Bits of different numbers do not meet, so a sum is as good as an OR.
        out[own] = np.add.reduceat(values << shift, first)
        out[own + 1] += np.add.reduceat(values >> np.uint64(1) >> (np.uint64(63) - shift), first)
        whole = self.size >> 6 << 6
        self.value |= int.from_bytes(out.astype("<u8").tobytes(), "little") << whole
        self.size += int(ends[-1])

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def huffman_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of an optimal prefix code for symbols that all occur, none longer than ``limit`` bits."""
    order = sorted(range(len(counts)), key=counts.__getitem__)
    weights = [counts[i] for i in order]
    m = len(weights)
    if m == 1:
        return [1]
    # Two queues: leaves by weight, and joined nodes in the order in which they arise.
    parent, joined, leaf, node = [0] * (2 * m - 1), [], 0, 0
    for new in range(m, 2 * m - 1):
        total = 0
        for _ in range(2):
            if node == len(joined) or leaf < m and weights[leaf] <= joined[node]:
                parent[leaf] = new
                total += weights[leaf]
                leaf += 1
            else:
                parent[m + node] = new
                total += joined[node]
                node += 1
        joined.append(total)
    depth = [0] * (2 * m - 1)
    for k in range(2 * m - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    if max(depth[:m]) > limit:
        # Package-merge: pairs of the level below compete with the symbols; a symbol's length is how often it is in the cheapest ones.
        level: list[tuple[int, tuple[int, ...]]] = []
        for _ in range(limit):
            packed = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])]
            level = sorted([(w, (i,)) for i, w in enumerate(weights)] + packed)
        depth = [0] * m
        for _, inside in level[: 2 * m - 2]:
            for i in inside:
                depth[i] += 1
    out = [0] * m
    for k, i in enumerate(order):
        out[i] = depth[k]
    return out


def _code_of(counts: np.ndarray, limit: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an alphabet with these counts: code lengths, the codes' bits as they are written, and bits written a symbol."""
    used = np.flatnonzero(counts)
    lengths, codes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.uint64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths, codes, np.zeros(len(counts), np.int64)
    lengths[used] = huffman_lengths(counts[used].tolist(), limit)
    used = used[np.argsort(lengths[used], kind="stable")]
    longest = int(lengths[used[-1]])
    share = 1 << (longest - lengths[used])
    codes[used] = _REVERSED(longest)[np.cumsum(share) - share]
    return lengths, codes, lengths


def _put_single(bits: BitWriter, symbol: int) -> None:
    """A code of one symbol."""
    wide = symbol > 1
    bits.put(1 | wide << 2 | symbol << 3, 11 if wide else 4)


def _put_code(bits: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 2 and (not used or used[0] < 256) or len(used) == 2 and used[1] < 256:
        if len(used) < 2:
            _put_single(bits, used[0] if used else 0)
        else:
            bits.put(7 | used[0] << 3 | used[1] << 11, 19)
        return
    bits.put(0, 1)
    said: list[tuple[int, int, int]] = []  # a symbol of the code length code, extra bits, their number
    last = 8
    for value, run in itertools.groupby(lengths[: used[-1] + 1].tolist()):
        n = len(list(run))
        if value and value != last:
            said.append((value, 0, 0))
            n, last = n - 1, value
        while n >= 3:
            k = min(n, 6 if value else 138)
            said.append((16, k - 3, 2) if value else (17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            n -= k
        said += [(value, 0, 0)] * n
    counts = np.bincount([x[0] for x in said], minlength=19)
    own, codes, widths = _code_of(counts, 7)
    n = 19
    while n > 4 and not own[CODE_LENGTH_ORDER[n - 1]]:
        n -= 1
    bits.put(n - 4 | sum(int(own[k]) << 4 + 3 * i for i, k in enumerate(CODE_LENGTH_ORDER[:n])), 4 + 3 * n)
    if used[-1] + 1 < len(lengths) and len(said) > 1:
        bits.put(1, 1)
        room = max(2, (len(said) - 2).bit_length() + 1 & ~1)
        bits.put((room - 2) // 2, 3)
        bits.put(len(said) - 2, room)
    else:
        bits.put(0, 1)
        if rest := len(lengths) - used[-1] - 1:
            raise AssertionError(f"{rest} code lengths are left over")
    codes, widths = codes.tolist(), widths.tolist()
    whole = n = 0
    for value, extra, more in said:
        whole |= (codes[value] | extra << widths[value]) << n
        n += widths[value] + more
    bits.put(whole, n)


def _size(counts: np.ndarray) -> float:
    """About how many bits symbols with these counts take."""
    some = counts[counts > 0]
    return float((some * np.log2(some.sum() / some)).sum()) + 4 * len(some)


#: The farthest that a back-reference can reach.
REACH = (1 << 20) - 120


def _matches(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of back-references to the last place with the same five bytes or two pixels, greedily from the left.

    Bytes are compared only after the most frequent one, which in texts ends words.
    """
    n, size = len(items), items.itemsize
    least = 5 if size == 1 else 2
    none = np.zeros(0, np.int64)
    if n <= least:
        return none, none, none
    raw = items.tobytes()
    words = np.ndarray((n + 8 // size,), "<u8", raw + bytes(16), strides=(size,))  # eight bytes from each item on
    key = words[: n - least + 1] & np.uint64((1 << 8 * size * least) - 1)
    if size == 1:
        tried = np.flatnonzero(items[: n - least] == np.bincount(items).argmax()) + 1
        key = key[tried]
    order = key.argsort(kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    if size == 1:
        order = tried[order]
    here, before = order[1:][same], order[:-1][same]
    if not len(here):
        return none, none, none
    place = here.argsort()
    here, far = here[place], (here - before)[place]
    end, step = here + least, 8 // size
    todo = np.arange(len(here))
    for _ in range(3):  # eight bytes at a time, for most are short
        at = end[todo]
        apart = words[at] ^ words[at - far[todo]]
        low = apart & (~apart + np.uint64(1))
        end[todo] += np.where(apart == 0, step, np.log2(np.maximum(low, np.uint64(1))).astype(np.int64) // (8 * size))
        todo = todo[(apart == 0) & (at + 2 * step < n)]
        if not len(todo):
            break
    np.minimum(end, n, out=end)
    more = np.zeros(len(here), bool)
    more[todo] = True
    picked, until = [], 0
    for i, back, stop, longer in zip(here.tolist(), far.tolist(), end.tolist(), more.tolist()):
        if i < until or back > REACH:
            continue
        if longer:
            at, skip, step, most = size * stop, size * back, 64, size * min(n, i + 4096)
            while step >= size:
                if at + step <= most and raw[at : at + step] == raw[at - skip : at - skip + step]:
                    at += step
                    step *= 2
                else:
                    step //= 2
            stop = at // size
        picked.append((i, stop - i, back))
        until = stop
    start, length, far = np.array(picked, np.int64).reshape(-1, 3).T
    return start, length, far


#: Lengths and distances up to this are looked up.
LOOKED_UP = 1 << 13


@functools.cache
def _prefix_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _prefix_of(np.maximum(np.arange(LOOKED_UP + 1), 1))


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, extra bits and their number, of lengths or distances."""
    if len(values) and int(values.max()) <= LOOKED_UP:
        code, extra, more = _prefix_table()
        return code[values], extra[values], more[values]
    return _prefix_of(values)


def _prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = values - 1
    top = np.maximum(np.log2(np.maximum(v, 1)).astype(np.int64), 1)
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> (top - 1) & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


@functools.lru_cache(maxsize=64)
def _short_code(width: int) -> np.ndarray:
    """By distance: its short distance code in an image of that width, or 0."""
    near = np.array(_near(width))
    out = np.zeros(int(near.max()) + 1, np.int64)
    out[near[::-1]] = np.arange(len(near), 0, -1)
    return out


def _cache_hits(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in a colour cache, and whether the pixel is there when its turn comes."""
    key = (pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
    order = np.argsort(key, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return key.astype(np.int64), hit


def _put_pixels(bits: BitWriter, pixels: np.ndarray, width: int, main: bool, rest: tuple[int, int, int] | None = None) -> dict[str, int]:
    """Write an entropy-coded image; returns how often what was used.

    With ``rest``, pixels are bytes of the green channel, and all pixels have
    these values of red, blue and alpha.
    """
    if rest is None:
        channels = [(pixels >> np.uint32(s)).astype(np.uint8) for s in (8, 16, 0, 24)]
        if all(int(c.min()) == int(c.max()) for c in channels[1:]):
            pixels, rest = channels[0], tuple(int(c[0]) for c in channels[1:])
    green = pixels if rest is not None else channels[0]
    start, length, far = _matches(pixels)
    n, cache_bits = len(pixels), 0
    if len(start):
        edge = np.zeros(n + 1, np.int8)
        edge[start] = 1
        edge[start + length] -= 1
        inside = edge[:-1].cumsum(dtype=np.int8) > 0
        first = ~inside
        first[start] = True
        at = np.flatnonzero(first)
        ref = np.flatnonzero(inside[at])
        symbol = green[at].astype(np.int64)
        size_code, size_extra, size_more = _prefixed(length)
        symbol[ref] = 256 + size_code
        short = _short_code(width)
        known = short[np.minimum(far, len(short) - 1)] * (far < len(short))
        far_code, far_extra, far_more = _prefixed(np.where(known > 0, known, far + 120))
        far_counts = np.bincount(far_code, minlength=40)
    else:
        at, ref, symbol, far_counts = np.arange(n), start, green.astype(np.int64), np.zeros(40, np.int64)

    if rest is None:
        literal = np.ones(len(at), bool)
        literal[ref] = False
        spent = sum(_size(np.bincount(c[at[literal]], minlength=1)) for c in channels)
        for b in (4, 7, 10):
            key, hit = _cache_hits(pixels, b)
            hit = hit[at] & literal
            others = at[literal & ~hit]
            cost = _size(np.bincount(np.where(hit, 256 + key[at], green[at])[literal])) + sum(_size(np.bincount(c[others], minlength=1)) for c in channels[1:])
            if cost < spent:
                spent, cache_bits, cached = cost, b, (key, hit)
        if cache_bits:
            key, hit = cached
            symbol[hit] = 280 + key[at[hit]]
            literal &= ~hit
    bits.put(cache_bits > 0, 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)  # one group of codes

    codes = [_code_of(np.bincount(symbol, minlength=280 + (1 << cache_bits if cache_bits else 0)))]
    _put_code(bits, codes[0][0])
    if rest is None:
        codes += [_code_of(np.bincount(c[at[literal]], minlength=256)) for c in channels[1:]]
        for lengths, _, _ in codes[1:]:
            _put_code(bits, lengths)
    else:
        for value in rest:
            _put_single(bits, value)
    codes.append(_code_of(far_counts))
    _put_code(bits, codes[-1][0])
    values, widths = codes[0][1][symbol], codes[0][2][symbol]
    for c, (_, code, wide) in zip(channels[1:], codes[1:4]) if rest is None else ():
        if wide.any():
            own = c[at[literal]]
            values[literal] |= code[own] << widths[literal].astype(np.uint64)
            widths[literal] += wide[own]
    if len(ref):
        value, wide = values[ref], widths[ref]
        for more, bits_more in ((size_extra, size_more), (codes[-1][1][far_code], codes[-1][2][far_code]), (far_extra, far_more)):
            value |= more.astype(np.uint64) << wide.astype(np.uint64)
            wide = wide + bits_more
        values[ref], widths[ref] = value, wide
    bits.put_all(values, widths)
    uneven = sum(len(np.unique(wide[wide > 0])) > 1 for _, _, wide in codes)
    return {"back-reference": len(ref), "colour cache": int(cache_bits and hit.sum()), "prefix code": uneven}


def _minus(pixels: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Each channel less that of its prediction."""
    parts = pixels.view(np.uint8) - guess.view(np.uint8)
    return parts.view(np.uint32)


#: The predictions that the encoder tries, each for a whole image; and the bits a grey sample below which it tries none.
TRIED_MODES, HARD = (1, 2, 4), 5


def _residual(grid: np.ndarray, mode: int) -> np.ndarray:
    """Rows of pixels, each as one or four bytes, less what a mode predicts."""
    rest = grid.copy()
    rest[0, 1:] -= grid[0, :-1]
    rest[1:, 0] -= grid[:-1, 0]
    rest[1:, 1:] -= {1: grid[1:, :-1], 2: grid[:-1, 1:], 4: grid[:-1, :-1]}[mode]
    if grid.ndim == 3:
        rest[0, 0] -= np.array([0, 0, 0, 255], np.uint8)  # the first pixel follows opaque black
    return rest


def _colours_size(pixels: np.ndarray) -> float:
    return sum(_size(np.bincount((pixels >> np.uint32(s)).astype(np.uint8), minlength=1)) for s in (0, 8, 16, 24))


def _best_factor(of: np.ndarray, by: np.ndarray) -> int:
    """The cross-colour factor by which one channel follows another, from a least-squares fit."""
    x, y = _signed(by).astype(float), _signed(of).astype(float)
    spread = float(((x - x.mean()) ** 2).sum())
    slope = float(((x - x.mean()) * (y - y.mean())).sum()) / spread if spread else 0.0
    return max(-128, min(127, round(32 * slope)))


def _cross(pixels: np.ndarray) -> tuple[np.ndarray, int]:
    """The pixels without what green tells of red and blue, and red of blue; and the factors as one pixel."""
    red, green, blue = (pixels >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0))
    delta = lambda factor, colour: factor * _signed(colour) >> 5
    to_red, to_blue = _best_factor(red, green), _best_factor(blue, green)
    rest = (blue.astype(np.int64) - delta(to_blue, green) & 255).astype(np.uint32)
    from_red = _best_factor(rest, red)
    rest = rest - delta(from_red, red) & 255
    less = red.astype(np.int64) - delta(to_red, green) & 255
    out = pixels & np.uint32(0xFF00FF00) | less.astype(np.uint32) << np.uint32(16) | rest.astype(np.uint32)
    return out, OPAQUE | (from_red & 255) << 16 | (to_blue & 255) << 8 | to_red & 255


def _riff(data: bytes) -> bytes:
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


class ImageWriter:
    """Writes one image, and notes which of the format's tools it uses."""

    def __init__(self, width: int, height: int):
        self.bits, self.used, self.width, self.height = BitWriter(), {}, width, height
        self.bits.put(0x2F | width - 1 << 8 | height - 1 << 22 | 1 << 36, 40)

    def transform(self, kind: int, name: str) -> None:
        self.bits.put(1 | kind << 1, 3)
        self.used[name] = 1

    def one_block(self, kind: int, name: str, pixel: int) -> None:
        """A transform with one pixel of parameters for the whole image."""
        self.transform(kind, name)
        across, down = -(-self.width >> 9), -(-self.height >> 9)
        self.bits.put(7, 3)
        _put_pixels(self.bits, np.full(across * down, pixel, np.uint32), across, False)

    def palette(self, colours: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, int]:
        """The table of colours; returns the packed indices and their width."""
        self.transform(PALETTE, "palette")
        self.bits.put(len(colours) - 1, 8)
        _put_pixels(self.bits, _minus(colours, np.append(np.uint32(0), colours[:-1])), len(colours), False)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index = np.pad(index.reshape(self.height, -1).astype(np.uint8), ((0, 0), (0, -self.width % (1 << packed)))).reshape(self.height, -1, 1 << packed)
        index = (index << (np.arange(1 << packed, dtype=np.uint8) * (8 >> packed))).sum(axis=2, dtype=np.uint8)
        return index.ravel(), index.shape[1]

    def finish(self, pixels: np.ndarray, width: int, rest: tuple[int, int, int] | None = None) -> tuple[bytes, dict[str, int]]:
        self.bits.put(0, 1)
        self.used |= _put_pixels(self.bits, pixels, width, True, rest)
        return _riff(self.bits.bytes()), self.used


def encode_grey(samples: np.ndarray) -> tuple[bytes, dict[str, int]]:
    """encode_image() for opaque grey pixels, given as rows of bytes."""
    height, width = samples.shape
    image, flat = ImageWriter(width, height), np.ascontiguousarray(samples, np.uint8).ravel()
    counts = np.bincount(flat, minlength=256)
    found = np.flatnonzero(counts)
    if len(found) <= 16:
        place = np.zeros(256, np.uint8)
        place[found] = np.arange(len(found))
        return image.finish(*image.palette(found.astype(np.uint32) * np.uint32(0x010101) + np.uint32(OPAQUE), place[flat]), (0, 0, 255))
    plain, alpha = _size(counts), 255
    if plain > HARD * len(flat):
        best, mode = min((_size(np.bincount(_residual(samples, m).ravel(), minlength=256)), m) for m in TRIED_MODES)
        if best + 64 < plain:
            image.one_block(PREDICT, "predictor", mode << 8 | OPAQUE)
            flat, alpha = _residual(samples, mode).ravel(), 0
    image.transform(GREEN, "subtract green")
    return image.finish(flat, width, (0, 0, alpha))


def encode_image(pixels: np.ndarray) -> tuple[bytes, dict[str, int]]:
    """A WebP file of height rows of ARGB pixels, and how often each of the format's tools was used."""
    height, width = pixels.shape
    pixels = np.ascontiguousarray(pixels, np.uint32)
    green = (pixels >> np.uint32(8)).astype(np.uint8)
    if (pixels == green * np.uint32(0x010101) + np.uint32(OPAQUE)).all():
        return encode_grey(green)
    image, flat = ImageWriter(width, height), pixels.ravel()
    colours, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
    plain = _colours_size(flat)
    if len(colours) <= 16 or len(colours) <= 256 and _size(counts) + 24 * len(colours) < plain:
        return image.finish(*image.palette(colours, index), (0, 0, 255))
    bytes_of = pixels.view(np.uint8).reshape(height, width, 4)
    tried = {m: np.ascontiguousarray(_residual(bytes_of, m)).view(np.uint32).ravel() for m in TRIED_MODES}
    best, mode = min((_colours_size(rest), m) for m, rest in tried.items())
    if best + 64 < plain:
        image.one_block(PREDICT, "predictor", mode << 8 | OPAQUE)
        flat, plain = tried[mode], best
    crossed, factors = _cross(flat)
    less, other = _colours_size(_less_green(flat)), _colours_size(crossed) + 64
    if less <= min(other, plain):
        image.transform(GREEN, "subtract green")
        flat = _less_green(flat)
    elif other < plain:
        image.one_block(CROSS, "cross-colour", factors)
        flat = crossed
    return image.finish(flat, width)


def _less_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    return _minus(pixels, green * np.uint32(0x010001))


def encode_pixels(image: np.ndarray) -> bytes:
    return encode_image(image)[0]


ROW, TILE = 64, 64 * SIDE


def grey(payload: bytes) -> list[np.ndarray]:
    """A payload of a multiple of 64 bytes as the samples of grey images of 64 pixels a row, at most 1 MiB each."""
    if len(payload) % ROW:
        raise ValueError(f"a payload is whole rows of {ROW} bytes")
    return [np.frombuffer(payload[s : s + TILE], np.uint8).reshape(-1, ROW) for s in range(0, len(payload), TILE)]


def encode_payload(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as WebP files, one after another."""
    return b"".join(encode_grey(samples)[0] for samples in grey(payload))


def payload_of(images: list[np.ndarray]) -> bytes:
    """The bytes of the pixels, as encode_payload() took them."""
    return b"".join((p >> np.uint32(8)).astype(np.uint8).tobytes() for p in images)
