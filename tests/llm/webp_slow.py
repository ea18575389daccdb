"""A slow decoder of lossless WebP, bit by bit and pixel by pixel, for images of one group of codes."""

import numpy as np

from splitbench.llm import webp


class Tape:
    def __init__(self, data):
        self.bits = "".join(f"{b:08b}"[::-1] for b in data)
        self.at = 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at][::-1] or "0", 2)


def code(tape, size):
    """Strings of bits to symbols."""
    if tape.take(1):
        two, wide = tape.take(1), tape.take(1)
        first = tape.take(8 if wide else 1)
        return {"0": first, "1": tape.take(8)} if two else {"": first}
    lengths = [0] * 19
    for k in range(4 + tape.take(4)):
        lengths[webp.CODE_LENGTH_ORDER[k]] = tape.take(3)
    outer = strings(lengths)
    left = 2 + tape.take(2 + 2 * tape.take(3)) if tape.take(1) else 10**9
    out, last = [], 8
    while len(out) < size and left:
        left -= 1
        s = symbol(tape, outer)
        if s < 16:
            out.append(s)
            last = s or last
        elif s == 16:
            out += [last] * (3 + tape.take(2))
        else:
            out += [0] * (3 + tape.take(3) if s == 17 else 11 + tape.take(7))
    return strings(out)


def strings(lengths):
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {"": used[0][1]}
    out, value, last = {}, 0, 0
    for n, s in used:
        value <<= n - last
        last = n
        out[f"{value:0{n}b}"] = s
        value += 1
    return out


def symbol(tape, table):
    so_far = ""
    while so_far not in table:
        so_far += tape.bits[tape.at]
        tape.at += 1
    return table[so_far]


def number(tape, s):
    if s < 4:
        return s + 1
    extra = s // 2 - 1
    return (2 + s % 2) * 2**extra + tape.take(extra) + 1


def pixels(tape, width, height, main):
    cache_bits = tape.take(4) if tape.take(1) else 0
    if main:
        assert not tape.take(1)
    codes = [code(tape, n) for n in (280 + (2**cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    out, cache = [], {}
    while len(out) < width * height:
        s = symbol(tape, codes[0])
        before = len(out)
        if s < 256:
            r, b, a = (symbol(tape, c) for c in codes[1:4])
            out.append((a, r, s, b))
        elif s < 280:
            n = number(tape, s - 256)
            far = number(tape, symbol(tape, codes[4]))
            if far <= 120:
                x, y = webp.SHORT_DISTANCES[far - 1]
                far = max(1, x + y * width)
            else:
                far -= 120
            for _ in range(n):
                out.append(out[len(out) - far])
        else:
            out.append(cache[s - 280])
        if cache_bits:
            for p in out[before:]:
                cache[(int.from_bytes(bytes(p)) * webp.CACHE_FACTOR) % 2**32 >> 32 - cache_bits] = p
    return out


def signed(x):
    return x - 256 if x > 127 else x


def slow_decode(data):
    tape = Tape(data[20:])
    assert tape.take(8) == 0x2F
    full, height = tape.take(14) + 1, tape.take(14) + 1
    tape.take(4)
    undo, width = [], full
    while tape.take(1):
        kind = tape.take(2)
        if kind in (0, 1):
            block = 2 ** (tape.take(3) + 2)
            undo.append((kind, width, block, pixels(tape, -(-width // block), -(-height // block), False)))
        elif kind == 2:
            undo.append((2, width, 0, None))
        else:
            n = tape.take(8) + 1
            table, last = [], (0, 0, 0, 0)
            for p in pixels(tape, n, 1, False):
                last = tuple((a + b) % 256 for a, b in zip(p, last))
                table.append(last)
            per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
            undo.append((3, width, per, table))
            width = -(-width // per)
    out = pixels(tape, width, height, True)
    for kind, w, x, table in reversed(undo):
        across = -(-w // x) if x else 0
        if kind == 2:
            out = [(a, (r + g) % 256, g, (b + g) % 256) for a, r, g, b in out]
        elif kind == 1:
            new = []
            for i, (a, r, g, b) in enumerate(out):
                _, rb, gb, gr = table[(i // w // x) * across + i % w // x]
                r = (r + (signed(gr) * signed(g) >> 5)) % 256
                new.append((a, r, g, (b + (signed(gb) * signed(g) >> 5) + (signed(rb) * signed(r) >> 5)) % 256))
            out = new
        elif kind == 0:
            new = []
            for i, p in enumerate(out):
                mode = table[(i // w // x) * across + i % w // x][2]
                if i < w:
                    guess = new[i - 1] if i else (255, 0, 0, 0)
                elif i % w == 0:
                    guess = new[i - w]
                else:
                    guess = new[{1: i - 1, 2: i - w, 4: i - w - 1}[mode]]
                new.append(tuple((u + v) % 256 for u, v in zip(p, guess)))
            out = new
        else:
            rows = -(-w // x)
            out = [table[out[y * rows + c // x][2] >> (c % x) * (8 // x) & 2 ** (8 // x) - 1] for y in range(height) for c in range(w)]
    return np.array([int.from_bytes(bytes(p)) for p in out], np.uint32).reshape(height, full)
