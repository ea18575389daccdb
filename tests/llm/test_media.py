import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from splitbench.llm import media, webp
from splitbench.llm.queries import op6_media_columns

from .conftest import PROSE
from .webp_slow import slow_decode
from .webp_writer import write

LOREM = " ".join(PROSE.values())
P, C, G, I = webp.PREDICT, webp.CROSS, webp.GREEN, webp.PALETTE


def picture(width, height, colours, seed):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint64)
    rows = table[rng.integers(0, colours, (height, width))]
    rows[height // 2 :, : width // 2] = rows[: height - height // 2, : width // 2]
    rows[0, :] = rows[0, 0]
    return [int(p) for p in rows.ravel()]


@pytest.mark.parametrize("transforms", [(), (G,), (P,), (C,), (P, C), (P, C, G), (G, P), (I,), (I, P), (C, G, P)])
@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("group_bits", [0, 2])
def test_decoder_knows_the_whole_format(transforms, cache_bits, group_bits):
    for seed, (w, h, colours) in enumerate([(1, 1, 1), (5, 3, 2), (17, 9, 4), (23, 11, 14), (40, 21, 200)]):
        pixels = picture(w, h, colours, seed)
        data = write(pixels, w, transforms, cache_bits, group_bits, seed)
        assert webp.decode(data).ravel().tolist() == pixels


def test_predictions_by_hand():
    left, top, right, corner = 0x10203040, 0x20304050, 0x01020304, 0x0A0B0C0D
    byte = lambda x, s: x >> s & 255
    each = lambda f: sum(f(*(byte(v, s) for v in (left, top, right, corner))) << s for s in (0, 8, 16, 24))
    clamp = lambda v: max(0, min(255, v))
    want = {
        0: webp.OPAQUE, 1: left, 2: top, 3: right, 4: corner,
        5: each(lambda l, t, r, c: ((l + r) // 2 + t) // 2),
        6: each(lambda l, t, r, c: (l + c) // 2), 7: each(lambda l, t, r, c: (l + t) // 2),
        8: each(lambda l, t, r, c: (c + t) // 2), 9: each(lambda l, t, r, c: (t + r) // 2),
        10: each(lambda l, t, r, c: ((l + c) // 2 + (t + r) // 2) // 2), 11: top,
        12: each(lambda l, t, r, c: clamp(l + t - c)),
        13: each(lambda l, t, r, c: clamp((l + t) // 2 + int(((l + t) // 2 - c) / 2))),
    }
    for mode, value in want.items():
        assert webp.predicted(mode, left, top, right, corner) == value, mode


def test_short_distances_are_all_places_near_by():
    """Seven rows up, eight columns left of here or seven right of it; in this row to the left only."""
    near = {(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0}
    assert set(webp.SHORT_DISTANCES) == near and len(webp.SHORT_DISTANCES) == 120 == len(near)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=600), st.integers(1, 256))
def test_payloads_survive(raw, limit):
    raw = bytes(b % limit for b in raw)
    raw += bytes(-len(raw) % 64)
    assert webp.payload_of(webp.decode_all(webp.encode_payload(raw))) == raw


def test_payload_above_one_tile():
    raw = np.random.default_rng(1).integers(0, 200, (1 << 20) + 128, dtype=np.uint8).tobytes()
    stored = webp.encode_payload(raw)
    assert len(webp.decode_all(stored)) == 2 and webp.payload_of(webp.decode_all(stored)) == raw


def test_broken_bytes():
    good = webp.encode_payload(bytes(64))
    for bad in (good[:10], b"RIFF" + bytes(20), good[:-3], good[:12] + b"VP8 " + good[16:]):
        with pytest.raises(webp.WebpError):
            webp.decode(bad)


def test_query_and_operators(spark, odd, clashing, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_media_columns(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.doc_id is not None:
            raw = media.payload(texts[r.doc_id])
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
            assert r.n_bytes == len((texts[r.doc_id] or "").encode())
    stored = media.decode_media(media.store_texts(clashing)).first()
    assert stored.images[0].width == 64 and bytes(stored.images[0].pixels)[2::4] == media.payload(stored.text)
    assert media.describe_media(media.store_texts(empty)).count() == 0


def test_encoder_chooses_tools_by_size_and_two_decoders_agree(spark, sf_dir):
    """Each tool is used where it shrinks the image; a slow decoder of its own reads the same pixels."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    samples = [i for t in [*texts, "", "abab" * 99, "0123456789" * 7, LOREM] for i in webp.grey(media.payload(t))]
    images = [x * np.uint32(0x010101) + np.uint32(webp.OPAQUE) for x in samples]
    ramp = np.add.outer(np.arange(40), 3 * np.arange(50)).astype(np.uint32) & 255
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, (40, 50)).astype(np.uint32)
    followed = rng.integers(0, 120, (40, 50)).astype(np.uint32)
    images += [
        ramp * np.uint32(0x010101) | np.uint32(webp.OPAQUE),
        noise << 16 | ramp << 8 | np.uint32(webp.OPAQUE),
        noise | followed << 8 | followed * 3 // 4 + 20 << 16 | np.uint32(webp.OPAQUE),
        rng.integers(0, 1 << 32, 300, dtype=np.uint32)[rng.integers(0, 300, (90, 90))],
        rng.integers(0, 1 << 32, (3, 5), dtype=np.uint32),
    ]
    seen, stored, raw = {}, 0, 0
    for k, image in enumerate(images):
        data, used = webp.encode_image(image)
        if k < 40 or k > len(texts):
            assert (slow_decode(data) == image).all()
        assert (webp.decode(data) == image).all()
        if k < len(texts):
            stored, raw = stored + len(data), raw + image.size
            for name, n in used.items():
                seen[name] = seen.get(name, 0) + (n > 0)
        else:
            for name, n in used.items():
                seen[f"any {name}"] = seen.get(f"any {name}", 0) + (n > 0)
    assert stored < 0.6 * raw
    assert min(seen[n] for n in ("prefix code", "back-reference")) > 0.8 * len(texts) and seen["subtract green"] > 0
    assert all(seen.get(f"any {n}") for n in ("prefix code", "back-reference", "colour cache", "palette", "predictor", "subtract green", "cross-colour")), seen


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.integers(1, 15))
def test_prefix_codes_are_optimal_within_their_limit(counts, limit):
    counts = [c + 1 for c in counts]
    if 1 << limit < len(counts):
        return
    lengths = webp.huffman_lengths(counts, limit)
    if len(counts) > 1:
        assert sum(2.0**-n for n in lengths) == 1 and max(lengths) <= limit
    if limit == 15 and len(counts) <= 14:  # no code is longer than that: Huffman's cost is the sum of all joined weights
        import heapq

        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert sum(c * n for c, n in zip(counts, lengths)) == cost or len(counts) == 1


def test_long_payloads_and_skewed_codes():
    fib = [1, 1]
    while len(fib) < 24:
        fib.append(fib[-1] + fib[-2])
    rng = np.random.default_rng(2)
    skewed = np.repeat(np.arange(24, dtype=np.uint8), fib)
    rng.shuffle(skewed)
    for raw in (skewed.tobytes(), b"word " * 60_000, bytes(200_000), LOREM.encode() * 3000):
        raw += bytes(-len(raw) % 64)
        assert webp.payload_of(webp.decode_all(webp.encode_payload(raw))) == raw


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=64, max_size=640))
def test_features_match_floating_point(raw):
    samples = np.frombuffer(raw[: len(raw) // 64 * 64], np.uint8)
    said = dict(x.split("=") for x in media.feature(samples).split(";"))
    assert abs(float(said["mean"]) - samples.mean()) < 1e-4 and abs(float(said["std"]) - samples.std()) < 1e-4
    above = [sum(map(int, part)) * 64 > sum(map(int, samples)) for part in samples.reshape(64, -1)]
    assert int(said["parts"], 16) == int("".join(map(str, map(int, above))), 2)
