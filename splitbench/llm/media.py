"""Media columns: texts stored as lossless WebP, decoded to pixel arrays and described.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are
the 8-bit samples of grey images of 64 pixels a row; above 1 MiB a text takes
several images, stored one after another.

Defined cases: a null or empty text is 64 zero bytes; texts of any length are
stored whole; equal texts give equal media; a null in a media column gives null
pixels, broken bytes raise WebpError; repeated rows are stored alike; an empty
table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbered, on_path
from .webp import decode_all, encode_payload, payload_of

IMAGES = "array<struct<width int, height int, pixels binary>>"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def _encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([encode_payload(payload(t)) for t in batch.to_pylist()], pa.binary())


def _decode(media: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))
    for batch in media:
        rows = []
        for m in batch:
            images = None if not m.is_valid else decode_all(m.as_py())
            rows.append(images and [{"width": p.shape[1], "height": p.shape[0], "pixels": p.astype(">u4").tobytes()} for p in images])
        yield pa.array(rows, kind)


LEVELS = np.arange(256)


def feature(samples: np.ndarray) -> str:
    """Mean and spread of the samples, and which of 64 equal parts lie above the mean; from whole numbers throughout."""
    n, counts = len(samples), np.bincount(samples, minlength=256)
    total, squares = int(counts @ LEVELS), int(counts @ (LEVELS * LEVELS))
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = int.from_bytes(np.packbits(parts * 64 > total).tobytes(), "big")
    return f"mean={total / n:.4f};std={math.sqrt(n * squares - total * total) / n:.4f};parts={bits:016x}"


DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(media: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [f.split()[0] for f in DESCRIBED.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.string() for f in DESCRIBED.split(", ")]
    for batch in media:
        rows = []
        for stored in batch.to_pylist():
            raw = payload_of(decode_all(stored))
            rows.append(
                (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(raw, np.uint8)))
            )
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def stored(text: Column | str) -> Column:
    """The WebP bytes of a text."""
    return F.arrow_udf(_encode, "binary")(text)


def images(media: Column | str) -> Column:
    """The images of WebP bytes: width, height and big-endian ARGB pixels."""
    return F.arrow_udf(_decode, IMAGES)(media)


def described(media: Column | str) -> Column:
    """What the stored bytes decode to, as sizes, digests and features."""
    return F.arrow_udf(_describe, DESCRIBED)(media)


def _add(df: DataFrame, source: str, make, to: str) -> DataFrame:
    on_path(df.sparkSession)
    own = Numbered(df)
    return own.restore(own.df.withColumn(to, make(own.place(source))), to)


def store_texts(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """df with the texts stored in a media column."""
    return _add(df, text, stored, to)


def decode_media(df: DataFrame, media: str = "media", to: str = "images") -> DataFrame:
    """df with the media column's pixel arrays."""
    return _add(df, media, images, to)


def describe_media(df: DataFrame, media: str = "media", to: str = "described") -> DataFrame:
    """df with sizes, digests and features of what the media column decodes to."""
    return _add(df, media, described, to)
