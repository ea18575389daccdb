"""Seeded, row-order-free pseudo-randomness and content digests.

Two profiles: the native one is SHA-256 in built-in functions; the other is
keyed BLAKE2b in vectorised Python.  Both rank by a hash of what a row is, never
by where it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first part of every digest header; set another to reproduce digests made under it.
DOMAIN = "SPLITBENCH"


def semantic_rank(seed: int | Column, namespace: str | Column, value: Column) -> Column:
    """A sortable hash of (seed, namespace, value) as 64 hex digits.

    The value comes last, so a separator inside it cannot imitate another triple.
    """
    part = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(str(x))
    return F.sha2(F.concat_ws("|", part(seed), part(namespace), value.cast("string")), 256)


def draw(hashed: Column) -> Column:
    """60 bits of a hex hash as a non-negative long."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def unit(hashed: Column) -> Column:
    """A hex hash as a double in [0, 1)."""
    return draw(hashed) / F.lit(float(1 << 60))


def _header(kind: str) -> Column:
    return F.encode(F.lit(kind), "UTF-8")


def _count(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def sequence_digest(canonical: Column, circular: Column | bool, domain: str = DOMAIN) -> Column:
    """SHA-256 of a canonical sequence with its topology and length."""
    circular = F.lit(circular) if isinstance(circular, bool) else circular
    kind = F.when(circular, F.lit("circular\0")).otherwise(F.lit("linear\0"))
    return F.sha2(F.concat(_header(f"{domain}-CONTIG-SHA256-v2\0"), F.encode(kind, "UTF-8"), _count(F.length(canonical)), F.encode(canonical, "UTF-8")), 256)


def multiset_digest(digests: Column, kind: str = "GENOME-SHA256-v2", domain: str = DOMAIN) -> Column:
    """SHA-256 over an array of hex digests as a multiset: order counts for nothing, copies count."""
    ordered = F.sort_array(digests)
    return F.sha2(F.concat(_header(f"{domain}-{kind}\0"), _count(F.size(ordered)), F.unhex(F.array_join(ordered, ""))), 256)


def genome_digest(digest: Column, domain: str = DOMAIN) -> Column:
    """Aggregate: the digest of a genome from its contigs' digests."""
    return multiset_digest(F.collect_list(digest), domain=domain)


def topology_agnostic_digest(linear_digest: Column, domain: str = DOMAIN) -> Column:
    """Aggregate: like genome_digest, over digests that treat every contig as linear."""
    return multiset_digest(F.collect_list(linear_digest), "TOPOLOGY-AGNOSTIC-GENOME-SHA256-v1", domain)


def group_id(digest: Column) -> Column:
    return F.concat(F.lit("sha256:"), digest)


def derive_seed(seed: int, *parts: int | str, person: bytes = b"splitbench.seed") -> int:
    """A 128-bit seed from typed, length-prefixed parts: 1 and "1" differ."""
    h = hashlib.blake2b(digest_size=16, person=person)
    for part in (seed, *parts):
        if isinstance(part, bool) or not isinstance(part, int | str):
            raise TypeError("parts are integers or strings")
        raw = str(part).encode()
        h.update((b"i" if isinstance(part, int) else b"s") + len(raw).to_bytes(8, "big") + raw)
    return int.from_bytes(h.digest(), "big")


def _elementwise(f: Callable[[str], str]) -> Callable:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else f(v) for v in batch.to_pylist()], pa.string())

    return run


def blake2_hex(text: Column, size: int, person: bytes) -> Column:
    """BLAKE2b of the text as hex, in vectorised Python."""
    return F.arrow_udf(_elementwise(lambda v: hashlib.blake2b(v.encode(), digest_size=size, person=person).hexdigest()), "string")(text)


def semantic_rank_blake2(seed: int, namespace: str, value: Column, person: bytes = b"splitbench-v1") -> Column:
    return blake2_hex(F.concat_ws("\0", F.lit("v1"), F.lit(str(seed)), F.lit(namespace), value.cast("string")), 16, person)


def kmer_hash_blake2(kmer: Column, person: bytes = b"splitbenchk") -> Column:
    return blake2_hex(kmer, 8, person)


def kmer_hash(kmer: Column) -> Column:
    """A 64-bit k-mer hash as 16 hex digits, which sort as the numbers do."""
    return F.substring(F.sha2(kmer, 256), 1, 16)


def number(hashed: Column) -> Column:
    """A hash of 16 hex digits as a long; numbers sort as the digits do."""
    return F.conv(hashed, 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def number_hex(value: Column) -> Column:
    """The 16 hex digits of number()."""
    return F.lower(F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
