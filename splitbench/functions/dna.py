"""Nucleotide sequences as column functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC nucleotide letters and their complements.
IUPAC = "ACGTRYSWKMBDHVN"
COMPLEMENT = "TGCAYRSWMKVHDBN"


def normalize(sequence: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(sequence, r"\s", ""))


def invalid_position(sequence: Column) -> Column:
    """1-based position of the first character that is no IUPAC letter or blank; 0 if all are, null-safe."""
    return F.regexp_instr(sequence, F.lit(rf"[^{IUPAC}{IUPAC.lower()}\s]"))


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), IUPAC, COMPLEMENT)


def canonical(sequence: Column) -> Column:
    """The smaller of a linear sequence and its reverse complement."""
    return F.least(sequence, reverse_complement(sequence))


def least_rotation_native(sequence: Column) -> Column:
    """The least rotation by listing all: for short sequences only, it takes quadratic space."""
    rotations = F.transform(F.sequence(F.lit(1), F.length(sequence)), lambda i: F.concat(F.substr(sequence, i), F.substr(sequence, F.lit(1), i - 1)))
    return F.when(F.length(sequence) > 1, F.array_min(rotations)).otherwise(sequence)


def least_rotation_start(s: str) -> int:
    """Where the least rotation starts, in linear time: two candidates race, the loser skips what it lost by."""
    n, i, j, k = len(s), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = s[(i + k) % n], s[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    return min(i, j)


def _rotated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            at = least_rotation_start(s) if s else 0
            out.append(s and s[at:] + s[:at])
        yield pa.array(out, pa.string())


def least_rotation(sequence: Column) -> Column:
    """The least rotation in linear time, in vectorised Python."""
    return F.arrow_udf(_rotated, "string")(sequence)


def canonical_circular(sequence: Column, native: bool = False) -> Column:
    """The smaller of the least rotations of both strands."""
    rotate = least_rotation_native if native else least_rotation
    return F.least(rotate(sequence), rotate(reverse_complement(sequence)))


def count_of(sequence: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(sequence, f"[^{letters}]", "")).cast("long")


def ambiguous_count(sequence: Column) -> Column:
    return F.length(F.regexp_replace(sequence, "[ACGT]", "")).cast("long")


def ambiguous_fraction(sequence: Column) -> Column:
    return ambiguous_count(sequence) / F.length(sequence)


def slice_forward(sequence: Column, start: Column, length: Column) -> Column:
    """length letters from a 0-based start, running past the origin of a circular sequence."""
    return F.when(start + length <= F.length(sequence), F.substr(sequence, start + 1, length)).otherwise(
        F.substr(F.concat(sequence, sequence), start + 1, length)
    )
