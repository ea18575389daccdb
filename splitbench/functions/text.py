"""Checks and conversions of identifiers, metadata, numbers and dates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stable identifiers and metadata keys look like.
STABLE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._:+-]{0,254}\z"
METADATA_KEY = r"\A[A-Za-z][A-Za-z0-9_.-]{0,63}\z"


def is_stable_id(value: Column) -> Column:
    return F.coalesce(value.rlike(STABLE_ID), F.lit(False))


def is_one_line(value: Column) -> Column:
    return ~value.rlike("[\\x00\\n\\r]")


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first value that is not blank: a rank or else its alias."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def iso_date(value: Column) -> Column:
    """A YYYY-MM-DD text as a date; blank or anything else is null."""
    return F.when(F.trim(value).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.trim(value).try_cast("date"))


def canonical_int(value: Column) -> Column:
    """A long if the text is its canonical decimal form, else null."""
    n = value.try_cast("long")
    return F.when(n.cast("string") == value, n)


def fraction(value: Column) -> Column:
    """A finite double in [0, 1], else null."""
    x = F.trim(value).try_cast("double")
    return F.when(~F.isnan(x) & x.between(0.0, 1.0), x)


def sorted_map_json(value: Column) -> Column:
    """A map as compact JSON in key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def _floats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(["" if v is None else repr(v) for v in batch.to_pylist()], pa.string())


def float_text(value: Column) -> Column:
    """The shortest decimal text that reads back equal; null is empty."""
    return F.arrow_udf(_floats, "string")(value.cast("double"))


def _folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if v is None else v.casefold() for v in batch.to_pylist()], pa.string())


def casefold(value: Column) -> Column:
    """Full Unicode case folding, in vectorised Python; lower() is enough for ASCII."""
    return F.arrow_udf(_folded, "string")(value)
