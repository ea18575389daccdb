"""FASTA files as a DataFrame of sequences, with the place of every fault."""

from __future__ import annotations

import gzip
import io
import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, require_empty
from ..functions import dna
from ..session import materialize

SUFFIXES = (".fa", ".fasta", ".fna", ".fa.gz", ".fasta.gz", ".fna.gz")
NO_LETTER = re.compile(f"[^{dna.IUPAC}]")
SCHEMA = "source_path string, line long, sequence_id string, description string, sequence string, error string"


def discover(paths: list[str]) -> list[str]:
    """The FASTA files at and below paths: symlinks resolved, without repeats, sorted."""
    found = set()
    for p in map(Path, paths):
        if p.is_dir():
            found |= {f.resolve() for d, _, names in os.walk(p) for n in names if n.lower().endswith(SUFFIXES) for f in [Path(d) / n]}
        elif not p.exists():
            raise InputError(f"no such file: {p}")
        elif not p.name.lower().endswith(SUFFIXES):
            raise InputError(f"not a FASTA file: {p}")
        else:
            found.add(p.resolve())
    return sorted(map(str, found))


def parse(path: str, content: bytes) -> Iterator[tuple]:
    """Records of a file, or a row whose error says what is wrong and where; the text is unpacked and read line by line.

    The fault of a record without a sequence names the record; its sequence is
    empty, or null if no line follows the header.
    """
    fault = lambda line, what: (path, line, None, None, None, f"{path}:{line}: {what}")
    raw = io.BytesIO(content)
    lines = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.lower().endswith(".gz") else raw, "utf-8", newline="\n")
    head, parts, at, number, follows = None, [], 0, 0, False

    def record():
        return (path, at, *head, "".join(parts), None) if parts else (path, at, *head, "" if follows else None, f"{path}:{at}: record {head[0]} has no sequence")

    try:
        for number, line in enumerate(lines, 1):
            line = line.rstrip("\r\n")
            if not line.strip():
                follows = True
                continue
            if line[0] == ">":
                if head:
                    yield record()
                ident, _, description = line[1:].strip().partition(" ")
                head, parts, at, follows = (ident, description.strip()), [], number, False
                if not ident:
                    yield fault(number, "a header has no identifier")
                    return
                continue
            if head is None:
                yield fault(number, "sequence before the first header")
                return
            piece = "".join(line.split()).upper()
            bad = NO_LETTER.search(piece)
            if bad:
                yield fault(number, f"{bad.group()!r} at position {bad.start() + 1} is no nucleotide letter")
                return
            parts.append(piece)
    except (OSError, EOFError, zlib.error, UnicodeDecodeError) as error:
        yield fault(0, f"cannot be read: {error}")
        return
    yield record() if head else fault(0, "no record")


#: Letters of sequence that a batch of records holds at most, but for one record.
BATCH_LETTERS = 8 << 20


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows, held = [], 0
            for row in parse(path.removeprefix("file:"), bytes(content)):
                rows.append(row)
                held += len(row[4] or "")
                if held >= BATCH_LETTERS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of SCHEMA for all records of the files; one task reads a file, as gzip demands."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_parse_files, SCHEMA)


#: Plain files above this size are split among tasks; their faults name file and record, not the line.
LARGE = 256 << 20


def read(spark: SparkSession, paths: list[str], large: int = LARGE) -> DataFrame:
    """Checked records: source_path, sequence_id, description, sequence."""
    files = discover(paths)
    split = [f for f in files if not f.lower().endswith(".gz") and Path(f).stat().st_size > large]
    for f in split:
        with open(f, "rb") as file:
            if file.read(1 << 16).lstrip()[:1] != b">":
                raise InputError(f"{f}: sequence before the first header")
    found = [scan(spark, whole)] if (whole := [f for f in files if f not in set(split)]) else []
    found += [checked_large(spark, split)] if split else []
    rows = materialize(reduce(DataFrame.unionByName, found), "records")
    if rows.select("source_path").distinct().count() < len(files):  # empty files give no row at all
        raise InputError("a FASTA file has no record")
    require_empty(rows.where("error is not null").select("error"), "malformed FASTA")
    place = F.concat_ws(":", "source_path", "line")
    twice = rows.groupBy("sequence_id").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("n > 1")
    require_empty(twice, "sequence identifiers repeat")
    return rows.select("source_path", "sequence_id", "description", "sequence")


def scan_large(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Plain FASTA split at headers by the text reader: any number of tasks per file, without line numbers."""
    records = spark.read.text(path, lineSep="\n>").where("trim(value) <> ''")
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(body, r"^([^\n\r]*)", 1)
    sequence = F.upper(F.regexp_replace(F.substr(body, F.length(head) + 1), r"\s", ""))
    source = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return records.select(
        F.regexp_extract(head, r"^(\S+)", 1).alias("sequence_id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), sequence.alias("sequence"), source.alias("source_path")
    )


def checked_large(spark: SparkSession, paths: list[str]) -> DataFrame:
    """scan_large() as rows of SCHEMA, with the faults of each record."""
    rows = scan_large(spark, paths)
    bad = dna.invalid_position(F.col("sequence"))
    ident = F.col("sequence_id")
    fault = (
        F.when(ident == "", F.concat("source_path", F.lit(": a header has no identifier")))
        .when(F.col("sequence") == "", F.concat(F.col("source_path"), F.lit(": record "), ident, F.lit(" has no sequence")))
        .when(bad > 0, F.concat(F.col("source_path"), F.lit(": record "), ident, F.lit(": '"), F.substr("sequence", bad, F.lit(1)), F.lit("' is no nucleotide letter")))
    )
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return rows.withColumn("line", F.lit(None).cast("long")).withColumn("error", fault).select(*[F.col("source_path") if n == names[0] else F.col(n) for n in names])


