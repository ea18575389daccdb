"""Deterministic files: FASTA, TSV, JSON, checksums, and a directory that appears at once or not at all."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .errors import IntegrityError, InputError

WIDTH = 80
CHECKSUMS, MARKER, EXECUTION = "checksums.sha256", ".splitbench-bundle", "execution.json"
LAYOUT = "urn:splitbench:bundle:1"
#: Of gzip. At 9 it takes 40 times as long for four-letter text, to save 8 % of the bytes.
GZIP_LEVEL = 4
#: Bytes of a file that executors hand to the driver at once, but for one row.
PART_BYTES = 1 << 20


def cell(value) -> str:
    """A value as TSV text: null is empty, floats read back equal, maps and lists are compact JSON."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, dict | list):
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return str(value)


def tsv_lines(rows: Iterable, columns: list[str]) -> Iterator[bytes]:
    buffer = io.StringIO()
    writer = csv.writer(buffer, delimiter="\t", lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    for row in [columns, *()]:
        writer.writerow(row)
    yield buffer.getvalue().encode()
    for row in rows:
        buffer.seek(0)
        buffer.truncate()
        writer.writerow([cell(row[c]) for c in columns])
        yield buffer.getvalue().encode()


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as cell() takes them: maps are dictionaries."""
    names = batch.schema.names
    values = [c.to_pylist(maps_as_pydicts="strict") if pa.types.is_map(c.type) else c.to_pylist() for c in batch.columns]
    return (dict(zip(names, row)) for row in zip(*values))


def _formatted(df: DataFrame, lines: Callable[[Iterator[dict]], Iterator[bytes]]) -> Iterator[bytes]:
    """An ordered DataFrame as bytes: executors write the lines, the driver takes one partition at a time."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda held: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["part"])
        for batch in batches:
            held, size = [], 0
            for line in lines(_columns(batch)):
                held.append(line)
                size += len(line)
                if size >= PART_BYTES:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    for row in df.mapInArrow(formatted, "part binary").toLocalIterator():
        yield bytes(row["part"])


def tsv(df: DataFrame, columns: list[str] | None = None) -> Iterator[bytes]:
    """An ordered DataFrame as TSV."""
    columns = columns or df.columns
    if unknown := [c for c in columns if c not in df.columns]:
        raise InputError(f"no such columns: {', '.join(unknown)}")
    yield next(tsv_lines([], columns))
    yield from _formatted(df.select(*columns), lambda rows: islice(tsv_lines(rows, columns), 1, None))


def _records(rows: Iterable[dict]) -> Iterator[bytes]:
    for row in rows:
        s = row["sequence"]
        lines = [s[i : i + WIDTH] for i in range(0, len(s), WIDTH)]
        yield (f">{row['sequence_id']}\n" + "\n".join(lines) + "\n").encode()


def fasta(df: DataFrame) -> Iterator[bytes]:
    """An ordered DataFrame of sequence_id and sequence as FASTA; headers are the identifiers alone."""
    return _formatted(df.select("sequence_id", "sequence"), _records)


def json_bytes(value) -> bytes:
    return (json.dumps(value, indent=2, sort_keys=True, allow_nan=False, default=str) + "\n").encode()


def write(path: Path, parts: Iterable[bytes]) -> str:
    """Write parts, gzipped without time or name if the suffix says so; through a temporary file, then renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(path.name + ".part")
    with open(temporary, "wb") as raw:
        out = gzip.GzipFile(filename="", mode="wb", compresslevel=GZIP_LEVEL, fileobj=raw, mtime=0) if path.suffix == ".gz" else raw
        for part in parts:
            out.write(part)
        if out is not raw:
            out.close()
        raw.flush()
        os.fsync(raw.fileno())
    os.replace(temporary, path)
    return file_sha256(path)


def file_sha256(path: Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def content_sha256(path: Path) -> str:
    """The digest of what a file holds, unpacked a piece at a time if it is gzipped."""
    with gzip.open(path) if path.suffix == ".gz" else open(path, "rb") as file:
        h = hashlib.sha256()
        while piece := file.read(PART_BYTES):
            h.update(piece)
    return h.hexdigest()


def inventory(root: Path) -> list[str]:
    """All files of a bundle but the checksums and the execution record; symbolic links are refused."""
    out = []
    for d, dirs, names in os.walk(root):
        for n in [*dirs, *names]:
            if (Path(d) / n).is_symlink():
                raise IntegrityError(f"symbolic link in bundle: {n}")
        out += [(Path(d) / n).relative_to(root).as_posix() for n in names]
    return sorted(n for n in out if n not in (CHECKSUMS, EXECUTION))


def write_checksums(root: Path) -> None:
    files = inventory(root)
    write(root / CHECKSUMS, [f"{file_sha256(root / f)}  {f}\n".encode() for f in files])


def read_checksums(root: Path) -> dict[str, str]:
    out = {}
    for line in (root / CHECKSUMS).read_text().splitlines():
        digest, _, name = line.partition("  ")
        if len(digest) != 64 or not name or name in out:
            raise IntegrityError(f"malformed line in {CHECKSUMS}")
        out[name] = digest
    return out


def verify_checksums(root: Path) -> dict[str, str]:
    if root.is_symlink() or not root.is_dir():
        raise IntegrityError(f"{root} is no bundle directory")
    if not (root / CHECKSUMS).is_file():
        raise IntegrityError(f"{root} has no {CHECKSUMS}")
    recorded, files = read_checksums(root), inventory(root)
    if list(recorded) != files:
        raise IntegrityError(f"files and {CHECKSUMS} differ: {', '.join(sorted(set(recorded) ^ set(files))[:5]) or 'order'}")
    for name, digest in recorded.items():
        if file_sha256(root / name) != digest:
            raise IntegrityError(f"{name} does not match its checksum")
    return recorded


def safe_target(path: Path) -> Path:
    """Refuse the root, the working and home directories and all that hold them."""
    target = path.expanduser().absolute()
    for held in (Path.cwd(), Path.home()):
        if target == held or target in held.parents:
            raise InputError(f"refusing to replace {target}")
    return target


@contextmanager
def atomic_directory(target: Path, overwrite: bool = False):
    """A staging directory beside target that takes its place on success; a replaced bundle comes back on failure."""
    target = safe_target(target)
    if target.exists():
        if not overwrite:
            raise InputError(f"{target} exists")
        if any(target.iterdir()) and not (target / MARKER).is_file():
            raise InputError(f"{target} is not a bundle")
    target.parent.mkdir(parents=True, exist_ok=True)
    staging = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    try:
        yield staging
        for d, _, names in os.walk(staging):
            os.chmod(d, 0o755)
            for n in names:
                os.chmod(Path(d) / n, 0o644)
        backup = target.with_name(f".{target.name}-old")
        if target.exists():
            os.rename(target, backup)
        try:
            os.rename(staging, target)
        except OSError:
            if backup.exists():
                os.rename(backup, target)
            raise
        shutil.rmtree(backup, ignore_errors=True)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
