"""Validation: every row by its schema, exclusions against the kept genomes, and the whole bundle made again and compared.

The tables are first checked for what they say, by queries that share nothing
with the code that wrote them; then the bundle is made again from its own sources
and compared byte by byte, which tells nothing about faults in the shared code.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, sinks
from ..config import DIRECTORIES, BenchmarkConfig
from ..errors import IntegrityError, SplitbenchError, require_empty
from ..operators import audit, catalog
from ..session import materialize
from ..sources import fasta, tables
from . import benchmark

MAP = "map<string,string>"


def load_json(path: Path) -> dict:
    """A JSON object without repeated keys."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise IntegrityError(f"{path.name} repeats a key")
        return out

    value = json.loads(path.read_text(), object_pairs_hook=once)
    if not isinstance(value, dict):
        raise IntegrityError(f"{path.name} is no object")
    return value


def bundle_config(root: Path) -> BenchmarkConfig:
    try:
        raw = load_json(root / "config.json")
        table = root / DIRECTORIES["similarity"] / "external-similarity.tsv"
        raw |= {"virus_paths": ["-"], "host_paths": ["-"], "output_dir": str(root)}
        raw["similarity_table"] = str(table) if table.exists() else None
        return BenchmarkConfig.from_mapping(raw, root)
    except (SplitbenchError, ValueError, TypeError) as error:
        raise IntegrityError(f"unusable config.json: {error}") from error


def bundle_catalog(spark: SparkSession, root: Path) -> benchmark.Catalog:
    """The catalogue from the bundle's sequences and their inventory."""
    rows = fasta.read(spark, [str(root / "sources.fasta.gz")]).select("sequence_id", "sequence")
    cells = tables.read_cells(spark, str(root / "sequences.tsv"))
    if cells.columns != benchmark.SEQUENCE_COLUMNS:
        raise IntegrityError("sequences.tsv has other columns")
    meta = cells.select(
        "sequence_id", "genome_id", "label", "accession_version", F.col("release_date").try_cast("date").alias("release_date"), "topology", "source_input_id",
        F.from_json("taxonomy", MAP).alias("taxonomy"), F.from_json("metadata_extra", MAP).alias("metadata_extra"),
    )
    if not audit.differences(rows.select("sequence_id"), meta.select("sequence_id")).isEmpty():
        raise IntegrityError("sources and sequences.tsv differ")
    cat = benchmark.build_catalog(rows.join(meta, "sequence_id"))
    # Dropped copies are not in the bundle; what the references record of them is held against exclusions.tsv.
    recorded = tables.read_cells(spark, str(root / "references.tsv")).select("genome_id", F.from_json("metadata_extra", MAP).alias("extra"))
    facts = recorded.select("genome_id", F.map_filter("extra", lambda k, v: k.startswith("duplicate_")).alias("facts"))
    cat.genomes = materialize(benchmark.add_facts(cat.genomes, facts), "recorded")
    return cat


def check_tables(spark: SparkSession, root: Path, config: BenchmarkConfig, cat: benchmark.Catalog) -> None:
    """Raise IntegrityError if a table breaks its schema, the exclusions contradict the genomes, or a strict test its candidates."""

    def cells(name: str, schema: str, key: str) -> DataFrame:
        found = tables.read_cells(spark, str(root / name))
        if found.columns != list(schemas.fields_of(schema)):
            raise IntegrityError(f"{name} has other columns than {schema}")
        require_empty(schemas.schema_violations(found, schema, key), f"{name} breaks its schema", IntegrityError)
        require_empty(catalog.duplicate_keys(found, key), f"{name} repeats a key", IntegrityError)
        return found

    cells("references.tsv", "reference-row", "genome_id")
    cells("sequences.tsv", "sequence-row", "sequence_id")
    gone = cells("exclusions.tsv", "exclusion-row", "genome_id")
    require_empty(audit.exclusion_violations(gone, cat.genomes), "exclusions.tsv contradicts the references", IntegrityError)
    for kind in config.splits:
        here = DIRECTORIES[kind]
        assigned = cells(f"{here}/assignments.tsv", "assignment-row", "genome_id")
        cells(f"{here}/exclusions.tsv", "exclusion-row", "genome_id")
        views = {v: cells(f"{here}/{v}.truth.tsv.gz", "truth-row", "sequence_id") for v in ("train", "test", *["candidate_test"] * (kind == "similarity"))}
        if kind == "similarity":
            require_empty(audit.strict_subset_violations(views["candidate_test"], views["test"], assigned), "the strict test is not the filtered candidate test", IntegrityError)


def validate_bundle(spark: SparkSession, root: str | Path) -> dict:
    """Raise IntegrityError unless the bundle is exactly what its sources and configuration give; returns counts."""
    root = Path(root)
    recorded = sinks.verify_checksums(root)
    if (root / sinks.MARKER).read_text().strip() != sinks.LAYOUT:
        raise IntegrityError("unknown bundle marker")
    config = bundle_config(root)
    try:
        cat = bundle_catalog(spark, root)
        files = benchmark.bundle_files(spark, cat, config, lambda: [(root / "exclusions.tsv").read_bytes()])
    except SplitbenchError as error:
        raise IntegrityError(f"the bundle cannot be made again: {error}") from error
    check_tables(spark, root, config, cat)
    extra = {f"{DIRECTORIES['similarity']}/external-similarity.tsv"} if config.similarity_table else set()
    if set(recorded) != set(files) | extra:
        raise IntegrityError(f"unexpected or missing files: {', '.join(sorted(set(recorded) ^ (set(files) | extra))[:5])}")
    for name, parts in files.items():
        h = hashlib.sha256()
        for part in parts():
            h.update(part)
        if h.hexdigest() != sinks.content_sha256(root / name):
            raise IntegrityError(f"{name} is not what the sources give")
    genomes = cat.genomes.count()
    return {"files": len(recorded), "genomes": genomes, "splits": list(config.splits)}
