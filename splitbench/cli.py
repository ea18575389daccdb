"""Command line: suite, generate, validate, inspect, schema."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .config import SPLITS, BenchmarkConfig
from .errors import ConfigurationError, InputError, IntegrityError, SplitbenchError

VERSION = "0.1.0"
_OPTIONS = {
    "--metadata": ("metadata_path", str), "--output": ("output_dir", str), "--seed": ("seed", int), "--test-fraction": ("test_fraction", float),
    "--fragment-lengths": ("fragment_lengths", str), "--fragments-per-genome": ("fragments_per_genome", int), "--strand-mode": ("strand_mode", str),
    "--max-ambiguous-fraction": ("max_ambiguous_fraction", float), "--duplicate-policy": ("duplicate_policy", str), "--missing-metadata": ("missing_metadata", str),
    "--contradictory-fragments": ("contradictory_fragments", str),
    "--temporal-cutoff": ("temporal_cutoff", str), "--taxonomy-rank": ("taxonomy_rank", str), "--auto-holdout-count": ("auto_holdout_count", int),
    "--similarity-k": ("similarity_k", int), "--sketch-size": ("sketch_size", int), "--max-train-similarity": ("max_train_similarity", float),
    "--min-similarity-coverage": ("min_similarity_coverage", float), "--similarity-table": ("similarity_table", str),
}
#: What ``schema`` prints as JSON Schema; for the names of files it prints a header line.
SCHEMA_NAMES = ("metadata-row", "truth-row", "reference-row", "sequence-row", "assignment-row", "exclusion-row")
_PATHS = ("metadata_path", "output_dir", "similarity_table")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="splitbench", description="Leakage-aware train/test benchmarks on Spark.")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--log-level", default="ERROR", choices=("DEBUG", "INFO", "WARN", "ERROR", "OFF"))
    p.add_argument("--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("suite", "generate"):
        c = sub.add_parser(name)
        c.add_argument("--config")
        for flag, dest in (("--virus", "virus_paths"), ("--host", "host_paths"), ("--holdout-taxon", "holdout_taxa")):
            c.add_argument(flag, dest=dest, action="append")
        if name == "generate":
            c.add_argument("--split", dest="splits", action="append")
        for flag, (dest, kind) in _OPTIONS.items():
            c.add_argument(flag, *["--outdir"] * (flag == "--output"), dest=dest, type=kind)
        c.add_argument("--high", type=float)
        c.add_argument("--moderate", type=float)
        c.add_argument("--low", type=float)
        c.add_argument("--force", dest="overwrite", action="store_true", default=None)
        c.add_argument("--dry-run", action="store_true")
    v = sub.add_parser("validate")
    v.add_argument("bundle")
    v.add_argument("--json", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("--virus", dest="virus_paths", action="append", required=True)
    i.add_argument("--host", dest="host_paths", action="append", required=True)
    i.add_argument("--metadata", dest="metadata_path")
    i.add_argument("--duplicate-policy", choices=("error", "drop"), default="error")
    i.add_argument("--json", action="store_true")
    s = sub.add_parser("schema")
    s.add_argument("name", choices=("metadata", "truth", "references", "sequences", "assignments", "exclusions", "similarity", *SCHEMA_NAMES))
    return p


def resolve(args: argparse.Namespace) -> BenchmarkConfig:
    """Flags over the file; paths in flags start at the working directory, paths in the file at the file."""
    names = ["virus_paths", "host_paths", "holdout_taxa", "splits", "overwrite", *[d for d, _ in _OPTIONS.values()]]
    given = {n: getattr(args, n) for n in names if getattr(args, n, None) is not None}
    for n in ("virus_paths", "host_paths"):
        if n in given:
            given[n] = [str(Path(p).resolve()) for p in given[n]]
    for n in _PATHS:
        if n in given:
            given[n] = str(Path(given[n]).resolve())
    bands = {b: getattr(args, b) for b in ("high", "moderate", "low") if getattr(args, b) is not None}
    if bands:
        given["similarity_bands"] = bands
    if args.command == "suite":
        given["splits"] = list(SPLITS)
    return BenchmarkConfig.from_toml(args.config, **given) if args.config else BenchmarkConfig.from_mapping(given)


def columns(name: str) -> list[str]:
    from .operators.stats import TRUTH_COLUMNS
    from .plans import benchmark as b
    from .sources.tables import KNOWN, SIMILARITY_COLUMNS

    return {
        "metadata": [*KNOWN, "realm", "kingdom", "phylum", "class", "order", "family", "genus", "species"], "truth": list(TRUTH_COLUMNS), "references": b.REFERENCE_COLUMNS,
        "sequences": b.SEQUENCE_COLUMNS, "assignments": b.ASSIGNMENT_COLUMNS, "exclusions": b.EXCLUSION_COLUMNS, "similarity": list(SIMILARITY_COLUMNS),
    }[name]


def _session(level: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("splitbench").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel(level)
    return spark


def run(args: argparse.Namespace, spark=None) -> int:
    if args.command == "schema":
        if args.name in SCHEMA_NAMES:
            from .schemas import json_schema

            print(json.dumps(json_schema(args.name), indent=2, sort_keys=True))
        else:
            print("\t".join(columns(args.name)))
        return 0
    from .plans import benchmark
    from .plans.validate import validate_bundle
    from .sinks import cell

    config = resolve(args) if args.command in ("suite", "generate") else None
    spark = spark or _session(args.log_level)
    if config:
        result = benchmark.generate(spark, config, args.dry_run)
        if not args.quiet:
            print(json.dumps(result, indent=2, sort_keys=True, default=str))
    elif args.command == "validate":
        report = validate_bundle(spark, args.bundle)
        print(json.dumps(report) if args.json else f"valid: {report['genomes']} genomes, {report['files']} files")
    else:
        given = BenchmarkConfig(tuple(args.virus_paths), tuple(args.host_paths), "unused", args.metadata_path, duplicate_policy=args.duplicate_policy)
        cat = benchmark.build_catalog(benchmark.load_contigs(spark, given), given.duplicate_policy)
        rows = [r.asDict(True) for r in catalog_rows(cat)]
        if args.json:
            print(json.dumps(rows, indent=2, sort_keys=True, default=str))
        else:
            shown = ["genome_id", "label", "contig_count", "length_nt", "release_date", "sha256"]
            print("\n".join("\t".join(x) for x in [shown, *[[cell(r[c]) for c in shown] for r in rows]]))
    return 0


def catalog_rows(cat):
    from pyspark.sql import functions as F

    from .plans.benchmark import REFERENCE_COLUMNS

    return cat.genomes.withColumn("sha256", F.col("digest")).select(*REFERENCE_COLUMNS).orderBy("genome_id").toLocalIterator()


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark)
    except IntegrityError as error:
        print(f"error: {error}", file=sys.stderr)
        return 3
    except (ConfigurationError, InputError, SplitbenchError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
