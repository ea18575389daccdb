"""A benchmark run: catalogue, plans, fragments and views, published as a bundle that can be made again byte by byte."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import DIRECTORIES, BenchmarkConfig
from ..errors import InputError, IntegrityError, require_empty
from ..functions import hashing, text
from ..operators import audit, catalog, sampling, similarity, stats
from ..session import discard, materialize
from ..sources import fasta, tables
from . import protocols

ASSIGNMENT_COLUMNS = [
    "genome_id", "group_id", "label", "partition", "candidate_partition", "reason", "release_date", "taxon", "similarity_bin", "nearest_train_genome_id",
    "max_train_similarity", "similarity_coverage", "similarity_method", "strict_gate_train_genome_id", "strict_gate_similarity", "strict_gate_coverage",
    "strict_gate_method",
]
EXCLUSION_COLUMNS = [
    "genome_id", "label", "split", "reason", "duplicate_of", "source_sha256", "source_accession_version", "release_date", *ASSIGNMENT_COLUMNS[8:],
]
REFERENCE_COLUMNS = [
    "genome_id", "label", "accession_version", "release_date", "sequence_ids", "contig_count", "length_nt", "sha256", "source_input_ids", "taxonomy", "metadata_extra",
]
SEQUENCE_COLUMNS = [
    "sequence_id", "genome_id", "label", "accession_version", "release_date", "topology", "length_nt", "sha256", "canonical_sha256", "source_input_id", "taxonomy",
    "metadata_extra",
]
AUDIT_PAYS = ("fragment_id_overlap", "test_fragments_with_coordinate_overlap", "source_genome_overlap", "source_content_hash_overlap")


@dataclass
class Catalog:
    """Kept contigs and genomes, and the genomes dropped as copies."""

    contigs: DataFrame
    genomes: DataFrame
    exclusions: DataFrame


@dataclass
class Split:
    kind: str
    assignments: DataFrame
    parameters: dict = field(default_factory=dict)


def _empty_map(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in names})


def load_contigs(spark: SparkSession, config: BenchmarkConfig) -> DataFrame:
    """Records of both classes with their metadata, checked against it exhaustively."""
    parts = []
    for label, paths in (("virus", config.virus_paths), ("host", config.host_paths)):
        parts.append(fasta.read(spark, list(paths)).withColumn("channel", F.lit(label)))
    records = parts[0].unionByName(parts[1])
    require_empty(catalog.duplicate_keys(records, "sequence_id"), "sequence identifiers repeat across inputs")
    digests = [(p, "sha256:" + sinks.file_sha256(Path(p))) for ps in (config.virus_paths, config.host_paths) for p in fasta.discover(list(ps))]
    records = records.join(F.broadcast(spark.createDataFrame(digests, "source_path string, source_input_id string")), "source_path", "left")
    if config.metadata_path is None:
        many = records.groupBy("source_path").agg(F.count("*").alias("n")).where("n > 1")
        require_empty(many, "files of several records need metadata")
        none = lambda t: F.lit(None).cast(t)
        return records.select(
            "sequence_id", F.col("sequence_id").alias("genome_id"), F.col("channel").alias("label"), F.col("sequence_id").alias("accession_version"), none("date").alias("release_date"),
            F.lit("linear").alias("topology"), "sequence", "source_input_id", F.create_map().cast("map<string,string>").alias("taxonomy"), F.create_map().cast("map<string,string>").alias("metadata_extra"),
        )
    meta = tables.read_metadata(spark, config.metadata_path).withColumnRenamed("label", "metadata_label")
    require_empty(catalog.metadata_join_audit(records, meta), "sequences and metadata do not match")
    joined = catalog.join_metadata(records, meta)
    require_empty(catalog.label_channel_conflicts(joined).select("sequence_id", "metadata_label", "channel"), "labels contradict their inputs")
    return joined.select(
        "sequence_id", F.coalesce("genome_id", "sequence_id").alias("genome_id"), F.col("channel").alias("label"), "accession_version", "release_date", "topology", "sequence", "source_input_id",
        "taxonomy", "metadata_extra",
    )


def add_facts(genomes: DataFrame, facts: DataFrame) -> DataFrame:
    """genomes with (genome_id, facts), a map, put into their metadata_extra."""
    joined = genomes.join(facts, "genome_id", "left")
    more = F.coalesce("facts", F.create_map().cast("map<string,string>"))
    other = F.map_filter("metadata_extra", lambda k, v: ~F.map_contains_key(more, k))
    return joined.withColumn("metadata_extra", F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(other, more))))).drop("facts")


def build_catalog(contigs: DataFrame, duplicate_policy: str = "error") -> Catalog:
    """Genomes from contigs: grouped, digested, checked for conflicts, copies dropped or refused."""
    contigs = materialize(catalog.with_digests(_empty_map(contigs, ("taxonomy", "metadata_extra"))), "contigs")
    require_empty(catalog.mixed_label_genomes(contigs), "genomes of both labels")
    ranked = contigs.select("genome_id", F.explode("taxonomy").alias("rank", "value"))
    require_empty(catalog.taxonomy_conflicts(ranked), "segments disagree on taxonomy")
    taxonomy = ranked.groupBy("genome_id", "rank").agg(F.max("value").alias("value")).groupBy("genome_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rank", "value")))).alias("taxonomy")
    )
    sizes = contigs.groupBy("genome_id").agg(F.count("*").alias("n"))
    extras = catalog.common_extras(contigs.select("genome_id", F.explode("metadata_extra").alias("key", "value")), sizes)
    grouped = contigs.groupBy("genome_id").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("release_date").isNull(), F.col("sequence_id")))), ",").alias("undated")
    ).where("n > 1")
    fact = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    facts = grouped.select(
        "genome_id",
        F.inline(F.array(fact("grouped_sequence_count", F.col("n")), fact("group_release_date_policy", F.lit("latest_if_all_known")), fact("missing_release_date_sequences", F.col("undated")))),
    )
    extra = extras.unionByName(facts).groupBy("genome_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata_extra"))
    inputs = contigs.groupBy("genome_id").agg(F.array_sort(F.collect_set("source_input_id")).alias("source_input_ids"))
    genomes = catalog.genomes_from_contigs(contigs).join(taxonomy, "genome_id", "left").join(extra, "genome_id", "left").join(inputs, "genome_id")
    genomes = materialize(_empty_map(genomes, ("taxonomy", "metadata_extra")).withColumn("group_id", hashing.group_id(F.col("digest"))), "genomes")
    require_empty(catalog.cross_label_conflicts(genomes), "content with both labels", InputError)
    marked = catalog.rank_duplicates(genomes)
    dropped = marked.where("duplicate_of is not null")
    if duplicate_policy == "error":
        require_empty(dropped.select("genome_id", "duplicate_of"), "copies of the same class")
    require_empty(catalog.copy_taxonomy_conflicts(genomes), "copies of one class disagree on taxonomy")
    facts = catalog.merge_facts(marked, contigs)
    kept = materialize(add_facts(marked.where("duplicate_of is null").drop("duplicate_of"), facts), "kept")
    exclusions = dropped.select(
        "genome_id", "label", F.lit("reference_preflight").alias("split"), F.lit("same_class_content_duplicate").alias("reason"), "duplicate_of", F.col("digest").alias("source_sha256"),
        F.col("accession_version").alias("source_accession_version"), "release_date",
    )
    few = [r["label"] for r in kept.groupBy("label").count().where("count >= 2").collect()]
    if len(few) < 2:
        raise InputError("each class needs two distinct genomes")
    own = materialize(contigs.join(kept.select("genome_id"), "genome_id", "left_semi"), "kept-contigs")
    discard(contigs)
    return Catalog(own, kept, exclusions)


def plan_split(kind: str, cat: Catalog, config: BenchmarkConfig, spark: SparkSession) -> Split:
    """The assignments of a protocol; random splits assign fragments, not genomes."""
    g, f, seed = cat.genomes, config.test_fraction, config.seed
    if kind == "random":
        a = g.select("genome_id", "label", "group_id", F.lit("mixed").alias("partition"), F.lit("diagnostic_random_fragment_split").alias("reason"))
        return Split(kind, a, {"diagnostic_only": True, "split_unit": "fragment", "test_fraction": f})
    protocols.require_groups(g)
    if kind == "genome":
        return _checked(Split(kind, protocols.genome_holdout(g, f, seed), {"test_fraction": f}))
    if kind == "temporal":
        cutoff = config.temporal_cutoff or protocols.choose_cutoff(g, f, seed)
        plan = protocols.temporal_holdout(g, cutoff, config.missing_metadata)
        require_empty(audit.temporal_violations(plan, str(cutoff)), "temporal plan contradicts its dates", IntegrityError)
        return _checked(Split(kind, plan, {"temporal_cutoff": str(cutoff)}))
    if kind == "taxonomy":
        rank = config.taxonomy_rank
        t = g.withColumn("taxon", F.try_element_at("taxonomy", F.lit(rank)))
        viruses = t.where("label = 'virus'")
        known = {r["f"]: r["taxon"] for r in viruses.where("taxon is not null").groupBy(text.casefold(F.col("taxon")).alias("f")).agg(F.min("taxon").alias("taxon")).collect()}
        if config.missing_metadata == "error":
            require_empty(viruses.where("taxon is null").select("genome_id"), f"viruses without {rank}")
        if config.holdout_taxa:
            if absent := [x for x in config.holdout_taxa if x.casefold() not in known]:
                raise InputError(f"held-out taxa are absent: {', '.join(absent)}")
            held = [known[x.casefold()] for x in config.holdout_taxa]
        else:
            held = [r["taxon"] for r in protocols.choose_taxa(viruses, rank, config.auto_holdout_count, seed).collect()]
        if len(set(held)) >= len(known):
            raise InputError("held-out taxa must leave one for training")
        plan = protocols.taxonomic_holdout(t, held, rank, f, seed)
        require_empty(audit.taxonomy_violations(plan, held), "taxonomic plan contradicts its taxa", IntegrityError)
        return _checked(Split(kind, plan, {"taxonomy_rank": rank, "holdout_taxa": held}))
    proposal = materialize(protocols.similarity_proposal(g, f, seed), "proposal")
    most = config.max_train_similarity
    if config.similarity_table:
        side = lambda p: proposal.where(F.col("candidate_partition") == p).select("genome_id")
        table = tables.read_similarity(spark, config.similarity_table, side("test"), side("train"))
        hits = similarity.collapse_table(table, most, config.min_similarity_coverage).withColumnRenamed("query_genome_id", "genome_id")
    else:
        sketched = materialize(similarity.sketches(cat.contigs, config.similarity_k, config.sketch_size), "sketches")
        hits = protocols.sketch_hits(proposal, sketched, config.similarity_k, config.sketch_size, most)
    plan = materialize(protocols.apply_gate(proposal, hits, most, config.similarity_bands.as_tuple()), "gated")
    require_empty(audit.similarity_violations(plan, most), "similarity evidence contradicts the plan", IntegrityError)
    return _checked(Split(kind, plan, {"max_train_similarity": most, "min_similarity_coverage": config.min_similarity_coverage}))


def _checked(split: Split) -> Split:
    split.assignments = materialize(split.assignments, "assignments")
    require_empty(audit.plan_violations(split.assignments), f"the {split.kind} plan is not viable", IntegrityError)
    return split


def _columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


Files = dict[str, Callable[[], Iterable[bytes]]]


def _view(files: Files, base: str, fragments: DataFrame, truth: DataFrame, seed: int, namespace: str) -> None:
    """One view as two files in the same order."""
    rank = lambda c: hashing.semantic_rank(seed, f"output-order:{namespace}", F.col(c))
    files[f"{base}.fasta.gz"] = lambda: sinks.fasta(fragments.select(F.col("fragment_id").alias("sequence_id"), "sequence").orderBy(rank("sequence_id"), "sequence_id"))
    files[f"{base}.truth.tsv.gz"] = lambda: sinks.tsv(truth.orderBy(rank("sequence_id"), "sequence_id"), list(stats.TRUTH_COLUMNS))


def bundle_files(spark: SparkSession, cat: Catalog, config: BenchmarkConfig, root_exclusions: Callable[[], Iterable[bytes]] | None = None) -> Files:
    """Every file of the bundle as a function that gives its bytes; all follow from the catalogue and the configuration."""
    files: Files = {}
    seqs = cat.contigs.orderBy("sequence_id")
    refs = cat.genomes.withColumn("sha256", F.col("digest")).orderBy("genome_id")
    files["references.tsv"] = lambda: sinks.tsv(refs, REFERENCE_COLUMNS)
    files["sequences.tsv"] = lambda: sinks.tsv(seqs, SEQUENCE_COLUMNS)
    files["sources.fasta.gz"] = lambda: sinks.fasta(seqs)
    files["exclusions.tsv"] = root_exclusions or (lambda: sinks.tsv(_columns(cat.exclusions, EXCLUSION_COLUMNS).orderBy("genome_id")))
    files["config.json"] = lambda: [sinks.json_bytes(config.resolved())]
    require_empty(sampling.length_preflight(cat.contigs, list(config.fragment_lengths)), "genomes too short for a fragment length")
    library = sampling.sample_fragments(
        cat.contigs, list(config.fragment_lengths), config.fragments_per_genome, config.seed, config.strand_mode, config.max_ambiguous_fraction,
        "redraw" if config.contradictory_fragments == "redraw" else "keep",
    )
    library = materialize(library, "fragments")
    summary = {}
    for kind in config.splits:
        split = plan_split(kind, cat, config, spark)
        summary[kind] = _split_files(files, split, library, cat, config)
    files["manifest.json"] = lambda: [sinks.json_bytes({"schema": sinks.LAYOUT, "splits": summary, "genomes": {r["label"]: r["n"] for r in catalog.label_counts(cat.genomes).collect()}})]
    files["report.md"] = lambda: [_report(summary).encode()]
    files[sinks.MARKER] = lambda: [f"{sinks.LAYOUT}\n".encode()]
    return files


def _split_files(files: Files, split: Split, library: DataFrame, cat: Catalog, config: BenchmarkConfig) -> dict:
    here, seed, kind, a = DIRECTORIES[split.kind], config.seed, split.kind, split.assignments
    if kind == "random":
        require_empty(sampling.small_strata(library), "strata with fewer than two fragments")
        own = materialize(sampling.random_split(library, config.test_fraction, seed), "random-split")
        details = a.drop("partition")
        truth_of = lambda rows, view: stats.truth_view(rows, details.withColumn("partition", F.lit(view)), cat.contigs, view)
        active = own
    else:
        sided = a.where("partition in ('train', 'test')").select("genome_id", "partition")
        active = materialize(library.join(sided, "genome_id"), "sided")
        truth_of = lambda rows, view: stats.truth_view(rows.drop("partition"), a, cat.contigs, view)
    require_empty(sampling.label_conflicts(active), "fragment contents with both labels")
    sides = {p: active.where(F.col("partition") == p) for p in ("train", "test")}
    checks = {r["check"]: r["n"] for r in audit.split_audit(active, cat.genomes).collect()}
    _require_clean(kind, checks)
    for p, rows in sides.items():
        _view(files, f"{here}/{p}", rows, truth_of(rows, p), seed, f"{kind}:{p}")
    files[f"{here}/assignments.tsv"] = lambda: sinks.tsv(_columns(a, ASSIGNMENT_COLUMNS).orderBy("genome_id"))
    dates = a.drop("release_date").join(cat.genomes.select("genome_id", "release_date", F.col("digest").alias("source_sha256"), F.col("accession_version").alias("source_accession_version")), "genome_id")
    out = dates.where("partition = 'excluded'").withColumn("split", F.lit(kind))
    files[f"{here}/exclusions.tsv"] = lambda: sinks.tsv(_columns(out, EXCLUSION_COLUMNS).orderBy("genome_id"))
    if kind == "similarity":
        candidates = materialize(library.join(a.where("candidate_partition = 'test'").select("genome_id", "similarity_bin"), "genome_id"), "candidates")
        plain = candidates.drop("similarity_bin")
        _view(files, f"{here}/candidate_test", plain, truth_of(plain, "candidate_test"), seed, f"{kind}:candidate-test")
        for band in stats.BANDS:
            rows = candidates.where(F.col("similarity_bin") == band).drop("similarity_bin")
            _view(files, f"{here}/test_strata/{band}", rows, truth_of(rows, f"test_strata/{band}"), seed, f"{kind}:candidate-test")
    record = {
        "schema": f"{sinks.LAYOUT}:split", "protocol": kind, "parameters": split.parameters, "validation": checks, "excluded_genomes": out.count(),
        **{p: stats.stats_maps(rows) for p, rows in sides.items()},
    }
    files[f"{here}/split.json"] = lambda: [sinks.json_bytes(record)]
    return {"train": record["train"]["records"], "test": record["test"]["records"], "excluded_genomes": record["excluded_genomes"]}


def _require_clean(kind: str, checks: dict[str, int]) -> None:
    """Random splits must share sources; all others must share nothing that leaks."""
    if kind == "random":
        if checks["fragment_id_overlap"] or not checks["source_genome_overlap"]:
            raise IntegrityError("a random-fragment split must share sources but no fragments")
        return
    bad = [c for c in AUDIT_PAYS if checks[c]]
    if kind == "similarity" and checks["exact_fragment_content_overlap"]:
        bad.append("exact_fragment_content_overlap")
    if bad:
        raise IntegrityError(f"the {kind} split leaks: {', '.join(bad)}")


def _report(summary: dict) -> str:
    rows = "\n".join(f"| {k} | {v['train']} | {v['test']} | {v['excluded_genomes']} |" for k, v in summary.items())
    return f"# Benchmark\n\n| split | train | test | excluded genomes |\n|---|---|---|---|\n{rows}\n"


def generate(spark: SparkSession, config: BenchmarkConfig, dry_run: bool = False, validate: bool = True) -> dict:
    """Write the bundle, validate it where it was staged, and publish it; returns counts.

    With dry_run only the plans are made; validate=False is for callers that validate what was published.
    """
    target = sinks.safe_target(Path(config.output_dir))
    if target.exists() and not config.overwrite:
        raise InputError(f"{target} exists")
    cat = build_catalog(load_contigs(spark, config), config.duplicate_policy)
    if dry_run:
        plans = {k: plan_split(k, cat, config, spark) for k in config.splits}
        return {k: {r["partition"]: r["n"] for r in p.assignments.groupBy("partition").agg(F.count("*").alias("n")).collect()} | {"parameters": p.parameters} for k, p in plans.items()}
    started = datetime.datetime.now(datetime.UTC).isoformat()
    with sinks.atomic_directory(target, config.overwrite) as staging:
        for name, parts in bundle_files(spark, cat, config).items():
            sinks.write(staging / name, parts())
        if config.similarity_table:
            sinks.write(staging / DIRECTORIES["similarity"] / "external-similarity.tsv", [Path(config.similarity_table).read_bytes()])
        sinks.write_checksums(staging)
        sinks.write(staging / sinks.EXECUTION, [sinks.json_bytes({"started": started, "finished": datetime.datetime.now(datetime.UTC).isoformat()})])
        if validate:
            from .validate import validate_bundle

            validate_bundle(spark, staging)
    return json.loads((target / "manifest.json").read_text())
