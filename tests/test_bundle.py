import gzip
import hashlib
import json
import random
import shutil

import pytest

from splitbench import cli, session, sinks
from splitbench.config import BenchmarkConfig, SimilarityBands, parse_splits
from splitbench.errors import ConfigurationError, InputError, IntegrityError
from splitbench.plans import benchmark, validate
from splitbench.plans.validate import validate_bundle
from splitbench.queries import files, fragments
from splitbench.sources import fasta, tables


def dna(seed, n=120):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    meta = ["sequence_id\tgenome_id\tlabel\trelease_date\tfamily\tNote"]
    for label, ids in (("virus", ("v_old", "v_new")), ("host", ("h_old", "h_new"))):
        with open(root / f"{label}.fna", "w") as f:
            for i, name in enumerate(ids):
                f.write(f">{name} described\n{dna(f'{label}{i}')[:70]}\n{dna(f'{label}{i}')[70:].lower()}\n\n")
                meta.append(f"{name}\t{name}\t{label}\t20{17 + 5 * i}-01-01\t{'AB'[i] if label == 'virus' else ''}\tx")
    (root / "metadata.tsv").write_text("\n".join(meta) + "\n")
    return root


def config(inputs, out, **more):
    return BenchmarkConfig.from_mapping(
        {
            "virus_paths": [str(inputs / "virus.fna")], "host_paths": [str(inputs / "host.fna")], "metadata_path": str(inputs / "metadata.tsv"), "output_dir": str(out), "splits": ["genome"],
            "fragment_lengths": [31], "fragments_per_genome": 4, "similarity_k": 15, "sketch_size": 100, "seed": 1729, "test_fraction": 0.5, **more,
        }
    )


@pytest.fixture(scope="module")
def bundle(spark, inputs, tmp_path_factory):
    out = tmp_path_factory.mktemp("out") / "bundle"
    benchmark.generate(spark, config(inputs, out))
    return out


def copy(bundle, tmp_path):
    return shutil.copytree(bundle, tmp_path / "copy")


def test_all_protocols_end_to_end(spark, inputs, tmp_path):
    result = benchmark.generate(spark, config(inputs, tmp_path / "all", splits="all", fragment_lengths=[31, 61]))
    assert set(result["splits"]) == {"random", "genome", "similarity", "temporal", "taxonomy"}
    assert all(s["train"] + s["test"] == 16 for s in result["splits"].values())
    root = tmp_path / "all"
    assert (root / "similarity_filtered/test_strata/high_similarity.fasta.gz").exists()
    assert gzip.decompress((root / "similarity_filtered/test_strata/high_similarity.fasta.gz").read_bytes()) == b""
    head = (root / "genome_holdout/assignments.tsv").read_text().split("\n")[0].split("\t")
    assert head == benchmark.ASSIGNMENT_COLUMNS
    assert json.loads((root / "temporal_holdout/split.json").read_text())["validation"]["source_genome_overlap"] == 0


def test_rerun_is_identical(spark, inputs, bundle, tmp_path):
    benchmark.generate(spark, config(inputs, tmp_path / "again"))
    assert (tmp_path / "again" / sinks.CHECKSUMS).read_text() == (bundle / sinks.CHECKSUMS).read_text()


def test_existing_target_is_refused(spark, inputs, bundle):
    with pytest.raises(InputError, match="exists"):
        benchmark.generate(spark, config(inputs, bundle))


@pytest.fixture(scope="module")
def contaminated(inputs, tmp_path_factory):
    """A host that is a virus with another end: most of its fragments may be drawn from both."""
    root = tmp_path_factory.mktemp("contaminated")
    shutil.copy(inputs / "virus.fna", root)
    shutil.copy(inputs / "metadata.tsv", root)
    (root / "metadata.tsv").write_text((root / "metadata.tsv").read_text() + "h_mixed\th_mixed\thost\t2019-01-01\t\tx\n")
    (root / "host.fna").write_text((inputs / "host.fna").read_text() + f">h_mixed\n{dna('virus0')[:110]}{dna('end', 5)}\n")
    return root


def test_contradictory_fragments_are_refused_or_drawn_again(spark, contaminated, tmp_path):
    many = {"fragments_per_genome": 60}
    with pytest.raises(InputError, match="both labels"):
        benchmark.generate(spark, config(contaminated, tmp_path / "refused", **many))
    made = benchmark.generate(spark, config(contaminated, tmp_path / "mixed", contradictory_fragments="redraw", **many))
    assert made["splits"]["genome"]["train"] + made["splits"]["genome"]["test"] == 5 * 60
    labels = {}
    for view in ("train", "test"):
        truth = gzip.decompress((tmp_path / f"mixed/genome_holdout/{view}.truth.tsv.gz").read_bytes()).decode().splitlines()
        column = truth[0].split("\t").index("label")
        of = {line.split("\t")[0]: line.split("\t")[column] for line in truth[1:]}
        for record in gzip.decompress((tmp_path / f"mixed/genome_holdout/{view}.fasta.gz").read_bytes()).decode().split(">")[1:]:
            name, content = record.split("\n", 1)
            content = content.replace("\n", "")
            labels.setdefault(min(content, content.translate(str.maketrans("ACGT", "TGCA"))[::-1]), set()).add(of[name])
    assert labels and all(len(x) == 1 for x in labels.values())
    assert "contradictory_fragments" not in config(contaminated, tmp_path / "x").resolved()


def test_bundle_queries_take_all_documents(spark, sf_dir):
    whole = fragments.source_contigs(spark, sf_dir)
    rows = {r.sequence_id: r for r in files._bundle_sources(spark, sf_dir).collect()}
    assert {r.sequence_id: r.sequence for r in whole.collect()} == {i: r.sequence for i, r in rows.items()}
    by_content = {}
    for r in rows.values():
        by_content.setdefault(r.sequence, set()).add(r.label)
    assert len(by_content) < len(rows) and all(len(x) == 1 for x in by_content.values())


def test_bundle_validate_counts_the_genomes_of_all_documents(spark, sf_dir):
    report = files.bundle_validate(spark, sf_dir).first()
    contents = fragments.source_contigs(spark, sf_dir).select("sequence").distinct().count()
    assert (report.genomes, report.splits) == (contents, "genome,temporal") and contents > 100


def test_bundle_validate_validates_once_and_leaves_nothing_behind(spark, sf_dir, monkeypatch, tmp_path):
    for module in (session, files):
        monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path))
    calls = []
    monkeypatch.setattr(files, "validate_bundle", lambda *a: calls.append(validate_bundle(*a)) or calls[-1])
    monkeypatch.setattr(validate, "validate_bundle", lambda *a: pytest.fail("validated twice"))
    report = files.bundle_validate(spark, sf_dir).first()
    assert len(calls) == 1 and report.genomes == calls[0]["genomes"] == 183
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_files_are_formatted_as_rows_are(spark, tmp_path):
    rows = spark.sql("""select * from values
        ('a"b', 1, 0.1D, true, date'2020-01-02', map('z', '1', 'b', null), array('x', null), repeat('ACGT', 41)),
        ('t\tc', null, 1e-7D, false, null, map(), null, ''), (null, 3, null, null, null, null, array(), 'é') as t(sequence_id, n, x, b, d, m, a, sequence)""").orderBy("sequence")
    want = list(sinks.tsv_lines(rows.collect(), rows.columns))
    assert b"".join(sinks.tsv(rows)) == b"".join(want) and len(want) == 4
    assert b"".join(sinks.tsv(rows.where("n = 9"))) == want[0]
    long = spark.range(40).selectExpr("concat('s', id) as sequence_id", "repeat('ACGT', 20000 + int(id)) as sequence").orderBy("sequence_id")
    text = b"".join(parts := list(sinks.fasta(long)))
    assert 1 < len(parts) < 40 and max(map(len, parts)) < sinks.PART_BYTES + 100_000
    body = {r.split("\n", 1)[0]: r.split("\n", 1)[1] for r in text.decode().split(">")[1:]}
    assert list(body) == sorted(body) and {k: v.replace("\n", "") for k, v in body.items()} == {r.sequence_id: r.sequence for r in long.collect()}
    assert all(len(x) == sinks.WIDTH for v in body.values() for x in v.split("\n")[:-2])
    digest = sinks.write(tmp_path / "x.fa.gz", parts)
    assert digest != sinks.content_sha256(tmp_path / "x.fa.gz") == hashlib.sha256(text).hexdigest()


def _shift(root):
    p = root / "genome_holdout/test.truth.tsv.gz"
    lines = gzip.decompress(p.read_bytes()).decode().split("\n")
    cells = lines[1].split("\t")
    cells[6] = str(int(cells[6]) + 1)
    lines[1] = "\t".join(cells)
    sinks.write(p, ["\n".join(lines).encode()])


def _source(root):
    p = root / "sources.fasta.gz"
    text = gzip.decompress(p.read_bytes()).decode()
    at = text.index("\n") + 20
    sinks.write(p, [(text[:at] + ("A" if text[at] != "A" else "C") + text[at + 1 :]).encode()])


def _seed(root):
    p = root / "config.json"
    p.write_text(p.read_text().replace("1729", "1730"))


def _extra(root):
    (root / "note.txt").write_text("x")


def _marker(root):
    (root / sinks.MARKER).write_text("other\n")


@pytest.mark.parametrize("edit", [_shift, _source, _seed, _extra, _marker])
def test_edits_with_fresh_checksums_are_found(spark, bundle, tmp_path, edit):
    root = copy(bundle, tmp_path)
    edit(root)
    sinks.write_checksums(root)
    with pytest.raises(IntegrityError):
        validate_bundle(spark, root)


def test_edits_without_fresh_checksums_are_found(spark, bundle, tmp_path):
    root = copy(bundle, tmp_path)
    (root / "report.md").write_text("x")
    with pytest.raises(IntegrityError, match="checksum"):
        validate_bundle(spark, root)
    (root / "link").symlink_to(root / "report.md")
    with pytest.raises(IntegrityError, match="symbolic"):
        validate_bundle(spark, root)


def test_fasta_faults_name_their_place(spark, tmp_path):
    cases = {"ACGT\n": "1: sequence before", ">a\n>b\nAC\n": "1: record a", ">a\nAXG\n": "2: 'X' at position 2", ">\nAC": "1: a header", "": "no record", ">a\nAC\n>a\nGG\n": "repeat"}
    for i, (content, want) in enumerate(cases.items()):
        (tmp_path / f"{i}.fa").write_text(content)
        with pytest.raises(InputError, match=want):
            fasta.read(spark, [str(tmp_path / f"{i}.fa")])
    (tmp_path / "bad.fa.gz").write_bytes(b"no gzip")
    with pytest.raises(InputError, match="cannot be read"):
        fasta.read(spark, [str(tmp_path / "bad.fa.gz")])
    with pytest.raises(InputError):
        fasta.discover([str(tmp_path / "none.fa")])


def test_large_files_are_split_and_checked(spark, tmp_path):
    good = tmp_path / "big.fa"
    good.write_text("".join(f">r{i} the {i}th\nACGT\nacg{'N' * (i % 7)}\n" for i in range(500)))
    small = tmp_path / "small.fa.gz"
    small.write_bytes(gzip.compress(b">s1\nAC\n"))
    split = {tuple(r) for r in fasta.read(spark, [str(good), str(small)], large=100).collect()}
    assert split == {tuple(r) for r in fasta.read(spark, [str(good), str(small)]).collect()} and len(split) == 501
    for text, said in ((">a\nAC!T\n", "no nucleotide letter"), (">a\n>b\nA\n", "no sequence"), ("AC\n>b\nA\n", "before the first header"), (">a\nA\n>a\nC\n", "repeat")):
        bad = tmp_path / "bad.fa"
        bad.write_text(text)
        for large in (0, 1 << 20):
            with pytest.raises(InputError, match=said):
                fasta.read(spark, [str(bad)], large=large)


def test_metadata_faults(spark, tmp_path):
    bad = {
        "genome_id\nx\n": "no sequence_id", "sequence_id\n": "no data", "sequence_id\tlabel\na\tother\n": "label", "sequence_id\trelease_date\na\t2020/01/02\n": "release_date",
        "sequence_id\ttopology\na\tbranched\n": "topology", "sequence_id\na\na\n": "repeats", "sequence_id\tcreate_date\na\tb\n": "instead", "sequence_id\tSequence-ID\na\tb\n": "repeat",
    }
    for i, (content, want) in enumerate(bad.items()):
        (tmp_path / f"{i}.tsv").write_text(content)
        with pytest.raises(InputError, match=want):
            tables.read_metadata(spark, str(tmp_path / f"{i}.tsv"))
    (tmp_path / "m.csv").write_text("Sequence ID,label,tax_family,custom\na,VIRUS,Fam,x\n")
    r = tables.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert (r.label, r.taxonomy, r.metadata_extra, r.topology) == ("virus", {"family": "Fam"}, {"custom": "x"}, "linear")


def test_config_rules(tmp_path):
    assert parse_splits("temporal,genome_holdout,genome") == ("genome", "temporal")
    good = {"virus_paths": ["v"], "host_paths": ["h"]}
    assert BenchmarkConfig.from_mapping(good).fragment_lengths == (500,)
    for more in (
        {"test_fraction": 1}, {"similarity_k": 22}, {"sketch_size": 99}, {"fragments_per_genome": 1}, {"max_train_similarity": 0.8}, {"unknown": 1}, {"splits": "x"}, {"strand_mode": "x"},
        {"fragment_lengths": "31,31"}, {"schema_version": 2}, {"temporal_cutoff": "2020/1/1"}, {"virus_paths": []},
    ):
        with pytest.raises(ConfigurationError):
            BenchmarkConfig.from_mapping(good | more)
    with pytest.raises(ConfigurationError):
        SimilarityBands(0.5, 0.6, 0.1)
    (tmp_path / "c.toml").write_text('[benchmark]\nvirus_paths = ["v.fa"]\nhost_paths = ["h.fa"]\nseed = 1\n')
    c = BenchmarkConfig.from_toml(tmp_path / "c.toml", seed=2)
    assert c.seed == 2 and c.virus_paths == (str(tmp_path / "v.fa"),)


def test_cli(spark, inputs, bundle, tmp_path, capsys):
    args = ["--virus", str(inputs / "virus.fna"), "--host", str(inputs / "host.fna"), "--metadata", str(inputs / "metadata.tsv")]
    assert cli.main(["inspect", *args], spark) == 0
    assert "v_old\tvirus\t1\t120\t2017-01-01" in capsys.readouterr().out
    assert cli.main(["schema", "truth"]) == 0 and cli.main(["validate", str(bundle), "--json"], spark) == 0
    assert cli.main(["generate", *args, "--split", "genome", "--fragment-lengths", "31", "--dry-run", "--output", str(tmp_path / "o")], spark) == 0
    assert not (tmp_path / "o").exists()
    assert cli.main(["validate", str(tmp_path)], spark) == 3 and cli.main(["inspect", "--virus", "none.fa", "--host", "none.fa"], spark) == 2


def test_writers(tmp_path):
    assert sinks.cell(1e-07) == "1e-07" and sinks.cell(None) == "" and sinks.cell({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'
    a = sinks.write(tmp_path / "x.gz", [b"a", b"b"])
    assert a == sinks.write(tmp_path / "y.gz", [b"ab"]) and gzip.decompress((tmp_path / "x.gz").read_bytes()) == b"ab"
    with pytest.raises(InputError):
        sinks.safe_target(tmp_path.cwd())
    target = tmp_path / "t"
    with pytest.raises(ValueError), sinks.atomic_directory(target) as d:
        (d / "f").write_text("x")
        raise ValueError
    assert not target.exists() and not list(tmp_path.glob(".t-*"))
