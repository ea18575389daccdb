import hashlib
import zlib

import pytest

import corpus_pipeline
from splitbench.llm import langid, mixing, packing, secret_scan

from .conftest import documents, odd_rows
from .test_simhash import brute_components, near_rows, slow_fingerprint


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_table(spark, sf_dir, odd, clashing, empty, name, stage):
    for df in (odd, clashing, empty):
        out = stage(spark, df, sf_dir)
        rows = out.collect()
        if name != "packing":
            assert out.columns == df.columns
            assert bool(rows) == (df is not empty)


def test_run_matches_the_stages_by_brute_force(spark, tmp_path):
    rows = odd_rows() + [(i + 1000, *r) for i, *r in near_rows()]
    df = documents(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from pyspark.sql import functions as F

    model = langid.train(df.where(~langid.held_out(F.col("doc_id"))))
    kept = []
    for r in df.collect():
        lang, score = model.predict(r.text)
        if lang != "und" and score >= langid.LEAST * min(1, len(r.text) / langid.SHORT):
            kept.append(r)
    groups = {}
    for (_, label), r in zip(sorted(brute_components([(r.doc_id, slow_fingerprint(r.text)) for r in kept])), sorted(kept, key=lambda r: str(r.doc_id))):
        groups.setdefault(label, []).append(r)
    least = lambda rows: min(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    stay = [least(rows) for rows in groups.values()]
    assert len({r.doc_id for r in stay}) == len(stay)  # so a row is known by its id below

    tested = {r.doc_id: secret_scan.tested_tokens(r.text, secret_scan.base_spans(r.text)) for r in stay}
    every = [(p, w) for found in tested.values() for _, _, p, w in found]
    cut = slow_threshold(every, 0.01)
    masked = {}
    for r in stay:
        spans = [(a, z) for a, z, _ in secret_scan.base_spans(r.text)] + [(a, z) for a, z, p, w in tested[r.doc_id] if p / w <= cut]
        text, at = "", 0
        for a, z in sorted(spans):
            text += r.text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, z)
        masked[r.doc_id] = (text + r.text[at:], r.source)

    times = slow_times(masked)
    want = []
    for ident, (text, _) in masked.items():
        ids = packing.token_ids(text, packing.public_tokenizers.path("byte_bpe_50k.json"))
        want += [(str(ident), piece, start, length, zlib.crc32(ids[start : start + length].tobytes())) for piece, (start, length) in enumerate(packing.cut_points(len(ids)))] * times[ident]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    fill = sorted(bins.values())
    assert fill[-1] <= 1024 and (len(fill) < 2 or fill[0] + fill[1] > 1024)  # no two sequences fit into one


def slow_threshold(tokens, rate):
    """The largest p over weight that weighted Benjamini-Hochberg lets pass, by sorting; -1 if none does."""
    mean = sum(w for _, w in tokens) / len(tokens) if tokens else 1
    q = sorted(p / w for p, w in tokens)
    return max((x for k, x in enumerate(q, 1) if x * mean * len(q) / k <= rate), default=-1)


def slow_times(rows):
    """How often the mixture takes each row of {id: (text, source)}, by sorting each source's rows by hash."""
    size = {i: len((text or "").encode().split()) for i, (text, _) in rows.items()}
    sources = {}
    for i, (_, source) in rows.items():
        sources.setdefault(source, []).append(i)
    aims = mixing.targets([(s, sum(size[i] for i in ids)) for s, ids in sources.items()])
    times = {}
    for s, ids in sources.items():
        whole = sum(size[i] for i in ids)
        passes = min(int(aims[s] // whole), 3) if whole else 0
        rest = int(aims[s] - passes * whole)
        for i in sorted(ids, key=lambda i: hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15]):
            taken = max(0, min(size[i], rest))
            rest -= taken
            times[i] = passes + (2 * taken >= size[i]) if size[i] else 1
    return times


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, sf_dir).count() == docs.count()
    assert corpus_pipeline.secrets(spark, docs, sf_dir).count() == docs.count()
