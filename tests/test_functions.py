import hashlib
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitbench.functions import dna, hashing, text
from splitbench.operators import similarity

QUICK = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SEQS = st.lists(st.text(alphabet=dna.IUPAC, min_size=1, max_size=60), min_size=1, max_size=15)


def col(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string").orderBy("i")
    return [tuple(r)[0] if len(exprs) == 1 else tuple(r) for r in df.select(*exprs).collect()]


def contig_digest(s, kind="linear"):
    return hashlib.sha256(b"SPLITBENCH-CONTIG-SHA256-v2\0" + kind.encode() + b"\0" + len(s).to_bytes(8, "big") + s.encode()).hexdigest()


def rc(s):
    return s.translate(str.maketrans(dna.IUPAC, dna.COMPLEMENT))[::-1]


@QUICK
@given(SEQS)
def test_reverse_complement_is_an_involution_and_digests_ignore_strands(spark, seqs):
    s, r = F.col("s"), dna.reverse_complement(F.col("s"))
    digest = lambda c: hashing.sequence_digest(dna.canonical(c), False)
    out = col(spark, seqs, r, dna.reverse_complement(r), digest(s), digest(r))
    for x, (one, two, d, e) in zip(seqs, out):
        assert one == rc(x) and two == x and d == e == contig_digest(min(x, rc(x)))


@QUICK
@given(SEQS)
def test_rotations(spark, seqs):
    want = [min(x[i:] + x[:i] for i in range(len(x))) for x in seqs]
    assert col(spark, seqs, dna.least_rotation(F.col("s"))) == want == col(spark, seqs, dna.least_rotation_native(F.col("s")))


def test_long_rotation_is_linear():
    s = "A" * 200_000 + "C"
    assert dna.least_rotation_start(s) == 0 and dna.least_rotation_start("C" + "A" * 200_000) == 1


def test_circular_digest_ignores_rotation(spark):
    a, b = col(spark, ["AACGT", "ACGTA"], hashing.sequence_digest(dna.canonical_circular(F.col("s")), True))
    assert a == b == contig_digest("AACGT", "circular")


def test_genome_digest_is_a_multiset(spark):
    d = contig_digest("ACGT")
    df = spark.createDataFrame([(1, d), (2, d), (2, d)], "g long, d string")
    got = {r.g: r.x for r in df.groupBy("g").agg(hashing.genome_digest(F.col("d")).alias("x")).collect()}
    head = b"SPLITBENCH-GENOME-SHA256-v2\0"
    want = {n: hashlib.sha256(head + n.to_bytes(8, "big") + bytes.fromhex(d) * n).hexdigest() for n in (1, 2)}
    assert got == want


def test_domain_is_a_parameter(spark):
    other = col(spark, ["ACGT"], hashing.sequence_digest(F.col("s"), False, domain="OTHER"))[0]
    assert other == hashlib.sha256(b"OTHER-CONTIG-SHA256-v2\0linear\0" + (4).to_bytes(8, "big") + b"ACGT").hexdigest()


def test_ranks_and_seeds():
    assert hashing.derive_seed(42, 1) != hashing.derive_seed(42, "1")
    assert hashing.derive_seed(42, "ab", "c") != hashing.derive_seed(42, "a", "bc")


def test_blake2_profile(spark):
    out = col(spark, ["AACCGGT"], hashing.kmer_hash_blake2(F.col("s"), b"k"), hashing.semantic_rank_blake2(42, "ns", F.col("s"), b"p"))[0]
    assert out[0] == hashlib.blake2b(b"AACCGGT", digest_size=8, person=b"k").hexdigest()
    assert out[1] == hashlib.blake2b(b"v1\x0042\0ns\0AACCGGT", digest_size=16, person=b"p").hexdigest()


def test_normalize_and_faults(spark):
    out = col(spark, ["ac gt\nN", "ACU", "AC-G", "RYSWKMBDHVN"], dna.normalize(F.col("s")), dna.invalid_position(F.col("s")))
    assert [p for _, p in out] == [0, 3, 3, 0] and out[0][0] == "ACGTN"


def test_slices_wrap(spark):
    cut = dna.slice_forward(F.col("s"), F.lit(3), F.lit(4))
    assert col(spark, ["AACGT", "AACGTTT"], cut) == ["GTAA", "GTTT"]


def test_text_rules(spark):
    s = F.col("s")
    out = col(spark, ["a.b:c+d-1", "#x", "", "é", "a" * 256, None], text.is_stable_id(s))
    assert out == [True, False, False, False, False, False]
    assert col(spark, ["2020-01-02", " 2020-01-02 ", "2020/01/02", "2020-13-01", "", None], text.iso_date(s).cast("string")) == ["2020-01-02"] * 2 + [None] * 4
    assert col(spark, ["7", "07", "+7", "x", "-3"], text.canonical_int(s)) == [7, None, None, None, -3]
    assert col(spark, ["0.5", "1.1", "nan", "", "1e-7"], text.fraction(s)) == [0.5, None, None, None, 1e-7]
    assert col(spark, ["1e-4", "1e-7", "0.1", None], text.float_text(s.try_cast("double"))) == ["0.0001", "1e-07", "0.1", ""]
    assert col(spark, ["Straße"], text.casefold(s)) == ["strasse"]


def test_mash_identity_and_bands(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1e-12,)], "j double")
    out = [r[0] for r in df.select(similarity.mash_identity(F.col("j"), 21)).collect()]
    assert out[0] is None and out[1] == 1.0 and math.isclose(out[2], 0.980692137709135) and out[3] == 0.0
    bands = spark.createDataFrame([(x,) for x in (None, 0.0, 0.29, 0.3, 0.7, 0.9)], "x double").select(similarity.classify(F.col("x"))).collect()
    assert [r[0] for r in bands] == ["no_detectable_match", "distant_detectable", "distant_detectable", "low_similarity", "moderate_similarity", "high_similarity"]
