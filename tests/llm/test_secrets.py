import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from splitbench.llm import secret_scan as s


def brute(text):
    out = []
    patterns = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    for kind, (p, fine) in patterns.items():
        out += [(m.start(), m.end(), kind) for m in re.finditer(p, text, re.ASCII) if fine(m)]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


PIECES = st.sampled_from(["token", "secret=", "API_KEY", "apikey:", " ", "=", '"', "abcdef", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH1234567890", "é", "x", "ſecret=", "\n", ": "])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_match_brute_force(text):
    assert s.base_spans(text) == brute(text)


def test_failing_match_still_consumes():
    text = "secret=token: abcdefgh"
    assert s.base_spans(text) == brute(text) == []


def test_battery_separates_random_tokens_from_people_s(spark):
    rng = random.Random(5)
    base62 = string.ascii_letters + string.digits
    secrets = ["".join(rng.choices(base62, k=40)) for _ in range(60)]
    plain = ["".join(w.title() for w in rng.choices(["table", "entry", "value", "order", "house", "window", "letter"], k=5)) + "2" for _ in range(60)]
    rows = [(i, f"an item {t} here") for i, t in enumerate(secrets + plain)]
    out = {r.doc_id: r.spans for r in s.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [any(x.kind == "token" for x in out[i]) for i in range(120)]
    assert sum(found[:60]) >= 50 and sum(found[60:]) <= 3
    i = found.index(True)
    span = out[i][0]
    assert rows[i][1][span.start : span.end] == secrets[i]


def test_prose_gives_no_tokens():
    text = "Donaudampfschifffahrtsgesellschaft https://example.org/some/long/path/of/words internationalization 20240101123456789012345"
    assert all(p > 0.05 for _, _, p, _ in s.tested_tokens(text, []))


def test_redaction_keeps_the_rest(spark, odd):
    key = "password = hunter2hunter2"
    df = odd.union(spark.createDataFrame([(900, f"é before {key} after", "en", "s", 1)], odd.schema))
    out = {(r.doc_id, r.lang): r for r in s.redact_secrets(df).collect()}
    assert out[900, "en"].text == "é before [SECRET] after" and out[900, "en"].n_chars == len("é before [SECRET] after")
    assert out[103, "en"].text == "word " * 30_000 and out[100, "en"].text is None
    assert s.redact_secrets(df).count() == df.count() and s.redact_secrets(df).columns == df.columns


def test_odd_empty_and_clashing(odd, empty, clashing):
    rows = {r.doc_id: r for r in s.digest_spans(s.scan_secrets(odd)).collect()}
    assert rows[100].n_assign == 0 and rows[100].spans == ""
    assert s.digest_spans(s.scan_secrets(empty)).count() == 0 and s.redact_secrets(empty).count() == 0
    assert s.digest_spans(s.scan_secrets(clashing)).count() == 12
    assert s.redact_secrets(clashing).columns == clashing.columns


def test_p_values_are_uniform_for_tokens_made_by_people():
    for kind in ("base62", "base36", "base32", "hex", "letters", "base64"):
        rng = random.Random(99)
        ps = [s.p_value(s.made_by_people(rng, kind, 32)) for _ in range(1000)]
        for cut in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75):
            assert abs(sum(p <= cut for p in ps) / 1000 - cut) <= 0.06 if cut > 0.05 else sum(p <= cut for p in ps) / 1000 <= 2.5 * cut


def discoveries(tokens, rate):
    """Weighted Benjamini-Hochberg by sorting."""
    mean = sum(w for _, w in tokens) / len(tokens)
    q = sorted(min(p * mean / w, 1.0) for p, w in tokens)
    ranks = [k for k, x in enumerate(q, 1) if x * len(q) / k <= rate]
    return max(ranks, default=0)


def test_discoveries_match_sorting_and_hold_the_rate(spark):
    rng = random.Random(8)
    alphabets = {"base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567", "hex": "0123456789ABCDEF"}
    secret = [("".join(rng.choices(a, k=32)), True) for a in alphabets.values() for _ in range(200)]
    plain = [(s.made_by_people(rng, k, rng.randrange(24, 48)), False) for k in ("base62", "base36", "base32", "letters") for _ in range(400)]
    tokens = [(t, real) for t, real in secret + plain if not s.base_spans(f" {t} ")]
    df = spark.createDataFrame([(i, f"see {t} there") for i, (t, _) in enumerate(tokens)], "doc_id long, text string")
    hit = {r.doc_id for r in s.scan_secrets(df).collect() if any(x.kind == "token" for x in r.spans)}
    tested = [(i, p, w) for i, (t, _) in enumerate(tokens) for _, _, p, w in s.tested_tokens(f"see {t} there", [])]
    exact = discoveries([(p, w) for _, p, w in tested], 0.01)
    assert 0.98 * exact <= len(hit) <= exact
    real = {i for i, (_, r) in enumerate(tokens) if r}
    for name, at in zip(alphabets, range(0, 600, 200)):
        assert sum(i in hit for i in range(at, at + 200)) >= 180, name
    assert len(hit - real) <= 0.03 * len(hit)


def test_identifiers_are_left_alone():
    for text in ("6f1c2d3e-4a5b-4c7d-8e9f-0a1b2c3d4e5f", "customer_account_number_2024", "12345678901234567890123", "getCustomerAccountAddressById2"):
        assert all(p > 1e-3 for _, _, p, _ in s.tested_tokens(text, []))


def test_overlapping_and_many_spans_are_masked_in_linear_time(spark):
    text = "token=" + "0123456789abcdef" * 2 + " a " + "secret: abcdef1 " * 50_000
    row = s.redact_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == "[SECRET] a " + "[SECRET] " * 50_000
