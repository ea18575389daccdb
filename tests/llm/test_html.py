import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitbench.llm.html_text import extract_text, render


def test_blocks_and_inline():
    assert render("<p>One <b>two</b>\n three<p>next<br>line") == "One two three\n\nnext\nline"
    assert render("a<div>b</div>c") == "a\nb\nc"
    assert render("<h1>T</h1>x &amp; y&nbsp;z &lt;") == "T\n\nx & y z <"
    assert render("x<b> y</b>z<i>q </i>w") == "x yzq w"


def test_lists():
    assert render("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n  - c\n- d"
    assert render("<ol start=3><li>x</li><li>y</li></ol>") == "3. x\n4. y"
    assert render("<dl><dt>t<dd>d<dt>u</dl>") == "t\n  d\nu"


def test_tables_are_aligned():
    assert render("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>") == "a     bbb\ncccc  d"
    assert render("<table><tr><th colspan=2>head<tr><td>a<td>b</table>") == "head\na  b"
    assert render("<table><tr><td><table><tr><td>in</table><td>out</table>") == "in  out"
    assert render("<table><td>no row</table>after") == "no row\n\nafter"


def test_only_visible_text():
    for hidden in (
        "<script>x</script>", "<style>x</style>", "<title>x</title>", "<template>x</template>", "<!-- x -->", "<p hidden>x", "<noscript>x</noscript>",
        "<div style='color:red; display : none'>x</div>", "<span style='visibility:hidden'>x</span>", "<dialog>x</dialog>", "<head><meta a='x'></head>",
    ):
        assert render(f"{hidden}</p>shown") == "shown", hidden
    assert render("<details><summary>s</summary>body</details>") == "s"
    assert render("<details open><summary>s</summary>body</details>") == "s\nbody"


def test_a_head_without_end_tag_hides_no_body():
    assert render("<html><head><title>T</title><h1>Top</h1><p>text") == "Top\n\ntext"
    assert render("<head><meta a=x><link b=y><style>s</style>shown<title>T</title>") == "shown"
    assert render("<head> \n<script>x</script><base c><noscript><p>n</p></noscript><template><p>t</p></template><p>shown") == "shown"
    assert render("<head><title>T</title><body><p>shown") == "shown"
    assert render("<head><head><title>T</title>first<p>next") == "first\n\nnext"


def test_preformatted():
    assert render("a<pre>  x\n   y</pre>b") == "a\n\n  x\n   y\n\nb"


def test_deep_and_unclosed():
    assert render("<div>" * 30_000 + "x") == "x"
    assert render("<table><tr><td>" * 500 + "x") == "x"
    assert render("<p>a</b></i></td>b") == "ab"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<td>", "</td>", "<tr>", "<table>", "</table>", "<ul>", "<li>", "</ul>", "<pre>", "</pre>", "w ", " v", "<br>", "<div", ">", "</ol>", "<dd>", "&#0;"]), max_size=25).map("".join))
def test_never_fails_and_loses_no_word(page):
    text = render(page)
    assert text == render(page) and not re.search(r"[ \t]\n|\n{3}", text)
    if "<div" not in page:
        assert text.count("w") == page.count("w ")


def test_operator(spark):
    df = spark.createDataFrame([(1, "<p>x"), (2, None), (3, ""), (None, "y"), (1, "<p>x")], "page_id long, html string").withColumn("text", F.lit("own"))
    out = extract_text(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == [("1", "x", 1), ("1", "x", 1), ("2", "", 0), ("3", "", 0), ("None", "y", 1)]
    assert extract_text(df.limit(0)).count() == 0


def test_blocks_in_cells_keep_their_lines():
    assert render("<table><tr><td>A<td><ul><li>one<li>two</ul><tr><td>B<td>x</table>") == "A  - one\n   - two\nB  x"
    assert render("<table><tr><td><p>p<p>q<td>z</table>") == "p  z\nq"
    assert render("<table><tr><td><table><tr><td>i<td>j<tr><td>k<td>l</table><td>out</table>") == "i  j  out\nk  l"


def test_cells_that_span_rows_keep_their_columns():
    assert render("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>c<td>d</table>") == "A  b1\n   b2\nc  d"
    assert render("<table><tr><td>x<td rowspan=3 colspan=2>B<td>y<tr><td>1<td>2<tr><td>3<td>4</table>") == "x  B  y\n1     2\n3     4"


def test_style_rules_and_visibility():
    style = "<style>/* .y{display:none} */ .x{display:none} #k, em.z { visibility: hidden } @media print { p{display:none} } p{color:red}</style>"
    assert render(style + "<p class='a x'>no</p><p class=y>yes</p><p id=k>no</p><em class=z>no</em><em>so</em>") == "yes\n\nso"
    assert render("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>") == "yes"
    assert render(".<style>.x{display:none} p.x{display:block}</style><p class=x>yes<b class=x>no</b>") == ".\n\nyes"
    assert render("<style>.x{display:none}</style><p class=x style='display:block'>yes") == "yes"


def test_pages_of_a_megabyte_take_seconds_and_little_room():
    wide = "<table><tr><td>" + "w" * 3000 + "<td>x</td></tr>" + "<tr><td>a<td>b</tr>" * 40_000 + "</table>"
    pages = {
        "nested": "<div>" * 200_000 + "x",
        "paragraphs": "<p>" * 300_000 + "x",
        "wide cell": wide,
        "columns": "<table><tr>" + "<td>c" * 100_000 + "<tr><td>" + "<p>l" * 100_000 + "</table>",
        "spans": "<table><tr>" + "<td rowspan=1000>a" * 1000 + "<tr><td>b" * 100_000 + "</table>",
        "tables": "<table><tr><td>" * 60_000 + "word " * 20_000,
        "lists": "<ul><li>" * 100_000 + "x",
        "styles": "<style>" + "a" * 500_000 + "</style><p style='" + ";" * 400_000 + "'>x",
        "end tags": "<b>" * 100_000 + "</i></td>" * 100_000,
    }
    for name, page in pages.items():
        began = time.thread_time()
        text = render(page)
        assert time.thread_time() - began < 20, name
        assert len(text) < 20 * len(page), name
    assert render(wide).split("\n")[0] == "w" * 3000 + "  x"


def lay_out(blocks):
    """(lines, blank lines around them) of blocks, by the rule that neighbours share the larger margin."""
    lines, last = [], None
    for own, margin in blocks:
        if own:
            lines += [""] * (0 if last is None else max(last, margin)) + own
            last = margin
    return lines


def random_block(rng, depth):
    """A block as markup, and as (lines, margin)."""
    words = lambda: " ".join(rng.choices(["ab", "c", "def", "ghij"], k=rng.randrange(1, 5)))
    kind = rng.choice(["p", "div", "ul", "table", "nest"] if depth else ["p", "div"])
    if kind in ("p", "div"):
        w = words()
        return f"<{kind}>{w}</{kind}>", ([w], 1 if kind == "p" else 0)
    if kind == "ul":
        items = [words() for _ in range(rng.randrange(1, 4))]
        return "<ul>" + "".join(f"<li>{i}" + rng.choice(["", "</li>"]) for i in items) + "</ul>", ([f"- {i}" for i in items], 1)
    if kind == "nest":
        inner = [random_block(rng, depth - 1) for _ in range(rng.randrange(1, 4))]
        made = [b for _, b in inner]
        return "<div>" + "".join(h for h, _ in inner) + "</div>", ("group", made)
    across = rng.randrange(1, 4)
    rows = [[words() for _ in range(across)] for _ in range(rng.randrange(1, 4))]
    width = [max(len(r[c]) for r in rows) for c in range(across)]
    lines = ["  ".join(r[c].ljust(width[c]) for c in range(across)).rstrip() for r in rows]
    return "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>", (lines, 1)


def flat(blocks):
    for lines, margin in blocks:
        if lines == "group":
            yield from flat(margin)
        else:
            yield lines, margin


def test_layout_matches_a_layout_by_blocks():
    rng = random.Random(3)
    for _ in range(400):
        made = [random_block(rng, 3) for _ in range(rng.randrange(1, 6))]
        assert render("".join(h for h, _ in made)) == "\n".join(lay_out(flat([b for _, b in made])))


def test_operator_takes_long_pages_and_clashing_columns(spark):
    page = "<p>" + "word " * 300_000
    df = spark.createDataFrame([(1, page)], "page_id long, html string").toDF("page_id", "html").select("*", F.lit("other").alias("HTML"), F.lit(3).alias("n_chars"))
    row = extract_text(df).first()
    assert row.n_chars == 5 * 300_000 - 1
