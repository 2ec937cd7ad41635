"""Fill-in-middle, against the rule written out and by exact round trips."""

import hashlib

import regex
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import infill

SHAPE = "doc_id long, text string, form string"


def brute(i, t):
    """The rule over code points, as it is stated."""
    t, said = t or "", hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(said[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n, form = len(t), "psm"
    if n == 0 or any(f"<{c}>" in t for c in "PSM") or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, form, a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_report(spark):
    texts = [None, "", " ", "\n\r\x00", "é" * 40, "\U0001f600x́", "<P>", "a<S", "<<M>>", "x" * 100_000, "<S", "P><", "ab"] * 8
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(None, "without id", "kept"), (3, "again", "kept"), (3, "again", "kept"), (-5, "less", None)]
    done = infill.infill(spark.createDataFrame(rows, SHAPE))
    assert done.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *(w := brute(i, t))[:4], sha(w[4]), sha(t or "")) for i, t, _ in rows), key=repr)
    got = infill.report(done)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert dict(got.dtypes) | {"n": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint"} == dict(got.dtypes)


def test_empty_table(spark):
    assert infill.report(infill.infill(spark.createDataFrame([], SHAPE))).collect() == []


@given(st.integers(0, 400), st.text(alphabet="<>PSM ab\né\U0001f600", max_size=40), st.sampled_from([infill.UNITS, r"\X", r"\S+\s*", r"a"]))
def test_round_trip(i, text, units):
    n, form, before, middle, output = infill.moved(i, text, regex.compile(units))
    assert infill.restored(output, form) == text
    assert form == "plain" or output.startswith(f"<P>{text[:before]}<S>" if form == "psm" else f"<S>{text[before + middle :]}<P>")
    assert n == len(infill.unit_ends(text, regex.compile(units)))


def test_units_are_not_cut(spark):
    """Clusters and words stay whole; what the pattern leaves out belongs to the unit after it."""
    assert list(infill.unit_ends("a éx", regex.compile(r"\X"))) == [1, 2, 4, 5]
    assert list(infill.unit_ends("  one two ", regex.compile(r"\S+"))) == [5, 9, 10]
    rows = [(i, "one twó three four five", "") for i in range(60)]
    for r in infill.infill(spark.createDataFrame(rows, SHAPE), units=r"\S+").collect():
        if r.form != "plain":
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {0, 3, 8, 14, 19, 24}


def test_restore_column(spark):
    rows = [(i, f"text number {i}", "") for i in range(50)]
    done = infill.infill(spark.createDataFrame(rows, SHAPE))
    back = done.select("text", infill.restore(done.output, done.form).alias("back")).collect()
    assert all(r.text == r.back for r in back)
