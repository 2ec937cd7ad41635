"""Column functions against Python's own str methods."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import arithmetic, paths, text, tolerant_json, vectors

ODD = ["a", "B", "é", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2028", "\u2029", "\u3000", "\ufeff", "\U0001f600", "#", "="]


def samples(n=2000, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize(
    "column, python",
    [
        (lambda c: text.lines(c), str.splitlines),
        (lambda c: text.strip(c), str.strip),
        (lambda c: text.words(c), str.split),
        (lambda c: text.heading_title(c), lambda s: s.lstrip("# ").strip()),
        (lambda c: text.approx_tokens(c), lambda s: max(1, len(s) // 4)),
        (lambda c: text.is_upper(c), str.isupper),
        (lambda c: text.universal_newlines(c), lambda s: s.replace("\r\n", "\n").replace("\r", "\n")),
    ],
)
def test_as_python_does(spark, column, python):
    rows = spark.createDataFrame([(s,) for s in samples()], "s string").select("s", column(F.col("s")).alias("got")).collect()
    assert [r.got for r in rows] == [python(r.s) for r in rows]


def test_long_runs_of_blanks(spark):
    """Trimming takes time in proportion to a text, wherever its blanks stand."""
    texts = ["a" + blank * 1_000_000 + "b" for blank in (" ", "\u3000")] + [" " * 1_000_000, "/" * 1_000_000 + "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    began = time.perf_counter()
    got = rows.select(F.length(text.strip(F.col("s"))).alias("n"), F.length(text.heading_title(F.col("s"))).alias("t"), F.length(paths.repository_name(F.col("s"))).alias("r")).collect()
    assert time.perf_counter() - began < 5
    assert [r.n for r in got] == [1_000_002, 1_000_002, 0, 1_000_001]


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "s string").select(text.lines(F.col("s")).alias("a"), text.strip(F.col("s")).alias("b"), text.approx_tokens(F.col("s")).alias("c")).first()
    assert list(row) == [None, None, None]


def test_indent_and_docstring(spark):
    rows = [("  \tx", 6, ""), ('\n """a\nb""" c', 1 - 1, '"""a\nb"""'), ("# x\n'''a'''", 0, ""), ("'''a'''", 0, "'''a'''"), ('r"""a"""', 0, "")]
    got = spark.createDataFrame(rows, "s string, n int, d string").select(text.indent(F.split("s", "\n")[0]).alias("n"), text.module_docstring(F.col("s")).alias("d")).collect()
    assert [r.d for r in got] == [r[2] for r in rows]
    assert got[0].n == 6


def test_paths(spark):
    rows = [("a/b/c.tar.gz", "c.tar.gz", ".gz", "c.tar"), (".hidden", ".hidden", "", ".hidden"), ("x/y", "y", "", "y"), ("z.", "z.", "", "z.")]
    got = spark.createDataFrame([r[:1] for r in rows], "p string").select("p", paths.name(F.col("p")), paths.suffix(F.col("p")), paths.stem(F.col("p"))).collect()
    assert [tuple(r) for r in got] == rows
    url = spark.createDataFrame([("https://host.example/o/name.git/",)], "u string").select(paths.repository_name(F.col("u")).alias("n"), paths.run_folder(F.col("u"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("f")).first()
    assert (url.n, url.f) == ("name", "name_20240102_030405")


@pytest.mark.parametrize("said, k", [('{"k": 1}', 1), ('Sure:\n```json\n{"k": 2}\n```', 2), ('{"k": 1} and {"k": 2}', None), ("nothing", None), ("", None), (None, None), ('{"k": 3', None)])
def test_tolerant_json(spark, said, k):
    row = spark.createDataFrame([(said,)], "s string").select(tolerant_json.field(tolerant_json.parse(F.col("s")), "$.k", "int").alias("k")).first()
    assert row.k == k


def test_turn_defaults(spark):
    said = '{"turns": [{"content": "x"}, {"role": "user", "evidence": [{"path": "a"}], "metadata": {"m": "1"}}]}'
    turns = spark.createDataFrame([(said,)], "s string").select(tolerant_json.turns(tolerant_json.parse(F.col("s"))).alias("t")).first().t
    assert [(t.role, t.content, t.evidence, t.metadata) for t in turns] == [("assistant", "x", [], {}), ("user", "", [{"path": "a"}], {"m": "1"})]


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (0, [0.0, 0.0]), (1, [2.0, 0.0])], "label int, v array<double>").withColumn("u", vectors.normalised(F.col("v")))
    assert [r.u for r in rows.collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0, 0.0]]
    assert {r.label: r.centroid for r in vectors.centroids(rows, "label", "u").collect()} == {0: [0.3, 0.4], 1: [1.0, 0.0]}


@pytest.mark.parametrize(
    "keys, shown",
    [
        ("12+3=", "15"), ("2+3*4=", "20"), ("1/0=", arithmetic.ZERO_DIVISION), ("1/0=7", "7"), ("5<", "0"), ("57<", "5"), ("5~", "-5"), ("0~", "0"), ("1.5.2", "1.52"), ("8%", "0.08"),
        ("2+*3=", "0"), ("7=", "7"), ("1/3=", "0.3333333333"), ("2+3=4", "4"), ("2+3=<", "0"), ("1234567890123456", "123456789012345"), ("9C", "0"), (".5+.5=", "1"),
    ],
)
def test_calculator(keys, shown):
    assert arithmetic.press(list(keys)) == shown


def test_calculator_columns(spark):
    rows = spark.createDataFrame([(6.0, "/", 0.0), (6.0, "/", 4.0), (1e99, "*", 1e9), (1.0, "?", 2.0)], "a double, op string, b double")
    got = [tuple(r.r) for r in rows.select(arithmetic.computed(F.col("a"), F.col("op"), F.col("b")).alias("r")).collect()]
    assert got == [(None, arithmetic.ZERO_DIVISION), (1.5, None), (None, arithmetic.TOO_LARGE), (None, None)]
    assert rows.select(arithmetic.display(F.split(F.lit("1 + 2 ="), " ")).alias("d")).first().d == "3"
    assert rows.select(arithmetic.symbol(F.col("op")).alias("s")).first().s == "÷"
