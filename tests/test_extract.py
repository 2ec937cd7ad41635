"""Extraction and chunking: ordinary files, and the odd cases that have to stay."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.markdown import headings
from millrace.operators import extract, sections, windows


def test_python_docstring():
    found = extract.python_items('\ndef add(x, y):\n    """Add two numbers."""\n    return x + y\n')
    assert [(i["kind"], i["name"], i["docstring"]) for i in found] == [("FunctionDef", "add", "Add two numbers.")]


def test_python_order_and_decorators():
    code = '"""M."""\nclass A:\n    @property\n    def f(self):\n        return 1\nasync def g(): pass\n'
    found = extract.python_items(code)
    assert [(i["kind"], i["name"]) for i in found] == [("Module", None), ("ClassDef", "A"), ("AsyncFunctionDef", "g"), ("FunctionDef", "f")]
    assert found[3]["code"] == "    def f(self):\n        return 1"
    assert extract.python_items("def broken(:") == []


def test_js():
    code = "\n/**\n * Multiply two numbers.\n */\nexport function mul(a, b) {\n  return a * b;\n}\n"
    (item,) = extract.js_items(code)
    assert "Multiply two numbers." in item["jsdoc"] and item["name"] == "mul" and item["code"].endswith("}")


def test_js_odd_cases():
    typed = "/** one */ function f(a): number { return 1 }\nfunction g(b) { return 2 }"
    assert extract.js_items(typed)[0]["code"] == "function g(b) { return 2 }"
    assert extract.js_items("/** x */ function f(a) { return '}' + 1; }")[0]["code"] == "function f(a) { return '}"
    assert extract.js_items("/** x */ function f(a) { if (a) {")[0]["code"].endswith("if (a) {")
    assert extract.js_items("/** x */ function f(a): b") == []


def _sections(spark, said):
    row = spark.createDataFrame([(said,)], "t string").select(sections.markdown_sections(F.col("t")).alias("s")).first()
    return [(s.title, s.content) for s in row.s]


def test_sections(spark):
    assert _sections(spark, "\n# Title\n\nIntro\n\n## Details\n\nMore info\n") == [("Title", "Intro"), ("Details", "More info")]
    assert _sections(spark, "before\n# A\n```\n# x\n```\n#no heading") == [("", "before"), ("A", "```"), ("x", "```\n#no heading")]
    assert _sections(spark, "") == [] and _sections(spark, "# only") == []


def chunks_of(code, least, most):
    """The rule in plain Python; no lines are no chunk."""
    done = [[]]
    for line in code.splitlines():
        if not line.strip() and len(done[-1]) >= least:
            if done[-1]:
                done.append([])
        else:
            done[-1].append(line)
    return [c for c in ["\n".join(c).strip() for c in done if len(c) >= least][:most] if c]


def test_chunks(spark):
    code = "def f(x):\n    a = x + 1\n\n    b = a * 2\n\n    return b\n"
    found = spark.createDataFrame([(code,)], "c string").select(windows.blank_line_chunks(F.col("c"), 1, 5).alias("x")).first().x
    assert len(found) >= 2 and any("return b" in c for c in found)
    rnd = random.Random(3)
    codes = ["\n".join(rnd.choice(["", " ", "a", "  b", "c\t"]) for _ in range(rnd.randrange(12))) for _ in range(400)]
    for least in (0, 1, 3, 6):
        rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", windows.blank_line_chunks(F.col("c"), least, 3).alias("x")).collect()
        assert [r.x for r in rows] == [chunks_of(r.c, least, 3) for r in rows]


def test_chunks_of_a_very_long_text(spark):
    code = "\n".join(f"line {i}" if i % 9 else "" for i in range(1_000_000))
    began = time.monotonic()
    found = spark.createDataFrame([(code,)], "c string").select(windows.blank_line_chunks(F.col("c"), 6, 5).alias("x")).first().x
    assert len(found) == 5 and found[1].startswith("line 10\n") and time.monotonic() - began < 60


@pytest.mark.parametrize("n, count", [(0, 0), (1, 1), (680, 1), (681, 2), (800, 2), (30_000, 33)])
def test_windows(spark, n, count):
    said = " ".join(f"w{i}" for i in range(n))
    found = spark.createDataFrame([(said,)], "t string").select(windows.word_windows(F.col("t"), 800).alias("x")).first().x
    assert len(found) == count
    assert all(w == " ".join(said.split()[k * 680 : k * 680 + 800]) for k, w in enumerate(found))


def spans_of(text, name):
    width = lambda s: len((lead := s[: len(s) - len(s.lstrip(" \t"))]).replace("\t", "    "))
    opening = next((m[0] for q in ('"""', "\'\'\'") for m in [re.match(f"(?s){q}.*?{q}", text.lstrip())] if m), "")
    return extract.python_spans(text.splitlines(), [width(s) for s in text.splitlines()], opening, name)


def test_python_spans():
    body = "    " + "x = 1  # " + "y" * 60 + "\n"
    long, short = "def f(a):\n" + body * 6, "def g(a):\n    return 1\n"
    (one,) = spans_of(long + short, "m.py")
    assert (one["kind"], one["name"], one["line_start"], one["line_end"]) == ("function_definition", "f", 1, 7)
    assert spans_of("async " + long, "m.py") == []
    cls = "class C(B):\n" + "".join(f"    def m{i}(self):\n    {body}{body}{body}" for i in range(3))
    assert [s["name"] for s in spans_of(cls, "m.py")] == ["C"]
    assert spans_of('"""Doc."""\n' + long, "m.py")[0]["content"].startswith('# File: m.py\n# Context: """Doc."""\n\ndef f')
    assert spans_of("def f(\n    a,\n):\n" + body * 9, "m.py") == []  # the bracket at the margin ends the block


@pytest.mark.parametrize("n, kept", [(399, 0), (400, 1)])
def test_least_span(n, kept):
    head = "def f():\n    "
    assert len(spans_of(head + "x" * (n - len(head)), "m.py")) == kept


def test_markdown_spans():
    said = "# A\nintro\n## B\nb\n## C\nc"
    assert [(s["title"], s["content"], s["line_start"], s["line_end"]) for s in extract.markdown_spans(said)] == [("B", "## B\nb", 3, 4), ("C", "## C\nc", 5, 6)]
    assert [(s["title"], s["line_start"], s["line_end"]) for s in extract.markdown_spans("")] == [("Document", 1, 0)]
    fenced = "# A\n```\n# no\n```\nTitle\n=====\nx"
    assert [s["title"] for s in extract.markdown_spans(fenced)] == ["A", "Title"]


@pytest.mark.parametrize(
    "said, found",
    [
        ("# a\n####### b\n#c\n  ## d ##\n    # code", [(0, 1), (3, 2)]), ("a\nb\n===\nc\n---", [(0, 1), (3, 2)]), ("---\n- ---\n***", []),
        ("> # quoted\n> a\n> ===\nb\n===", [(0, 1), (1, 1), (3, 1)]), ("- # in list\n  ## deeper\n\n  a\n  -\n1) # n", [(0, 1), (1, 2), (3, 2), (5, 1)]), ("> a\n===", []),
        ("<div>\n# html\n</div>\n\n# yes", [(4, 1)]), ("<!-- a\n# no\n-->\n# yes", [(3, 1)]), ("a\n<b>\n# yes", [(2, 1)]), ("<b>\n# no\n\n# yes", [(3, 1)]),
        ("```\n# no\n~~~\n```\n# yes", [(4, 1)]), ("> ```\n# yes", [(1, 1)]), ("- a\n\n      # code\n\n  # yes", [(4, 1)]), ("[a]: /b\n===\nx\n---", [(1, 2)]),
        ("-\n\n  # out", [(2, 1)]), ("a\n2. # text\n1. # item", [(2, 1)]), ("a\n    # text\n# yes", [(2, 1)]), ("\t# code\n-\t# tab", [(1, 1)]), ("", []),
    ],
)
def test_headings(said, found):
    assert headings(said) == found


def test_long_expressions_lose_no_items():
    code = "x = " + " + ".join(["1"] * 1500) + "\ntry:\n    def a(): pass\nexcept E:\n    class B:\n        def c(self): pass\n"
    assert [i["name"] for i in extract.python_items(code)] == ["a", "B", "c"]


def test_block_ends_are_those_of_each_line():
    rnd = random.Random(4)
    for _ in range(300):
        widths = [rnd.choice([None, 0, 1, 2, 3]) for _ in range(rnd.randrange(12))]
        for i, w in enumerate(widths):
            if w is not None:
                inside = []
                for j in range(i + 1, len(widths)):
                    if widths[j] is not None and widths[j] <= w:
                        break
                    inside += [j] * (widths[j] is not None)
                assert extract.block_ends(widths)[i] == max([i, *inside])


def _direct(text):
    """js_items by the two patterns as they are written, each search from the start."""
    said = re.compile(r"/\*\*([\s\S]*?)\*/\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_$]+)\s*\(")
    head = re.compile(r"(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_$]+)\s*\([^)]*\)\s*{")
    for m in said.finditer(text):
        h = head.search(text, m.start())
        if h:
            depth, end = 0, len(text)
            for b in re.compile("[{}]").finditer(text, h.end() - 1):
                depth += 1 if b[0] == "{" else -1
                if not depth:
                    end = b.end()
                    break
            yield {"kind": "Function", "name": m[2], "jsdoc": m[1].strip(), "code": text[h.start() : end]}


_PIECES = ["/**", "*/", "/**/", "*", "/", " ", "\n", "export ", "async ", "export\n", "function ", "function", "f", "(", "a", ")", "{", "}", " {", "function f(a) {", "/** d */ function h(", "/** e */\nexport async function k(x) { }"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=25).map("".join))
def test_js_items_are_those_of_the_patterns(text):
    assert extract.js_items(text) == list(_direct(text))


@pytest.mark.parametrize("text", ["/** x */\n" * 20_000, "/** x */ function f(a\n" * 20_000, "/** x */ function f(a) " * 20_000, "function f(" * 20_000 + "/** */" * 20_000, "{" * 200_000, "/**" * 50_000 + "*/ function" * 50_000])
def test_js_items_take_time_in_proportion(text):
    began = time.perf_counter()
    extract.js_items(text)
    assert time.perf_counter() - began < 2


def test_few_texts_at_a_time(spark):
    """A worker holds a hundred texts, however many a task has."""

    def resident(text):
        return [{"kind": str(int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20), "name": str(len(text)), "jsdoc": None, "code": None}]

    rows = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    item = extract._called(resident, extract.JS_ITEM)(F.col("text"))[0]
    found = rows.select(item.alias("i")).agg(F.max(F.col("i.kind").cast("int")).alias("mb"), F.sum(F.col("i.name").cast("long")).alias("n")).first()
    assert found.n == 400_000_000 and found.mb < 250
