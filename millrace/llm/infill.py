"""Fill-in-middle transformation: a text's middle is moved behind its prefix and suffix.

A text is cut into units, code points unless another pattern is given; characters that the pattern
doesn't match belong to the unit after them, those behind the last match are a unit of their own. Two
cuts between units come from a seed of the document's id, so reruns and every partitioning agree. A
batch of texts is worked on at a time: the ends of a text's units are gathered in one array of machine
words, two lookups in it slice the text, and a digest's groups are the draws.

Null texts are empty and stay plain, as do texts that hold one of the marks; then output and text are
equal. Null ids are drawn for as `null`. Rows that agree in id and text give equal rows, each its own;
other columns pass through, but for those of the names that are added here. A text costs in proportion
to its length and is held in a few copies; no text meets another.
"""

from __future__ import annotations

import hashlib
from array import array
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle. A text without one of them can be told apart from its pieces' joins.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points.
UNITS = r"(?s)."
#: Of a hundred draws, those that are moved at all, and of these, those whose suffix comes first.
MOVED, SUFFIX_FIRST = 90, 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"

_END = methodcaller("end")


def unit_ends(text: str, pattern: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    ends = array("Q", map(_END, pattern.finditer(text)))
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def draws(doc_id: int | str | None) -> list[int]:
    """The first four groups of eight digits of the id's digest."""
    said = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i : i + 8], 16) for i in range(0, 32, 8)]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def moved(doc_id: int | str | None, text: str, pattern: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output); no lengths where the form is plain."""
    ends = unit_ends(text, pattern)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id)
    if not text or h3 % 100 >= MOVED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: str, form: str) -> str:
    """The text that gave the output."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        before, _, after = head.removeprefix(PREFIX).partition(SUFFIX)
    else:
        after, _, before = head.removeprefix(SUFFIX).partition(PREFIX)
    return before + middle + after


def infill(docs: DataFrame, units: str = UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents, and: n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output, output_sha256."""

    @F.pandas_udf(RESULT)
    def transform(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(units)
        rows = (moved(i, t or "", pattern) for i, t in zip(ids, texts))
        done = pd.DataFrame([(*r, digest(r[-1])) for r in rows], columns=said)
        return done.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    said = [f.split()[0] for f in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in said]
    # Ids go as text: a batch with a null id would turn to floating point.
    return docs.withColumn("__m", transform(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))).select(*kept, "__m.*")


def restore(output: Column, form: Column) -> Column:
    """The text rebuilt from output and form alone."""

    @F.pandas_udf("string")
    def rebuild(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return rebuild(output, form)


def restored_sha256(output: Column, form: Column) -> Column:
    """Digest of the text rebuilt from output and form alone."""

    @F.pandas_udf("string")
    def rebuilt(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([digest(restored(o, f)) for o, f in zip(outputs, forms)], dtype=object)

    return rebuilt(output, form)


def report(done: DataFrame) -> DataFrame:
    """Lengths and digests of infill(); the restored digest is of the text rebuilt from output and form alone."""
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        restored_sha256(F.col("output"), F.col("form")).alias("restored_sha256"),
    )
