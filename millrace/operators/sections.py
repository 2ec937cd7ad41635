"""Markdown split at headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import heading_title, let, lines, strip

HEADING = r"(?U)^#{1,6}[\s\x1c-\x1f]"


def markdown_sections(text: Column) -> Column:
    """array<struct<title, content>>: what stands before the first heading, untitled, and below each heading.

    Every line that looks like a heading is one, inside code fences too. Sections without content go.
    """
    return let(lines(text), _sections)


def _sections(every: Column) -> Column:
    marks = F.filter(F.transform(every, lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
    bounds = let(marks, lambda m: F.arrays_zip(F.concat(F.array(F.lit(-1)), m).alias("s"), F.concat(m, F.array(F.size(every))).alias("e")))

    def one(b: Column) -> Column:
        title = F.when(b["s"] < 0, F.lit("")).otherwise(heading_title(F.get(every, b["s"])))
        return F.struct(title.alias("title"), strip(F.array_join(F.slice(every, b["s"] + 2, b["e"] - b["s"] - 1), "\n")).alias("content"))

    return F.filter(F.transform(bounds, one), lambda x: x["content"] != "")
