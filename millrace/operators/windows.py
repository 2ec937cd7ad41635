"""Long texts cut into overlapping windows of words, and code into chunks at blank lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, is_blank, let, lines, strip, words

#: Windows that the original cuts a text into at most.
MOST_WINDOWS = 33


def word_windows(text: Column, window: int, overlap: int = 120, most: int | None = MOST_WINDOWS) -> Column:
    """Windows of `window` words, each `window - overlap` after the last, white space as single spaces; the first `most`, or with None all of the text."""
    step, none = max(1, window - overlap), F.array().cast("array<string>")

    def cut(w: Column) -> Column:
        last = F.ceil(F.size(w) / step).cast("int") - 1
        last = last if most is None else F.least(last, F.lit(most - 1))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda p: F.array_join(F.slice(w, p * step + 1, window), " "))
        return F.when(F.size(w) > 0, parts).otherwise(none)

    return let(words(text), cut) if window > 0 else none


def windowed(content: Column, window: int, overlap: int = 120, most: int | None = MOST_WINDOWS) -> Column:
    """The content as it is while its approximate tokens fit, else its windows."""
    return F.when(approx_tokens(content) > window, word_windows(content, window, overlap, most)).otherwise(F.array(content))


def blank_line_chunks(code: Column, min_lines: int, max_chunks: int) -> Column:
    """Chunks of code that a blank line ends once they have `min_lines` lines; shorter ones go.

    A blank line before that is part of the chunk. Chunks are stripped, cut to `max_chunks`, and then empty ones left out.
    A chunk ends at the first blank line that is `min_lines` or more after its start, so chunks are found by going through the
    numbers of blank lines, once for each chunk that is kept.
    """
    none = F.array().cast("array<string>")
    if max_chunks <= 0:
        return F.when(code.isNotNull(), none)

    def of(every: Column) -> Column:
        blank = F.filter(F.transform(every, lambda line, i: F.when(is_blank(line), i)), lambda i: i.isNotNull())
        return let(blank, lambda marks: bounded(every, marks))

    def bounded(every: Column, marks: Column) -> Column:
        n = F.size(every)
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<s:int,e:int>>").alias("done"))
        most = F.least(F.lit(max_chunks), F.floor(n / max(1, min_lines)).cast("int") + 1)

        def step(a: Column, _: Column) -> Column:
            first = a["s"]
            if min_lines <= 0:  # blank lines that a chunk would start with end nothing
                first = F.coalesce(F.get(F.filter(F.sequence(first, F.greatest(first, n - 1)), lambda i: ~F.array_contains(marks, i)), F.lit(0)), n)
            end = F.coalesce(F.get(F.filter(marks, lambda b: b >= first + min_lines), F.lit(0)), n)
            chunk = F.struct(first.cast("int").alias("s"), end.cast("int").alias("e"))
            done = F.when((end - first >= min_lines) & (first < n), F.array_append(a["done"], chunk)).otherwise(a["done"])
            return F.struct((end + 1).cast("int").alias("s"), done.alias("done"))

        found = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["done"])
        said = F.transform(found, lambda c: strip(F.array_join(F.slice(every, c["s"] + 1, c["e"] - c["s"]), "\n")))
        return F.filter(said, lambda c: c != "")

    return let(lines(code), of)
