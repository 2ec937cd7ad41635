"""Line dedup: windows of three consecutive lines that stand earlier in the corpus go.

A line's trimmed text counts; blank lines belong to no window. Of each window's places in the
whole corpus the first by (doc_id, place) stays, null ids last; every line that lies in a later
place of some window is covered, and covered lines are removed. Documents of fewer than three
lines have no window and stay as they are, as do null and empty texts. Rows that agree in id and
text are one document: they keep or lose the same lines.

All is DataFrame code. The texts are cut into windows once, and their hashes written. First places are
found by minima that each task takes of its own rows before they are shuffled, so a frequent window is
one row a task. Of the windows that repeat, those with more than one in `HOT_SHARE` of all places, at most as many, are broadcast;
their places are dealt over as many salts as keep each below that share. The work is in proportion to a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

WIDTH = 3
#: Places of a window, as a share of all places of repeated windows (one in so many) and in number, beyond which they are dealt over several tasks.
HOT_SHARE, HOT_PLACES = 10_000, 1000
_BLANKS = "".join(map(chr, range(0x21)))


def _let(value: Column, fn) -> Column:
    """fn of a value that is worked out once, not for each element of an array."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    trimmed = F.filter(F.transform(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(_BLANKS))), lambda s: s != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def _windows(lines: Column, width: int) -> Column:
    """128 bits of each window, and its number."""

    def one(j: Column) -> Column:
        said = F.array_join(F.slice(lines, j + 1, width), "\n")
        return F.struct(F.xxhash64(said).alias("a"), F.xxhash64(F.lit(1), said).alias("b"), j.alias("j"))

    n = F.size(lines) - width
    return F.transform(F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>")), one)


def _document(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(id_col, text_col).alias("k"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(__doc, __later): for documents with covered lines, the numbers of the windows that stand earlier."""
    doc = docs.select(_document(id_col, text_col).alias("__doc"), _lines(F.col(text_col)).alias("__l"))
    each = written(doc.select("__doc", F.explode(_windows(F.col("__l"), width)).alias("w")).select("__doc", "w.*"))
    place = F.struct("__doc", "j")
    first = written(each.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    bound = max(HOT_PLACES, (first.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    salts = F.when(F.col("n") > bound, F.ceil(F.col("n") / bound)).otherwise(1).cast("int")
    hot = F.broadcast(first.filter(F.col("n") > bound).select("a", "b", salts.alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64("__doc", "j"), F.col("salts")), F.lit(0)).cast("int")
    dealt = each.join(hot, ["a", "b"], "left").select("__doc", "a", "b", "j", salt.alias("salt"))
    firsts = first.select("a", "b", "first", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    later = dealt.join(firsts, ["a", "b", "salt"]).filter(place != F.col("first"))
    return later.groupBy("__doc").agg(F.collect_set("j").alias("__later"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of the documents, the text without covered lines, and the numbers of lines and removed lines, in place of any of the names in `counts`."""
    later = repeated_windows(docs, id_col, text_col, width)
    kept = [c for c in docs.columns if c not in counts]
    both = docs.select(*kept, _document(id_col, text_col).alias("__doc")).join(later, "__doc", "left")
    lines = F.split(text_col, "\n", -1)

    def uncovered(every: Column) -> Column:
        """The lines that no later window covers."""
        full = F.filter(F.transform(every, lambda s, i: F.when(F.btrim(s, F.lit(_BLANKS)) != "", i)), lambda i: i.isNotNull())
        covered = F.array_distinct(F.flatten(F.transform("__later", lambda j: F.sequence(j, j + width - 1))))
        places = _let(full, lambda at: F.transform(covered, lambda j: F.get(at, j)))
        rest = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), places)
        return F.transform(rest, lambda i: F.get(every, i))

    some = F.col("__later").isNotNull()
    left = F.when(some, _let(lines, uncovered))
    cut = both.select(*kept, left.alias("__left"))
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return cut.select(
        *(F.when(F.col("__left").isNull(), F.col(c)).otherwise(F.array_join("__left", "\n")).alias(c) if c == text_col else F.col(c) for c in kept),
        n.alias(counts[0]), F.when(F.col("__left").isNull(), F.lit(0)).otherwise(n - F.size("__left")).cast("long").alias(counts[1]),
    )
