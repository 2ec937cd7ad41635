"""Text functions as column expressions, with the semantics of Python's str methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of str.strip() and str.split() as a Java character class; needs (?U).
_WHITE = r"[\s\x1c-\x1f]"
#: The same characters.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once; what a lambda uses from outside is otherwise worked out for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def approx_tokens(text: Column) -> Column:
    """A token for every four code points, one at least; null is null."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def lines(text: Column) -> Column:
    """str.splitlines()."""
    split = F.split(text, r"\R|[\x1c-\x1e]", -1)
    return let(split, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def strip(text: Column) -> Column:
    """str.strip()."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    """str.split()."""
    return F.filter(F.split(text, rf"(?U){_WHITE}+", -1), lambda w: w != "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def is_upper(text: Column) -> Column:
    """str.isupper(): some cased letter and none in lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def starts_alpha(text: Column) -> Column:
    """Whether the first character is a letter."""
    return text.rlike(r"^\p{L}")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def heading_title(line: Column) -> Column:
    """What a heading says: leading # and spaces off, then stripped."""
    return strip(F.regexp_replace(line, "^[# ]+", ""))


def indent(line: Column) -> Column:
    """Width of leading white space; a tab counts four."""
    return F.length(F.replace(F.regexp_extract(line, r"^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


def module_docstring(text: Column) -> Column:
    """A triple-quoted string that opens the text, quotes included; else empty."""
    return F.regexp_extract(text, r"(?sU)\A[\s\x1c-\x1f]*(\"\"\".*?\"\"\"|'''.*?''')", 1)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def show(x: float) -> str:
    """Whole numbers without a point, others with ten significant digits, zeros at the end taken off."""
    return str(int(x)) if x.is_integer() else f"{x:.10g}".rstrip("0").rstrip(".")


def display_float(number: Column) -> Column:
    return F.udf(lambda x: None if x is None else show(float(x)), "string", useArrow=True)(number)
