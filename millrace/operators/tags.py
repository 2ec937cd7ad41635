"""Tags of spans by keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags and the words that give them, and tags that a span's kind gives.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "factor": ("factor", "alpha", "exposure", "top20"),
    "regime": ("regime", "volatility", "dispersion", "momentum"),
    "optimizer": ("optimization", "target", "constraint", "solver"),
    "logging": ("logging.", "info(", "warning(", "error("),
    "validation": ("raise ", "ValueError", "assert "),
    "report": ("heatmap", "quilt", "chart", "report"),
}
KINDS = {"logging_call": "logging", "module_constant": "config"}


def tags(content: Column, kind: Column | None = None, keywords: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Sorted tags of which a keyword stands anywhere in the content, in either case."""
    low = F.lower(content)
    found = [F.when(low.rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(tag)) for tag, words in (keywords or KEYWORDS).items() if words]
    if kind is not None:
        found += [F.when(kind == k, F.lit(tag)) for k, tag in KINDS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found).cast("array<string>"))))


def merged(old: Column, new: Column) -> Column:
    """Tags that were there, then new ones in their order."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), new)
