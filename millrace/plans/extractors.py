"""Extractors for further kinds of files: suffixes, and a function from a text to records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.builders import RECORDS

Extractor = Callable[[str], list[dict]]
_FIELDS = ("messages", "task", "source_type", "title", "name")
_registered: dict[str, Extractor] = {}


def register_extractor(suffixes: tuple[str, ...], fn: Extractor) -> None:
    """From now on files with these suffixes give the records that fn makes of their text."""
    for s in suffixes:
        _registered[s] = fn


def registered_suffixes() -> tuple[str, ...]:
    return tuple(sorted(_registered))


def registered_records(suffix: Column, text: Column) -> Column | None:
    """Records of files of registered suffixes; null for others, None where none is registered."""
    fns = dict(_registered)
    if not fns:
        return None

    def run(s: str | None, t: str | None) -> list[dict] | None:
        if s not in fns or t is None:
            return None
        return [{f: r.get(f) for f in _FIELDS} for r in fns[s](t)]

    return F.udf(run, RECORDS, useArrow=True)(suffix, text)
