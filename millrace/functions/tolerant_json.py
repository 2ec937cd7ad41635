"""JSON from the mouths of models: objects with talk around them, and fields that may be absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string,evidence:array<map<string,string>>,metadata:map<string,string>>"


def _strict(text: Column) -> Column:
    """One JSON value with nothing after it; the parser alone stops at a value's end."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def parse(text: Column) -> Column:
    """The whole text as JSON, else what stands from its first { to its last }, else null."""
    return F.coalesce(_strict(text), _strict(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def field(parsed: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(parsed, path, kind)


def turns(parsed: Column) -> Column:
    """The turns of a conversation, absent fields filled in."""
    said = F.coalesce(F.from_json(F.to_json(F.try_variant_get(parsed, "$.turns", "variant")), f"array<{TURN}>"), F.array().cast(f"array<{TURN}>"))
    return F.transform(
        said,
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("assistant")).alias("role"),
            F.coalesce(t["content"], F.lit("")).alias("content"),
            F.coalesce(t["evidence"], F.array().cast("array<map<string,string>>")).alias("evidence"),
            F.coalesce(t["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
        ),
    )
