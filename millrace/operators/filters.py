"""Predicates and caps over chat records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, strip

#: Phrases of answers that say nothing, and the shortest answer that may say something.
BOILERPLATE = (
    "this code appears to be",
    "handles financial data processing",
    "financial data processing",
    "code analysis",
    "system component",
)
SHORTEST_ANSWER = 150
#: Kinds of spans worth a question, and their least length.
SPAN_KINDS = ("function_definition", "class_definition", "markdown_section")
SHORTEST_SPAN = 400


def message_tokens(messages: Column) -> Column:
    """Approximate tokens of all messages; messages without content count nothing."""
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.coalesce(approx_tokens(m["content"]), F.lit(0)))


def token_budget(messages: Column, least: int = 48, most: int = 4096) -> Column:
    return message_tokens(messages).between(least, most)


def within_budget(messages: Column, most: int, tokens: Callable[[Column], Column] = approx_tokens) -> Column:
    """The upper bound alone, with any counter of tokens."""
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.coalesce(tokens(m["content"]).cast("int"), F.lit(0))) <= most


def redacted(messages: Column, patterns: dict[str, str] | None = None) -> Column:
    """The messages with each pattern replaced; without patterns, as they are."""
    if not patterns:
        return messages

    def clean(content: Column) -> Column:
        for found, put in patterns.items():
            content = F.regexp_replace(content, found, put)
        return content

    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), clean(m["content"]).alias("content")))


def file_cap(records: DataFrame, path: str, order: list[str], cap: int = 15) -> DataFrame:
    """The first `cap` records of each path; Spark cuts each task's rows before it shuffles them."""
    first = Window.partitionBy(path).orderBy(*order)
    return records.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= cap).drop("__n")


def is_boilerplate(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(map(re.escape, BOILERPLATE))) | (F.length(strip(answer)) < SHORTEST_ANSWER)


def is_meaningful(kind: Column, content: Column) -> Column:
    return kind.isin(*SPAN_KINDS) & (F.length(strip(content)) >= SHORTEST_SPAN)
