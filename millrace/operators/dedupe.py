"""First record of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key. A task's later rows of a key go before the shuffle, so a key that very many rows share is no burden."""
    first = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def messages_key(messages: Column) -> Column:
    """Role and content of all messages, nothing else of a record."""
    return F.sha2(F.to_json(messages), 256)


def answer_key(question: Column, answer: Column) -> Column:
    return F.md5(F.concat(question, F.lit("|||"), answer))


def dedupe_records(records: DataFrame, order: list, messages: str = "messages") -> DataFrame:
    return first_of(records, messages_key(F.col(messages)), order)


def dedupe_answers(rows: DataFrame, question: str, answer: str, order: list) -> DataFrame:
    return first_of(rows, answer_key(F.col(question), F.col(answer)), order)
