"""A corpus cleaned stage by stage: toxicity, line dedup, near copies, benchmark passages, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, lines, mixing, ngram_join, toxicity
from millrace.llm._spark import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; null and empty texts are scored as texts without toxic words."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=True, name="__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows that stand earlier in the corpus; one that loses all its lines goes, one that had none stays."""
    kept = lines.dedup_lines(docs, counts=("__lines", "__gone")).filter("__gone = 0 or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the n-gram join links, the document of the smallest id; rows of null id stay."""
    kept = ngram_join.ngram_join(docs, links=False).filter("component_id = doc_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("__kept"), "left").filter("doc_id is null or __kept is not null").select(*docs.columns)


def unseen_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def weighed_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their text and how often they are taken; a table without sources or languages is an error that says so."""
    absent = {"doc_id", "text", "lang", "source"} - {*docs.columns}
    if absent:
        raise ValueError(f"the mix needs {', '.join(sorted(absent))}")
    return mixing.mix(docs, keep=("text", "lang", "source")).filter("copies > 0").select("doc_id", "text", "lang", "source", "size", "target", "copies", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_language),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_a_kind),
    ("benchmark decontamination", unseen_tests),
    ("mixing sources to target weights", weighed_mix),
]

#: The first stage learns, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
