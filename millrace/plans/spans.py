"""Spans of source trees, and the plans over them: conversations of clusters, and three record formats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ClusterConfig
from ..functions import paths
from ..operators import cluster, formats, synthesis
from ..operators.extract import with_markdown_spans, with_python_spans
from ..operators.filters import is_meaningful
from ..operators.split import counts, prefix, train_valid_test
from ..operators.tags import tags
from ..sources.cache import embedded
from ..sources.repository import span_files
from ..sources.sinks import write_splits, write_stats
from ..storage import durable, written
from ..streaming.raw import listed, resumable

SPAN_ORDER = ["source_path", "seq"]
SPAN_FIELDS = ["source_path", "kind", "content", "line_start", "line_end", "name", "title", "tags"]
#: What questions about spans, and their records, are made of.
ASKED_FIELDS = ["source_path", "kind", "content", "line_start", "line_end", "name", "tags"]


def spans_of(files: DataFrame, keywords: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """All spans of the files (path, suffix, text), tagged: (source_path, seq, kind, content, line_start, line_end, name, title, tags)."""
    py = F.col("suffix") == ".py"
    found = F.when(py, with_python_spans(F.when(py, F.col("text")), paths.name(F.col("path")))).otherwise(with_markdown_spans(F.when(~py, F.col("text"))))
    each = files.select(F.col("path").alias("source_path"), F.posexplode(found).alias("seq", "s")).select("source_path", "seq", "s.*")
    return each.withColumn("tags", tags(F.col("content"), F.col("kind"), keywords))


def clusters_of(spans: DataFrame, embed: Callable[[list[str]], np.ndarray], config: ClusterConfig | None = None, model: str = "default", cache: str | None = None) -> DataFrame:
    vectors = embedded(spans, "content", embed, model, cache)
    return cluster.assemble(cluster.hdbscan(vectors, "embedding", SPAN_ORDER, config), SPAN_FIELDS)


def conversations(spark: SparkSession, root: str, out: str, embed: Callable[[list[str]], np.ndarray], writer: synthesis.Model, critic: synthesis.Model, config: ClusterConfig | None = None, cache: str | None = None) -> dict:
    """Parse, tag, embed, cluster, synthesise and write; the first tenth of the conversations is valid."""
    found = durable(clusters_of(spans_of(span_files(spark, root)), embed, config, cache=cache))
    made = durable(synthesis.conversations(found, writer, critic))
    parted = prefix(made, ["conversation_id"])
    row = counts(parted).first()
    stats = {"total": row["total"], "train": row["train"], "valid": row["valid"]}
    write_splits(parted, out, "semantic.", keep_nulls=True, order=("conversation_id",))
    write_stats(spark, f"{out}/semantic.stats.json", stats)
    return stats


def record_formats(
    spark: SparkSession, root: str, out: str, model: synthesis.Model, name: str, max_spans: int | None = 10_000, seed: int = 17, pause: float = 0.0,
    rate: synthesis.Rate | None = None, resume: str | None = None,
) -> dict:
    """Questions about meaningful spans of a tree, answered by the model, as three formats in three splits each; returns the counts."""
    repo = root.rstrip("/").rsplit("/", 1)[-1]
    return formats_of(spans_of(span_files(spark, root)), repo, out, model, name, max_spans, seed, pause, rate, resume)


def formats_of(
    spans: DataFrame, repo: str, out: str, model: synthesis.Model, name: str, max_spans: int | None = 10_000, seed: int = 17, pause: float = 0.0,
    rate: synthesis.Rate | None = None, resume: str | None = None,
) -> dict:
    """record_formats() of given spans. With a folder to `resume` from, answers are kept there as they come, and none is asked for twice.

    Contents are in the work list alone: prompts are made of it as they are asked, and answers and their status are kept without; the
    one format that shows contents takes them from the list again.
    """
    spark, system = spans.sparkSession, formats.system_prompt(repo)
    meaningful = spans.filter(is_meaningful(F.col("kind"), F.col("content"))).select(*SPAN_ORDER, *(c for c in ASKED_FIELDS if c not in SPAN_ORDER))
    work = formats.work_list(meaningful, SPAN_ORDER, repo, max_spans).drop("context")
    ask = lambda rows: synthesis.answers(formats.with_context(rows), system, model, pause, rate).drop("context", "content")
    said = resumable(work, resume, ask) if resume else written(ask(work))
    work = listed(spark, resume, work.schema) if resume else work
    answered = written(formats.with_status(said, ["idx"]))
    kept = answered.filter("status = 'kept'")
    shown = kept.join(work.select("idx", F.substring("content", 1, formats.REFERENCE_CHARS).alias("content")), "idx")
    stats: dict = {}
    for i, (kind, rows) in enumerate((("sft", formats.sft(kept, system)), ("dpo", formats.dpo(kept)), ("grpo", formats.grpo(shown)))):
        parted = train_valid_test(rows, "idx", seed + i)
        row = counts(parted).first()
        stats[kind] = {"total": row["total"], "train": row["train"], "valid": row["valid"], "test": row["test"]}
        write_splits(parted, out, f"{name}_{kind}_", ("train", "valid", "test"), order=("rank", "idx"), drop=("idx",))
    n = answered.agg(F.count_if(F.col("status") == "kept").alias("k"), F.count_if(F.col("status") != "kept").alias("s")).first()
    stats |= {"success": n["k"], "skipped": n["s"]}
    write_stats(spark, f"{out}/{name}_stats.json", stats)
    return stats
