"""The plans that call models, over whole documents, with models whose answers follow from the prompt's digest.

A model here is told apart from a real one only by what it says: some prompts fail, some get nothing, prose or no JSON, so that
every way of a row through the plans is taken.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import formats, synthesis
from .operators.split import prefix
from .plans import spans
from .sources import cache, sinks
from .storage import durable, read_table, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def digest(said: str) -> str:
    return hashlib.md5(said.encode()).hexdigest()


def writer(system: str, prompt: str, max_tokens: int, heat: float) -> str | None:
    d = digest(prompt)
    if d[0] in "01":
        raise ValueError("no answer")
    if d[0] in "23":
        return None if d[0] == "2" else "There is nothing to say."
    named = "" if d[1] in "0123" else d[:12]
    return f'Here it is:\n```json\n{{"conversation_id": "{named}", "turns": [{{"role": "user", "content": "{d}"}}, {{"content": "{max_tokens}"}}], "summary": {{"risk_notes": "{d[2]}"}}}}\n```'


def critic(system: str, prompt: str, max_tokens: int, heat: float) -> str | None:
    d = digest(prompt)
    if d[0] == "0":
        raise ValueError("no answer")
    return None if d[0] == "1" else f"OK {d} {max_tokens}"


def answerer(system: str, prompt: str, max_tokens: int, heat: float) -> str | None:
    d = digest(prompt)
    if d[0] == "0":
        raise ValueError("no answer")
    if d[0] == "1":
        return None
    return "short" if d[0] == "2" else f"Answer {d} " + "with reasons " * 12 + str(max_tokens)


def embed(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), int(digest(t)[:6], 16)] for t in texts], np.float32).reshape(-1, 2)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet")


def _doc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as spans of files of their own."""
    i = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return _docs(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("d/"), i, F.lit(".md")).alias("source_path"), F.lit(0).alias("seq"), F.when(F.col("doc_id") % 2 == 0, "function_definition").otherwise("markdown_section").alias("kind"),
        F.col("text").alias("content"), F.lit(1).alias("line_start"), F.col("n_chars").cast("int").alias("line_end"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("doc"), "lang")).alias("tags"),
    )


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents a cluster."""
    each = _doc_spans(spark, sf_dir).withColumn("cluster", F.floor(F.col("doc_id") / 3))
    found = each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("doc_id", "source_path", "line_start", "line_end", "tags", "content"))).alias("spans"))
    clusters = found.select(
        F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("cluster_id"), "spans",
        F.array_sort(F.array_distinct(F.flatten(F.col("spans.tags")))).alias("ontology_tags"), F.col("spans.source_path").alias("source_files"),
    )
    return synthesis.conversations(clusters, writer, critic)


def l1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _conversations(spark, sf_dir)
    return made.select(
        "conversation_id", F.array_join("source_files", ",").alias("files"), F.array_join("ontology_tags", ",").alias("tags"), F.size("turns").alias("n_turns"),
        F.col("turns")[0]["content"].alias("said"), F.col("turns")[1]["role"].alias("second_role"), F.col("turns")[1]["content"].alias("second_said"), F.col("summary")["risk_notes"].alias("risk"), "critique",
    )


def k3_semantic_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as the span plan writes them, and read again."""
    folder = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    parted = prefix(durable(_conversations(spark, sf_dir)), ["conversation_id", "source_files"])
    sinks.write_splits(parted, folder, "semantic.", keep_nulls=True, order=("conversation_id",))
    shape = "conversation_id string, source_files array<string>, critique string"
    train, valid = (sinks.read_jsonl(spark, [f"{folder}/semantic.{name}.jsonl"], shape).withColumn("split", F.lit(name)) for name in ("train", "valid"))
    return train.unionByName(valid).select("conversation_id", F.array_join("source_files", ",").alias("files"), "critique", "split")


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.work_list(_doc_spans(spark, sf_dir), spans.SPAN_ORDER, "corpus", max_spans=None)


def l4_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen and rejected answers about each document, and what becomes of them."""
    said = durable(synthesis.answers(_work(spark, sf_dir), formats.system_prompt("corpus"), answerer))
    return formats.with_status(said, ["idx"]).select("idx", "question_type", F.md5("context").alias("context_md5"), "chosen", "rejected", "status")


def o3_work_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 spans are the work of the multi-format plan when no more are asked for."""
    return formats.work_list(_doc_spans(spark, sf_dir), spans.SPAN_ORDER, "corpus", max_spans=200).select("idx", "source_path", "question")


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    folder = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    return folder, spans.formats_of(_doc_spans(spark, sf_dir), "corpus", folder, answerer, "docs", max_spans=None, resume=f"{folder}/raw")


def k6_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the three formats as they were written, answers kept in batches before."""
    folder, _ = _written(spark, sf_dir)
    meta = "metadata struct<source_file:string,tags:array<string>,question_type:string,lines:string>"
    shapes = {"sft": f"messages array<struct<role:string,content:string>>, {meta}", "dpo": f"prompt string, chosen string, rejected string, {meta}", "grpo": f"prompt string, reference string, {meta}"}
    said = {"sft": F.concat_ws("|", F.col("messages")[1]["content"], F.col("messages")[2]["content"]), "dpo": F.concat_ws("|", "prompt", "chosen", "rejected"), "grpo": F.concat_ws("|", "prompt", "reference")}
    out = None
    for kind, shape in shapes.items():
        rows = sinks.read_jsonl(spark, [f"{folder}/docs_{kind}_{part}.jsonl" for part in ("train", "valid", "test")], shape)
        one = rows.select(F.lit(kind).alias("format"), "metadata.source_file", "metadata.question_type", "metadata.lines", F.array_join("metadata.tags", ",").alias("tags"), F.md5(said[kind]).alias("said_md5"))
        out = one if out is None else out.unionByName(one)
    return out


def k7_format_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts file of the same run."""
    folder, _ = _written(spark, sf_dir)
    part = "struct<total:long,train:long,valid:long,test:long>"
    stats = spark.read.schema(f"sft {part}, dpo {part}, grpo {part}, success long, skipped long").option("multiLine", True).json(f"{folder}/docs_stats.json")
    return stats.select(F.explode(F.array(*(F.struct(F.lit(k).alias("format"), f"{k}.*") for k in ("sft", "dpo", "grpo")))).alias("x"), "success", "skipped").select("x.*", "success", "skipped")


def v5_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all documents after those of even ids are in the cache."""
    path, docs = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}", _docs(spark, sf_dir).select("doc_id", "text")
    cache.embedded(docs.filter("doc_id % 2 = 0"), "text", embed, "m", path).count()
    before = durable(cache.read(docs, path).select("key").distinct())
    rows = cache.embedded(docs, "text", embed, "m", path).withColumn("key", cache.key(F.col("text"), "m"))
    known = rows.join(before.withColumn("cached", F.lit(True)), "key", "left")
    entries = spark.read.schema(cache.SCHEMA).parquet(path).groupBy("key").agg(F.count(F.lit(1)).alias("entries"))
    return known.join(entries, "key").select("doc_id", F.col("embedding")[0].cast("long").alias("length"), F.col("embedding")[1].cast("long").alias("code"), F.coalesce("cached", F.lit(False)).alias("cached"), "entries")


QUERIES: dict[str, Query] = {f.__name__: f for f in (l1_conversations, k3_semantic_splits, l4_answers, o3_work_limit, k6_formats, k7_format_stats, v5_embedding_cache)}
