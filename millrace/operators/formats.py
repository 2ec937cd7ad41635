"""Questions about spans, and the three record formats of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .builders import chat
from .dedupe import dedupe_answers
from .filters import is_boilerplate
from .split import numbered

#: System prompts, question types and templates, prompts for answers.
DEFAULT_SYSTEM = (
    "You are an expert software engineer and technical analyst. "
    "Answer questions about code with deep technical precision, using exact variable and function names, "
    "explaining design decisions, tradeoffs, and implementation details clearly."
)
REPO_SYSTEM = (
    "You are an expert in the `{repo}` codebase. "
    "Answer questions about its code with deep technical precision, using exact variable and function names, "
    "explaining design decisions, tradeoffs, and implementation details clearly."
)
QUESTIONS = (
    ("explain", "What does `{name}` do and why is it designed this way?"),
    ("domain", "What is the domain-specific intuition behind the logic in `{name}`?"),
    ("connect", "How does `{name}` fit into the broader `{repo}` system?"),
    ("implement", "Walk through the key implementation decisions in `{name}` and what alternatives were considered."),
    ("debug", "What are the edge cases or failure modes in `{name}` and how are they handled?"),
    ("compare", "What are the tradeoffs in the approach taken by `{name}` compared to simpler alternatives?"),
)
CHOSEN_PROMPT = (
    "Answer this question about the following code. Be specific, use exact variable/function names, "
    "and include financial reasoning where relevant. Write 3-6 paragraphs.\n\n"
    "Question: ",
    "\n\nCode:\n",
)
REJECTED_PROMPT = (
    "Write a deliberately vague, generic, unhelpful answer to this question. "
    "Use AI-isms like 'it is important to note', 'this function handles', 'various operations'. "
    "Do NOT mention specific variable names, numbers, or financial concepts. Keep it to 2 sentences.\n\n"
    "Question: "
)
FALLBACK = ("This code handles various operations related to ", ".")
CONTEXT_CHARS, REFERENCE_CHARS = 3500, 3000


def system_prompt(repo: str | None = None) -> str:
    return REPO_SYSTEM.format(repo=repo) if repo else DEFAULT_SYSTEM


def tag_list(tags: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(tags, ", "), F.lit("")), F.lit("none"))


def span_name(name: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), paths.stem(path))


def span_context(path: Column, kind: Column, start: Column, end: Column, tags: Column, content: Column) -> Column:
    return F.concat(
        F.lit("File: "), paths.name(path), F.lit("\nType: "), kind, F.lit("\nLines: "), start.cast("string"), F.lit("-"), end.cast("string"),
        F.lit("\nTags: "), tag_list(tags), F.lit("\n\n"), F.substring(content, 1, CONTEXT_CHARS),
    )


def question(position: Column, name: Column, repo: str) -> tuple[Column, Column]:
    """(type, question): the templates in turn."""
    turn = F.element_at(F.array(*(F.struct(F.lit(t).alias("type"), F.lit(q).alias("text")) for t, q in QUESTIONS)), (F.pmod(position, F.lit(len(QUESTIONS))) + 1).cast("int"))
    # the name goes in last, so that what it holds is not taken for a place to fill
    return turn["type"], F.replace(F.replace(turn["text"], F.lit("{repo}"), F.lit(repo)), F.lit("{name}"), name)


def work_list(spans: DataFrame, order: list, repo: str, max_spans: int | None = 10_000) -> DataFrame:
    """The first spans in their order, or all, each with a question, its type, and its context."""
    first = numbered(spans if max_spans is None else spans.orderBy(*order).limit(max_spans), order, "idx")
    kind, asked = question(F.col("idx"), span_name(F.col("name"), F.col("source_path")), repo)
    return with_context(first.withColumns({"question_type": kind, "question": asked}))


def with_context(spans: DataFrame) -> DataFrame:
    return spans.withColumn("context", span_context(*(F.col(c) for c in ("source_path", "kind", "line_start", "line_end", "tags", "content"))))


def chosen_prompt(asked: Column, context: Column) -> Column:
    return F.concat(F.lit(CHOSEN_PROMPT[0]), asked, F.lit(CHOSEN_PROMPT[1]), context)


def rejected_prompt(asked: Column) -> Column:
    return F.concat(F.lit(REJECTED_PROMPT), asked)


def rejected_or_fallback(answer: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(answer, F.lit("")), F.concat(F.lit(FALLBACK[0]), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(FALLBACK[1])))


def with_status(answered: DataFrame, order: list, question: str = "question", answer: str = "chosen") -> DataFrame:
    """`status`: kept, or skipped for want of an answer, for boilerplate, or as a duplicate."""
    empty = F.coalesce(F.col(answer), F.lit("")) == ""
    judged = answered.withColumn("status", F.when(empty, "empty").when(is_boilerplate(F.col(answer)), "boilerplate").otherwise("kept"))
    good = dedupe_answers(judged.filter("status = 'kept'"), question, answer, order).select(*order, F.lit(True).alias("__first"))
    return judged.join(good, order, "left").withColumn("status", F.when((F.col("status") == "kept") & F.col("__first").isNull(), "duplicate").otherwise(F.col("status"))).drop("__first")


def _meta() -> Column:
    return F.struct(
        paths.name(F.col("source_path")).alias("source_file"), F.col("tags"), F.col("question_type"),
        F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("lines"),
    ).alias("metadata")


def sft(rows: DataFrame, system: str) -> DataFrame:
    return rows.select("idx", chat(F.col("question"), F.col("chosen"), system).alias("messages"), _meta())


def dpo(rows: DataFrame) -> DataFrame:
    return rows.select("idx", F.col("question").alias("prompt"), "chosen", rejected_or_fallback(F.col("rejected"), F.col("kind")).alias("rejected"), _meta())


def grpo(rows: DataFrame) -> DataFrame:
    return rows.select("idx", F.col("question").alias("prompt"), F.substring("content", 1, REFERENCE_CHARS).alias("reference"), _meta())
