"""Conversations and answers from a language model that the caller hands in as a function.

The functions run on the executors, once for each row; what fails is a row with an `error`, not a lost job.
Nothing here knows a provider: llm(system, prompt, max_tokens, temperature) returns a text or None.
A rate is the whole job's: rows are dealt over a number of lanes, partitions of which each waits its share of the
rate before every call, so however many of them run at a time, no more calls begin in a second than the rate says.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tolerant_json
from ..functions.text import strip
from .filters import is_boilerplate
from .formats import chosen_prompt, rejected_prompt, tag_list

Model = Callable[[str, str, int, float], "str | None"]

#: Prompts and limits of conversations and their critique.
SYSTEM = (
    "You are a finance-focused AI documentation expert. "
    "Given source excerpts, produce a multi-turn conversation that explains the code, "
    "highlights validation/logging, and summarizes key financial insights. "
    "Always cite evidence using file paths and line ranges."
)
CONVERSATION = (
    "Create a JSON object with keys: conversation_id, turns (list of {role, content, evidence, metadata}), "
    "summary (with keys bullet_points, data_quality, risk_notes). Use the provided context strictly.\n\n"
    "Context:\n"
)
CRITIQUE = "Review the following JSON conversation for factual accuracy and clarity. Respond with concise critique (or 'OK' if solid).\n\n"
CONVERSATION_TOKENS, CONVERSATION_HEAT = 1800, 0.2
CRITIQUE_TOKENS, CRITIQUE_HEAT = 400, 0.0
CHOSEN_TOKENS, REJECTED_TOKENS, ANSWER_HEAT = 1200, 200, 0.4


def context(spans: Column) -> Column:
    """Spans (source_path, line_start, line_end, tags, content) as numbered blocks."""

    def block(s: Column, i: Column) -> Column:
        return F.concat(
            F.lit("Span "), (i + 1).cast("string"), F.lit(":\nPath: "), s["source_path"], F.lit("\nLines: "), s["line_start"].cast("string"), F.lit("-"), s["line_end"].cast("string"),
            F.lit("\nTags: "), tag_list(s["tags"]), F.lit("\nContent:\n"), strip(s["content"]), F.lit("\n"),
        )

    return F.array_join(F.transform(spans, block), "\n")


@dataclass(frozen=True)
class Rate:
    """Calls a second for a whole job, made by up to so many tasks at a time."""

    per_second: float
    lanes: int = 8

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.lanes)

    def wait(self, first: bool) -> None:
        """Before a call: a lane's turn comes once in lanes / per_second; the first turns of the lanes follow one another."""
        lane = TaskContext.get().partitionId() % self.lanes
        time.sleep(((lane + 1) if first else self.lanes) / self.per_second)


def asked(rows: DataFrame, system: str, prompt: str, answer: str, model: Model, max_tokens: int, heat: float, pause: float = 0.0, rate: Rate | None = None) -> DataFrame:
    """The rows with the model's answer to the column `prompt`, and `error` where it failed; rows without a prompt aren't asked.

    `pause` seconds lie between a task's calls; a rate holds for all tasks together. The rows may be a stream's.
    """
    kept = [c for c in rows.columns if c not in (answer, "error")]
    waited: list[bool] = []  # a task's own, as each task gets its own copy of the function

    def call(p: str | None) -> tuple[str | None, str | None]:
        if p is None:
            return None, None
        if rate:
            rate.wait(not waited)
            waited[:] = [True]
        said = failed = None
        try:
            said = model(system, p, max_tokens, heat)
        except Exception as e:  # one row's failure is that row's
            failed = f"{type(e).__name__}: {e}"
        if pause:
            time.sleep(pause)
        return said, failed

    # Only prompts go to Python, a hundred at a time, however long the other columns; each is asked once, as the optimizer copies no call that may differ.
    said = F.udf(call, "said string, failed string", useArrow=False).asNondeterministic()
    dealt = (rate.dealt(rows) if rate else rows).withColumn("__said", said(prompt))
    return dealt.select(*(F.col(f"`{c}`") for c in kept), F.col("__said.said").alias(answer), F.col("__said.failed").alias("error"))


def conversations(clusters: DataFrame, writer: Model, critic: Model) -> DataFrame:
    """Conversation records of clusters (cluster_id, spans, ontology_tags, source_files).

    Clusters whose call fails or whose answer holds no JSON give no record.
    """
    said = asked(clusters.withColumn("prompt", F.concat(F.lit(CONVERSATION), context(F.col("spans")))), SYSTEM, "prompt", "said", writer, CONVERSATION_TOKENS, CONVERSATION_HEAT)
    read = said.withColumn("parsed", tolerant_json.parse(F.col("said"))).filter("parsed is not null").drop("error", "prompt")
    named = F.coalesce(F.nullif(tolerant_json.field(F.col("parsed"), "$.conversation_id", "string"), F.lit("")), F.concat(F.lit("cluster-"), F.sha2("said", 256)))
    made = read.select(
        named.alias("conversation_id"), "source_files", "ontology_tags", tolerant_json.turns(F.col("parsed")).alias("turns"),
        F.from_json(F.to_json(F.try_variant_get("parsed", "$.summary", "variant")), "map<string,string>").alias("summary"), F.concat(F.lit(CRITIQUE), F.col("said")).alias("prompt"),
    )
    judged = asked(made, "", "prompt", "critique", critic, CRITIQUE_TOKENS, CRITIQUE_HEAT).filter("error is null")
    return judged.select("conversation_id", "source_files", "ontology_tags", "turns", F.coalesce("summary", F.create_map().cast("map<string,string>")).alias("summary"), F.coalesce("critique", F.lit("")).alias("critique"))


def answers(work: DataFrame, system: str, model: Model, pause: float = 0.0, rate: Rate | None = None) -> DataFrame:
    """The work list with a chosen answer, and a rejected one for those that have it. Of a rate, each kind of call gets half."""
    half = rate and replace(rate, per_second=rate.per_second / 2)
    prompted = work.withColumn("__p", chosen_prompt(F.col("question"), F.col("context")))
    good = asked(prompted, system, "__p", "chosen", model, CHOSEN_TOKENS, ANSWER_HEAT, rate=half).drop("error")
    wanted = F.coalesce(F.col("chosen"), F.lit("")) != ""
    again = good.withColumn("__p", F.when(wanted & ~is_boilerplate(F.col("chosen")), rejected_prompt(F.col("question"))))
    return asked(again, system, "__p", "rejected", model, REJECTED_TOKENS, ANSWER_HEAT, pause, half).drop("error", "__p")
