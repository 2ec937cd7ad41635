"""Answers that are kept as they come, and a rate for a whole job."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import synthesis
from millrace.streaming.raw import resumable


def counted(log, stop=None):
    """A model that notes each call, and whose process dies at a prompt while a file is there."""

    def model(system, prompt, max_tokens, heat):
        with open(log, "a") as f:
            f.write(f"{prompt} {time.time()}\n")
        if stop and prompt == "p17" and os.path.exists(stop):
            os._exit(1)
        return prompt.upper()

    return model


def test_a_stopped_run_goes_on(spark, tmp_path):
    """A run whose worker dies keeps the batches that were done; the next asks only for the rest, and gives what an undisturbed run gives."""
    work = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.col("id").alias("idx"))
    log, stop = tmp_path / "calls", tmp_path / "stop"
    stop.touch()
    ask = lambda rows: synthesis.asked(rows, "", "prompt", "said", counted(log, stop), 1, 0.0)
    with pytest.raises(Exception):
        resumable(work, f"{tmp_path}/raw", ask, parts=8)
    first = Counter(line.split()[0] for line in log.read_text().splitlines())
    stop.unlink()
    got = {r.idx: r.said for r in resumable(work.withColumn("idx", F.col("idx") + 1), f"{tmp_path}/raw", ask, parts=8).collect()}
    calls = Counter(line.split()[0] for line in log.read_text().splitlines())
    again = {p for p, n in calls.items() if n > 1}
    assert got == {i: f"P{i}" for i in range(40)} and len(calls) == 40
    assert "p17" in first and again <= set(first) and len(again) <= 8  # the batch that was cut short
    assert resumable(work, f"{tmp_path}/raw", ask, parts=8).count() == 40
    assert Counter(line.split()[0] for line in log.read_text().splitlines()) == calls


def test_rate_of_all_tasks(spark, tmp_path):
    log = tmp_path / "calls"
    rows = spark.range(48).repartition(12).select(F.col("id").cast("string").alias("prompt"))
    synthesis.asked(rows, "", "prompt", "said", counted(log), 1, 0.0, rate=synthesis.Rate(16.0, lanes=4)).collect()
    at = sorted(float(line.split()[1]) for line in log.read_text().splitlines())
    assert len(at) == 48
    for a in at:  # no second holds more calls than the rate, but for one at its end
        assert sum(a <= b < a + 1 for b in at) <= 16 + 4
    assert (len(at) - 1) / (at[-1] - at[0]) <= 16 * 1.1


def test_both_calls_of_an_answer_share_the_rate(spark, tmp_path):
    work = spark.range(10).select(F.col("id").alias("idx"), F.concat(F.lit("q"), F.col("id")).alias("question"), F.lit("c").alias("context"))
    log = tmp_path / "calls"

    def model(system, prompt, max_tokens, heat):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return prompt * 3

    rows = synthesis.answers(work, "", model, rate=synthesis.Rate(20.0, lanes=2)).collect()
    at = sorted(map(float, log.read_text().split()))
    assert len(at) == 20 and all(r.rejected for r in rows) and 19 / (at[-1] - at[0]) <= 22
