"""Click throttling, against the rule in plain Python, click by click."""

import datetime
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from held import SF_DIR
from pyspark.sql import functions as F

from millrace.llm import throttle

SHAPE = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"
EPOCH = datetime.datetime(1970, 1, 1)
us = lambda t: (t - EPOCH) // datetime.timedelta(microseconds=1)


def brute(rows, batches=8, delay=throttle.DELAY, cost=throttle.COST, burst=5):
    """Outcomes of (click_id, ts, arrived_at, client_id, ...), as stated."""
    rows = [r for r in dict.fromkeys(rows) if r[1] is not None and r[3] is not None]
    hour = lambda t: us(t) // throttle.HOUR
    lo, hi = min(hour(r[2]) for r in rows if r[2]), max(hour(r[2]) for r in rows if r[2])
    dealt = [[] for _ in range(batches)]
    for r in rows:
        b = ((hour(r[2]) if r[2] else lo) - lo) * batches // (hi - lo + 1)
        b += r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        dealt[min(b, batches - 1)].append(r)
    waiting, clients, out, seen = [], {}, [], []
    for b, came in enumerate(dealt):
        w = max(seen) - delay if seen else float("-inf")
        late = [r for r in came if us(r[1]) < w]
        out += [(r[0], "late", b, None, None, None) for r in late]
        due = [r for r in waiting if us(r[1]) < w]
        waiting = [r for r in waiting if us(r[1]) >= w] + [r for r in came if us(r[1]) >= w]
        if b == batches - 1:
            due, waiting = due + waiting, []
        for r in sorted(due, key=lambda r: (us(r[1]), r[0] is not None, r[0] or 0)):
            t = us(r[1])
            credit, last, start = clients.get(r[3], (burst * cost, t, None))
            credit = min(burst * cost, credit + t - last)
            if credit >= cost:
                credit, start = credit - cost, None
                out.append((r[0], "admitted", b, credit, None, None))
            else:
                start = t if start is None else start
                out.append((r[0], "throttled", b, credit, start, t + cost - credit))
            clients[r[3]] = credit, t, start
        seen += [us(r[1]) for r in came]
    return Counter(out)


def made(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def random_clicks(seed, clients=4, n=600, hours=40):
    """Bursts and pauses about as long as the cost, at times that often coincide; late, repeated and broken rows."""
    rnd, rows, start = random.Random(seed), [], datetime.datetime(2024, 1, 1)
    for c in range(clients):
        t = 0
        for _ in range(n // clients if c else n):
            t += rnd.choice([0, 0, 1, 7, 40, 60, 240, 900, 901, 3600, 4500, 5000, 20_000]) if c % 2 else rnd.choice([0, 1, 5, 20, 60, 60, 899, 900, 3599, 3600])
            ts = start + datetime.timedelta(seconds=t % (hours * 3600), microseconds=rnd.choice([0, 0, 1, 999_999]))
            arrived = ts + datetime.timedelta(seconds=rnd.choice([0, 1, 30, 30_000, 90_000]))
            rows.append((rnd.randrange(n), ts, arrived, c, rnd.choice(["a", "b", None]), rnd.choice([None, 0.5])))
    rows += rows[:20] + [(1, None, start, 1, "x", 1.0), (2, start, start, None, "x", 1.0), (None, start, start, 0, "x", None), (None, start, start, 0, "y", None), (3, start, None, 0, "x", None)]
    rnd.shuffle(rows)
    return rows


def got(done):
    return Counter(map(tuple, throttle.report(done).collect()))


@pytest.mark.parametrize("seed, hot_rows", [(1, 10_000), (1, 12), (2, 0), (3, 3)])
def test_by_cells_or_click_by_click(spark, seed, hot_rows):
    rows = random_clicks(seed)
    delay = 6 * throttle.HOUR
    want = brute(rows, batches=4, delay=delay)
    assert got(throttle.throttle(made(spark, rows), batches=4, delay=delay, hot_rows=hot_rows)) == want
    assert {k[1] for k in want} == {"admitted", "throttled", "late"}


def test_other_columns_and_parts(spark, monkeypatch):
    """Columns named like the operator's own play no part but in telling rows apart; the queue is dealt over parts."""
    monkeypatch.setattr(throttle, "ROWS_PART", 50)
    rows = random_clicks(5, n=200)
    wide = made(spark, rows).withColumns({"batch": F.lit(1), "part": F.lit("x"), "mark": F.lit(2), "client": F.lit(3), "hour": F.lit(None).cast("int"), "late": F.lit(True)})
    assert got(throttle.throttle(wide, delay=throttle.HOUR, batches=3, hot_rows=5)) == brute(rows, batches=3, delay=throttle.HOUR)


def test_one_batch_and_one_click(spark):
    rows = [(7, datetime.datetime(2024, 1, 1, 0, 0, 0, 1), datetime.datetime(2024, 1, 1), 1, "a", 1.0)]
    assert got(throttle.throttle(made(spark, rows))) == brute(rows)


def test_no_clicks(spark):
    done = throttle.report(throttle.throttle(made(spark, [(1, None, None, 1, "a", 0.0)])))
    assert done.collect() == [] and done.columns[:3] == ["click_id", "outcome", "batch"]


def test_given_table(spark):
    clicks = spark.read.parquet(f"{SF_DIR}/clicks.parquet")
    assert got(throttle.throttle(clicks, hot_rows=30)) == brute([tuple(r) for r in clicks.collect()])


def test_clicks_travel_light(spark):
    """Clicks go through two shuffles, to the queue and to the fold; neither copies nor clients are sought by more."""
    clicks = spark.read.parquet(f"{SF_DIR}/clicks.parquet")
    n = clicks.count()
    sent = lambda: sum(x.totalShuffleWrite() for x in map(listed().apply, range(listed().size())))
    listed = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
    before = sent()
    throttle.throttle(clicks)
    time.sleep(1)
    assert sent() - before < 50 * n


def test_pieces_of_cells(spark):
    """The fold joins what several batches hold of a cell."""
    rnd, hour = random.Random(4), throttle.HOUR
    times = sorted(rnd.choices(range(0, 3 * hour, hour // 60), k=400))
    rows = [{"client": c, "ts": t, "cell": t // throttle.COST * throttle.COST, "seg": t // (2 * hour)} for c in (1, 2) for t in times]
    shuffled = rnd.sample(rows, len(rows))
    batch = lambda some: pa.RecordBatch.from_pylist(some)
    fold = lambda pieces: sorted(map(str, pa.Table.from_batches(throttle._settle(throttle.COST, 5)(iter(pieces))).to_pylist()))
    whole = list(throttle._pieces(5)(iter([batch(rows)])))
    pieces = list(throttle._pieces(5)(batch(shuffled[i : i + 7]) for i in range(0, len(rows), 7)))
    assert sum(p.num_rows for p in pieces) > 3 * whole[0].num_rows == 6 * len(np.unique([t // throttle.COST for t in times])) and fold(whole) == fold(pieces)


def test_a_tick_with_cells_takes_one_shuffle_after_they_are_written(spark, tmp_path):
    drained = [(False, 1, t * 1_000_000, t) for t in range(50)] + [(None, 1, 0, None)]
    done, some = throttle.settle(spark.createDataFrame(drained, throttle._DRAINED), spark.createDataFrame([], throttle._SETTLED), str(tmp_path), 0, throttle.COST, 5)
    assert some and done._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert [(r.k, r.credit) for r in done.filter("kind = 1").collect()] == [(5, 5 * throttle.COST)]
