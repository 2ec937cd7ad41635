"""Sessions of streams, against sessions of the whole table."""

import datetime
import random
from collections import Counter, defaultdict

import pytest

from millrace import table_queries
from millrace.streaming import sessions

DAY = datetime.datetime(2024, 1, 1)
GAP = datetime.timedelta(minutes=10)
US = datetime.timedelta(microseconds=1)


def whole(rows):
    """(key, start, end, n) of all events."""
    of = defaultdict(list)
    for _, k, t in rows:
        if k is not None and t is not None:
            of[k].append((t - datetime.datetime(1970, 1, 1)) // US)
    out = Counter()
    for k, times in of.items():
        out.update((k, *s) for s in sessions.merged([(t, t, 1) for t in times], GAP // US))
    return out


def made(n=300, seed=1, jitter=3600):
    """Events of keys of very different sizes, with the order of their arrival."""
    rnd, rows, t = random.Random(seed), [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 30, 200, 600, 601, 2000])
        rows.append((t + rnd.randrange(jitter), (i, rnd.choice([1, 1, 1, 1, 2, 3, 4, None]), None if i % 40 == 0 else DAY + datetime.timedelta(seconds=t, microseconds=rnd.choice([0, 1])))))
    return [r for _, r in sorted(rows)]


@pytest.mark.parametrize("lanes", [1, 3])
def test_any_order_within_the_watermark(spark, lanes):
    rows = made()
    frame = spark.createDataFrame([(*r, n * 4 // len(rows)) for n, r in enumerate(rows)], "id long, k long, t timestamp_ntz, batch int")
    got, late = sessions.replay_sessions(frame, "batch", "k", "t", GAP, "2 hours", lanes)
    assert late == 0 and Counter(map(tuple, got.select("key", "start", "end", "n").collect())) == whole(rows)


def test_late_rows_are_counted_and_left_out(spark):
    first = [(i, 1, DAY + datetime.timedelta(minutes=i)) for i in range(0, 600, 5)]
    late = [(1000 + i, 1, DAY + datetime.timedelta(minutes=i, seconds=30)) for i in (1, 7, 200)]
    fresh = [(2000, 1, DAY + datetime.timedelta(minutes=596)), (2001, 2, DAY + datetime.timedelta(minutes=580))]
    frame = spark.createDataFrame([(*r, 0) for r in first] + [(*r, 3) for r in late + fresh], "id long, k long, t timestamp_ntz, batch int")
    got, n = sessions.replay_sessions(frame, "batch", "k", "t", GAP, "1 hour")
    assert n == 3 and Counter(map(tuple, got.select("key", "start", "end", "n").collect())) == whole(first + fresh)


def test_sessions_need_no_python(spark):
    fed = spark.readStream.format("rate").load()
    plan = sessions.sessions(fed, "value", "timestamp", GAP, "1 hour", 3)._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "TransformWithState" not in plan and "Python" not in plan


def test_pairs_that_open_a_session_are_in_it(spark):
    """Two events of one time, the first of a session, both count to it, however they are ordered; one as late as the gap still joins."""
    rows = [(1, 1, DAY), (2, 1, DAY + 2 * GAP), (3, 1, DAY + 2 * GAP), (4, 1, DAY + 3 * GAP), (5, 1, DAY + 4 * GAP + US)]
    frame = spark.createDataFrame([(*r, n % 2) for n, r in enumerate(rows)], "id long, k long, t timestamp_ntz, batch int")
    got, late = sessions.replay_sessions(frame, "batch", "k", "t", GAP, "2 hours", lanes=2)
    assert late == 0 and Counter(map(tuple, got.select("key", "start", "end", "n").collect())) == whole(rows) and sorted(r.n for r in got.collect()) == [1, 1, 3]


def test_no_events(spark):
    got, late = sessions.replay_sessions(spark.createDataFrame([], "id long, k long, t timestamp_ntz, batch int"), "batch", "k", "t", GAP, "1 hour")
    assert got.collect() == [] and late == 0


def test_lanes_are_merged(spark):
    rows = [("a", 0, 5, 2), ("a", 9, 9, 1), ("a", 3, 12, 4), ("a", 40, 41, 1), ("b", 0, 0, 1)]
    got = sessions.merge_sessions(spark.createDataFrame(rows, "key string, start long, end long, n long"), 5 * US).collect()
    assert sorted((r.key, r.start, r.end, r.n) for r in got) == [("a", 0, 12, 7), ("a", 40, 41, 1), ("b", 0, 0, 1)]


def test_clicks_later_than_days_count(spark, tmp_path):
    hour = datetime.timedelta(hours=1)
    rows = [(i, 1, DAY + i * hour, DAY + i * hour) for i in range(200)]
    rows += [(500, 1, DAY + hour / 2, DAY + 199 * hour), (501, 2, DAY, DAY + 199 * hour), (502, 1, None, DAY + 120 * hour)]
    spark.createDataFrame(rows, "click_id long, client_id long, ts timestamp_ntz, arrived_at timestamp_ntz").write.parquet(f"{tmp_path}/clicks.parquet")
    got = table_queries.s1_click_sessions(spark, str(tmp_path)).collect()
    assert {r.n_late for r in got} == {0} and sum(r.n for r in got) == 202
    us = lambda t: (t - datetime.datetime(1970, 1, 1)) // US
    assert sorted((r.client_id, r.start_us, r.end_us, r.n) for r in got if r.n > 1 or r.client_id == 2) == [(1, us(DAY), us(DAY + hour), 3), (2, us(DAY), us(DAY), 1)]
