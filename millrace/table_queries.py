"""Joins by order and overlap over the given tables of events and of a shop."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.times import micros
from .operators import rollups
from .operators.joins import asof_join, overlap_join
from .storage import read_table, written
from .streaming.sessions import replay_sessions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def j1_asof_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale with its client's last change up to then."""
    sales, changes = _table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at"), _table(spark, sf_dir, "client_changes").select("change_id", "client_id", "seq", "valid_at")
    return asof_join(sales, changes, ["client_id"], "sold_at", "valid_at", order=["seq", "change_id"]).select("sale_id", "client_id", "sold_at", F.col("right_change_id").alias("change_id"), F.col("right_seq").alias("seq"))


def j2_asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it, at most an hour earlier."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    bought, clicked = (events.filter(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "click"))
    return asof_join(bought, clicked, ["user_id"], "ts", "ts", order=["event_id"], strict=True, within=timedelta(hours=1)).select("event_id", "user_id", F.col("right_event_id").alias("click_id"))


def j3_overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders that were open on a common day, the earlier id first."""
    shipped = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    opened = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("opened")).join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    pairs = overlap_join(opened, opened, ("opened", "closed"), ("opened", "closed"), by=["o_custkey"])
    return pairs.filter("o_orderkey < right_o_orderkey").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("order_a"), F.col("right_o_orderkey").alias("order_b"))


def j4_clicks_before_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clicks a sale's client made in the hour up to it, for sales with some."""
    sales = _table(spark, sf_dir, "sales").select("sale_id", "client_id", "status", "sold_at", (F.col("sold_at") - F.expr("interval 1 hour")).alias("since"))
    clicks = _table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts")
    pairs = overlap_join(clicks, sales, ("ts", "ts"), ("since", "sold_at"), by=["client_id"])
    return pairs.groupBy(F.col("right_sale_id").alias("sale_id")).agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("click_id").alias("n_clicks"), F.max("ts").alias("last_click"))


def r1_rollup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks by day and kind, by kind and in all, from states of days and kinds that were written first; distinct values as sketches say."""
    measures = rollups.Measures(sums=["cents"], distinct=["client_id"], quantiles=["value"])
    clicks = _table(spark, sf_dir, "clicks").select("ts", "kind", "client_id", "value", F.round(F.col("value") * 100).cast("long").alias("cents"))
    stored = written(rollups.states(clicks, F.col("ts").cast("date"), ["kind"], measures))
    found = rollups.read(rollups.rolled(stored, [["period", "kind"], ["kind"], []], measures, ["period", "kind"]), measures, [0.5])
    exact = clicks.groupBy("kind").agg(F.count_distinct("client_id").alias("clients")).withColumn("level", F.lit(1))
    close = F.abs(F.col("distinct_client_id") - F.col("clients")) <= 2 * measures.distinct_error() * F.col("clients") + 1
    both = found.alias("f").join(exact.alias("e"), (F.col("f.level") == F.col("e.level")) & F.col("f.kind").eqNullSafe(F.col("e.kind")), "left")
    return both.select("f.level", "f.period", "f.kind", "n", "sum_cents", F.when(F.col("f.level") == 1, close).alias("distinct_within"), F.col("quantile_value").isNotNull().alias("has_median"))


#: Seconds that late clicks are waited for at least.
LEAST_DELAY_S = 80 * 3600


def s1_click_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' sessions of clicks no more than half an hour apart, from a stream of clicks in the order of their arrival, waited for as long as the latest of them needs."""
    clicks = _table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts", "arrived_at")
    hour = F.floor(micros(F.col("arrived_at"), clicks.schema["arrived_at"].dataType) / 3_600_000_000)
    lo, hi = clicks.agg(F.min(hour), F.max(hour)).first()
    batch = F.coalesce(F.floor((hour - lo) * 4 / (hi - lo + 1)), F.lit(0)) if lo is not None else F.lit(0)
    clicks, at = clicks.withColumn("batch", batch), micros(F.col("ts"), clicks.schema["ts"].dataType)
    upto, behind = None, 0  # the latest ts of earlier batches, and how far one of a later batch lies behind it at most
    for _, first, last in clicks.filter("ts is not null").groupBy("batch").agg(F.min(at), F.max(at)).orderBy("batch").collect():  # a row for each of four batches
        behind = behind if upto is None else max(behind, upto - first)
        upto = last if upto is None else max(upto, last)
    delay = f"{max(LEAST_DELAY_S, behind // 1_000_000 + 1)} seconds"
    found, late = replay_sessions(clicks, "batch", "client_id", "ts", timedelta(minutes=30), delay, lanes=4)
    return found.select(F.col("key").alias("client_id"), F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n", F.lit(late).cast("long").alias("n_late"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (j1_asof_changes, j2_asof_events, j3_overlapping_orders, j4_clicks_before_sales, r1_rollup_states, s1_click_sessions)}

ORACLES: dict[str, str] = {
    "j1_asof_changes": """
WITH change AS (
  SELECT client_id, valid_at, change_id, seq FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, valid_at ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1
)
SELECT s.sale_id, s.client_id, s.sold_at, c.change_id, c.seq FROM sales s ASOF LEFT JOIN change c ON s.client_id = c.client_id AND s.sold_at >= c.valid_at
""",
    "j2_asof_events": """
WITH click AS (
  SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL
)
SELECT e.event_id, e.user_id, CASE WHEN e.ts - INTERVAL 1 HOUR <= c.ts THEN c.event_id END AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN click c ON e.user_id = c.user_id AND e.ts > c.ts
""",
    "j3_overlapping_orders": """
WITH opened AS (
  SELECT o_custkey, o_orderkey, o_orderdate AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
)
SELECT x.o_custkey AS custkey, x.o_orderkey AS order_a, y.o_orderkey AS order_b
FROM opened x JOIN opened y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.b AND y.a <= x.b AND x.a <= x.b AND y.a <= y.b
""",
    "j4_clicks_before_sales": """
SELECT s.sale_id, count(*) AS n_pairs, count(DISTINCT c.click_id) AS n_clicks, max(c.ts) AS last_click
FROM sales s JOIN clicks c ON s.client_id = c.client_id AND c.ts BETWEEN s.sold_at - INTERVAL 1 HOUR AND s.sold_at GROUP BY s.sale_id
""",
    "r1_rollup_states": """
WITH click AS (
  SELECT ts::DATE AS period, kind, round(value * 100)::BIGINT AS cents, value FROM clicks
), level AS (
  SELECT 0 AS level, period, kind, count(*) AS n, sum(cents)::BIGINT AS sum_cents, count(value) > 0 AS has_median FROM click GROUP BY period, kind
  UNION ALL SELECT 1, NULL, kind, count(*), sum(cents)::BIGINT, count(value) > 0 FROM click GROUP BY kind
  UNION ALL SELECT 2, NULL, NULL, count(*), sum(cents)::BIGINT, count(value) > 0 FROM click
)
SELECT *, CASE WHEN level = 1 THEN true END AS distinct_within FROM level
""",
    "s1_click_sessions": """
WITH click AS (
  SELECT client_id, epoch_us(ts) AS t FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL
), marked AS (
  SELECT *, coalesce(t - lag(t) OVER (PARTITION BY client_id ORDER BY t) > 1800000000, true)::INT AS new FROM click
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM marked
)
SELECT client_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n, 0 AS n_late FROM numbered GROUP BY client_id, g
""",
}
