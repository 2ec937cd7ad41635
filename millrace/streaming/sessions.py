"""Sessions of a stream of events that come late and in any order.

A key's events belong to one session while no pause between them is longer than the gap. Open sessions are
Spark's own state of session windows, as start, end and number, and nothing of it goes through Python; one is closed when the
watermark has passed its end by the gap, as no event that still counts could reach it. Events whose own window ends behind the
watermark are dropped by Spark. With more than one lane a key's events are dealt over as many states, so that a key of many
events isn't one task's; each lane closes sessions of its own and merge_sessions() puts them together.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.times import micros
from ..storage import shared_dir

_MICRO = timedelta(microseconds=1)


def merged(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Spans (start, end, number), those no further apart than the gap put together."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def sessions(events: DataFrame, key: str, ts: str, gap: timedelta, delay: str, lanes: int = 1) -> DataFrame:
    """(key, start, end, n) of closed sessions of a stream, times in microseconds; null keys and times are in none."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    stamped = events.withColumn("__ts", F.timestamp_micros(micros(F.col(ts), kinds[ts]))).withWatermark("__ts", delay)
    lane = F.pmod(F.xxhash64(*events.columns), F.lit(lanes)).alias("lane")
    # One condition on both, as one on the key alone would be moved before the watermark, which rows without a key move on too.
    rows = stamped.filter(F.when(F.col(key).isNotNull(), F.col("__ts")).isNotNull()).select(F.col(key).alias("key"), lane, "__ts")
    pause = gap // _MICRO
    found = rows.groupBy("key", "lane", F.session_window("__ts", f"{pause} microseconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("key", F.unix_micros("w.start").alias("start"), (F.unix_micros("w.end") - pause).alias("end"), "n")


def merge_sessions(parts: DataFrame, gap: timedelta) -> DataFrame:
    """Sessions of several lanes, or of several runs, put together."""
    upto = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") - F.max("end").over(upto) > gap // _MICRO, F.lit(True)).cast("int")
    numbered = parts.withColumn("new", new).withColumn("session", F.sum("new").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("session")


def state_session(spark: SparkSession) -> SparkSession:
    """A session with the store that keyed state and timers need; the caller's settings stay as they are."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


def replay_sessions(events: DataFrame, batch: str, key: str, ts: str, gap: timedelta, delay: str, lanes: int = 1) -> tuple[DataFrame, int]:
    """Sessions of a table whose rows come in batches numbered from 0, and how many rows were late.

    Each batch is a run of the query on one checkpoint, as after a stop; at last the clock is moved on until all sessions have closed.
    Files are written below the shared folder, in a new one at every call.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    kept = [c for c in events.columns if c != batch]
    events.select(*kept, F.col(batch).cast("int").alias("__batch")).write.partitionBy("__batch").parquet(f"{base}/fed")
    session = state_session(spark)
    shape = events.select(*kept).schema

    def run(folders: str) -> None:
        fed = session.readStream.schema(shape).option("maxFilesPerTrigger", 2**31 - 1).parquet(folders)

        def write(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{base}/sessions/batch={number}")

        query = sessions(fed, key, ts, gap, delay, lanes).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    there = sorted(r[0] for r in spark.read.schema("__batch int").parquet(f"{base}/fed").distinct().collect() if r[0] is not None) if not events.isEmpty() else []
    for n in range(len(there)):
        run(f"{base}/fed/__batch={{{','.join(map(str, there[: n + 1]))}}}")
    if there:
        most = spark.read.schema(shape).parquet(f"{base}/fed").agg(F.max(ts).alias("m"))
        end = most.select((F.col("m") + F.expr(f"interval {delay}") + F.lit(gap) + F.expr("interval 1 second")).alias(ts))
        last = end.select(*(F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in shape))
        for n in (1, 2):  # the clock moves with the first, and the second finds it moved
            last.write.parquet(f"{base}/fed/__batch={there[-1] + n}")
            run(f"{base}/fed/__batch={{{','.join(map(str, [*there, *range(there[-1] + 1, there[-1] + n + 1)]))}}}")
    out = T.StructType([T.StructField("key", events.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "end", "n"))])
    found = spark.read.schema(out).parquet(f"{base}/sessions") if there else spark.createDataFrame([], out)
    # All sessions are closed, so what is in none of them came too late.
    late = spark.read.schema(shape).parquet(f"{base}/fed").filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).count() - (found.agg(F.sum("n")).first()[0] or 0) if there else 0
    return (merge_sessions(found, gap) if lanes > 1 else found), late
