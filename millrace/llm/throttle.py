"""Click throttling: a token bucket for each client over a stream of late clicks.

Clicks come in batches. A stateful query holds them back in a calendar queue, a map of event hours to lists
of clicks, until W, the largest time seen in earlier batches less a delay, has passed them: each tick drains
complete hours, splits the hour in which W lies, and sorts only what it has drained and what came. Clicks that are behind
W as they come are late and change no credit; the last tick drains all. The queue needs no client's clicks
together, so it is dealt by a hash of the click over as many parts as the rows ask for. Lists of an hour travel and are kept
packed, as Python would otherwise spend its time on turning numbers into objects.

What a tick has drained is settled client by client in order of time, id (null first); rows that differ only in what
else they say get the same, whichever comes first. A client with more than `HOT_ROWS` clicks in a tick is not put into one task; each part tells of clients that
have more than its share of that, so nothing is shuffled to count them. Its credit, seen as whole
coins and a rest, gains a coin at instants `cost` apart; these shift only after a pause of at least `cost`, to the
click that ends it. So the first click after each pause gives a possible shift, and between the instants of all
shifts, clicks are alike: their number and the first six are all that the fold needs. A pause that fills the credit whatever
it was starts a segment, which is folded by itself and has only its own shifts. Cells of that
kind number no more than time and pauses allow, however many clicks they hold; each click then gets its
outcome from its cell. The fold carries each client's credit, last time and penalty from tick to tick in a table.

Rows that are equal in all columns count once: they arrive in one batch and one part of the queue, which drops them; those without time or client play no part; rows that differ
somewhere are settled each, ids equal or not. A null time of arrival counts as the first hour. Without
clicks nothing is streamed. Everything is written below the shared folder, in a new folder at every call, and a
tick that is run again writes the same files again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.times import micros
from ._spark import shared_dir

BATCHES = 8
HOUR = 3600 * 1_000_000
DELAY = 168 * HOUR
#: What a click costs, and how many costs a client's credit holds.
COST, BURST = 900 * 1_000_000, 5
#: Rows for each part of the queue.
ROWS_PART = 500_000
#: A client's clicks in a tick, in number and as a share of them all (one in so many), beyond which they are settled by cells.
#: A part of the queue holds its share of both, so a client of more is told by one part at least.
HOT_ROWS, HOT_SHARE = 10_000, 10_000

#: Clicks that are unpacked or settled at once.
SLICE = 50_000
#: A click as it is packed, where `known` tells a null id from others; and as it comes, with a hash of what else the row says.
CLICK = np.dtype([("ts", "<i8"), ("client", "<i8"), ("click", "<i8"), ("known", "?")])
CAME = np.dtype([*CLICK.descr, ("mark", "<i8")])
_FED = "part bigint, ts bigint, client bigint, click bigint, mark bigint"
_PACKED = "part bigint, clicks binary"
#: Late, settled, or (null) a client of many clicks.
_DRAINED = "late boolean, client bigint, ts bigint, click bigint"
_HOT = "client bigint, ts bigint, click bigint, cell bigint, seg bigint"
_DEALT = "client bigint, first bigint, click bigint, more array<bigint>"
_SETTLED = "client bigint, kind int, first bigint, click bigint, k bigint, credit bigint, since bigint, cell bigint"


def cut(clicks: DataFrame, folder: str, batches: int = BATCHES) -> tuple[list[int | None], int]:
    """Write the clicks as batches; (largest time of each batch, parts of the queue). Equal rows get one batch and one part."""
    kinds = {f.name: f.dataType for f in clicks.schema.fields}
    arrived = F.floor(micros(F.col("arrived_at"), kinds["arrived_at"]) / HOUR)
    told = [x for c in clicks.columns if c not in ("click_id", "ts", "client_id") for x in (F.col(c).isNull(), F.col(c))]
    there = clicks.filter("ts is not null and client_id is not null")
    lo, hi, n = there.agg(F.min(arrived), F.max(arrived), F.count(F.lit(1))).first()
    if not n:
        return [], 0
    lo, wide = (0, 1) if lo is None else (lo, hi - lo + 1)
    parts = -(-n // ROWS_PART)
    later = F.when(F.crc32(F.col("click_id").cast("string")) % 7 == 0, 1).otherwise(0)
    batch = F.least(F.floor((F.coalesce(arrived, F.lit(lo)) - lo) * batches / wide) + later, F.lit(batches - 1)).cast("int")
    rows = there.select(
        batch.alias("batch"), micros(F.col("ts"), kinds["ts"]).alias("ts"), F.col("client_id").cast("long").alias("client"), F.col("click_id").cast("long").alias("click"), F.xxhash64(*told).alias("mark")
    )
    part = F.pmod(F.xxhash64("client", "ts", "click", "mark"), F.lit(parts))
    rows = rows.select("batch", part.alias("part"), "ts", "client", "click", "mark")
    # A row without a click for every part and batch, so that each part ticks with each batch, empty ones too.
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("ts", "long"), ("client", "long"), ("click", "long"), ("mark", "long"))]
    ticks = clicks.sparkSession.range(batches * parts, numPartitions=1).select((F.col("id") % batches).cast("int").alias("batch"), F.floor(F.col("id") / batches).alias("part"), *none)
    rows.unionByName(ticks).sortWithinPartitions("batch", "part", "ts", "mark").write.option("compression", "zstd").partitionBy("batch").parquet(folder)
    fed = clicks.sparkSession.read.schema(f"{_FED}, batch int").parquet(folder)
    most = {r.batch: r.most for r in fed.groupBy("batch").agg(F.max("ts").alias("most")).collect()}
    return [most.get(b) for b in range(batches)], parts


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by part, without copies that stand side by side; those without a click keep their part."""
    for b in batches:
        part, there = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
        packed = np.empty(b.num_rows, CAME)
        for i, name in enumerate(("ts", "client", "click", "mark")):
            packed[name] = b.column(i + 1).fill_null(0).to_numpy()
        packed["known"] = b.column(3).is_valid().to_numpy(zero_copy_only=False)
        order = np.argsort(part, kind="stable")
        part, there, packed = part[order], there[order], packed[order]
        starts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
        lists = [_planes(_once(x[y])) for x, y in zip(np.split(packed, starts[1:]), np.split(there, starts[1:]))] if len(part) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(lists, pa.binary())], ["part", "clicks"])


def _once(clicks: np.ndarray) -> np.ndarray:
    """The clicks without those that are equal to the one before them."""
    new = np.ones(len(clicks), bool)
    new[1:] = np.any([clicks[c][1:] != clicks[c][:-1] for c in clicks.dtype.names], axis=0)
    return clicks[new]


def _planes(clicks: np.ndarray) -> bytes:
    """First bytes first, then second ones, and so on, as alike bytes side by side are packed tight on their way."""
    return clicks.view("u1").reshape(-1, CAME.itemsize).T.tobytes()


def _of_planes(said: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(said, "u1").reshape(CAME.itemsize, -1).T).reshape(-1).view(CAME)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for late, said in zip(b.column(0), b.column(1)):
            c = np.frombuffer(said.as_buffer(), CLICK)
            click = pa.array(np.ascontiguousarray(c["click"]), mask=~c["known"])
            rest = [pa.array(np.ascontiguousarray(c[x])) for x in ("client", "ts")]
            yield pa.RecordBatch.from_arrays([pa.repeat(late, len(c)), *rest, click], ["late", "client", "ts", "click"])


class CalendarQueue(StatefulProcessor):
    """Holds clicks by event hour until the clock has passed them; tells of clients with more than `many` clicks among those."""

    def __init__(self, clock: int | None, last: bool, many: int):
        self.clock, self.last, self.many = clock, last, many

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour bigint", "clicks binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        came = np.concatenate([_of_planes(r.clicks) for r in rows])
        came = _once(came[np.lexsort([came[x] for x in ("mark", "click", "known", "client", "ts")])])
        fresh = np.empty(len(came), CLICK)
        for name in CLICK.names:
            fresh[name] = came[name]
        late, fresh = self._split(fresh)
        yield from _said(late, True)
        due = []
        edge = -(2**63) if self.clock is None else self.clock // HOUR
        held = {hour for (hour,) in self.hours.keys()}
        for hour in sorted(h for h in held if self.last or h <= edge):
            passed, kept = self._split(self._list(hour))
            due += [passed, kept] if self.last else [passed]
            if self.last:
                continue
            if len(kept):
                self.hours.updateValue((hour,), (kept.tobytes(),))
            else:
                self.hours.removeKey((hour,))
                held.remove(hour)
        if self.last:
            due.append(fresh)
            self.hours.clear()
        elif len(fresh):
            hour = fresh["ts"] // HOUR
            for clicks in np.split(fresh, np.flatnonzero(np.diff(hour)) + 1):
                at = int(clicks["ts"][0] // HOUR)
                before = self._list(at).tobytes() if at in held else b""
                self.hours.updateValue((at,), (before + clicks.tobytes(),))
        due = np.concatenate([np.empty(0, CLICK), *due])
        due = due[np.lexsort([due[x] for x in ("ts", "client")])]
        yield from _said(due, False)
        who, n = np.unique(due["client"], return_counts=True)
        many = np.zeros(np.count_nonzero(n > self.many), CLICK)
        many["client"] = who[n > self.many]
        yield from _said(many, None)

    def _list(self, hour: int) -> np.ndarray:
        return np.frombuffer(bytes(self.hours.getValue((hour,))[0]), CLICK)

    def _split(self, clicks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that the clock has passed, and the others."""
        passed = np.zeros(len(clicks), bool) if self.clock is None else clicks["ts"] < self.clock
        return clicks[passed], clicks[~passed]


def _said(clicks: np.ndarray, late: bool | None) -> Iterator[Row]:
    """Clicks as they leave the queue."""
    for i in range(0, len(clicks), SLICE):
        yield Row(late=late, clicks=clicks[i : i + SLICE].tobytes())


def _settle(cost: int, burst: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fold over the cells of each client, or of each of its segments; they lie in one partition, whose rows are sorted here.

    `more` is empty (not null, as Spark's Arrow writer goes over all nulls of a list column again at each row) but for what a client carries on (0, 0, credit, since) and pieces of cells of some clicks (1, segment, last, number, cell, its first times).
    """
    schema, full = to_arrow_schema(T.StructType.fromDDL(_SETTLED)), burst * cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = [b for b in batches if b.num_rows]
        if not there:
            return
        rows = pa.Table.from_batches(there)
        client, first, click = (rows[c].fill_null(0).to_numpy() for c in ("client", "first", "click"))
        known, special = rows["click"].is_valid().to_numpy(), pc.list_value_length(rows["more"]).to_numpy() > 0
        seg, kind = np.zeros(len(client), np.int64), np.ones(len(client), np.int8)
        joined, other = {}, np.zeros(len(client), bool)
        if len(at_all := np.flatnonzero(special)):
            head = rows["more"].filter(pa.array(special))
            kind[at_all], seg[at_all] = pc.list_element(head, 0).to_numpy(), pc.list_element(head, 1).to_numpy()
            if len(pieces := at_all[kind[at_all] == 1]):
                joined, others = _joined(rows["more"], pieces, client, first, burst)
                other[others] = True
        order = np.lexsort((click, known, first, kind, seg, client))
        order = order[~other[order]]
        who, credit, at, since = None, full, 0, None
        for start in range(0, len(order), SLICE):
            these = order[start : start + SLICE]
            clients, segments, kinds, firsts = (x[these].tolist() for x in (client, seg, kind, first))
            places = np.flatnonzero(special[these])
            more = {i: joined.get(row, said) for i, row, said in zip(places.tolist(), these[places].tolist(), rows["more"].take(pa.array(these[places])).to_pylist())}
            k_of, credits, sinces, cells = [0] * len(kinds), [0] * len(kinds), [None] * len(kinds), [None] * len(kinds)
            carried: list[tuple] = []
            for i, (c, segment, is_click, t) in enumerate(zip(clients, segments, kinds, firsts)):
                if (c, segment) != who:
                    if who is not None:
                        carried.append((who[0], at, credit, since))
                    who, credit, at, since = (c, segment), full, t, None
                if not is_click:
                    _, _, credit, since = more[i]
                    at = t
                    continue
                x = min(full, credit + t - at)
                if i in more:  # a cell of some clicks
                    _, _, last, n, cells[i], *heads = more[i]
                    k = min(x // cost, n)
                    since = None if k == n else heads[k] if k else t if since is None else since
                    credit, at = x - k * cost + last - t, last
                else:
                    k = int(x >= cost)
                    since = None if k else t if since is None else since
                    credit, at = x - k * cost, t
                k_of[i], credits[i], sinces[i] = k, x, since
            ids = pa.array(click[these], mask=~known[these])
            columns = [pa.array(client[these]), pa.array(kind[these]), pa.array(first[these]), ids, *(pa.array(x, pa.int64()) for x in (k_of, credits, sinces, cells))]
            done = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            yield done.filter(pa.array(kind[these] == 1))
            yield _carry(carried, schema)
        if who is not None:
            yield _carry([(who[0], at, credit, since)], schema)

    return run


def _carry(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Credit after the last click of clients or segments, for the next tick."""
    said = [{"client": c, "kind": 0, "first": at, "credit": credit, "since": since} for c, at, credit, since in rows]
    return pa.RecordBatch.from_pylist(said, schema=schema)


def _cells(hot: DataFrame, carried: DataFrame, cost: int, burst: int) -> DataFrame:
    """The clicks with their segment and the start of their cell: the latest instant, of any possible shift, at which a coin may come."""
    slots = hot.groupBy("client", F.floor(F.col("ts") / cost).alias("slot")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    before = carried.select("client", F.col("first").alias("at"), F.pmod(F.col("first") - F.col("credit"), F.lit(cost)).alias("shift"))
    slots = slots.join(before, "client", "left")
    ordered = Window.partitionBy("client").orderBy("slot")
    gap = F.col("first") - F.coalesce(F.lag("last").over(ordered), "at")
    slots = slots.withColumn("gap", gap).withColumn("seg", F.sum((F.coalesce("gap", F.lit(0)) >= burst * cost).cast("long")).over(ordered))
    own = F.when(F.col("gap").isNull() | (F.col("gap") >= cost), F.pmod("first", F.lit(cost)))
    slots = slots.select("client", "slot", "seg", F.when(F.col("seg") == 0, F.col("shift")).alias("shift"), own.alias("own"))
    whole = Window.partitionBy("client", "seg")
    shifts = F.array_compact(F.array_distinct(F.array_append(F.collect_set("own").over(whole), F.max("shift").over(whole))))
    # A slot's row, then its clicks, each of which takes what the slot says.
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("ts", "long"), ("click", "long"))]
    said = slots.select("client", "slot", *none, F.struct("seg", shifts.alias("shifts")).alias("said"))
    clicks = hot.select("client", F.floor(F.col("ts") / cost).alias("slot"), "ts", "click", F.lit(None).cast("struct<seg:bigint,shifts:array<bigint>>").alias("said"))
    both = said.unionByName(clicks).withColumn("said", F.first("said").over(Window.partitionBy("client", "slot").orderBy("ts"))).filter("ts is not null")
    back = F.array_min(F.transform("said.shifts", lambda s: F.pmod(F.col("ts") - s, F.lit(cost))))
    return both.select("client", "ts", "click", (F.col("ts") - back).alias("cell"), "said.seg")


def _pieces(burst: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows for the fold from clicks with their cells: what a batch holds of each cell, so that no more than that is shuffled; the fold joins the pieces of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            client, ts, cell, seg = (b[c].to_numpy() for c in ("client", "ts", "cell", "seg"))
            order = np.lexsort((ts, cell, client))
            client, ts, cell, seg = (x[order] for x in (client, ts, cell, seg))
            starts = np.flatnonzero(np.r_[True, (client[1:] != client[:-1]) | (cell[1:] != cell[:-1])])
            n = np.diff(np.r_[starts, len(ts)])
            rank = np.arange(len(ts)) - np.repeat(starts, n)
            at = np.r_[0, np.cumsum(5 + np.minimum(n, burst + 1))]
            more = np.empty(at[-1], np.int64)
            for i, x in enumerate((1, seg[starts], ts[starts + n - 1], n, cell[starts])):
                more[at[:-1] + i] = x
            more[(np.repeat(at[:-1], n) + 5 + rank)[rank <= burst]] = ts[rank <= burst]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(more))
            yield pa.RecordBatch.from_arrays([pa.array(client[starts]), pa.array(ts[starts]), pa.nulls(len(starts), pa.int64()), lists], ["client", "first", "click", "more"])

    return run


def _joined(more: pa.ChunkedArray, of: np.ndarray, client: np.ndarray, first: np.ndarray, burst: int) -> tuple[dict[int, list], np.ndarray]:
    """For the rows `of` which hold pieces of cells: what the first piece of each cell says for all of them, where there are others; and those others."""
    said = more.take(pa.array(of))
    seg, last, n, cell = (pc.list_element(said, i).to_numpy() for i in range(1, 5))
    order = np.lexsort((first[of], cell, seg, client[of]))
    key = np.stack([x[order] for x in (client[of], seg, cell)])
    new = np.r_[True, np.any(key[:, 1:] != key[:, :-1], axis=0)]
    starts = np.flatnonzero(new)
    ends, joined = np.r_[starts[1:], len(of)], {}
    for x, y in zip(starts.tolist(), ends.tolist()):
        if y - x > 1:
            these = order[x:y]
            heads = sorted(t for piece in said.take(pa.array(these)).to_pylist() for t in piece[5:])
            joined[int(of[order[x]])] = [1, int(seg[order[x]]), int(last[these].max()), int(n[these].sum()), int(cell[order[x]]), *heads[: burst + 1]]
    return joined, of[order[~new]]


def settle(drained: DataFrame, carried: DataFrame, folder: str, tick: int, cost: int, burst: int) -> tuple[DataFrame, bool]:
    """Clicks and cells with the credit at their first click and the number admitted, and what clients carry on; whether there are cells of some clicks."""
    spark = drained.sparkSession
    carried = carried.filter("kind = 0").select("client", "first", "credit", "since")  # of each segment of a client; the fold goes on from the last
    clicks = drained.filter("not late")
    many = [r.client for r in drained.filter("late is null").select("client").distinct().collect()]  # about HOT_SHARE at most
    some = bool(many)
    each = clicks.select("client", F.col("ts").alias("first"), "click", F.array().cast("array<bigint>").alias("more"))
    before = carried.select("client", "first", F.lit(None).cast("long").alias("click"), F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), "credit", "since").alias("more"))
    if some:
        hot = F.col("client").isin(many)
        latest = carried.filter(hot).groupBy("client").agg(F.max_by(F.struct("first", "credit"), "first").alias("c")).select("client", "c.*")
        _cells(clicks.filter(hot), latest, cost, burst).write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/hot/tick={tick}")
        cells = spark.read.schema(_HOT).parquet(f"{folder}/hot/tick={tick}").select("client", "ts", "cell", "seg")
        each = each.filter(~hot).unionByName(cells.mapInArrow(_pieces(burst), _DEALT))
    dealt = each.unionByName(before).repartition("client", F.coalesce(F.get("more", F.lit(1)), F.lit(0)))
    return dealt.mapInArrow(_settle(cost, burst), _SETTLED), some


def throttle(
    clicks: DataFrame, batches: int = BATCHES, delay: int = DELAY, cost: int = COST, burst: int = BURST, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """click_id, client_id, ts_us, outcome (admitted, throttled, late), batch, credit_after, penalty_start_us, penalty_end_us for each click."""
    spark = clicks.sparkSession
    base = f"{shared_dir(spark)}/throttle-{uuid.uuid4().hex}"
    most, parts = cut(clicks, f"{base}/fed", batches)
    session = _streaming_session(spark, parts)
    hot_rows = max(hot_rows, parts * ROWS_PART // HOT_SHARE)  # so few clients have more
    many = hot_rows // parts if parts else 0
    hot_ticks: set[int] = set()
    for b in range(batches if parts else 0):
        earlier = [m for m in most[:b] if m is not None]
        clock = max(earlier) - delay if earlier else None

        def tick(drained: DataFrame, _: int, b: int = b) -> None:
            own = drained.sparkSession
            drained.mapInArrow(_unpack, _DRAINED).write.option("compression", "zstd").mode("overwrite").parquet(f"{base}/drained/tick={b}")
            before = own.read.schema(_SETTLED).parquet(f"{base}/settled/tick={b - 1}") if b else own.createDataFrame([], _SETTLED)
            done, some = settle(own.read.schema(_DRAINED).parquet(f"{base}/drained/tick={b}"), before, base, b, cost, burst)
            done.write.option("compression", "zstd").mode("overwrite").parquet(f"{base}/settled/tick={b}")
            if some:
                hot_ticks.add(b)

        upto = ",".join(map(str, range(b + 1)))  # of the batches so far the checkpoint knows which files are new
        fed = session.readStream.schema(_FED).option("maxFilesPerTrigger", 2**31 - 1).parquet(f"{base}/fed/batch={{{upto}}}")
        lists = fed.mapInArrow(_pack, _PACKED).groupBy("part")
        queue = lists.transformWithState(CalendarQueue(clock, b == batches - 1, many), "late boolean, clicks binary", "Append", "None")
        query = queue.writeStream.foreachBatch(tick).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return _outcomes(spark, base, cost, bool(parts), bool(hot_ticks))


def _streaming_session(spark: SparkSession, parts: int) -> SparkSession:
    """A session with the settings that the stateful query needs; the caller's stay as they are."""
    session = spark.newSession()
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, parts))
    for name, value in (
        ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
        ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"),
        ("spark.sql.streaming.stateStore.unloadOnCommit", "true"),  # each run is one batch; an open store takes 4 MB of disk even if it is empty
        ("spark.sql.streaming.noDataMicroBatches.enabled", "false"),
        # Without it each small file of a part's changes is given its rights by a process of its own, where Hadoop has no native library.
        ("spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"),
        ("spark.sql.shuffle.partitions", str(few)),
    ):
        session.conf.set(name, value)
    return session


def _outcomes(spark: SparkSession, base: str, cost: int, some: bool, hot: bool) -> DataFrame:
    """A row for each click, from what the ticks have written."""

    def read(name: str, shape: str) -> DataFrame:
        return spark.read.schema(f"{shape}, tick int").parquet(f"{base}/{name}") if some else spark.createDataFrame([], f"{shape}, tick int")

    def said(rows: DataFrame, outcome: Column, credit: Column, start: Column, end: Column) -> DataFrame:
        return rows.select(
            F.col("click").alias("click_id"), F.col("client").alias("client_id"), F.col("ts").alias("ts_us"), outcome.alias("outcome"), F.col("tick").alias("batch"),
            credit.cast("long").alias("credit_after"), start.cast("long").alias("penalty_start_us"), end.cast("long").alias("penalty_end_us"),
        )

    def settled(rows: DataFrame, rank: Column) -> DataFrame:
        """rank: of an admitted click in its cell; else null."""
        gone = rank.isNotNull()
        credit = F.col("credit") + F.col("ts") - F.col("first") - F.coalesce(rank, "k") * cost
        start, end = F.when(~gone, F.col("since")), F.when(~gone, F.col("first") + cost - F.col("credit") + F.col("k") * cost)
        return said(rows, F.when(gone, "admitted").otherwise("throttled"), credit, start, end)

    none = F.lit(None)
    late = said(read("drained", _DRAINED).filter("late"), F.lit("late"), none, none, none)
    cells = read("settled", _SETTLED).filter("kind = 1")
    alone = settled(cells.filter("cell is null").withColumn("ts", F.col("first")), F.when(F.col("k") == 1, F.lit(1)))
    done = late.unionByName(alone)
    if hot:  # a cell's row, then its clicks, each of which takes what the cell says and its place in it
        of = cells.filter("cell is not null").select("tick", "client", "cell", F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("ts", "click")), F.struct("first", "credit", "since", "k").alias("said"))
        clicks = read("hot", _HOT).select("tick", "client", "cell", F.lit(1).alias("kind"), "ts", "click", F.lit(None).cast("struct<first:bigint,credit:bigint,since:bigint,k:bigint>").alias("said"))
        upto = Window.partitionBy("tick", "client", "cell").orderBy("kind", "ts", "click")
        told = of.unionByName(clicks).withColumns({"said": F.first("said").over(upto), "r": F.row_number().over(upto) - 1}).filter("kind = 1")
        told = told.select("tick", "client", "ts", "click", "r", "said.*")
        done = done.unionByName(settled(told, F.when(F.col("r") <= F.col("k"), F.col("r"))))
    return done


def report(done: DataFrame) -> DataFrame:
    return done.select("click_id", "outcome", "batch", "credit_after", "penalty_start_us", "penalty_end_us")
