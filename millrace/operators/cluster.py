"""Density clusters of vectors (HDBSCAN), and spans put together by them.

The hierarchy needs, of all pairs, only a minimum spanning tree under mutual reachability, the largest of
both points' core distances and their distance. It is built by rounds in which each component takes its
shortest edge out. Points go to the nearest of some pivots, and each pivot's are packed into blocks, a row each, so
that a block is a ball with a centre and a radius; a pair of blocks meets in one task, once for both. Blocks first meet
themselves and the nearest; what that finds bounds what others can find, and pairs of blocks that lie further apart than
the bound never meet. What is kept of it are the nearest few of each point, from which the rounds take their edges: an edge
that is in no list is as long as its ends' lists reach, so a component whose shortest listed edge is below that has its own for
sure. When no component is sure any more, only the points whose lists end below their component's shortest edge meet the
blocks again. So no task holds more than two groups of blocks and their lists, of bounded size, and pairs of points are never rows. On the driver are the balls, the
components, and the tree's n - 1 edges, from which the labels are worked out.

A point's core distance is that to its `min_samples`-th nearest point, itself counted as the first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterConfig
from ..functions.vectors import centroids, normalised
from ..storage import durable
from .split import numbered

BLOCK_ROWS = 4096
#: Bytes of vectors that a task holds of either of two groups of blocks that meet in it, at most.
SIDE_BYTES = 64 << 20
#: Points whose tree fits the driver.
MOST_POINTS = 20_000_000


#: Blocks up to which each pair's own spanning tree is found in one round.
FEW_BLOCKS = 8


def _matrix(rows: pa.Table, column: str) -> np.ndarray:
    return rows.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _paired(points: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The points for each pair of a few blocks, on either side."""
    every, block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.floor(F.col("pos") / BLOCK_ROWS).cast("int")
    columns = [F.col(c).alias(c) for c in points.columns]  # named anew, so that either side is its own
    return points.select(*columns, block.alias("i"), every.alias("j")), points.select(*columns, block.alias("j"), every.alias("i"))


def _core(points: DataFrame, blocks: int, k: int) -> DataFrame:
    left, right = _paired(points, blocks)

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _matrix(a, "v"), _matrix(b, "v")
        out = []
        if len(y):
            for s in range(0, len(x), 512):
                d = _distances(x[s : s + 512], y)
                n = min(k, d.shape[1])
                out += np.sort(np.partition(d, n - 1, axis=1)[:, :n], axis=1).tolist()
        else:
            out = [[] for _ in range(len(x))]
        return pa.table({"pos": a.column("pos"), "d": pa.array(out, pa.list_(pa.float64()))})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(near, "pos long, d array<double>")
    least = F.sort_array(F.flatten(F.collect_list("d")))  # k for each block
    return found.groupBy("pos").agg(F.element_at(least, F.least(F.lit(k), F.size(least))).alias("core"))


#: What a cell's pairs of blocks give, of the cell, the pairs, and the blocks on either side as positions and vectors.
Meeting = Callable[[int, np.ndarray, dict, dict], pa.Table]


@dataclass
class Balls:
    """Packed blocks, each a ball: rows (block, pos, v), centres, radii, and the block of each point."""

    packed: DataFrame
    centre: np.ndarray
    radius: np.ndarray
    of: np.ndarray
    counts: list[int] = field(default_factory=list)  # of pairs of blocks that have met, time after time

    def apart(self) -> np.ndarray:
        """Distances that no two points of two blocks lie closer than."""
        return np.maximum(_distances(self.centre, self.centre) - self.radius[:, None] - self.radius[None, :], 0)

    def width(self, blocks: int) -> int:
        """Blocks of a group, so that pairs of groups keep every core busy and a group's vectors fit a task."""
        cores = self.packed.sparkSession.sparkContext.defaultParallelism
        groups = max(math.isqrt(6 * cores) + 1, -(-blocks * BLOCK_ROWS * self.centre.shape[1] * 8 // SIDE_BYTES))
        return -(-blocks // groups)

    def met(self, pairs: np.ndarray, meet: Meeting, schema: str, asking: DataFrame | None = None, asked: int = 0) -> DataFrame:
        """What meet() gives for the pairs (i, j, ...) of blocks, those asked for (as many as `asked`) as i.

        Blocks are dealt to groups, and a pair of groups is a cell, a task's: a block is sent once to each cell in which it meets any,
        so what is shuffled grows with blocks times groups, not with the pairs.
        """
        self.counts.append(len(pairs))
        spark, one = self.packed.sparkSession, asking is None
        wide = len(self.centre) // self.width(len(self.centre)) + 1
        cell = pairs[:, 0] // self.width(len(self.centre) if one else asked) * wide + pairs[:, 1] // self.width(len(self.centre))
        order = np.argsort(cell, kind="stable")
        cells, starts = np.unique(cell[order], return_index=True)
        pairs_of = spark.sparkContext.broadcast(dict(zip(cells.tolist(), np.split(pairs[order].astype(np.int32), starts[1:]))))

        def sent(blocks: DataFrame, columns: list[int], side: int) -> DataFrame:
            to = np.unique(np.concatenate([np.stack([pairs[:, c], cell], axis=1) for c in columns]), axis=0)
            told = spark.createDataFrame(pa.table({"block": pa.array(to[:, 0], pa.int32()), "cell": pa.array(to[:, 1], pa.int64())}))
            return blocks.join(F.broadcast(told), "block").select("cell", F.lit(side).alias("side"), "block", "pos", "v")

        rows = sent(self.packed, [0, 1], 1) if one else sent(asking, [0], 0).unionByName(sent(self.packed, [1], 1))

        def each(rows: pa.Table) -> pa.Table:
            held: list[dict] = [{}, {}]
            for side, block, pos, v in zip(*(rows.column(c) for c in ("side", "block", "pos", "v"))):
                pos = np.frombuffer(pos.as_buffer(), np.int64)
                held[side.as_py()][block.as_py()] = pos, np.frombuffer(v.as_buffer(), np.float64).reshape(len(pos), -1)
            key = rows.column("cell")[0].as_py()
            return meet(key, pairs_of.value[key], held[1 if one else 0], held[1])

        return rows.groupBy("cell").applyInArrow(each, schema)


#: Further blocks that each meets before its bounds are known.
NEAREST = 2
#: Nearest points that are kept of each, itself among them. Most of the tree's edges are between these; the more there are, the fewer points have to look further.
NEIGHBOURS = 16
_LIST, _EDGE = "block int, p binary, q binary, d binary", "c long, w double, p long, q long"


def _balls(points: DataFrame, blocks: int) -> Balls:
    """Points (pos, v) in the order of the nearest of as many pivots as there are full blocks, and of the distance to it; no block holds points of two."""
    pivots = np.array([r.v for r in points.orderBy(F.xxhash64("pos"), "pos").limit(blocks).select("v").collect()], np.float64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(pa.Table.from_batches([b]), "v")
            at, least = np.zeros(len(x), np.int64), np.zeros(len(x))
            for s in range(0, len(x), 512):
                d = _distances(x[s : s + 512], pivots)
                at[s : s + 512], least[s : s + 512] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(least)], ["pos", "v", "pivot", "d"])

    kind = points.schema["v"].dataType.simpleString()
    dealt = points.select("pos", "v").mapInArrow(near, f"pos long, v {kind}, pivot long, d double")
    placed = numbered(dealt, ["pivot", "d", "pos"], "slot")
    cells = sorted(tuple(r) for r in placed.groupBy("pivot").agg(F.min("slot"), F.count(F.lit(1))).collect())  # a row for each pivot
    starts = np.cumsum([0, *(-(-n // BLOCK_ROWS) for *_, n in cells)])
    named = points.sparkSession.createDataFrame([(p, int(first), int(at)) for (p, first, _), at in zip(cells, starts)], "pivot long, first long, at long")
    placed = placed.join(F.broadcast(named), "pivot").withColumn("block", (F.col("at") + F.floor((F.col("slot") - F.col("first")) / BLOCK_ROWS)).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        x = _matrix(rows, "v")
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        return pa.table({"block": rows.column("block").combine_chunks()[:1], "pos": [rows.column("pos").to_numpy().tobytes()], "v": [x.tobytes()], "centre": [centre.tolist()], "radius": [radius]})

    packed = durable(placed.select("block", "pos", "v").groupBy("block").applyInArrow(pack, "block int, pos binary, v binary, centre array<double>, radius double"))
    found = sorted(packed.select("block", "pos", "centre", "radius").collect())
    of = np.zeros(sum(len(r.pos) // 8 for r in found), np.int64)
    for r in found:
        of[np.frombuffer(bytes(r.pos), np.int64)] = r.block
    return Balls(packed.select("block", "pos", "v"), np.array([r.centre for r in found]), np.array([r.radius for r in found]), of)


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pos = np.frombuffer(rows.column("pos")[0].as_py(), np.int64)
    return pos, np.frombuffer(rows.column("v")[0].as_py(), np.float64).reshape(len(pos), -1)


def _first_pairs(apart: np.ndarray) -> np.ndarray:
    """Each block with itself and its nearest."""
    n = len(apart)
    order = np.argsort(apart + np.where(np.eye(n, dtype=bool), -1.0, 0.0), axis=1, kind="stable")[:, : NEAREST + 1]
    return np.stack([np.repeat(np.arange(n), order.shape[1]), order.ravel()], axis=1)


def _rest(apart: np.ndarray, bound: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Pairs i < j that have not met either way round and whose distance leaves room below one block's bound; and whether i and j have it."""
    room = apart <= bound[:, None] * (1 + 1e-9) + 1e-9
    room[met[:, 0], met[:, 1]] = False
    pairs = np.argwhere(np.triu(room | room.T, 1))
    return np.column_stack([pairs, room[pairs[:, 0], pairs[:, 1]], room[pairs[:, 1], pairs[:, 0]]])


def _nearest(p: np.ndarray, q: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each point p, of pairs with their distance, sorted."""
    order = np.lexsort((q, d, p))
    p, q, d = p[order], q[order], d[order]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    kept = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p)))) < k
    return p[kept], q[kept], d[kept]


def _list_rows(rows: list[tuple]) -> pa.Table:
    block, *packed = zip(*rows) if rows else ([],) * 4
    return pa.table([pa.array(block, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in packed)], ["block", "p", "q", "d"])


def _list_arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.frombuffer(x, kind) for x in rows.column(c).to_pylist()]) for c, kind in (("p", np.int64), ("q", np.int64), ("d", np.float64)))


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One row for each block, of a row for each cell that it was in."""

    def merge(rows: pa.Table) -> pa.Table:
        return _list_rows([(rows.column("block")[0].as_py(), *_nearest(*_list_arrays(rows), k))])

    return lists.groupBy("block").applyInArrow(merge, _LIST)


def _reach(lists: DataFrame, n: int, k: int) -> np.ndarray:
    """Each point's distance to its k-th nearest in the lists; infinite if there are fewer."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _, d = _list_arrays(pa.Table.from_batches([b]))
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            full = np.diff(np.append(at, len(p))) >= k
            far = np.where(full, d[np.minimum(at + k - 1, len(d) - 1)], np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([p[at].tobytes()], pa.binary()), pa.array([far.tobytes()], pa.binary())], ["p", "d"])

    out = np.full(n, np.inf)
    for r in lists.mapInArrow(last, "p binary, d binary").toLocalIterator():  # two numbers for each point
        out[np.frombuffer(bytes(r.p), np.int64)] = np.frombuffer(bytes(r.d), np.float64)
    return out


def _lists(balls: Balls, k: int) -> tuple[DataFrame, np.ndarray]:
    """The k nearest of each point, itself among them, a packed row for each block; and how far each list reaches."""
    n, apart = len(balls.of), balls.apart()

    def near(cell: int, pairs: np.ndarray, left: dict, right: dict) -> pa.Table:
        lists = {}
        for i, j in pairs.tolist():
            (pos, x), (at, y), found = left[i], right[j], [lists[i]] if i in lists else []
            for s in range(0, len(x), 512):
                d = _distances(x[s : s + 512], y)
                m = min(k, d.shape[1])
                c = np.argpartition(d, m - 1, axis=1)[:, :m]
                found.append((np.repeat(pos[s : s + 512], m), at[c].ravel(), np.take_along_axis(d, c, 1).ravel()))
            lists[i] = _nearest(*(np.concatenate(c) for c in zip(*found)), k)
        return _list_rows([(i, *of) for i, of in lists.items()])

    first = _first_pairs(apart)
    lists = durable(_merged(balls.met(first, near, _LIST), k))
    reach = _reach(lists, n, k)
    bound = np.zeros(len(apart))
    np.maximum.at(bound, balls.of, reach)
    rest = _rest(apart, bound, first)
    if not len(rest):
        return lists, reach
    reached = balls.packed.sparkSession.sparkContext.broadcast(reach)

    def nearer(cell: int, pairs: np.ndarray, left: dict, right: dict) -> pa.Table:
        lists: dict = {}
        far = {b: reached.value[pos] for b, (pos, _) in (left | right).items()}  # how far each point's list reaches, less and less

        def take(block: int, pos: np.ndarray, found: list[tuple]) -> None:
            found = [f for f in found if len(f[0])]
            if not found:
                return
            p, q, d = lists[block] = _nearest(*(np.concatenate(c) for c in zip(*found, *([lists[block]] if block in lists else []))), k)
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            full = at[np.diff(np.append(at, len(p))) >= k]
            order = np.argsort(pos)
            far[block][order[np.searchsorted(pos, p[full], sorter=order)]] = d[full + k - 1]

        for i, j, there, back in pairs.tolist():
            (pos, x), (at, y) = left[i], right[j]
            ways: list[list[tuple]] = [[], []]
            for s in range(0, len(x), 512):
                d, own = _distances(x[s : s + 512], y), pos[s : s + 512]
                if there:
                    r, c = np.nonzero(d < far[i][s : s + 512, None])
                    ways[0].append((own[r], at[c], d[r, c]))
                if back:
                    r, c = np.nonzero(d < far[j][None, :])
                    ways[1].append((at[c], own[r], d[r, c]))
            take(i, pos, ways[0])
            take(j, at, ways[1])
        return _list_rows([(block, *of) for block, of in lists.items()])

    lists = durable(_merged(lists.unionByName(balls.met(rest, nearer, _LIST)), k))
    reached.unpersist()
    return lists, _reach(lists, n, k)


def _cores(lists: DataFrame, n: int, k: int) -> np.ndarray:
    """Each point's distance to its k-th nearest, itself the first; to its farthest, if there are fewer points."""
    return _reach(lists, n, min(k, n))


def _least(root: np.ndarray, core: np.ndarray, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """The shortest edge out of each component, by weight, then ends, of pairs with their distance."""
    w, a, b = np.maximum(d, np.maximum(core[p], core[q])), root[p], root[q]
    out = np.flatnonzero(a != b)
    low, high, c, e = np.minimum(p, q), np.maximum(p, q), np.concatenate([a[out], b[out]]), np.concatenate([out, out])
    order = np.lexsort((high[e], low[e], w[e], c))
    c, e = c[order], e[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))[: len(c)]
    c, e = c[first], e[first]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(w[e]), pa.array(low[e]), pa.array(high[e])], ["c", "w", "p", "q"])


@dataclass
class _Best:
    """Each component's shortest edge so far."""

    w: np.ndarray
    p: np.ndarray
    q: np.ndarray

    def take(self, found: DataFrame) -> None:
        """found: some edges (c, w, p, q) of each component."""
        t = found.groupBy("c").agg(F.min(F.struct("w", "p", "q")).alias("e")).select("c", "e.*").toArrow()  # one of each component
        c, w, p, q = (t.column(x).to_numpy() for x in ("c", "w", "p", "q"))
        less = (w < self.w[c]) | (w == self.w[c]) & ((p < self.p[c]) | (p == self.p[c]) & (q < self.q[c]))
        c = c[less]
        self.w[c], self.p[c], self.q[c] = w[less], p[less], q[less]


def spanning_tree(points: DataFrame, min_samples: int = 3, counts: list[int] | None = None) -> list[tuple[int, int, float]]:
    """Edges (a, b, weight) of the minimum spanning tree of points (pos, v), pos from 0; `counts` takes how many pairs of blocks met each time."""
    n = points.count()
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; the hierarchy of at most {MOST_POINTS} fits the driver")
    if n < 2:
        return []
    blocks = -(-n // BLOCK_ROWS)
    if blocks <= FEW_BLOCKS:
        return _joined_trees(durable(points.join(_core(points, blocks, min_samples), "pos")), blocks, n)
    balls = _balls(points, blocks)
    balls.counts = balls.counts if counts is None else counts
    apart, of, context = balls.apart(), balls.of, points.sparkSession.sparkContext
    lists, reach = _lists(balls, max(NEIGHBOURS, min_samples))
    core = _cores(lists, n, min_samples)
    quiet = np.full(len(apart), np.inf)  # the least core distance of a block, which no edge of it is shorter than
    np.minimum.at(quiet, of, core)
    apart = np.maximum(apart, np.maximum(quiet[:, None], quiet[None, :]))
    cores = context.broadcast(core)
    root = np.arange(n)
    tree: list[tuple[int, int, float]] = []
    while len(tree) < n - 1:
        best, roots = _Best(np.full(n, np.inf), np.full(n, n), np.full(n, n)), context.broadcast(root)

        def listed(batches: Iterator[pa.RecordBatch], roots: Broadcast = roots) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _least(roots.value, cores.value, *_list_arrays(pa.Table.from_batches([b])))

        best.take(lists.mapInArrow(listed, _EDGE))
        # An edge that is in no list is as long as the lists of both its ends reach, at least.
        unseen = np.full(n, np.inf)
        np.minimum.at(unseen, root, reach)
        sure = np.flatnonzero(best.w < unseen)
        if not len(sure):
            if np.isnan(reach).any():
                raise ValueError("vectors that hold what is no number have no distances")
            _scan(balls, apart, cores, roots, root, reach, best)
            sure = np.flatnonzero(best.w < np.inf)
        roots.unpersist()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            return x

        for w, p, q in sorted(set(zip(best.w[sure].tolist(), best.p[sure].tolist(), best.q[sure].tolist()))):
            a, b = find(p), find(q)
            if a != b:
                root[max(a, b)] = min(a, b)
                tree.append((p, q, w))
        while not np.array_equal(up := root[root], root):
            root = up
    return tree


def _only_component(root: np.ndarray, of: np.ndarray, blocks: int) -> np.ndarray:
    """The component that all of a block's points lie in, -1 where there are several."""
    low, high = np.full(blocks, len(root)), np.full(blocks, -1)
    np.minimum.at(low, of, root)
    np.maximum.at(high, of, root)
    return np.where(low == high, low, -1)


def _scan(balls: Balls, apart: np.ndarray, cores: Broadcast, roots: Broadcast, root: np.ndarray, reach: np.ndarray, best: _Best) -> None:
    """Put into `best` the shorter edges of points whose lists end too early: they meet the nearest blocks, and then every other that may hold one."""
    asked = np.flatnonzero(reach <= best.w[root])
    asked = asked[np.lexsort((balls.of[asked], root[asked]))]
    chunk = np.arange(len(asked)) // BLOCK_ROWS
    chunks = int(chunk[-1]) + 1
    of = np.full(len(root), -1, np.int32)
    of[asked] = chunk
    chunk_of = balls.packed.sparkSession.sparkContext.broadcast(of)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pos, x = _unpacked(pa.Table.from_batches([b.slice(i, 1)]))
                own = chunk_of.value[pos]
                to = np.unique(own[own >= 0])
                columns = [pa.array([part[own == c].tobytes() for c in to], pa.binary()) for part in (pos, x)]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *columns], ["block", "pos", "v"])

    def gather(rows: pa.Table) -> pa.Table:
        return pa.table([rows.column("block").combine_chunks()[:1], *(pa.array([b"".join(rows.column(c).to_pylist())], pa.binary()) for c in ("pos", "v"))], ["block", "pos", "v"])

    kind = "block int, pos binary, v binary"
    gathered = durable(balls.packed.mapInArrow(pick, kind).groupBy("block").applyInArrow(gather, kind))
    near = np.full((chunks, len(apart)), np.inf)
    for c, b in np.unique(np.stack([chunk, balls.of[asked]], axis=1), axis=0).tolist():
        near[c] = np.minimum(near[c], apart[b])
    whole, one = _only_component(root, balls.of, len(apart)), _only_component(root[asked], chunk, chunks)
    near[(whole[None, :] >= 0) & (whole[None, :] == one[:, None])] = np.inf  # within one component there is no edge

    def shortest(cell: int, pairs: np.ndarray, left: dict, right: dict) -> pa.Table:
        out = []
        for i, j in pairs.tolist():
            (pa_, x), (pb, y) = left[i], right[j]
            ca, cb, ka, kb = roots.value[pa_], roots.value[pb], cores.value[pa_], cores.value[pb]
            for s in range(0, len(x), 512):
                d = _distances(x[s : s + 512], y)
                w = np.maximum(d, np.maximum(ka[s : s + 512, None], kb[None, :]))
                w[ca[s : s + 512, None] == cb[None, :]] = np.inf
                least = w.min(axis=1)
                component = np.full(len(least), np.inf)  # the least of the row's component
                _, at = np.unique(ca[s : s + 512], return_inverse=True)
                np.minimum.at(component, at, least)
                r = np.flatnonzero((least == component[at]) & (least < np.inf))
                e, c = np.nonzero(w[r] == least[r, None])
                out.append(_least(roots.value, cores.value, pa_[s + r[e]], pb[c], d[r[e], c]))
        return pa.Table.from_batches(out)

    def meet(room: np.ndarray) -> None:
        best.take(balls.met(np.argwhere(room), shortest, _EDGE, gathered, chunks))

    first = np.zeros(near.shape, bool)
    np.put_along_axis(first, np.argsort(near, axis=1, kind="stable")[:, : NEAREST + 1], True, axis=1)
    meet(first & (near < np.inf))
    bound = np.full(chunks, -1.0)
    open_ = reach[asked] <= best.w[root[asked]]
    np.maximum.at(bound, chunk[open_], best.w[root[asked[open_]]])
    rest = (near <= bound[:, None] * (1 + 1e-9) + 1e-9) & (near < np.inf) & (bound[:, None] >= 0) & ~first
    if rest.any():
        meet(rest)
    chunk_of.unpersist()


def _local_tree(pos: np.ndarray, core: np.ndarray, x: np.ndarray) -> list[tuple[int, int, float]]:
    """The spanning tree of some points that is least by (weight, ends), by Prim's algorithm."""
    n, squares = len(pos), (x * x).sum(1)
    weight, other = np.full(n, np.inf), np.zeros(n, np.int64)
    inside, at, out = np.zeros(n, bool), 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.sqrt(np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0)), np.maximum(core, core[at]))
        low, high = np.minimum(pos, pos[at]), np.maximum(pos, pos[at])
        was_low, was_high = np.minimum(pos, pos[other]), np.maximum(pos, pos[other])
        closer = ~inside & ((d < weight) | (d == weight) & ((low < was_low) | (low == was_low) & (high < was_high)))
        weight[closer], other[closer] = d[closer], at
        w = np.where(inside, np.inf, weight)
        ties = np.flatnonzero(w == w.min())
        at = int(min(ties, key=lambda i: (min(pos[i], pos[other[i]]), max(pos[i], pos[other[i]]))))
        p, q = int(pos[at]), int(pos[other[at]])
        out.append((min(p, q), max(p, q), float(weight[at])))
    return out


def _joined_trees(cored: DataFrame, blocks: int, n: int) -> list[tuple[int, int, float]]:
    """The tree of all from those of each pair of blocks: an edge that is in none of these is in no least tree."""
    left, right = _paired(cored, blocks)

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        one = a.column("i")[0].as_py() == a.column("j")[0].as_py() if len(a) else True
        rows = a if one else pa.concat_tables([a.select(["pos", "v", "core"]), b.select(["pos", "v", "core"])])
        tree = _local_tree(rows.column("pos").to_numpy(), rows.column("core").to_numpy(), _matrix(rows, "v")) if len(rows) else []
        return pa.table({"p": pa.array([e[0] for e in tree], pa.int64()), "q": pa.array([e[1] for e in tree], pa.int64()), "w": pa.array([e[2] for e in tree], pa.float64())})

    below = (F.col("i") < F.col("j")) if blocks > 1 else F.lit(True)
    found = left.filter(below).groupBy("i", "j").cogroup(right.filter(below).groupBy("i", "j")).applyInArrow(both, "p long, q long, w double")
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = []
    for w, p, q in sorted({(e["w"], e["p"], e["q"]) for e in found.collect()}):  # a row of edges for each pair of a few blocks
        a, b = find(p), find(q)
        if a != b:
            root[max(a, b)] = min(a, b)
            tree.append((p, q, w))
    return tree


def tree_labels(n: int, tree: list[tuple[int, int, float]], min_cluster_size: int) -> list[int]:
    """Cluster of each point by excess of mass, -1 for noise; never all points as one cluster. Numbered by smallest point."""
    if n < 2:
        return [-1] * n
    # single linkage: node n + k joins two nodes at the k-th shortest edge
    up, size, kids, height = list(range(n)), [1] * n, [], []
    top = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b, w in sorted(tree, key=lambda e: (e[2], e[0], e[1])):
        a, b = find(a), find(b)
        kids.append((top[a], top[b]))
        height.append(w)
        size.append(size[top[a]] + size[top[b]])
        up[max(a, b)] = min(a, b)
        top[min(a, b)] = len(size) - 1
    # condensed: clusters that only lose points go on, splits into two large enough parts start new ones
    clusters = [{"birth": 0.0, "kids": [], "stability": 0.0}]
    left: list[tuple[int, int, float]] = []  # point, cluster it falls out of, density
    todo = [(len(size) - 1, 0)]

    def points(node: int) -> Iterator[int]:
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                yield x
            else:
                stack.extend(kids[x - n])

    while todo:
        node, c = todo.pop()
        if node < n:
            left.append((node, c, float("inf")))
            continue
        density = 1 / height[node - n] if height[node - n] > 0 else float("inf")
        big = [x for x in kids[node - n] if size[x] >= min_cluster_size]
        for x in kids[node - n]:
            if len(big) == 2:
                clusters.append({"birth": density, "kids": [], "stability": 0.0})
                clusters[c]["kids"].append(len(clusters) - 1)
                clusters[c]["stability"] += _excess(density, clusters[c]["birth"]) * size[x]
                todo.append((x, len(clusters) - 1))
            elif x in big:
                todo.append((x, c))
            else:
                for p in points(x):
                    left.append((p, c, density))
                    clusters[c]["stability"] += _excess(density, clusters[c]["birth"])
    chosen = [False] * len(clusters)
    for c in range(len(clusters) - 1, 0, -1):
        below = sum(clusters[k]["stability"] for k in clusters[c]["kids"])
        if clusters[c]["kids"] and below > clusters[c]["stability"]:
            clusters[c]["stability"] = below
        else:
            chosen[c] = True
    owner = [-1] * len(clusters)
    todo2 = [(0, -1)]
    while todo2:
        c, o = todo2.pop()
        owner[c] = o if o >= 0 else c if chosen[c] else -1
        todo2.extend((k, owner[c]) for k in clusters[c]["kids"])
    found = [-1] * n
    for p, c, _ in left:
        found[p] = owner[c]
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) if c >= 0 else -1 for c in found]


def _excess(density: float, birth: float) -> float:
    return (0.0 if birth == float("inf") else 1e300) if density == float("inf") else density - birth


def hdbscan(rows: DataFrame, vector: str, order: list, config: ClusterConfig | None = None) -> DataFrame:
    """The rows with `pos`, their place in the order, `unit`, the vector at length one, and `label`, -1 for noise."""
    config = config or ClusterConfig()
    placed = numbered(rows, order, "pos").withColumn("unit", normalised(F.col(vector)))
    n = placed.count()
    tree = spanning_tree(placed.select("pos", F.col("unit").alias("v")), config.min_samples)
    labels = tree_labels(n, tree, config.min_cluster_size)
    spark = rows.sparkSession
    said = spark.createDataFrame(pa.table({"pos": pa.array(range(n), pa.int64()), "label": pa.array(labels, pa.int64())}))
    return placed.join(said, "pos")


def tag_union(rows: DataFrame, by: str, tags: str = "tags", name: str = "ontology_tags") -> DataFrame:
    """(by, name): the different tags of each group, sorted; a task's rows of a tag are one before they are shuffled."""
    each = rows.select(by, F.explode(tags).alias("t")).distinct()
    return each.groupBy(by).agg(F.array_sort(F.collect_list("t")).alias(name))


def _named(labelled: DataFrame) -> DataFrame:
    """The rows with `cluster_id` and their place in the cluster, `seq`."""
    noise = numbered(labelled.filter("label < 0"), ["pos"], "__k").withColumn("cluster_id", F.concat(F.lit("singleton-"), (F.col("__k") + 1).cast("string"))).drop("__k")
    group = labelled.filter("label >= 0").withColumn("cluster_id", F.concat(F.lit("cluster-"), F.col("label").cast("string")))
    return group.unionByName(noise)


def members(labelled: DataFrame, span_columns: list[str]) -> DataFrame:
    """(cluster_id, pos, spans' columns): a row for each span, however many a cluster has."""
    return _named(labelled).select("cluster_id", "pos", *span_columns)


def assemble(labelled: DataFrame, span_columns: list[str] | None = None) -> DataFrame:
    """Clusters of rows (pos, label, unit, tags, source_path): id, size, tags, files, centroid; with span_columns, also the spans themselves in order.

    Rows of label -1 are clusters of their own, numbered in their order, with their own tags as they stand. Spans in one row are for
    clusters that go to a model whole; members() has them as rows.
    """
    named = _named(labelled)
    group, alone = named.filter("label >= 0"), named.filter("label < 0")
    files = group.select("cluster_id", "source_path").distinct().groupBy("cluster_id").agg(F.array_sort(F.collect_list("source_path")).alias("source_files"))
    none = F.array().cast("array<string>")
    parts = (
        group.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).join(centroids(group, "cluster_id", "unit"), "cluster_id").join(files, "cluster_id")
        .join(tag_union(group, "cluster_id"), "cluster_id", "left").withColumn("ontology_tags", F.coalesce("ontology_tags", none))
    )
    single = alone.select("cluster_id", F.lit(1).cast("long").alias("n"), F.col("tags").alias("ontology_tags"), F.array("source_path").alias("source_files"), F.col("unit").alias("centroid"))
    if span_columns is not None:
        span = F.struct("pos", *span_columns)
        parts = parts.join(group.groupBy("cluster_id").agg(F.array_sort(F.collect_list(span)).alias("spans")), "cluster_id")
        single = alone.select("cluster_id", F.lit(1).cast("long").alias("n"), F.col("tags").alias("ontology_tags"), F.array("source_path").alias("source_files"), F.col("unit").alias("centroid"), F.array(span).alias("spans"))
    return parts.unionByName(single)


def spans_by_file(spans: DataFrame, order: list[str]) -> DataFrame:
    """The spans with `seq`, their place within their file, from 0; a row each, so a file may have any number."""
    placed = numbered(spans, ["source_path", *order], "__at")
    first = placed.groupBy("source_path").agg(F.min("__at").alias("__first")).withColumnRenamed("source_path", "__path")
    return placed.join(first, F.col("source_path").eqNullSafe(F.col("__path"))).withColumn("seq", F.col("__at") - F.col("__first")).drop("__at", "__first", "__path")
