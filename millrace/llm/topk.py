"""Exact top-k search by inner product, with a threshold of three phases.

Vectors become integers, floor(256 x) of each component, packed as narrow as a block's fit. A node holds a shard of them,
longest first, and meets one block of queries at a time. Scores are sums over slices of the dimensions.

1. Every node gathers local lists: whole scores of each query with the longest vectors of its shard, of which it
   returns the k best.
2. The k-th best of all gathered scores is a safe cutoff for the query, and is sent to all nodes. A node takes the first slice's
   partial scores with all its vectors, and collects the entries that can still reach the cutoff: their other slices add no more than
   the product of both sides' lengths there.
3. The collected entries' remaining slices are resolved exactly, slice by slice, entries that can't reach the cutoff any more being
   let go on the way; the k best of a node go on, and the k best of those are the answer.

Queries and vectors meet in blocks, each query block with each shard; blocks are packed matrices, so the shuffles carry
few rows. No block is broadcast, and no score list leaves its node but for its first entries.

Vectors that are null, or hold a null or non-finite component, take no part, nor do rows of null
id. Vectors are compared with those of their own length. All rows with a query's id are its own and
no candidates; query rows that agree in id and vector are one query. Of fewer than k candidates
all are returned; ties go to the smaller id, then are arbitrary among rows of one id and score.
Scores beyond 64 bits are held to the range of a long; components and sums of any size are exact. Columns other than id and vector play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import scan
from ._text import mix

SHARD_ROWS, QUERY_ROWS, SLICES = 8192, 16384, 4
#: Of a shard's rows, one in so many is gathered from in the first phase.
GATHERED = 16
#: Collected entries, one in so many of all, below which they are resolved one by one and not as a matrix.
FEW = 8
_BATCH = 256
_BLOCK = "part int, dim int, kind int, ids binary, vectors binary"
#: How a block is packed: whole numbers of 2 or 4 bytes or as doubles, or, where 256 x is beyond a double, x itself.
_KINDS = (np.int16, np.int32, np.float64, np.float64)
_RAW = 3


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, components) of vectors that take part, for each length of vector."""
    ids, vectors = batch.column(0), batch.column(1)
    there = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
    ids, vectors = ids.filter(there), vectors.filter(there)
    if not len(ids):
        return
    flat = vectors.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # a null component is not a number
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        m = flat[starts[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
        good = np.isfinite(m).all(axis=1)
        yield ids[rows[good]], m[good]


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    with np.errstate(over="ignore"):
        whole = np.floor(m * 256.0)
    most = np.abs(whole).max() if whole.size else 0
    kind = 0 if most < 2**15 else 1 if most < 2**31 else 2 if most < np.inf else _RAW
    return kind, (m if kind == _RAW else whole.astype(_KINDS[kind])).tobytes()


def _blocks(frame: DataFrame, id_col: str, vector_col: str, parts: int) -> DataFrame:
    """The vectors as packed matrices, dealt over the parts by id."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, m in _matrices(batch):
            part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part).tolist():
                at = part == p
                kind, raw = _packed(m[at])
                ints = [pa.array([x], pa.int32()) for x in (p, m.shape[1], kind)]
                yield pa.record_batch([*ints, pa.array([ids[at].tobytes()], pa.binary()), pa.array([raw], pa.binary())], names=["part", "dim", "kind", "ids", "vectors"])

    return scan(frame, [id_col, vector_col], run, _BLOCK)


def _exact(m: np.ndarray) -> np.ndarray:
    """floor(256 x) as numbers of any size."""
    return np.array([[int(v) * 256 if abs(v) > 2.0**60 else math.floor(v * 256) for v in r] for r in m.tolist()], object).reshape(m.shape)


def _unpacked(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, whole numbers) by length: doubles, or objects where doubles can't hold them."""
    found: dict[int, list] = {}
    for dim, kind, ids, vectors in zip(*(table.column(c).to_pylist() for c in ("dim", "kind", "ids", "vectors"))):
        i = np.frombuffer(ids, np.int64)
        m = np.frombuffer(vectors, _KINDS[kind]).reshape(len(i), dim)
        found.setdefault(dim, []).append((i, _exact(m) if kind == _RAW else m.astype(np.float64)))
    return {d: (np.concatenate([i for i, _ in x]), np.concatenate([m for _, m in x])) for d, x in found.items()}


def _names(m: np.ndarray) -> np.ndarray:
    if m.dtype == object:
        return np.array([hash(tuple(int(v) for v in r)) for r in m.tolist()], np.int64)
    odd = 2 * np.arange(m.shape[1], dtype=np.uint64) + np.uint64(1)
    return mix((mix(m.view(np.uint64) + odd) * odd).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _queries(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: ids, a name of each vector, and vectors, each (id, vector) once."""
    out = {}
    for d, (ids, m) in _unpacked(table).items():
        name = _names(m + 0 if m.dtype == object else np.ascontiguousarray(m + 0.0))  # no zero with a sign
        _, first = np.unique(np.stack([ids, name], 1), axis=0, return_index=True)
        out[d] = ids[first], name[first], m[first]
    return out


def _longest_first(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if m.dtype == object:
        return ids, m
    order = np.lexsort((ids, -(m * m).sum(1)))
    return ids[order], m[order]


def _fitting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles while all sums of products fit them, else as whole numbers of any size."""
    if a.dtype != object and b.dtype != object:
        if (np.abs(a).max() if a.size else 0) * (np.abs(b).max() if b.size else 0) * a.shape[1] < 2.0**53:
            return a, b
    return tuple(x if x.dtype == object else np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape) for x in (a, b))


def _slices(dim: int, m: int) -> list[slice]:
    cuts = [dim * i // m for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a] or [slice(0, dim)]


def _whole(score) -> list[int]:
    return [max(-(2**63), min(2**63 - 1, int(v))) for v in score]


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best."""
    return [(v, i) for v, i in sorted(zip(_whole(score), ids.tolist()), key=lambda x: (-x[0], x[1]))[:k]]


def _gather(queries: pa.Table, vectors: pa.Table, k: int) -> Iterator[tuple[int, int, list[int]]]:
    """Phase 1: (query, name, its k best whole scores among the shard's longest vectors)."""
    held = _unpacked(vectors)
    for dim, (ids, names, q) in _queries(queries).items():
        if dim not in held:
            continue
        cid, c = _longest_first(*held[dim])
        n = min(len(cid), max(4 * k, -(-len(cid) // GATHERED)))
        cid, (q, c) = cid[:n], _fitting(q, c[:n])
        for s in range(0, len(ids), _BATCH):
            score = q[s : s + _BATCH] @ c.T
            for r in range(len(score)):
                there = np.flatnonzero(cid != ids[s + r])
                yield int(ids[s + r]), int(names[s + r]), [v for v, _ in _best(cid[there], score[r, there], k)]


def _reaching(q: np.ndarray, c: np.ndarray, cut: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phases 2 and 3 in doubles: (rows of q, rows of c, whole scores) of entries that reach the queries' cutoffs, and some that don't."""
    parts = _slices(q.shape[1], m)
    rest = [(np.sqrt((q[:, p.stop :] ** 2).sum(1)), np.sqrt((c[:, p.stop :] ** 2).sum(1))) for p in parts]
    slack = 1 + 1e-9 * rest[0][0].max(initial=0) * rest[0][1].max(initial=0)  # lengths are rounded, products aren't
    for s in range(0, len(q), _BATCH):
        a, least = q[s : s + _BATCH], cut[s : s + _BATCH, None] - slack
        partial = np.zeros((len(a), len(c)))
        for x, p in enumerate(parts):
            partial += a[:, p] @ c[:, p].T
            reach = partial + rest[x][0][s : s + _BATCH, None] * rest[x][1][None, :] >= least
            if np.count_nonzero(reach) * FEW <= reach.size:
                break
        row, col = np.nonzero(reach)
        score = partial[row, col]
        for y in range(x + 1, len(parts)):
            p = parts[y]
            for t in range(0, len(row), 1 << 16):
                score[t : t + (1 << 16)] += np.einsum("ij,ij->i", a[row[t : t + (1 << 16)], p], c[col[t : t + (1 << 16)], p])
            kept = score + rest[y][0][s + row] * rest[y][1][col] >= least[row, 0]
            row, col, score = row[kept], col[kept], score[kept]
        yield s + row, col, score


def _resolve(queries: pa.Table, vectors: pa.Table, cutoffs: dict[tuple[int, int], int], k: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """Phases 2 and 3: (query, name, vector, score) of the k best of this node that reach the cutoff."""
    held = _unpacked(vectors)
    for dim, (ids, names, q) in _queries(queries).items():
        if dim not in held:
            continue
        cid, c = held[dim]
        q, c = _fitting(q, c)
        cuts = [cutoffs.get(key, -(2**63)) for key in zip(ids.tolist(), names.tolist())]
        if q.dtype == object:
            every = np.arange(len(cid))
            found = ((np.full(len(cid), r), every, q[r] @ c.T) for r in range(len(ids)))
        else:
            found = _reaching(q, c, np.array(cuts, np.float64), m)
        for row, col, score in found:
            other = ids[row] != cid[col]
            row, col, score = row[other], col[other], score[other]
            order = np.argsort(row, kind="stable")
            row, col, score = row[order], col[order], score[order]
            for r, a, b in zip(*(x.tolist() for x in _groups(row))):
                for v, i in _best(cid[col[a:b]], score[a:b], k):
                    if v >= cuts[r]:
                        yield int(ids[r]), int(names[r]), i, v


def _groups(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different number, and where it starts and ends in the sorted array."""
    found, first = np.unique(row, return_index=True)
    return found, first, np.append(first[1:], len(row))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each query, by score, then by id."""
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    held = _blocks(vectors, id_col, vector_col, shards).withColumnRenamed("part", "shard")
    asked = _blocks(queries, id_col, vector_col, groups).withColumnRenamed("part", "qb")
    there = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    here = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def gather(q: pa.Table, v: pa.Table) -> pa.Table:
        got = list(_gather(q, v, k))
        return pa.table({"query_id": pa.array([x[0] for x in got], pa.int64()), "name": pa.array([x[1] for x in got], pa.int64()), "scores": pa.array([x[2] for x in got], pa.list_(pa.int64()))})

    keys = ["qb", "shard"]
    first = here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(gather, "query_id bigint, name bigint, scores array<bigint>")
    # The k-th best of all shards: tasks hand on k of what they hold for a query, however many shards that is.
    each = first.select("query_id", "name", F.explode("scores").alias("cut"))
    place = F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.desc("cut")))
    cutoffs = each.withColumn("r", place).filter(F.col("r") == k).select("query_id", "name", "cut")

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy()
        part = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        yield pa.record_batch([pa.array(part), *batch.columns], names=["qb", "query_id", "name", "cut"])

    dealt = scan(cutoffs, ["query_id", "name", "cut"], deal, "qb int, query_id bigint, name bigint, cut bigint")
    packed = dealt.groupBy("qb").agg(F.collect_list(F.struct("query_id", "name", "cut")).alias("cuts"))  # of one block of queries
    known = asked.join(packed, "qb", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def resolve(q: pa.Table, v: pa.Table) -> pa.Table:
        cuts = {(c["query_id"], c["name"]): c["cut"] for row in q.column("cuts").to_pylist()[:1] for c in row or ()}
        got = list(_resolve(q, v, cuts, k, slices))
        return pa.table({n: pa.array([x[i] for x in got], pa.int64()) for i, n in enumerate(("query_id", "name", "vec_id", "score"))})

    last = known.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(resolve, "query_id bigint, name bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    return last.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
