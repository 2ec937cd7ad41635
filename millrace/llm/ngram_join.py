"""N-gram Jaccard join: T-occurrence search over inverted lists, by DivideSkip.

A document's set holds its distinct word shingles, by 64-bit hash; documents of one set are one
class, found by sums of the set's hashes, and only classes are searched.

Cells. Two sets that link share a shingle among the first n - ceil(t n) + 1 of either, in any order
of all shingles that both use. The order here takes shingles below a quantile of the hash range
first, among them the rarest first, then the rest by hash; so only a share of the shingles has
to be counted. Shingles go out packed by bucket, 64-bit hash, class and room together, and are
counted as they stream by: of a shingle in very many sets no more than `HOT` rows are held at a time,
since all such rank alike. The sets that share one of their first shingles make a cell; a star to
the smallest set of each shingle's list is enough to find cells, whatever the list's length.

Search. The whole sets of a cell meet in one task, small cells several at once, and cells beyond
`BLOCK` shingles by pairs of blocks. Where the numbers of links aren't asked for, such a cell's first block, a random
sample of it, first meets all others; what this links to one group needs no more comparing within that group, so then only the sets
outside the cell's largest group are dealt into blocks, each of which meets the whole cell. A group of near copies of any size thus costs
one meeting with the sample, and not all pairs of blocks. In a meeting each set asks an inverted index for the sets that hold
enough of its shingles: its longest lists are set aside, the short ones are merged by a heap, and sets that
occur in them often enough are probed for in the long lists by binary search. A stated exact
test follows: 100 * shared >= 100 t * union. Every link between two classes is tested and counted, each pair in one
place only: the one cell that holds both, and there in the pair of their blocks. Only where the numbers of links
aren't asked for are sets skipped that others already link, so that a group of near copies costs a few probes
each, not all pairs; components are the same.

Null and empty texts have the empty set and link with nothing, nor do they have a partner. Rows of
null id get a null component and link nothing. Rows that share an id are one document for links.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, scan, written
from ._text import BLANK, Words, chunks, inside, mix, windows
from .components import components

SHINGLE, PERCENT = 5, 80
#: Share of the hash range whose shingles are counted.
COUNTED = 0.4
#: Rows held of one shingle while it is counted; more frequent ones rank alike.
HOT = 1024
#: Shingles of a block of the search.
BLOCK = 1 << 20
#: Share of long lists in DivideSkip: T / (MU * log2(longest) + 1).
MU = 0.0085
#: Entries of short lists up to which a heap merges them; beyond, they are counted.
MERGED = 512
_SALT = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles); a row of fewer than k words has one, of none no shingle."""
    for i, j, raw, offs in chunks(column):
        w = Words(raw, offs, BLANK)
        h = w.hashes()
        g = windows(h, k)
        for row, (a, b) in enumerate(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist())):
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                yield i + row, s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield i + row, windows(h[a:b], b - a)
            else:
                yield i + row, g[:0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class(s: np.ndarray) -> tuple[int, int, int]:
    """Class key of a set: a 64-bit name and the two sums it is made of."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _SALT).sum(dtype=np.uint64)
    name = np.bitwise_xor.reduce(mix(np.array([a, b, len(s)], np.uint64)) * np.array([1, 3, 5], np.uint64))
    return tuple(_signed(np.array([name, a, b], np.uint64)).tolist())


def digests(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """(id, n, cid, a, b): size and class of each document's set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [(len(s), *_class(s)) for _, s in shingle_sets(batch.column(1), k)]
        cols = np.array(got, np.int64).reshape(-1, 4)
        yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(cols[:, c])) for c in range(4))], names=["id", "n", "cid", "a", "b"])

    return scan(docs, [id_col, text_col], run, f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, cid bigint, a bigint, b bigint")


_POSTING = np.dtype([("tok", "<u8"), ("cid", "<i8"), ("room", "<i4")])
_PIECE = "bucket int, piece binary"


def _pieces(bucket: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows packed by bucket."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(starts[1:], len(rows))
    yield pa.record_batch([
        pa.array(bucket[starts].astype(np.int32)), pa.array([rows[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())], pa.binary()),
    ], names=["bucket", "piece"])


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _postings(docs: DataFrame, text_col: str, k: int, percent: int, buckets: int) -> DataFrame:
    """The first shingles of each set, by bucket of the shingle."""
    bound = np.uint64(int(COUNTED * 2**64))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for _, s in shingle_sets(batch.column(0), k):
            n = len(s)
            if not n:
                continue
            first, low = n - _least(n, percent) + 1, int(np.searchsorted(s, bound))
            out = np.empty(max(first, low), _POSTING)
            out["tok"], out["cid"], out["room"] = s[: len(out)], _class(s)[0], first - low
            parts.append(out)
        if parts:
            rows = np.concatenate(parts)
            yield from _pieces((rows["tok"] % np.uint64(buckets)).astype(np.int64), rows)

    return scan(docs, [text_col], run, _PIECE)


def _least(n: int, percent: int) -> int:
    """Shared shingles that a set of n needs with any partner."""
    return -(-n * percent // 100)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Pieces of each bucket, from rows sorted by bucket."""

    def rows() -> Iterator[tuple[int, bytes]]:
        for b in batches:
            for i in range(b.num_rows):
                yield b.column(0)[i].as_py(), b.column(1)[i].as_py()

    for bucket, group in itertools.groupby(rows(), key=lambda x: x[0]):
        yield bucket, (p for _, p in group)


#: Buckets for each shuffle partition; more of them are worked on with less memory, and make more packed rows.
BUCKETS = 1
#: Shingles of a bucket on average, by which their number grows with the corpus, as a task holds a bucket whole.
BUCKET_SHINGLES = 4_000_000


def _gathered(pieces: DataFrame, buckets: int) -> DataFrame:
    return pieces.repartition(buckets // BUCKETS, "bucket").sortWithinPartitions("bucket")


_SHARED = np.dtype([("cid", "<i8"), ("tok", "<u8"), ("df", "<u4"), ("room", "<i4")])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows["cid"], rows["tok"]))]
    same = (rows["tok"][1:] == rows["tok"][:-1]) & (rows["cid"][1:] == rows["cid"][:-1])
    return rows[np.concatenate([[True], ~same])] if len(rows) else rows


def _counted(pieces: DataFrame, buckets: int) -> DataFrame:
    """Shingles of two classes or more with their number, packed by class."""

    def shared(rows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = np.empty(len(rows), _SHARED)
        for f in ("cid", "tok", "room"):
            out[f] = rows[f]
        out["df"] = n
        yield from _pieces(_spread(out["cid"], buckets), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_bucket(batches):
            held, fresh, n_fresh = np.zeros(0, _POSTING), [], 0
            hot = np.zeros(0, np.uint64)

            def settle(held: np.ndarray, fresh: list, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Rows to hold, rows of hot shingles to let go, hot shingles."""
                rows = _distinct(np.concatenate([held, *fresh]))
                starts, n = _runs(rows["tok"])
                hot = np.union1d(hot, rows["tok"][starts[n >= HOT]])
                gone = np.isin(rows["tok"], hot)
                return rows[~gone], rows[gone], hot

            for p in group:
                fresh.append(np.frombuffer(p, _POSTING))
                n_fresh += len(fresh[-1])
                if n_fresh > max(1 << 20, len(held)):
                    held, gone, hot = settle(held, fresh, hot)
                    fresh, n_fresh = [], 0
                    yield from shared(gone, np.full(len(gone), HOT, np.uint32))
            held, gone, hot = settle(held, fresh, hot)
            yield from shared(gone, np.full(len(gone), HOT, np.uint32))
            starts, n = _runs(held["tok"])
            each = np.repeat(n, n)
            yield from shared(held[each > 1], each[each > 1])

    return _gathered(pieces, buckets).mapInArrow(run, _PIECE)


_EDGE = "a bigint, b bigint"


def _prefixes(shared: DataFrame, buckets: int) -> DataFrame:
    """The shared ones of each class's first shingles, packed by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_bucket(batches):
            rows = np.concatenate([np.frombuffer(p, _SHARED) for p in group])
            rows = rows[np.lexsort((rows["tok"], rows["df"], rows["cid"]))]
            same = (rows["tok"][1:] == rows["tok"][:-1]) & (rows["cid"][1:] == rows["cid"][:-1])
            rows = rows[np.concatenate([[True], ~same])]
            starts, n = _runs(rows["cid"])
            room = rows["room"][starts].astype(np.int64)
            keep = np.where(room >= 0, n, np.clip(room + n, 0, n))  # shingles of one class alone come first in the order
            at = np.arange(len(rows)) - np.repeat(starts, n)
            rows = rows[at < np.repeat(keep, n)]
            out = np.empty(len(rows), _POSTING)
            out["tok"], out["cid"], out["room"] = rows["tok"], rows["cid"], 0
            yield from _pieces((out["tok"] % np.uint64(buckets)).astype(np.int64), out)

    return _gathered(shared, buckets).mapInArrow(run, _PIECE)


def _stars(prefixes: DataFrame, buckets: int) -> DataFrame:
    """From each class in a shingle's list to the first that was seen there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_bucket(batches):
            tok, lead = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for p in group:
                rows = np.frombuffer(p, _POSTING)
                every, first = np.unique(np.concatenate([tok, rows["tok"]]), return_index=True)
                lead = np.concatenate([lead, rows["cid"]])[first]
                tok = every
                a, b = rows["cid"], lead[np.searchsorted(tok, rows["tok"])]
                edge = np.unique(np.stack([a, b], 1)[a != b], axis=0)
                if len(edge):
                    yield pa.record_batch([pa.array(np.ascontiguousarray(edge[:, 0])), pa.array(np.ascontiguousarray(edge[:, 1]))], names=["a", "b"])

    return _gathered(prefixes, buckets).mapInArrow(run, _EDGE)


class Index:
    """Inverted lists over sets, numbered by size; finds and joins those that link."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int = PERCENT, weights: list[int] | None = None, blocks: list[int] | None = None, groups: list | None = None):
        """weights: documents of each set, by which links are counted; blocks: where given, only links between two of them are; groups: names of groups that sets are known to be in."""
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets, self.percent = [ids[i] for i in order], [sets[i] for i in order], percent
        self.size = np.array([len(s) for s in self.sets], np.int64)
        tok = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        by = np.argsort(tok, kind="stable")
        self.owner = owner[by]
        starts, n = _runs(tok[by])
        run = np.empty(len(tok), np.int64)
        run[by] = np.repeat(np.arange(len(starts)), n)
        self.run, self.starts, self.n = run, starts, n  # run: number of the list of each shingle, set by set
        self.ptr = np.concatenate([[0], np.cumsum(self.size)])
        self.root = np.arange(len(self.sets))
        self.weight = np.array([weights[i] for i in order], np.int64) if weights is not None else None
        self.block = np.array([blocks[i] for i in order], np.int64) if blocks is not None else None
        self.order, self.links = order, np.zeros(len(self.sets), np.int64)
        if groups is not None:
            first: dict[object, int] = {}
            self.root = np.array([x if groups[i] is None else first.setdefault(groups[i], x) for x, i in enumerate(order)], np.int64)

    def _lists(self, numbers: np.ndarray) -> list[np.ndarray]:
        return [self.owner[s:e] for s, e in zip(self.starts[numbers].tolist(), (self.starts[numbers] + self.n[numbers]).tolist())]

    def occurrences(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Larger sets that hold enough of x's shingles, and how many they share; only those of other groups if links aren't counted."""
        none = np.zeros(0, np.int64)
        n = int(self.size[x])
        lists = self.run[self.ptr[x] : self.ptr[x + 1]]
        lists = lists[self.n[lists] > 1]
        need, top = _least(n, self.percent), int(np.searchsorted(self.size, n * 100 // self.percent, "right"))
        if len(lists) < need or top <= x + 1 or (self.weight is None and (self.root[x + 1 : top] == self.root[x]).all()):
            return none, none
        lists = lists[np.argsort(self.n[lists], kind="stable")]
        long = min(need - 1, int(need / (MU * math.log2(int(self.n[lists[-1]])) + 1)))
        short, rest = self._lists(lists[: len(lists) - long]), lists[len(lists) - long :]
        if sum(map(len, short)) <= MERGED:
            found = [(y, len(list(group))) for y, group in itertools.groupby(heapq.merge(*(p.tolist() for p in short)))]
            found = [(y, c) for y, c in found if c >= need - long and x < y < top]
            ys, shared = np.array([y for y, _ in found], np.int64), np.array([c for _, c in found], np.int64)
        else:  # the merge of many entries, by counting
            count = np.bincount(np.concatenate(short), minlength=top)
            ys = np.flatnonzero(count[x + 1 : top] >= need - long) + x + 1
            shared = count[ys]
        # 100 shared >= percent (n + size - shared)
        enough = shared + long >= -(-self.percent * (n + self.size[ys]) // (100 + self.percent))
        if self.weight is None:
            enough &= self.root[ys] != self.root[x]
        ys, shared = ys[enough], shared[enough]
        if not len(ys) or not long:
            return ys, shared
        parts = self._lists(rest)
        if len(ys) * 16 < len(parts[0]):
            for part in parts:
                at = np.minimum(part.searchsorted(ys), len(part) - 1)
                shared = shared + (part[at] == ys)
        else:  # as many sets to probe for as the lists have: the lists are read through
            shared = shared + np.bincount(np.concatenate(parts), minlength=top)[ys]
        return ys, shared

    def join(self) -> Iterator[tuple]:
        """(id, smallest id of its group) for each set that links with another."""
        for x in range(len(self.sets)):
            if not self.size[x]:
                continue
            ys, shared = self.occurrences(x)
            ys = ys[100 * shared >= self.percent * (self.size[x] + self.size[ys] - shared)]
            if self.weight is not None:
                to = ys if self.block is None else ys[self.block[ys] != self.block[x]]
                self.links[x] += self.weight[to].sum()
                self.links[to] += self.weight[x]
            for q in np.unique(self.root[ys]).tolist():
                p = int(self.root[x])
                self.root[self.root == max(p, q)] = min(p, q)
        least: dict[int, object] = {}
        for i, r in enumerate(self.root.tolist()):
            least[r] = min(least.get(r, self.ids[i]), self.ids[i])
        for i, r in enumerate(self.root.tolist()):
            if least[r] != self.ids[i]:
                yield self.ids[i], least[r]


def _search(members: DataFrame, kind: str, k: int, percent: int, links: bool) -> DataFrame:
    """Links (a, b) among the members (grp, block, id, cid, docs, root, text) of each group, and where asked for (cid, links) of each class."""

    def run(table: pa.Table) -> pa.Table:
        ids, cids = table.column("id").to_pylist(), table.column("cid").to_pylist()
        docs, blocks = table.column("docs").to_pylist(), table.column("block").to_pylist()
        sets: list = [None] * len(ids)
        for row, s in shingle_sets(table.column("text").combine_chunks(), k):
            sets[row] = s
        weights = None
        if links:
            first: dict[int, int] = {}  # rows that share an id and a text, or an id alone, count once or not at all
            for row, s in enumerate(sets):
                if _class(s)[0] == cids[row]:
                    first.setdefault(cids[row], row)
            weights = [docs[row] if first.get(cids[row]) == row else 0 for row in range(len(ids))]
        place = table.column("grp")[0].as_py().split(",")
        index = Index(ids, sets, percent, weights, blocks if len(set(place[1:])) == 2 else None, table.column("root").to_pylist())
        got = list(index.join())
        of = table.schema.field("id").type
        n = [(cids[row], x) for row, x in zip(index.order, index.links.tolist()) if weights is not None and weights[row] and x]
        return pa.table({
            "a": pa.array([a for a, _ in got] + [None] * len(n), of), "b": pa.array([b for _, b in got] + [None] * len(n), of),
            "cid": pa.array([None] * len(got) + [c for c, _ in n], pa.int64()), "links": pa.array([None] * len(got) + [x for _, x in n], pa.int64()),
        })

    return members.groupBy("grp").applyInArrow(run, f"a {kind}, b {kind}, cid bigint, links bigint")


def _dealt(members: DataFrame, few: int, links: bool) -> DataFrame:
    """The members of cells with the groups that they meet in, `grps`: all pairs of blocks, or, without links, the first block and each."""
    wide = members.groupBy("cell").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    name = lambda a, b: F.concat_ws(",", "cell", a, b)
    pairs = F.transform(every, lambda o: name(F.least(o, block), F.greatest(o, block)))
    if not links:
        pairs = F.when(block == 0, F.transform(every, lambda o: name(F.lit(0), o))).otherwise(F.array(name(F.lit(0), block)))
    alone = F.array(F.pmod(F.xxhash64("cell"), F.lit(few)).cast("string"))
    return members.join(wide, "cell").select("rep", "cid", "docs", "cell", "n", "blocks", block.alias("block"), F.when(F.col("blocks") > 1, pairs).otherwise(alone).alias("grps"))


def _left_over(placed: DataFrame, linked: DataFrame) -> DataFrame:
    """Of cells of several blocks, the members with `root`, the group that the first round put them in, and the groups that they meet in next.

    Sets outside a cell's largest group are dealt into parts of a block's size, and each part meets all blocks of the cell.
    """
    rooted = placed.filter("blocks > 1").join(linked.withColumnRenamed("v", "rep"), "rep", "left")
    rooted = durable(rooted.select("rep", "cid", "docs", "cell", "n", "blocks", "block", F.coalesce("root", "rep").alias("root")))
    size = rooted.groupBy("cell", "root").agg(F.sum("n").alias("size"))
    most = size.groupBy("cell").agg(F.max(F.struct("size", "root")).alias("m"), F.sum("size").alias("all"))
    most = most.select("cell", F.col("m.root").alias("largest"), F.ceil((F.col("all") - F.col("m.size")) / BLOCK).cast("int").alias("parts")).filter("parts > 0")
    name = lambda part, block: F.concat_ws(",", "cell", part, block, F.lit("rest"))
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    own = F.when(F.col("root") != F.col("largest"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: name(part, b))).otherwise(F.array().cast("array<string>"))
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: name(p, F.col("block")))
    return rooted.join(most, "cell").select("rep", "cid", "docs", "block", "root", F.array_distinct(F.concat(own, other)).alias("grps"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """One row per document: its id, n_shingles, component_id, the smallest id that links reach, and n_links, the other documents it links with.

    Without `links` the last column is left out and not worked out.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    named = written(digests(docs, id_col, text_col, k))
    shingles = named.agg(F.sum("n")).first()[0] or 0
    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))

    counted = _counted(_postings(docs, text_col, k, percent, buckets), buckets)
    cells = components(_stars(_prefixes(counted, buckets), buckets))

    key = ["n", "cid", "a", "b"]
    classes = named.filter("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("docs"))
    members = durable(classes.join(cells.select(F.col("v").alias("cid"), F.col("root").alias("cell")), "cid").select("rep", "n", "cid", "docs", "cell"))
    total = members.agg(F.sum("n")).first()[0] or 0
    few = max(1, 2 * total // BLOCK, min(total // 50_000, spark.sparkContext.defaultParallelism * 2))
    placed = _dealt(members, few, links)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def met(where: DataFrame) -> DataFrame:
        each = texts.join(where, texts["id"] == where["rep"]).select(F.explode("grps").alias("grp"), "block", "id", "cid", "docs", "root", "text")
        return durable(_search(each, kind, k, percent, links))

    found = met(placed.withColumn("root", F.lit(None).cast(kind)))
    linked = components(found.select("a", "b"))
    if not links and not placed.filter("blocks > 1").isEmpty():
        linked = components(found.select("a", "b").unionByName(met(_left_over(placed, linked)).select("a", "b")))
    groups = classes.join(linked.withColumnRenamed("v", "rep"), "rep", "left").select(*key, "docs", F.coalesce("root", "rep").alias("component_id"))
    if links:
        groups = groups.join(found.filter("cid is not null").groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    every = named.join(groups, key, "left")
    n_links = F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce("docs", F.lit(1)) - 1) if links else None
    # only sets without shingles, and rows without an id, have no class
    return every.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        *([n_links.alias("n_links")] if links else []),
    )
