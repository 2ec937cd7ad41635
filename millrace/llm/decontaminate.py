"""Benchmark decontamination: windows of test words against every window of the documents.

A window is ten consecutive words of a benchmark item; an item of fewer words, but not none, is
one window. Tasks cut the items into pieces, normalise them and hash their windows; what is sent to all executors is
the hashes, the pieces' bytes and the places of windows in them, so the driver only hands it on. The executors look up
every window of every text, compare the words of what they find, and mark them.

Up to `block_bytes` are sent at a time, measured as they are sent. A larger benchmark goes in blocks of that size, of which
one is held at a time: what each finds is written, then marks of all are put together by a key of each row's own, which is
written with the rows before. Long items go in several pieces, so an item may be larger than a block.

Null texts have no words. Each row gives one row, also where ids, null ones too, and texts are equal; other columns play no part. An item
whose id is null is listed as "null"; equal ids are listed once. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import scan, written
from ._text import ALNUM, CHUNK_BYTES, Words, chunks, inside, windows

BLOCK_BYTES = 32 << 20
#: Words of a piece of an item.
PIECE_WORDS = 50_000
_BITS = 22

_PIECE = "item string, k int, said binary, hashes binary, starts binary, ends binary"


def _pieces(item: str, text: str, width: int, piece_words: int) -> Iterator[tuple]:
    raw = text.encode()
    w = Words(raw, np.array([0, len(raw)]), ALNUM)
    n = len(w.starts)
    k = min(width, n)
    h = w.hashes()
    for s in range(0, n - k + 1 if n else 0, piece_words):
        e = min(n, s + piece_words + k - 1)
        sizes = w.ends[s:e] - w.starts[s:e]
        first = np.cumsum(sizes + 1) - sizes - 1
        last = (first + sizes)[k - 1 :]
        yield item, k, w.text(s, e), windows(h[s:e], k).tobytes(), first[: len(last)].astype(np.int32).tobytes(), last.astype(np.int32).tobytes()


def _cut(benchmark: DataFrame, width: int, item_col: str, text_col: str, piece_words: int) -> DataFrame:
    """The items' pieces: normalised words, hashes of their windows, and where each starts and ends."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for piece in _pieces(item, text.as_py(), width, piece_words):
                yield pa.record_batch([pa.array([x], t) for x, t in zip(piece, (pa.string(), pa.int32(), *[pa.binary()] * 4))], names=["item", "k", "said", "hashes", "starts", "ends"])

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    return scan(items, ["item", "text"], run, _PIECE)


class WindowSet:
    """Windows of pieces, by length: sorted hashes, the piece of each, and its place there. Found by hash and compared word by word."""

    def __init__(self, pieces: list[tuple]):
        self.items, self.said = [p[0] for p in pieces], [bytes(p[2]) for p in pieces]
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted({p[1] for p in pieces}):
            own = [i for i, p in enumerate(pieces) if p[1] == k]
            keys = [np.frombuffer(pieces[i][3], np.uint64) for i in own]
            places = (np.frombuffer(b"".join(bytes(pieces[i][c]) for i in own), np.int32) for c in (4, 5))
            piece = np.repeat(np.array(own, np.int32), [len(x) for x in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            self.by_length[k] = (keys[order], piece[order], *(x[order] for x in places))
        self._ready()

    def _ready(self) -> None:
        self.there = {k: self._bits(x[0]) for k, x in self.by_length.items()}
        self.known: dict[tuple[int, int], dict[bytes, frozenset[str]]] = {}

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        there = np.zeros(1 << _BITS, bool)
        there[keys >> np.uint64(64 - _BITS)] = True
        return there

    def __getstate__(self) -> tuple:
        return self.items, self.said, self.by_length

    def __setstate__(self, state: tuple) -> None:
        self.items, self.said, self.by_length = state
        self._ready()

    def _owners(self, k: int, at: int) -> dict[bytes, frozenset[str]]:
        """Items by window, for the run of equal hashes that starts here."""
        found = self.known.get((k, at))
        if found is None:
            keys, piece, starts, ends = self.by_length[k]
            stop = int(np.searchsorted(keys, keys[at], "right"))
            by: dict[bytes, set[str]] = {}
            for p, s, e in zip(piece[at:stop].tolist(), starts[at:stop].tolist(), ends[at:stop].tolist()):
                by.setdefault(self.said[p][s:e], set()).add(self.items[p])
            found = self.known[k, at] = {t: frozenset(x) for t, x in by.items()}
        return found

    def scan(self, w: Words) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(first word, end word, items) of each window that occurs."""
        if not len(w.starts):
            return
        h = w.hashes()
        for k, (keys, *_) in self.by_length.items():
            g = windows(h, k)
            at = np.flatnonzero(self.there[k][g >> np.uint64(64 - _BITS)] & inside(w.ptr, k, len(g)))
            place = np.searchsorted(keys, g[at])
            same = keys[np.minimum(place, len(keys) - 1)] == g[at]
            for i, p in zip(at[same].tolist(), place[same].tolist()):
                owners = self._owners(k, p).get(w.text(i, i + k))
                if owners:
                    yield i, i + k, owners


def _merged(marks: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s, e in sorted(marks):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def _blocks(benchmark: DataFrame, width: int, block_bytes: int, item_col: str, text_col: str, piece_words: int) -> tuple[int, Callable[[int], WindowSet]]:
    """The number of blocks, and what makes one of them: pieces in order, as many as block_bytes hold, one at least."""
    cut = written(_cut(benchmark, width, item_col, text_col, piece_words))
    size = (F.octet_length("item") + F.octet_length("said") + 2 * F.octet_length("hashes") + 200).cast("long")
    total = cut.agg(F.sum(size)).first()[0] or 0
    if total <= block_bytes:
        return 1, lambda _: WindowSet(cut.collect())
    order = Window.orderBy("item", "k", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = cut.select("item", "k", F.xxhash64("said", "hashes").alias("h"), size.alias("size"))  # a short row for each piece
    number = F.floor((F.sum("size").over(order) - 1) / block_bytes).cast("int")
    dealt = written(sized.select("item", "k", "h", number.alias("block")).distinct())
    found = written(cut.withColumn("h", F.xxhash64("said", "hashes")).distinct().join(dealt.groupBy("item", "k", "h").agg(F.min("block").alias("block")), ["item", "k", "h"]).drop("h"))
    n = found.agg(F.max("block")).first()[0] + 1
    return n, lambda b: WindowSet([tuple(r)[:6] for r in found.filter(F.col("block") == b).select("item", "k", "said", "hashes", "starts", "ends").collect()])


SPANS = "array<struct<start:bigint,end:bigint>>"
SCHEMA = f"n_words bigint, spans {SPANS}, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(known: WindowSet, w: Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """For each row with hits, its spans of words (numbered in the chunk) and items."""
    marks: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for s, e, owners in known.scan(w):
        spans, items = marks.setdefault(int(np.searchsorted(w.ptr, s, "right")) - 1, ([], set()))
        spans.append((s, e))
        items |= owners
    return marks


def _scanned(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, raw, offs in chunks(batch.column(1), CHUNK_BYTES):
            w = Words(raw, offs, ALNUM)
            marks = _found(sent.value, w)
            none: tuple[list, set] = ([], set())
            own = [(_merged([(s - int(w.ptr[r]), e - int(w.ptr[r])) for s, e in spans]), sorted(items)) for r in range(j - i) for spans, items in (marks.get(r, none),)]
            yield pa.record_batch([
                batch.column(0).slice(i, j - i), pa.array(w.counts(), pa.int64()), pa.array([x for x, _ in own], _SPANS), pa.array([x for _, x in own], pa.list_(pa.string())),
            ], names=[id_col, "n_words", "spans", "items"])

    return scan(docs, [id_col, text_col], run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


_KEY, _HIT = "__key", "key long, start long, end long, first long, upto long, item string"


def _keyed(docs: DataFrame) -> DataFrame:
    return written(docs.withColumn(_KEY, F.monotonically_increasing_id()))


def _hits(keyed: DataFrame, known: WindowSet, text_col: str) -> DataFrame:
    """(key, start, end, first, upto, item): merged spans of words and of bytes, then items without a span. The block is let go once they are written."""
    sent = keyed.sparkSession.sparkContext.broadcast(known)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(0).to_numpy()
        for i, _, raw, offs in chunks(batch.column(1), CHUNK_BYTES):
            w = Words(raw, offs, ALNUM)
            rows = []
            for r, (spans, items) in sorted(_found(sent.value, w).items()):
                key, base, at = int(keys[i + r]), int(w.ptr[r]), int(offs[r])
                rows += [(key, x["start"] - base, x["end"] - base, int(w.starts[x["start"]]) - at, int(w.ends[x["end"] - 1]) - at, None) for x in _merged(spans)]
                rows += [(key, None, None, None, None, x) for x in sorted(items)]
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.record_batch([pa.array([x[c] for x in rows], kinds[c]) for c in range(6)], names=["key", "start", "end", "first", "upto", "item"])

    found = written(scan(keyed, [_KEY, text_col], run, _HIT))
    sent.destroy()
    return found


def _marks(keyed: DataFrame, blocks: tuple[int, Callable[[int], WindowSet]], text_col: str) -> DataFrame:
    """(key, spans, bytes, items) of the rows with hits in any block: sorted by key and start, and merged as they stream by."""
    n, made = blocks
    every = None
    for b in range(n):
        part = _hits(keyed, made(b), text_col)
        every = part if every is None else every.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, raw, items = None, [], [], set()

        def out() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield pa.record_batch(
                    [pa.array([key], pa.int64()), pa.array([_merged(words)], _SPANS), pa.array([_merged(raw)], _SPANS), pa.array([sorted(items)], pa.list_(pa.string()))],
                    names=["key", "spans", "bytes", "items"],
                )

        for batch in batches:
            for k, s, e, first, upto, item in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    yield from out()
                    key, words, raw, items = k, [], [], set()
                if item is not None:
                    items.add(item)
                elif words and s <= words[-1][1]:
                    words[-1], raw[-1] = (words[-1][0], max(e, words[-1][1])), (raw[-1][0], max(upto, raw[-1][1]))
                else:
                    words.append((s, e))
                    raw.append((first, upto))
        yield from out()

    return every.repartition("key").sortWithinPartitions("key", "start", "end").mapInArrow(run, f"key long, spans {SPANS}, bytes {SPANS}, items array<string>")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", piece_words: int = PIECE_WORDS) -> DataFrame:
    """One row per document: its id, n_words, merged spans of hit words, and ids of the items that occur. The benchmark's texts are in a column `text`."""
    blocks = _blocks(benchmark, width, block_bytes, item_col, "text", piece_words)
    if blocks[0] == 1:
        return _scanned(docs, docs.sparkSession.sparkContext.broadcast(blocks[1](0)), id_col, text_col)
    keyed = _keyed(docs.select(id_col, text_col))
    marks = _marks(keyed, blocks, text_col)
    none = WindowSet([])
    counted = _scanned(keyed.select(F.struct(id_col, _KEY).alias("own"), text_col), docs.sparkSession.sparkContext.broadcast(none), "own", text_col)
    rows = counted.select(F.col("own")[id_col].alias(id_col), F.col("own")[_KEY].alias(_KEY), "n_words")
    return rows.join(marks, rows[_KEY] == marks["key"], "left").select(
        id_col, "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def report(found: DataFrame) -> DataFrame:
    """The digest of find_overlaps()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", piece_words: int = PIECE_WORDS) -> DataFrame:
    """All columns of the documents, without those that hold a window (`documents`) or with the hit words cut out (`spans`).

    With a benchmark of one block nothing is shuffled.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    blocks = _blocks(benchmark, width, block_bytes, item_col, "text", piece_words)
    if blocks[0] == 1:
        return _cleaned(docs, docs.sparkSession.sparkContext.broadcast(blocks[1](0)), text_col, remove == "spans")
    keyed = _keyed(docs)
    marks = _marks(keyed, blocks, text_col).select(F.col("key").alias(_KEY), F.col("bytes").alias(_BYTES))
    if remove == "documents":
        return keyed.join(marks, _KEY, "left_anti").select(*docs.columns)
    return _without(keyed.join(marks, _KEY, "left").select(*docs.columns, _BYTES), text_col).select(*docs.columns)


def _shortened(text: str, cuts: list[tuple[int, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    for s, e in cuts:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def _cleaned(docs: DataFrame, sent, text_col: str, spans: bool) -> DataFrame:
    """The rows without those whose text holds a window, or with what hit cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.schema.get_field_index(text_col)
            for i, j, raw, offs in chunks(batch.column(col), CHUNK_BYTES):
                w = Words(raw, offs, ALNUM)
                marks, part = _found(sent.value, w), batch.slice(i, j - i)
                if not marks:
                    yield part
                elif not spans:
                    keep = np.ones(j - i, bool)
                    keep[[*marks]] = False
                    yield part.filter(pa.array(keep))
                else:
                    texts = part.column(col).to_pylist()
                    for r, (found, _) in marks.items():
                        texts[r] = _shortened(texts[r], [(int(w.starts[x["start"]] - offs[r]), int(w.ends[x["end"] - 1] - offs[r])) for x in _merged(found)])
                    yield part.set_column(col, part.schema.field(col), pa.array(texts, part.schema.field(col).type))

    return docs.mapInArrow(run, docs.schema)


_BYTES = "__bytes"


def _without(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with the marked bytes of their texts cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.schema.get_field_index(text_col)
            texts = batch.column(col).to_pylist()
            for r, cuts in enumerate(batch.column(batch.schema.get_field_index(_BYTES)).to_pylist()):
                if cuts:
                    texts[r] = _shortened(texts[r], [(x["start"], x["end"]) for x in cuts])
            yield batch.set_column(col, batch.schema.field(col), pa.array(texts, batch.schema.field(col).type))

    return docs.mapInArrow(run, docs.schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
