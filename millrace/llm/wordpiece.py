"""Token counts: lengths of greedy word pieces, by a linear longest-match automaton.

A word's pieces are, from its start, always the longest vocabulary entry that fits; pieces that
start a word and pieces within one are two tries. A node from which no match goes on has a failure
link to where the rest of what was read leads after the longest pieces are split off, and the
number of those pieces, worked out when the automaton is built. So a word costs a step for each
character, however often matches break off, and no piece is ever built.

A word that can't be split into entries counts as one piece, and as unknown. Words are [^\x20\x09-\x0D]+.
Null and empty texts have no words and no pieces. Each row gives one row, also where ids, null ones too, and texts are equal; other
columns play no part. A text costs in proportion to its length, however long its words are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import scan
from ._text import strings

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
#: Entries at most, so that what is sent to the executors is bounded.
MOST_ENTRIES = 2_000_000
#: Words whose counts a worker remembers.
REMEMBERED = 400_000


class Automaton:
    """Counts greedy longest-match pieces. Node 0 is the root of pieces that start a word, node 1 of those within."""

    def __init__(self, starting: Iterable[str], within: Iterable[str]):
        go: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, entries in ((0, starting), (1, within)):
            for entry in entries:
                at = root
                for c in entry:
                    if c not in go[at]:
                        go[at][c] = len(go)
                        go.append({})
                        ends.append(False)
                    at = go[at][c]
                if at > 1:
                    ends[at] = True
        fail, popped = [-1] * len(go), [0] * len(go)
        queue = deque([(0, -1, ""), (1, -1, "")])
        while queue:
            u, parent, c = queue.popleft()
            queue.extend((v, u, x) for x, v in go[u].items())
            if parent < 0:
                continue
            if ends[u]:
                fail[u], popped[u] = 1, 1
                continue
            z, n = fail[parent], popped[parent]
            while z >= 0 and c not in go[z]:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[u], popped[u] = go[z][c], n
        self.go, self.fail, self.popped = go, fail, popped

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it has no split."""
        go, fail, popped = self.go, self.fail, self.popped
        u = n = 0
        for c in word:
            while (v := go[u].get(c)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return -1
            u = v
        while u != 1:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return -1
        return n


def vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Entries that start a word and entries within, of a sentencepiece model; without control, unknown and byte entries."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if len(pieces) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of {len(pieces)} entries")
    return [p[1:] for p in pieces if p.startswith(START) and len(p) > 1], [p for p in pieces if not p.startswith(START)]


@lru_cache(2)
def _ready(entries: tuple[tuple[str, ...], tuple[str, ...]]) -> tuple[Automaton, dict[bytes, int]]:
    """The automaton, and the counts of words met so far; one for each worker and vocabulary."""
    return Automaton(*entries), {}


def tally(texts: Iterable[bytes], entries: tuple[tuple[str, ...], tuple[str, ...]]) -> list[tuple[int, int, int]]:
    """(words, pieces, unknown words) of each text."""
    automaton, known = _ready(entries)
    rows = []
    for t in texts:
        words = t.split()  # of bytes, at ASCII white space only
        pieces = unknown = 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[w] = automaton.count(w.decode())
            if n < 0:
                unknown += 1
                n = 1
            pieces += n
        rows.append((len(words), pieces, unknown))
    return rows


def count_tokens(docs: DataFrame, entries: tuple[Iterable[str], Iterable[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_words, n_pieces, n_unknown (words without a split)."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, entries)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = tally((t.as_py() for t in strings(batch.column(1)).cast(pa.large_binary())), sent.value)
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[id_col, "n_words", "n_pieces", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return scan(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_words bigint, n_pieces bigint, n_unknown bigint")
