"""Toxicity: a subsequence string kernel, Nystrom landmarks and a support vector machine.

Words are compared by the subsequences of four characters that they share, the word's bounds
counting as characters and punctuation as none; a subsequence that skips g characters weighs DECAY ** g, up to MOST_GAP
of them, so that an insult with characters put in or left out stays close to itself. The kernel of
two words is the product of these weights over all shared subsequences, scaled by the words' norms.
A sentence's kernel with a landmark is the largest of its words', or 0 below NEAR.

Landmarks are words of toxic training documents that hold character sequences found far more often
there, and the words of clean ones that come closest to these. The kernel among the landmarks,
to the power of -1/2, turns kernel values into Nystrom features. The machine learns
from sentences, each with its document's label; as not every sentence of a toxic document is
toxic, sentences there that it takes for clean are left out in further rounds, but for the
document's worst. A logistic curve over sums of the sentences' margins gives the document's score.

The fit uses a sample of `rows_each` labelled documents of either label, drawn by a hash of the id,
never one whose crc32(id as text) mod 5 is 0; scoring is one pass over all texts without a shuffle.
Null and empty texts score as texts without any word that comes near a landmark. Without training
documents of both labels every score is 0. Conflicting labels of an id count as toxic. Rows that share an id are scored each by its own
text; the fit takes the first of their texts in alphabetical order. Other columns play no part. Letters of Latin script beyond ASCII are told
apart, either case as one; of other scripts, their UTF-8 bytes are compared by five bits.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import scan
from ._text import BLANK, Words, chunks, strings

FOLDS = 5
ROWS_EACH = 4000
#: Bits of a character.
BITS = 6
LANDMARKS, CONTRASTS = 72, 24
NEAR, DECAY, MOST_GAP, LENGTH, GRAM = 0.45, 0.6, 2, 4, 5
_DROP = 255

#: ASCII that is no letter or digit.
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Gaps after each of the first three characters of a subsequence.
GAPS = [g for g in itertools.product(range(MOST_GAP + 1), repeat=LENGTH - 1) if sum(g) <= MOST_GAP]


def _classes() -> np.ndarray:
    out = np.full(256, _DROP, np.uint8)  # punctuation between letters hides nothing
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = 27
    last = np.arange(0x80, 0xC0)  # the last bytes of other letters; of capitals as of small ones, as far as Latin has them
    out[0x80:0xC0] = 28 + np.where(last < 0x9F, last + 0x20, last) % 32
    return out


CLASSES = _classes()


def _sequences(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the words, each with 0 before and after it; the word of each; the words' lengths."""
    n = ends - starts
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    word = np.repeat(np.arange(len(n)), n)
    c = CLASSES[buf[at]]
    keep = c != _DROP
    c, word = c[keep], word[keep]
    size = np.bincount(word, minlength=len(n)) + 2
    out = np.zeros(int(size.sum()), np.int32)
    out[np.arange(len(c)) + 2 * word + 1] = c
    return out, np.repeat(np.arange(len(n)), size), size


def _grams(seq: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, number) of each run of GRAM characters."""
    n = len(seq) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    code = np.zeros(n, np.int64)
    for j in range(GRAM):
        code = code << BITS | seq[j : j + n]
    same = word[:n] == word[GRAM - 1 :]
    return word[:n][same], code[same]


def _norms(size: np.ndarray) -> np.ndarray:
    return np.sqrt(sum(DECAY ** (2 * sum(g)) * np.maximum(0, size - LENGTH - sum(g) + 1) for g in GAPS))


def _subsequences(seq: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, code, weight) of the subsequences, gap by gap."""
    for g in GAPS:
        span = LENGTH - 1 + sum(g)
        n = len(seq) - span
        if n <= 0:
            continue
        code, at = seq[:n].copy(), 0
        for gap in g:
            at += gap + 1
            code = code << BITS | seq[at : at + n]
        same = word[:n] == word[span:]
        yield word[:n][same], code[same], DECAY ** sum(g)


class Kernel:
    """Kernel of words with the landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        raw = b"".join(landmarks)
        ends = np.cumsum([len(w) for w in landmarks])
        seq, word, size = _sequences(np.frombuffer(raw, np.uint8), ends - [len(w) for w in landmarks], ends)
        parts = [(w, c, np.full(len(c), x)) for w, c, x in _subsequences(seq, word)]
        w, c, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
        codes, row = np.unique(c, return_inverse=True)
        self.codes = codes
        self.known = np.zeros(1 << (BITS * LENGTH), bool)
        self.known[codes] = True
        self.value = np.zeros((len(codes), len(landmarks)), np.float32)
        np.add.at(self.value, (row, w), (x / np.maximum(_norms(size), 1e-9)[w]).astype(np.float32))
        self.most = self.value.max(axis=1)

    def __reduce__(self) -> tuple:
        return Kernel, (self.landmarks,)

    def near(self, seq: np.ndarray, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that come near a landmark, and their kernel with each; 0 below NEAR."""
        norm, bound, parts = np.maximum(_norms(size), 1e-9), np.zeros(len(size)), []
        for w, c, x in _subsequences(seq, word):
            hit = self.known[c]
            w, row = w[hit], np.searchsorted(self.codes, c[hit])
            bound += np.bincount(w, self.most[row] * x, len(size))
            parts.append((w, row, x))
        passing = bound / norm >= NEAR
        words = np.flatnonzero(passing)
        k = np.zeros((len(words), len(self.landmarks)), np.float32)
        place = np.cumsum(passing) - 1
        for w, row, x in parts:
            kept = passing[w]
            w, row = place[w[kept]], row[kept]
            for s in range(0, len(w), 50_000):
                a = w[s : s + 50_000]
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                k[a[first]] += np.add.reduceat(self.value[row[s : s + 50_000]] * np.float32(x), first, axis=0)
        k = np.minimum(k / norm[words, None].astype(np.float32), 1)  # norms count every subsequence by itself, also equal ones
        k[k < NEAR] = 0
        some = k.any(axis=1)
        return words[some], k[some]


def _unique(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct word, and the distinct word of each place."""
    _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return first, back


def _sentences(w: Words) -> np.ndarray:
    """Number of each word's sentence; sentences end at a word's full stop, a line's or a document's end."""
    buf = np.frombuffer(w.raw, np.uint8)
    after = np.append(buf, 10)[w.ends]
    over = np.isin(buf[w.ends - 1], np.frombuffer(b".!?", np.uint8)) | (after == 10)
    new = np.concatenate([[False], over[:-1]])
    inner = w.ptr[1:-1]
    new[inner[inner < len(new)]] = True
    return np.cumsum(new)


def sentence_kernels(kernel: Kernel, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row of the chunk, kernel) of each sentence with a word near a landmark."""
    none = np.zeros(0, np.int64), np.zeros((0, len(kernel.landmarks)), np.float32)
    if not len(w.starts):
        return none
    first, back = _unique(w)
    near, k = kernel.near(*_sequences(w.buf, w.starts[first], w.ends[first]))
    if not len(near):
        return none
    at = np.full(len(first), -1)
    at[near] = np.arange(len(near))
    tokens = np.flatnonzero(at[back] >= 0)
    sentence = _sentences(w)[tokens]
    start = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    pooled = np.maximum.reduceat(k[at[back[tokens]]], start, axis=0)
    return np.searchsorted(w.ptr, tokens[start], "right") - 1, pooled


@dataclass
class Model:
    kernel: Kernel | None
    beta: np.ndarray
    bias: float
    curve: np.ndarray

    def margins(self, k: np.ndarray) -> np.ndarray:
        return k @ self.beta + self.bias

    def scores(self, w: Words) -> np.ndarray:
        rows = len(w.ptr) - 1
        if self.kernel is None:
            return np.zeros(rows)
        doc, k = sentence_kernels(self.kernel, w)
        return 1 / (1 + np.exp(-np.clip(_summary(doc, self.margins(k), rows, w.counts()) @ self.curve, -30, 30)))


def _summary(doc: np.ndarray, margin: np.ndarray, rows: int, words: np.ndarray) -> np.ndarray:
    """What a document's score is made of."""
    total = np.bincount(doc, np.clip(margin, 0, 2), rows)
    most = np.full(rows, -1.0)
    np.maximum.at(most, doc, np.clip(margin, -1, 2))
    return np.stack([np.ones(rows), np.log1p(total), np.minimum(total, 3), most, np.log1p(words) / 10], 1)


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge loss, by Newton's method."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(25):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + 2 * c * xa.T @ x[active], 2 * c * xa.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _telling(chunk_words: list[Words], toxic: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character sequences that far more toxic than clean documents hold, in order, and how sure that is."""
    held: tuple[list, list] = ([], [])
    for w, y in zip(chunk_words, toxic):
        seq, word, _ = _sequences(w.buf, w.starts, w.ends)
        g, code = _grams(seq, word)
        doc = np.searchsorted(w.ptr, g, "right") - 1
        key = np.unique(doc << (BITS * GRAM) | code)
        doc, code = key >> (BITS * GRAM), (key & ((1 << (BITS * GRAM)) - 1)).astype(np.int32)
        for label in (0, 1):
            held[label].append(code[y[doc] == label])
    codes, bad = np.unique(np.concatenate(held[1]), return_counts=True)
    often = bad >= max(2, min(5, n[1] // 20))
    codes, bad = codes[often], bad[often]
    clean = np.concatenate(held[0])
    place = np.searchsorted(codes, clean)
    place = place[(place < len(codes)) & (codes[np.minimum(place, len(codes) - 1)] == clean)] if len(codes) else place[:0]
    good = np.bincount(place, minlength=len(codes))
    pos, neg, both = bad / n[1], good / n[0], (bad + good) / n.sum()
    z = (pos - neg) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-12)
    some = (z >= 4) & (pos >= 4 * neg)
    return codes[some], z[some]


def _sure(code: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sequences are telling, and the number of each of these."""
    place = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
    hit = codes[place] == code if len(codes) else np.zeros(len(code), bool)
    return hit, place[hit]


def _picked(chunk_words: list[Words], toxic: list[np.ndarray], codes: np.ndarray, z: np.ndarray) -> list[bytes]:
    """Words of toxic documents that hold most of the telling sequences, none held by many before."""
    sure = z.copy()
    found: dict[bytes, int] = {}
    for w, y in zip(chunk_words, toxic):
        bad = np.flatnonzero(y[np.searchsorted(w.ptr, np.arange(len(w.starts)), "right") - 1] == 1)
        if not len(bad):
            continue
        seq, word, _ = _sequences(w.buf, w.starts[bad], w.ends[bad])
        g, code = _grams(seq, word)
        for i in np.unique(g[_sure(code, codes)[0]]).tolist():
            t = w.low[w.starts[bad[i]] : w.ends[bad[i]]].translate(None, _MARKS)
            found[t] = found.get(t, 0) + 1
    words = sorted(found, key=lambda t: (-found[t], t))
    if not words:
        return []
    ends = np.cumsum([len(t) for t in words])
    seq, word, size = _sequences(np.frombuffer(b"".join(words), np.uint8), ends - [len(t) for t in words], ends)
    g, code = _grams(seq, word)
    hit, code = _sure(code, codes)
    g = g[hit]
    often = np.log1p([found[t] for t in words])
    out: list[bytes] = []
    for _ in range(LANDMARKS):
        gain = np.bincount(g, sure[code], len(words)) / np.sqrt(size) * often
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        out.append(words[best])
        sure[code[g == best]] *= 0.3
        often[best] = 0
    return out


def _contrasts(kernel: Kernel, chunk_words: list[Words], toxic: list[np.ndarray]) -> list[bytes]:
    """The words near a landmark that most often stand in clean documents."""
    found: dict[bytes, int] = {}
    for w, y in zip(chunk_words, toxic):
        if not len(w.starts):
            continue
        first, back = _unique(w)
        near, _ = kernel.near(*_sequences(w.buf, w.starts[first], w.ends[first]))
        clean = y[np.searchsorted(w.ptr, np.arange(len(w.starts)), "right") - 1] == 0
        n = np.bincount(back[clean], minlength=len(first))
        for i in near[n[near] > 0].tolist():
            t = w.low[w.starts[first[i]] : w.ends[first[i]]].translate(None, _MARKS)
            found[t] = found.get(t, 0) + int(n[i])
    return sorted(found, key=lambda t: (-found[t], t))[:CONTRASTS]


def fit(texts: list[str] | pa.ChunkedArray, labels: list[int], prior: float | None = None) -> Model:
    """A model of texts and their labels; prior: share of toxic documents where the sample's isn't it."""
    y = np.array(labels, np.int64)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    empty = Model(None, np.zeros(0), 0.0, np.zeros(0))
    if not n.all():
        return empty
    chunk_words, toxic = [], []
    for i, j, raw, offs in chunks(strings(texts) if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.large_string())):
        chunk_words.append(Words(raw, offs, BLANK))
        toxic.append(y[i:j])
    codes, z = _telling(chunk_words, toxic, n)
    landmarks = _picked(chunk_words, toxic, codes, z)
    if not landmarks:
        return empty
    kernel = Kernel(landmarks)
    more = [t for t in _contrasts(kernel, chunk_words, toxic) if t not in landmarks]
    kernel = Kernel([*landmarks, *more]) if more else kernel

    docs, kernels, at = [], [], 0
    for w, part in zip(chunk_words, toxic):
        d, k = sentence_kernels(kernel, w)
        docs.append(d + at)
        kernels.append(k)
        at += len(part)
    doc, k = np.concatenate(docs), np.concatenate(kernels).astype(np.float64)
    ends = np.cumsum([len(t) for t in kernel.landmarks])
    seq = _sequences(np.frombuffer(b"".join(kernel.landmarks), np.uint8), ends - [len(t) for t in kernel.landmarks], ends)
    gram = np.zeros((len(kernel.landmarks),) * 2)
    near, own = kernel.near(*seq)
    gram[near] = own
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(np.where(value > 1e-3, 1 / np.sqrt(np.maximum(value, 1e-3)), 0)) @ vector.T
    features, sign = k @ root, np.where(y[doc] == 1, 1.0, -1.0)
    use = np.ones(len(doc), bool)
    beta, bias = np.zeros(k.shape[1]), -1.0
    for _ in range(4):
        weight = np.where(sign > 0, 1 / max(1, (use & (sign > 0)).sum()), 1 / max(1, (use & (sign < 0)).sum())) * use.sum() / 2
        w, bias = _machine(features[use], sign[use], weight[use])
        beta = root @ w
        margin = k @ beta + bias
        worst = np.full(len(y), -np.inf)
        np.maximum.at(worst, doc, margin)
        use = (sign < 0) | (margin > 0) | (margin == worst[doc])
    counts = np.concatenate([w.counts() for w in chunk_words])
    x = _summary(doc, k @ beta + bias, len(y), counts)
    share = n[1] / n.sum() if prior is None else prior
    weight = np.where(y == 1, share / n[1], (1 - share) / n[0]) * n.sum()
    return Model(kernel, beta, bias, _logistic(x, y.astype(float), weight))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_each: int = ROWS_EACH) -> Model:
    """Fit on a bounded sample of labelled documents outside fold 0."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y")).filter(fold(F.col(id_col)) != 0)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return fit([], [])
    drawn = None
    for label in (0, 1):
        part = known.filter(F.col("y") == label).orderBy(F.xxhash64(id_col), id_col).limit(rows_each)
        drawn = part if drawn is None else drawn.unionByName(part)
    ids = drawn.withColumnRenamed(id_col, "__id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(ids), F.col("id") == F.col("__id")).groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    share = n[1] / (n[0] + n[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            sample = pa.Table.from_batches(held).sort_by("id")
            yield pa.record_batch([pa.array([pickle.dumps(fit(sample.column("t"), sample.column("y").to_pylist(), share))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()  # the sample is bounded: one task fits it
    return pickle.loads(made[0]["model"]) if made else fit([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """(id, score) of every document, or all its columns and the score, in place of any of its name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != name] if keep else [id_col, text_col]
    at = columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = np.concatenate([sent.value.scores(Words(raw, offs, BLANK)) for _, _, raw, offs in chunks(batch.column(at))])
        own = batch.columns if keep else [batch.column(0)]
        yield pa.record_batch([*own, pa.array(scores)], names=[*(columns if keep else [id_col]), name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in (columns if keep else [id_col]))
    return scan(docs, columns, run, f"{kinds}, `{name}` double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
