"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names.

Each long token is read in the smallest encoding whose alphabet holds it. A battery of three tests
looks at its symbols, and each test gives two p-values: one of uniform draws from the alphabet, one of text.

    chi-squared  counts of symbols against equal shares; counts of vowels, frequent, middling and rare consonants against text's
    runs         runs about the alphabet's middle; changes between small letters, capitals, digits and signs against one in five
    serial       lag-one correlation of symbols; that of vowels, which in text avoid each other

The three p-values of text, put together by Fisher's method (which takes them as independent), go through the step-up
procedure of Benjamini and Hochberg over all of a document's long tokens, each divided by a weight. The weight is in proportion
to the token's length, so that short tokens, which the tests hardly tell apart, need more evidence, and to the p-value of
uniform draws where that is below `TELLING` times the level at which they are rejected, so that tokens need more the less their symbols look drawn from their alphabet;
where uniform draws are rejected outright there is no finding. A token of digits alone is not told from a number.

Null texts are empty and hold nothing; each row is scanned on its own, also where ids or texts are equal or ids are null; other
columns play no part. The work is in proportion to a text's length, but for the sorting of its findings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import scan

#: Kinds of the base, in the order in which equal starts are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABETS = [
    (name, {c: i for i, c in enumerate(chars)}, re.compile(f"[{re.escape(chars)}]+"))
    for name, chars in (
        ("hex", _DIGITS + "abcdef"), ("hex", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"),
        ("base36", _DIGITS + _LOWER), ("base36", _DIGITS + _UPPER), ("base62", _UPPER + _LOWER + _DIGITS),
        ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    )
]
#: Letters of text per thousand, a to z; rare ones as often as in the language that has most of them.
_LETTERS = (82, 19, 31, 51, 147, 22, 30, 61, 76, 6, 14, 55, 30, 78, 75, 30, 9, 65, 73, 90, 42, 18, 19, 4, 10, 11)
#: Cells of letters, either case: vowels, frequent, middling and rare consonants.
_CELLS = {c: k for k, chars in enumerate(("aeiou", "nrstldh", "cmgpbf", "jkqvwxyz")) for c in chars + chars.upper()}
#: How often, in text, one symbol's class is not the next one's, and the correlation of vowels with the letter after.
_CHANGES, _VOWELS = 0.2, -0.25


#: Levels of rejection up to which the p-value of uniform draws makes a token weigh less in the step-up.
TELLING = 50

#: Text's shares of the cells.
_SHARES = tuple(sum(n for c, n in zip(_LOWER, _LETTERS) if _CELLS[c] == k) / sum(_LETTERS) for k in range(4))


def encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """Name and alphabet of the smallest encoding that holds the token."""
    return next(((name, at) for name, at, fits in _ALPHABETS if fits.fullmatch(token)), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(x: list[int], k: int) -> float:
    """p-value of uniform symbols, in bins that expect five or more each."""
    bins = min(k, max(2, len(x) // 5))
    wide, seen = [0] * bins, [0] * bins
    for v in range(k):
        wide[v * bins // k] += 1
    for v in x:
        seen[v * bins // k] += 1
    stat = sum((s - e) ** 2 / e for s, w in zip(seen, wide) for e in (len(x) * w / k,))
    df = bins - 1  # Wilson and Hilferty: the cube root is close to normal
    z = ((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(x: list[int], k: int) -> float:
    """p-value of the number of runs above and below the alphabet's middle."""
    up = [2 * v >= k for v in x]
    n, a = len(x), sum(up)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((1 + sum(p != q for p, q in zip(up, up[1:])) - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(x: list[int]) -> float:
    """p-value of the correlation of neighbouring symbols."""
    n, mean = len(x), sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x)
    if not var:
        return 0.0
    r = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / var
    return _two_sided((r + 1 / n) * math.sqrt(n))


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def text_cells(token: str) -> float | None:
    """Chi-squared p-value of text's shares of the cells; None with too few letters to tell."""
    seen = [0] * len(_SHARES)
    for c in token:
        if c in _CELLS:
            seen[_CELLS[c]] += 1
    n = sum(seen)
    if n < 5:
        return None
    x = sum((s - n * q) ** 2 / (n * q) for s, q in zip(seen, _SHARES))
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)  # three degrees of freedom


def text_changes(token: str) -> float:
    """Chance that text changes its class of symbols as often: an upper tail of the binomial distribution."""
    kinds = [_class(c) for c in token]
    n, x = len(kinds) - 1, sum(a != b for a, b in zip(kinds, kinds[1:]))
    if x <= n * _CHANGES:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(_CHANGES) + (n - x) * math.log1p(-_CHANGES))
    total, odds = 0.0, _CHANGES / (1 - _CHANGES)
    while x <= n and term > total * 1e-12:
        total += term
        term *= (n - x) / (x + 1) * odds
        x += 1
    return min(1.0, total)


def text_vowels(token: str) -> float | None:
    """Chance that vowels of text avoid each other as little, by the lag-one correlation within runs of letters; None with too few pairs."""
    pairs = [(_CELLS[a] == 0, _CELLS[b] == 0) for a, b in zip(token, token[1:]) if a in _CELLS and b in _CELLS]
    n = len(pairs)
    p, q = sum(a for a, _ in pairs), sum(b for _, b in pairs)
    spread = p * (n - p) * q * (n - q)
    if n < 8 or not spread:
        return None
    r = (n * sum(a and b for a, b in pairs) - p * q) / math.sqrt(spread)
    return 0.5 * math.erfc((r - _VOWELS) * math.sqrt(n / 2))


def fisher(p: list[float | None]) -> float:
    """One p-value for those that are there: minus twice the sum of their logarithms has two degrees of freedom for each."""
    there = [max(v, 1e-300) for v in p if v is not None]
    x = -sum(map(math.log, there))
    return min(1.0, math.exp(-x) * sum(x**k / math.factorial(k) for k in range(len(there))))


def battery(token: str) -> tuple[float, float] | None:
    """p-values of uniform draws from the token's alphabet, and of text; None without an encoding."""
    kind = encoding(token)
    if kind is None:
        return None
    x, k = [kind[1][c] for c in token], len(kind[1])
    return min(1.0, 3 * min(chi_squared(x, k), runs(x, k), serial(x))), fisher([text_cells(token), text_changes(token), text_vowels(token)])


def random_tokens(text: str, reject: float = 0.001, fdr: float = 0.01) -> list[tuple[int, int, float]]:
    """(start, end, p of text) of tokens that the battery finds to be random, under control of false findings."""
    found = []
    for m in _TOKEN.finditer(text):
        token = m[0].strip("=+/_-")
        if len(token) >= 16 and (p := battery(token)) is not None:
            at = m.start() + m[0].index(token)
            found.append((at, at + len(token), p[1], p[0]))
    if not found:
        return []
    mean = sum(e - s for s, e, _, _ in found) / len(found)
    weights = [(e - s) / mean * (min(1.0, max(uniform, 1e-12) / (TELLING * reject)) if reject else 1.0) for s, e, _, uniform in found]
    weighed = sorted((min(1.0, x[2] / w), i) for i, (x, w) in enumerate(zip(found, weights)))
    last = max((r for r, (p, _) in enumerate(weighed, 1) if p <= fdr * r / len(found)), default=0)
    return [(s, e, p) for i in sorted(i for _, i in weighed[:last]) for s, e, p, uniform in (found[i],) if uniform >= reject]


def find(text: str, reject: float = 0.001, fdr: float = 0.01) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, p) by start, then kind; random tokens only where no pattern has a span."""
    low = text.lower()  # only spares the search: a name's letters stay in any lower-casing
    named = any(name in low for name in ("pass", "secret", "token", "api"))
    out = [("assign", m.start(), m.end(), 0.0) for m in (_ASSIGN.finditer(text) if named else ()) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end(), 0.0) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), 0.0) for m in _HEX.finditer(text)]
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return sorted([*out, *(("random", *x) for x in _free(random_tokens(text, reject, fdr), out))], key=lambda x: (x[1], KINDS.index(x[0])))


def _free(spans: list[tuple[int, int, float]], taken: list[tuple[str, int, int, float]]) -> Iterator[tuple[int, int, float]]:
    """Spans that none of the taken ones overlaps; both sorted by start."""
    at, upto = 0, -1  # upto: largest end of the taken spans that start before the span's end
    for s, e, p in spans:
        while at < len(taken) and taken[at][1] < e:
            upto = max(upto, taken[at][2])
            at += 1
        if upto <= s:
            yield s, e, p


SCHEMA = "array<struct<kind:string,start:bigint,end:bigint,p:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """One row per document: its id and `secrets`, an array of spans in code points.

    Spans of one kind never overlap. Empty and null texts have an empty array.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[dict(zip(("kind", "start", "end", "p"), x)) for x in find(t.as_py() or "", reject, fdr)] for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(rows, _SPAN)], names=[id_col, "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return scan(docs, [id_col, text_col], run, f"`{id_col}` {kind}, secrets {SCHEMA}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span of a secret put as `mask`; null stays null."""

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for _, s, e, _ in find(t):
            if s >= at:
                out += [t[at:s], mask]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = batch.schema.get_field_index(text_col)
        yield batch.set_column(at, text_col, pa.array([clean(t.as_py()) for t in batch.column(at)], pa.string()))

    return docs.mapInArrow(lambda it: (x for b in it if b.num_rows for x in run(b)), docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest of scan_secrets()."""
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )
