"""Licence scans: Aho-Corasick finds tags and notices, a shunting-yard parser weighs expressions.

Words are compared lower-cased, whatever stands between them. Every place where a phrase's
words stand one after another counts. What follows an identifier tag up to the line's end, or to
the next tag on the line, is parsed as an expression of licences with AND, OR, WITH and brackets (WITH binds closest, then
AND, then OR; a slash between two names is an OR) and evaluated: OR takes the side that asks least of a user, AND the side that asks
most, WITH an exception asks one step less. A tag whose expression can't be parsed gives the
licences that it names up to where parsing breaks off, and the class `unknown`; a tag that nothing follows on its line names none.
A name is a licence if it is of a known family, begins with LicenseRef- or DocumentRef-, or an operator joins it to another; any other
word after a tag, such as `see` of `see LICENSE file`, is none, and the expression's class is `unknown`. Words such as `licensed under`,
which name no licence, raise the score and give no label.

Null texts are empty: no words, no labels, score 0. Each row gives one row, also where ids, null ones too, and texts are equal; other
columns play no part. The work is in proportion to a text's length.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import scan
from ._text import ALNUM, strings

#: Phrases of the base and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices: phrase, label, how sure it makes us.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.7),
    "gnu affero general public license": ("agpl", 0.7),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "bsd license": ("bsd", 0.6),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "boost software license": ("bsl", 0.7),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc0": ("cc0", 0.5),
    "creative commons": ("creative-commons", 0.4),
    "all rights reserved": ("all-rights-reserved", 0.4),
    "licensed under": (None, 0.3),
}
#: Families that are named in short after "licensed under", and their labels.
SHORT = {"mit": "mit", "apache": "apache", "gpl": "gpl", "gnu gpl": "gpl", "lgpl": "lgpl", "gnu lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "isc": "isc", "cc by": "cc-by", "cc0": "cc0"}
NOTICES |= {f"licensed under {the}{name}": (label, 0.5) for name, label in SHORT.items() for the in ("", "the ", "a ", "an ")}
_TAG = "spdx license identifier"
_BASE_SURE = 0.6

#: How much a licence asks of a user, by the start of its identifier.
ASKS = (
    ("agpl", 4), ("gpl", 3), ("cc-by-sa", 3), ("lgpl", 2), ("mpl", 2), ("epl", 2), ("cddl", 2), ("cc-by-nc", 6), ("cc-by-nd", 5),
    ("apache", 1), ("mit", 1), ("bsd", 1), ("isc", 1), ("zlib", 1), ("bsl", 1), ("cc-by", 1), ("cc0", 0), ("unlicense", 0), ("0bsd", 0),
)
#: Further families of identifiers.
KNOWN = frozenset(
    """aal afl apl apsl artistic blueoak bsd bzip2 cecill clartistic cpal cpl curl ecl efl elastic etalab eudatagrid eupl fdl ftl gfdl hpnd icu ijg ipl
    json latex libpng lppl ms-pl ms-rl mulanpsl naumen ncsa ngpl nosl ntp oclc odbl odc-by ofl ogl oldap openssl osl pddl php postgresql psf python
    qpl rpl rpsl ruby simpl sissl sleepycat spl sspl busl tcl unicode upl vim vsl w3c wtfpl x11 xnet zpl cc-pddc cc-by none noassertion""".split()
)
CLASSES = ("public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "no-derivatives", "non-commercial", "unknown")
_UNKNOWN = len(CLASSES) - 1

_GAP = rb"[^0-9A-Za-z\x80-\xff\r\n]"
_TAGGED = re.compile(rb"spdx%b+license%b+identifier(?:(?![(])%b)*" % (_GAP, _GAP, _GAP), re.I)
_LINE_END = re.compile(rb"[\r\n]")
_PART = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)|(?<=[A-Za-z0-9.+)])(/)(?=[A-Za-z0-9(])")
_BINDS = {"or": 1, "and": 2, "with": 3}


def asks(name: str) -> int:
    return next((n for start, n in ASKS if name.startswith(start)), _UNKNOWN)


def known(name: str) -> bool:
    """Whether a lower-cased word is an identifier by itself: a family's name, alone or before a version or variant, or a reference."""
    if name.startswith(("licenseref-", "documentref-")):
        return True
    return any(name.startswith(f) and re.fullmatch(r"(?:[-+.0-9]|v[0-9]).*|", name[len(f) :]) for f in (*(start for start, _ in ASKS), *KNOWN))


def read(expression: str) -> tuple[list[str], int | None]:
    """Licences named up to where parsing ends, sorted, and the class of the whole by shunting-yard; None if it isn't an expression.

    Words that follow a complete expression, such as the end of a comment, end it. A single word that is no identifier names nothing.
    """
    names, kind, joined = _read(expression)
    told = names if joined else [n for n in names if known(n)]
    return told, kind if told else None


def _read(expression: str) -> tuple[list[str], int | None, bool]:
    """As read(), with every name, and whether an operator stands between some."""
    values: list[tuple[int, str]] = []
    waiting: list[str] = []
    names: set[str] = set()

    def apply() -> None:
        op, (b, right), (a, left) = waiting.pop(), values.pop(), values.pop()
        values.append((min(a, b), "") if op == "or" else (max(a, b), "") if op == "and" else (max(0, a - 1), left))

    at, operand, joined = 0, True, False
    while m := _PART.match(expression, at):
        part = "or" if m[2] else m[1].lower()
        if operand:
            if part == "(":
                waiting.append(part)
            elif part == ")" or part in _BINDS:
                return sorted(names), None, joined
            else:
                exception = bool(waiting) and waiting[-1] == "with"
                values.append((0 if exception else asks(part), part))
                if not exception:
                    names.add(part)
                operand = False
        elif part in _BINDS:
            if part == "with" and not values[-1][1]:
                return sorted(names), None, joined  # an exception goes with one licence
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[part]:
                apply()
            waiting.append(part)
            operand = joined = True
        elif part == ")":
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                break
            waiting.pop()
            values[-1] = (values[-1][0], "")
        else:
            break
        at = m.end()
    if operand or "(" in waiting:
        return sorted(names), None, joined
    while waiting:
        apply()
    return sorted(names), values[0][0], joined


def parse(expression: str) -> tuple[list[str], int] | None:
    """As read(), None for what isn't an expression."""
    names, kind = read(expression)
    return None if kind is None else (names, kind)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, _TAG}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def _said(text: bytes) -> Iterator[bytes]:
    """What follows each tag."""
    tags = list(_TAGGED.finditer(text))
    for m, after in zip(tags, [*tags[1:], None]):
        end = after.start() if after else len(text)
        stop = _LINE_END.search(text, m.end(), end)
        yield text[m.end() : stop.start() if stop else end]


def find(text: bytes) -> dict:
    """What a text's bytes (UTF-8) hold."""
    low = text.translate(ALNUM).split()
    norm = f" {b' '.join(low).decode('latin-1')} "
    words, named, labels, doubt, tagged = [], [], set(), 1.0, False
    upto = counted = 0
    for end, phrase in _automaton().iter(norm):
        if phrase == _TAG:
            tagged = True
            continue
        counted, upto = counted + norm.count(" ", upto, end), end  # words before the blank at the phrase's end
        if phrase in BASE:
            words.append(counted - phrase.count(" ") - 1)
            named.append(BASE[phrase])
            doubt *= 1 - _BASE_SURE
        if phrase in NOTICES:
            labels |= {NOTICES[phrase][0]} - {None}
            doubt *= 1 - NOTICES[phrase][1]
    expressions = []
    for part in _said(text) if tagged else ():
        said = part.decode("utf-8", "replace")
        names, kind = read(said)
        labels |= {*names}
        expressions.append({"expression": said.strip(), "licenses": names, "class": CLASSES[_UNKNOWN if kind is None else kind]})
        doubt *= 0.05
    return {"n_words": len(low), "words": words, "named": named, "labels": sorted(labels), "expressions": expressions, "score": 1 - doubt}


_EXPRESSIONS = pa.list_(pa.struct([("expression", pa.string()), ("licenses", pa.list_(pa.string())), ("class", pa.string())]))
SCHEMA = "n_words bigint, places array<struct<word:bigint,label:string>>, labels array<string>, expressions array<struct<expression:string,licenses:array<string>,class:string>>, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, the base's places, further labels, parsed expressions, and a score.

    The score is the chance that some evidence holds, each kind of evidence taken as independent.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [find(t.as_py()) for t in strings(batch.column(1)).cast(pa.large_binary())]
        of = lambda k, kind: pa.array([f[k] for f in found], kind)
        starts = pa.array(np.cumsum([0, *(len(f["words"]) for f in found)]), pa.int32())
        each = pa.StructArray.from_arrays([pa.array(itertools.chain.from_iterable(f[k] for f in found), kind) for k, kind in (("words", pa.int64()), ("named", pa.string()))], ["word", "label"])
        yield pa.record_batch([
            batch.column(0), of("n_words", pa.int64()), pa.ListArray.from_arrays(starts, each), of("labels", pa.list_(pa.string())), of("expressions", _EXPRESSIONS), of("score", pa.float64()),
        ], names=[id_col, "n_words", "places", "labels", "expressions", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return scan(docs, [id_col, text_col], run, f"`{id_col}` {kind}, {SCHEMA}")


def report(found: DataFrame) -> DataFrame:
    """The digest of scan_licenses()."""
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    words = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.array_union(base, "labels")).alias("labels"), "score",
        F.to_json("expressions").alias("expressions"),
    )
