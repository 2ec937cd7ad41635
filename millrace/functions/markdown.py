"""Headings of Markdown text by the rules of CommonMark: blocks only, line by line, in quotes and lists too."""

from __future__ import annotations

import re

_QUOTE = re.compile(r" {0,3}> ?")
_ATX = re.compile(r" {0,3}(#{1,6})(?: |$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+) *$")
_RULE = re.compile(r" {0,3}([-*_])(?: *\1){2,} *$")
_FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])( +|$)")
#: A link's definition on one line; such lines at a paragraph's start are no part of it.
_DEFINITION = re.compile(r""" {0,3}\[(?:[^\[\]\\]|\\.)+\]: *(?:<[^<>]*>|[^\s<]\S*)(?: +(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))? *$""")
#: Names of elements whose tags start a block of HTML.
_BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4"
    " h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_VALUE = r"""(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
#: How a block of HTML starts, and what ends it on the same or a later line (None: a blank line).
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_BLOCK_NAMES)})(?:\s|/?>|$)", re.I), None),
]
#: A line that is one whole tag starts a block of HTML as well, but doesn't break into a paragraph.
_HTML_TAG = re.compile(rf" {{0,3}}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*{_VALUE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")

_NONE, _TEXT, _CODE, _MARKUP = range(4)


class _Reader:
    """Open quotes and list items, and what stands open in the innermost: nothing, a paragraph, fenced code, or HTML."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int]] = []
        self.open: list[int] = []  # columns that an item's lines are indented by; 0 for a quote
        self.empty: list[bool] = []  # items that hold nothing yet
        self.leaf, self.end, self.lines, self.start = _NONE, None, [], 0

    def _continued(self, rest: str) -> tuple[int, str]:
        """How many of the open containers the line goes on with, and the line without their marks."""
        for n, width in enumerate(self.open):
            if not width:
                m = _QUOTE.match(rest)
                if m is None:
                    return n, rest
                rest = rest[m.end() :]
            elif not rest.strip():
                if self.empty[n]:
                    return n, rest
            elif rest[:width].strip():
                return n, rest
            else:
                rest = rest[width:]
        return len(self.open), rest

    def _cut(self, n: int) -> None:
        if n < len(self.open):
            del self.open[n:], self.empty[n:]
            self.leaf = _NONE

    def _html(self, rest: str, inside_text: bool) -> bool:
        for start, end in _HTML:
            if start.match(rest):
                if end is None or not end.search(rest):
                    self.leaf, self.end = _MARKUP, end
                else:
                    self.leaf = _NONE
                return True
        if not inside_text and _HTML_TAG.match(rest):
            self.leaf, self.end = _MARKUP, None
            return True
        return False

    def line(self, i: int, said: str) -> None:
        n, rest = self._continued(said.expandtabs(4))
        whole = n == len(self.open)
        if whole and self.leaf == _CODE:
            if re.fullmatch(rf" {{0,3}}{re.escape(self.end[0])}{{{len(self.end)},}} *", rest):
                self.leaf = _NONE
            return
        if whole and self.leaf == _MARKUP:
            if self.end.search(rest) if self.end else not rest.strip():
                self.leaf = _NONE
            return
        while True:
            inside_text = self.leaf == _TEXT and n == len(self.open)
            if not rest.strip():
                self._cut(n)
                self.leaf = _NONE
                return
            if rest.startswith("    "):
                if self.leaf != _TEXT:  # indented code
                    self._cut(n)
                    self._filled()
                    return
                break
            if m := _QUOTE.match(rest):
                self._into(n, 0)
                n, rest = n + 1, rest[m.end() :]
                continue
            if m := _ATX.match(rest):
                self._cut(n)
                self.found.append((i, len(m[1])))
            elif m := _FENCE.match(rest):
                self._cut(n)
                self._filled()
                self.leaf, self.end = _CODE, m[1] or m[2]
                return
            elif inside_text and (m := _UNDERLINE.match(rest)) and self._heading(1 if m[1][0] == "=" else 2):
                pass
            elif _RULE.match(rest):
                self._cut(n)
            elif (m := _ITEM.match(rest)) and not (inside_text and (m.end() == len(rest) and not m[4].strip() and not rest[m.end(2) :].strip() or m[3] and int(m[3]) != 1)):
                width = m.end() if len(m[4]) < 5 and rest[m.end() :] else m.end(2) + 1
                self._into(n, width)
                self.empty[-1] = not rest[m.end() :]
                n, rest = n + 1, rest[width:]
                if not rest.strip():
                    return
                continue
            else:
                opened = self.leaf, self.open[:]
                if self._html(rest, self.leaf == _TEXT):
                    leaf, self.leaf = self.leaf, opened[0]
                    self._cut(n)
                    self.leaf = leaf
                    self._filled()
                    return
                break
            self.leaf = _NONE
            self._filled()
            return
        if self.leaf == _TEXT:  # goes on, also without the marks of its containers
            self.lines.append(rest)
            return
        self._cut(n)
        self._filled()
        self.leaf, self.start, self.lines = _TEXT, i, [rest]

    def _into(self, n: int, width: int) -> None:
        self._cut(n)
        self._filled()
        self.open.append(width)
        self.empty.append(False)
        self.leaf = _NONE

    def _filled(self) -> None:
        if self.empty:
            self.empty[-1] = False

    def _heading(self, level: int) -> bool:
        """An underlined paragraph; definitions of links at its start aren't part of it, and alone are none."""
        while self.lines and _DEFINITION.match(self.lines[0]):
            del self.lines[0]
            self.start += 1
        if not self.lines:
            return False
        self.found.append((self.start, level))
        return True


def headings(text: str) -> list[tuple[int, int]]:
    """(line, level) of headings, lines counted from 0 by \\n."""
    reader = _Reader()
    for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        reader.line(i, line)
    return reader.found
