"""Items of source files that only a parser or a scanner finds; a call a file, a hundred files at a time in Python, as an Arrow batch of long texts has no bound.

The scanners keep to what the data was made with, odd cases included: tests pin those.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.markdown import headings
from ..functions.text import indent, lines, module_docstring

PY_ITEM = "array<struct<kind:string,name:string,docstring:string,code:string>>"
JS_ITEM = "array<struct<kind:string,name:string,jsdoc:string,code:string>>"
SPAN = "array<struct<kind:string,content:string,line_start:int,line_end:int,name:string,title:string>>"
#: Stripped characters of a function or class that are worth a span.
MIN_SPAN = 400


class _Definitions(ast.NodeVisitor):
    """(depth, definition) of a tree, as they stand in the source. Only statements are visited: expressions hold no definitions, and may nest without limit."""

    def __init__(self) -> None:
        self.depth, self.found = 0, []

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.found.append((self.depth, node))
        self.depth += 1
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.stmt, ast.excepthandler, ast.match_case)):
                self.visit(child)
        self.depth -= 1


def python_items(text: str) -> list[dict]:
    """The module, if it has a docstring, then all functions and classes, level by level; none if it doesn't parse.

    Records are numbered in this order, so it is part of the result: nearer the root first, and as they stand within a depth.
    """
    seen = _Definitions()
    try:
        tree = ast.parse(text)
        seen.visit(tree)
        about = ast.get_docstring(tree)
    except Exception:  # whatever the parser can't stand is a file without items
        return []
    source = text.splitlines()

    def described(node: ast.AST, name: str | None, code: str) -> dict:
        return {"kind": type(node).__name__, "name": name, "docstring": (ast.get_docstring(node) or "").strip(), "code": code}

    module = [described(tree, None, text)] if about else []
    inside = sorted(seen.found, key=lambda x: x[0])  # stable: order within a depth stays
    return module + [described(n, n.name, "\n".join(source[n.lineno - 1 : n.end_lineno])) for _, n in inside]


#: What ends a documentation comment right before a function, and a function's head up to its parenthesis.
JS_DOCUMENTED = re.compile(r"\*/\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_$]+)\s*\(")
JS_HEAD = re.compile(r"function\s+[a-zA-Z0-9_$]+\s*\(")
_JS_BEFORE = ("async", "export")
_SPACES = re.compile(r"\s*")
_BRACE = re.compile(r"[{}]")


def _closings(text: str) -> dict[int, int]:
    """End of the block that each brace opens; strings and comments are not looked into, and blocks that nothing closes end with the text."""
    ends: dict[int, int] = {}
    waiting: list[int] = []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            waiting.append(m.start())
        elif waiting:
            ends[waiting.pop()] = m.end()
    return ends | dict.fromkeys(waiting, len(text))


def _documented(text: str) -> Iterator[tuple[int, str, str]]:
    """(place, name, comment) of functions right after a comment, which begins with the first opening that no such comment before holds."""
    at = 0
    for m in JS_DOCUMENTED.finditer(text):
        at = text.find("/**", at)  # what lies before it is never searched again
        if at < 0:
            return
        if at + 3 <= m.start():
            yield at, m[1], text[at + 3 : m.start()]
            at = m.end()


def _complete_heads(text: str) -> list[tuple[int, int, int]]:
    """(place of the word, start, brace) of heads whose parenthesis closes before a brace; a closing parenthesis is looked at once, however many heads wait for it."""
    found, close, brace = [], -1, None
    for m in JS_HEAD.finditer(text):
        if close < m.end():
            close = text.find(")", m.end())
            if close < 0:
                break
            after = _SPACES.match(text, close + 1).end()
            brace = after if text.startswith("{", after) else None
        if brace is not None:
            start = m.start()
            for word in _JS_BEFORE:
                blank = start
                while blank and text[blank - 1].isspace():
                    blank -= 1
                if blank < start and text.endswith(word, 0, blank):
                    start = blank - len(word)
            found.append((m.start(), start, brace))
    return found


def js_items(text: str) -> list[dict]:
    """Documented functions, each with the first complete head from its comment on; in one pass, but for what functions within others say again."""
    heads, ends = _complete_heads(text), _closings(text)
    words = [h[0] for h in heads]
    items = []
    for place, name, comment in _documented(text):
        n = bisect_left(words, place)
        if n < len(heads):
            _, start, brace = heads[n]
            items.append({"kind": "Function", "name": name, "jsdoc": comment.strip(), "code": text[start : ends[brace]]})
    return items


def block_ends(widths: list[int | None]) -> list[int]:
    """For each line, the last line of its block: those after it that are indented deeper, up to one that isn't. Blank lines, of width None, end none and belong to none at its end.

    One pass: lines wait until one comes that stands no deeper.
    """
    ends = list(range(len(widths)))
    waiting: list[int] = []
    last = -1  # the line before, blank ones aside
    for i, width in enumerate(widths):
        if width is None:
            continue
        while waiting and widths[waiting[-1]] >= width:
            ends[waiting.pop()] = last
        waiting.append(i)
        last = i
    for i in waiting:
        ends[i] = last
    return ends


#: How a definition's line starts, and what it has to hold.
_HEADS = {"function_definition": (re.compile(r"[ \t]*def "), "def ", "("), "class_definition": (re.compile(r"[ \t]*class "), "class ", ":")}


def _heads(source: list[str]) -> Iterator[tuple[int, str, str]]:
    """(line, kind, name) of lines that look like definitions."""
    for i, line in enumerate(source):
        for kind, (start, word, mark) in _HEADS.items():
            if start.match(line) and mark in line.strip():
                name = line.strip().partition("(")[0].replace(word, "")
                yield i, kind, (name if mark == "(" else name.rstrip(":")).strip()


def python_spans(source: list[str], widths: list[int], opening: str, file_name: str) -> list[dict]:
    """Functions and classes by their indentation, outermost first seen; what is inside one is not looked at again.

    source, widths: lines and their indentation; opening: the string that opens the file, of which each span quotes a part.
    """
    ends = block_ends([w if s.strip() else None for s, w in zip(source, widths)])
    lead = f"# File: {file_name}\n# Context: {opening[:300]}\n\n" if opening else ""
    spans, free = [], 0
    for i, kind, name in _heads(source):
        if i < free:
            continue
        free = ends[i] + 1
        body = "\n".join(source[i:free])
        if len(body.strip()) >= MIN_SPAN:
            spans.append({"kind": kind, "content": lead + body, "line_start": i + 1, "line_end": free, "name": name, "title": None})
    return spans


def markdown_spans(text: str) -> list[dict]:
    """Sections that a heading of the same or a higher rank ends, and always the last.

    So text between a heading and a deeper one right after it is left out, as is what stands before the first.
    """
    source, spans, depth = text.splitlines(), [], 0
    start, title = 1, "Document"

    def section(end: int) -> None:
        spans.append({"kind": "markdown_section", "content": "\n".join(source[start - 1 : end]).strip(), "line_start": start, "line_end": end, "name": None, "title": title})

    for line, level in headings(text):
        if depth and level <= depth:
            section(line)
        depth = min(depth, level - 1) + 1
        start, title = line + 1, source[line].lstrip("# ") if line < len(source) else ""
    section(len(source))
    return spans


def _called(fn: Callable[..., list[dict]], kind: str) -> Callable[..., Column]:
    return F.udf(lambda *args: None if args[0] is None else fn(*args), kind, useArrow=False)


def with_python_items(text: Column) -> Column:
    return _called(python_items, PY_ITEM)(text)


def with_js_items(text: Column) -> Column:
    return _called(js_items, JS_ITEM)(text)


def with_python_spans(text: Column, file_name: Column) -> Column:
    return _called(python_spans, SPAN)(lines(text), F.transform(lines(text), indent), module_docstring(text), file_name)


def with_markdown_spans(text: Column) -> Column:
    return _called(markdown_spans, SPAN)(text)
