"""Wrappers of hosts: union-free expressions over the tag streams of their pages, inferred by alignment.

Two levels of siblings are aligned by pairing equal entries in order: the n-th of a kind on one side with the
n-th on the other, of these pairs a longest rising run, and what lies between in the same way; so a
level of n siblings costs about n log n. What is paired is merged and its children are aligned in turn, neighbours of
equal structure are merged to a repeated group, what one side lacks becomes optional, and texts that differ become
slots. Nothing recurses: levels wait in a list, so any depth will do.

Parts are counted by lossy counting: in steps of `STEP` pages those go that fewer than one page in `STEP` has, so a
wrapper's size follows that of a page, not the number of pages, and a part that more pages have always stays.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

#: Pages whose main texts differ that must share a text before it counts as the template's, and the share of the host's pages that must have it (one in so many).
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 8
#: Parts that fewer than one page in so many has are let go.
STEP = 64
GROUP = "("


class Part:
    """A tag with class names, or a group (GROUP) whose kids are its members; least 0: optional, most 2: repeated.

    more: lists of kids still to be aligned with `kids`, each with what its parts' and the others' `missed` rise by where
    the other side lacks them. nodes: of a page's outline, the elements themselves. Of a wrapper, texts: digests of what
    all elements, the first and the last of them say ("": nothing, None: a slot), keys: up to TEMPLATE_PAGES sketches of
    differing main texts of pages that have it, votes: pages whose main part it is, pages: pages that have it, missed:
    pages that may have had it before.
    """

    __slots__ = ("sig", "least", "most", "kids", "more", "raw", "nodes", "texts", "keys", "votes", "pages", "missed")

    def __init__(self, sig: str, least: int = 1, most: int = 1, kids: list[Part] | None = None, nodes: list | None = None, raw: bool = False):
        self.sig, self.least, self.most, self.kids, self.more, self.raw, self.nodes = sig, least, most, kids or [], [], raw, nodes
        self.texts, self.keys, self.votes, self.pages, self.missed = ["", "", ""], [], 0, 0, 0

    def name(self) -> str:
        return self.sig if self.sig != GROUP else "(" + " ".join(k.name() for k in self.kids) + ")"

    def facts(self) -> list:
        return [self.texts, self.keys, self.votes, self.pages, self.missed]


def differ(a: str, b: str) -> bool:
    """Whether fewer than six of two sketches' eight numbers agree; of near copies (0.8 alike) six or more do, as a rule."""
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 32, 4)) < 6


def _met(a: Part, b: Part, up_b: int = 0, up_a: int = 0) -> None:
    """b becomes part of a."""
    a.least, a.most = min(a.least, b.least), max(a.most, b.most)
    if a.sig == GROUP:
        for x, y in zip(a.kids, b.kids):
            _met(x, y, up_b, up_a)
        return
    if a.kids or a.more or b.kids or b.more:
        a.more.append((b.kids, up_b, up_a))
        a.more += b.more
    a.raw = a.raw or b.raw
    if a.nodes is not None:
        a.nodes += b.nodes or []
        return
    a.texts = [x if y in ("", x) else y if x == "" else None for x, y in zip(a.texts, b.texts)]
    if not any(a.texts):
        a.keys = []
    else:
        for k in b.keys:
            if len(a.keys) < TEMPLATE_PAGES and all(differ(k, x) for x in a.keys):
                a.keys.append(k)
    a.votes, a.pages, a.missed = a.votes + b.votes, a.pages + b.pages, a.missed + b.missed


def _folded(parts: list[Part]) -> list[Part]:
    """Repeats of one to three neighbours become repeated parts."""
    for period in (1, 2, 3):
        if len(parts) < 2 * period and not (period > 1 and any(p.sig == GROUP for p in parts)):
            break
        out: list[Part] = []
        names: list[str] = []
        for part in parts:
            out.append(part)
            names.append(part.name())
            while len(out) >= 2 * period and names[-period:] == names[-2 * period : -period]:
                old, new = out[-2 * period : -period], out[-period:]
                for x, y in zip(old, new):
                    _met(x, y)
                del out[-period:], names[-period:]
                if period == 1:
                    old[0].most = 2
                else:
                    del out[-period:], names[-period:]
                    out.append(Part(GROUP, 1, 2, old))
                    names.append(out[-1].name())
                    break
            if period > 1 and len(out) > period and out[-1 - period].sig == GROUP and names[-1 - period] == "(" + " ".join(names[-period:]) + ")":
                for x, y in zip(out[-1 - period].kids, out[-period:]):
                    _met(x, y)
                out[-1 - period].most = 2
                del out[-period:], names[-period:]
        parts = out
    return parts


def _grouped(parts: list[Part], like: list[Part]) -> list[Part]:
    """Neighbours that stand as a group on the other side become one."""
    wanted = {tuple(k.name() for k in g.kids) for g in like if g.sig == GROUP}
    if not wanted:
        return parts
    sizes, names, out, i = sorted({len(w) for w in wanted}, reverse=True), [p.name() for p in parts], [], 0
    while i < len(parts):
        n = next((n for n in sizes if tuple(names[i : i + n]) in wanted), 0)
        out.append(Part(GROUP, 1, 1, parts[i : i + n]) if n else parts[i])
        i += n or 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs whose second numbers rise."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for at, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k : k + 1], last[k : k + 1] = [j], [at]
        before.append(last[k - 1] if k else -1)
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal entries, rising on both sides."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        places: dict[str, list[int]] = defaultdict(list)
        for y in range(j_end - 1, j - 1, -1):
            places[b[y]].append(y)
        run = _rising([(x, places[a[x]].pop()) for x in range(i, i_end) if places.get(a[x])])
        found += run
        for x, y in [*run, (i_end, j_end)] if run else ():
            if i < x and j < y:
                todo.append((i, x, j, y))
            i, j = x + 1, y + 1
    return sorted(found)


def _missed(parts: list[Part], by: int) -> None:
    todo = list(parts) if by else []
    while todo:
        p = todo.pop()
        p.missed += by
        todo += p.kids


def _level(a: list[Part], b: list[Part], up_b: int = 0, up_a: int = 0) -> list[Part]:
    """One level over both: what is paired merged, the rest optional; children are left in `more`."""
    a, b = _grouped(a, b), _grouped(b, a)
    pairs = common([x.name() for x in a], [x.name() for x in b])
    out: list[Part] = []
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        for alone, by in ((a[i:x], up_a), (b[j:y], up_b)):
            _missed(alone, by)
            for p in alone:
                p.least = 0
            out += alone
        if x < len(a):
            _met(a[x], b[y], up_b, up_a)
            out.append(a[x])
        i, j = x + 1, y + 1
    return _folded(out) if len(pairs) < max(len(a), len(b)) else out


def _settled(top: list[Part]) -> list[Part]:
    """The levels below, folded and aligned one after another."""
    todo = [top]
    while todo:
        for p in todo.pop():
            if p.sig == GROUP:
                todo.append(p.kids)
            elif p.more or p.raw:
                now = _folded(p.kids) if p.raw else p.kids
                for kids, up_b, up_a in p.more:
                    now = _level(now, _folded(kids) if p.raw else kids, up_b, up_a)
                p.kids, p.more, p.raw = now, [], False
                if now:
                    todo.append(now)
    return top


def outline(root) -> list[Part]:
    """A page's elements, repeats folded; each part holds its elements."""
    made: dict[int, list[Part]] = {}
    todo, order = [root], []
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(k for k in n.kids if type(k) is not str)
    for n in reversed(order):
        made[id(n)] = [Part(k.sig, 1, 1, made.pop(id(k)), [k], True) for k in n.kids if type(k) is not str]
    return _settled(_folded(made[id(root)]))


def aligned(a: list[Part], b: list[Part], pages_a: int = 0, pages_b: int = 0) -> list[Part]:
    """The expression over both, made of the parts of either."""
    return _settled(_level(a, b, pages_a // STEP, pages_b // STEP))


def matched(wrapper: list[Part], page: list[Part]) -> Iterator[tuple[Part, Part]]:
    """Parts of a wrapper, and the part of a page's outline that each is aligned with."""
    todo = [(wrapper, page)]
    while todo:
        a, b = todo.pop()
        a, b = _grouped(a, b), _grouped(b, a)
        for i, j in common([x.name() for x in a], [x.name() for x in b]):
            yield a[i], b[j]
            if a[i].kids and b[j].kids:
                todo.append((a[i].kids, b[j].kids))


def _rows(tree: list[Part]) -> Iterator[tuple[int, Part]]:
    """(depth, part) in order."""
    todo = [(0, p) for p in reversed(tree)]
    while todo:
        depth, p = todo.pop()
        yield depth, p
        todo.extend((depth + 1, k) for k in reversed(p.kids))


def _tree(rows: list[list]) -> list[Part]:
    """Parts of rows (depth, sig, least, most, facts)."""
    levels: list[list[Part]] = [[]]
    for depth, sig, least, most, *facts in rows:
        p = Part(sig, least, most)
        if facts:
            p.texts, p.keys, p.votes, p.pages, p.missed = facts
        del levels[depth + 1 :]
        levels[depth].append(p)
        levels.append(p.kids)
    return levels[0]


class Wrapper:
    """What is known of a host: its expression with texts and votes for the main part, and its pages."""

    def __init__(self) -> None:
        self.tree: list[Part] | None = None
        self.whole = 0  # pages whose main part is all of them
        self.pages = 0

    def add(self, page: list[Part], whole: bool) -> None:
        """A page's outline with its facts (see html.noted)."""
        self._meet(page, 1)
        self.whole += whole
        if self.pages % STEP == 0:
            self._prune()

    def _meet(self, tree: list[Part], pages: int) -> None:
        self.tree = tree if self.tree is None else aligned(self.tree, tree, self.pages, pages)
        self.pages += pages

    def merge(self, other: Wrapper) -> None:
        self.whole += other.whole
        if other.tree is not None:
            self._meet(other.tree, other.pages)
            self._prune()

    def _prune(self) -> None:
        least = self.pages // STEP
        stays = lambda p: any(map(stays, p.kids)) if p.sig == GROUP else p.pages + p.missed > least
        if not least or self.tree is None:
            return
        top = Part("", kids=self.tree)
        todo = [top]
        while todo:
            p = todo.pop()
            if p.sig != GROUP:  # a group goes whole or not at all
                p.kids = [k for k in p.kids if stays(k)]
            todo += p.kids
        self.tree = top.kids

    def size(self) -> int:
        return sum(1 for _ in _rows(self.tree or []))

    def packed(self) -> str:
        rows = [[d, p.sig, p.least, p.most, *([] if p.sig == GROUP else p.facts())] for d, p in _rows(self.tree or [])]
        return json.dumps([rows, self.whole, self.pages])

    @staticmethod
    def unpacked(said: str) -> Wrapper:
        w = Wrapper()
        rows, w.whole, w.pages = json.loads(said)
        w.tree = _tree(rows)
        return w

    def expression(self) -> str:
        """The wrapper as an expression: (x)? optional, (x)+ repeated, #slot or "text" where an element has text."""
        out: list[str] = []
        open_: list[tuple[int, str]] = []
        for depth, p in [*_rows(self.tree or []), (0, None)]:
            while open_ and open_[-1][0] >= depth:
                out.append(open_.pop()[1])
            if p is None:
                break
            mark = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[p.least, p.most]
            text = {"": "", None: "#slot"}.get(p.texts[0], '"text"')
            out.append("(" * bool(mark) + (f"<{p.sig}>{text}" if p.sig != GROUP else ""))
            open_.append((depth, ("</>" if p.sig != GROUP else "") + (f"){mark}" if mark else "")))
        return "".join(out)

    def reader(self) -> str | None:
        """What pages are read with: the levels that lead to template texts or the main part; None without any."""
        rows = list(_rows(self.tree or []))
        voted = max((p for _, p in rows if p.sig != GROUP), key=lambda p: p.votes, default=None)
        if voted is not None and voted.votes < max(1, self.whole):
            voted = None
        fixed = {id(p) for _, p in rows if p.sig != GROUP and any(p.texts) and len(p.keys) >= TEMPLATE_PAGES and p.pages * TEMPLATE_SHARE >= self.pages}
        above: list[int] = []  # numbers of the rows that lead to this one
        parent, leads = [-1] * len(rows), [False] * len(rows)
        for i, (depth, p) in enumerate(rows):
            del above[depth:]
            parent[i] = above[-1] if above else -1
            above.append(i)
        some = False
        for i in range(len(rows) - 1, -1, -1):
            if leads[i] or id(rows[i][1]) in fixed or rows[i][1] is voted:
                some = True
                if parent[i] >= 0:
                    leads[parent[i]] = True
        whole = voted is None and self.whole > 0
        if not some:
            return json.dumps([[], whole]) if whole else None
        kept: list[list] = []
        keep = [False] * len(rows)
        for i, (depth, p) in enumerate(rows):
            up = parent[i]
            keep[i] = up < 0 or keep[up] and (leads[up] or rows[up][1].sig == GROUP)
            if keep[i]:
                kept.append([depth, p.sig, p.least, p.most, p.texts if id(p) in fixed else ["", "", ""], [], int(p is voted), 0, 0])
        return json.dumps([kept, whole])


def read(reader: str) -> tuple[list[Part], bool]:
    """The parts of reader(), and whether the main part is all of a page."""
    rows, whole = json.loads(reader)
    return _tree(rows), whole
