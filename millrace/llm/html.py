"""HTML extraction: wrappers inferred host by host, then each page's article read with them.

A page becomes a stream of structural tags and texts, closed as browsers would. Pages of a host are
aligned one after another with the host's wrapper, a union-free expression over such streams (see
wrapper.py). Each task folds its own pages, then the tasks' wrappers of a host are aligned with each other in
the same way, in two rounds, so any number of pages of a host takes the memory of one wrapper.

Each page is matched with its host's wrapper by the same alignment, whether it marks its article or not.
Texts that match a template's are left out; what matches slots stays. A template's text is one that no page
has otherwise at its place of the wrapper, that an eighth of the host's pages have, and three pages among them whose main
texts are no near copies of each other (by a sketch of word shingles); of a repeated
element it is all texts in a row, the first, or the last. Pages that mark no article take as their main part what matches
the element that most such pages of the host have theirs in. A page's text is that of its main part, without
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers, and
template texts. Headings stay, also equal ones, and so do titles in an article's header. Within the main part an element goes
by its tag, its role, an attribute that hides it, a whole class such as `ad`, or the wrapper; ids, and words that are only a piece
of a class, help to find the main part and drop nothing in it.

Wrappers depend on the order of alignment: pages as they stand in a task's rows, then the tasks' wrappers sorted.

Null and empty pages have an empty text. Null urls, and urls without a host, have no wrapper: such pages are read on
their own. Each row gives one row, also where ids, urls and pages are equal; null ids stay null. No step recurses or
looks at all pairs, so pages of any depth and length are read.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, scan
from ._text import BLANK, Words, mix, windows
from .wrapper import GROUP, Part, Wrapper, matched, outline, read

#: Readers of hosts up to this size are broadcast; beyond, pages are joined with them.
BROADCAST_BYTES = 32 << 20
#: Parts of wrappers that a task holds before it hands them on.
_PARTS_HELD = 400_000
#: First-round tasks that a host's wrappers are dealt to.
_SPREAD = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>|([^<]++|<)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(f"</{t}[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed")}

#: Tags that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never main text.
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe svg math button select option textarea dialog menu head title object canvas audio video map search input datalist".split()
)
#: Words that mark what isn't main text: whole classes anywhere, pieces of class and id only outside the main part.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert"
    " alerts popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars aside widget widgets menu menus nav navbar navigation navigations breadcrumb"
    " breadcrumbs pagination pager footer foot footnav masthead topbar toolbar comment comments commentlist disqus replies reply respond share sharing social related recommended"
    " recommendations recirculation login search searchbox skip copyright disclaimer form hidden".split()
)
_READERS = frozenset(("comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "related", "recommended"))
#: Roles that say the same, and whole ids that pages give to their readers' comments.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_COMMENT_IDS = frozenset(("comments", "commentlist", "disqus_thread", "respond"))
_HEADER = frozenset(("header", "masthead", "pageheader", "topbar"))
_MAIN = ("article", "main", "articlebody", "content", "post", "entry", "story")
_CLOSED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_PARAGRAPHS = frozenset(("p", "pre", "blockquote"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Marks(NamedTuple):
    """What tag and attributes say: bad, dropped anywhere; named, by a whole class; hinted, by pieces of its names, which only count outside the main part."""

    bad: bool = False
    named: bool = False
    hinted: bool = False
    readers: bool = False
    head: bool = False


class Node:
    """An element. Of what is below it, measured(): size, characters of text; said, those in paragraphs that are seen; holds, whether an article, a main part or a title is."""

    __slots__ = ("tag", "words", "is_", "kids", "sig", "size", "said", "holds")

    def __init__(self, tag: str, words: frozenset[str], is_: Marks):
        self.tag, self.words, self.is_, self.kids = tag, words, is_, []
        self.sig = tag + ("." + ".".join(sorted(w for w in words if not w.isdigit())) if words else "")
        self.size = self.said = 0
        self.holds = False

    def seen(self) -> bool:
        """Not dropped: marks of an element that holds the main part, such as a layout named for its sidebar, can't mean all of it."""
        if not (self.is_.bad or self.is_.hinted) and self.tag != "header":
            return True
        return self.holds and self.tag not in DROPPED and not self.is_.readers


_NO_WORDS: frozenset[str] = frozenset()


def _described(tag: str, said: str) -> tuple[frozenset[str], Marks]:
    """Words of an element's class, id, role and itemprop, and what they say about its part in the page.

    A name that was made from a heading or holds a telling word among others says nothing within the main part.
    """
    if not said or said.isspace():
        return _NO_WORDS, _PLAIN.get(tag, _UNMARKED)
    words: set[str] = set()
    classes: frozenset[str] = frozenset()
    bad, own_id = tag in DROPPED, ""
    for m in _ATTRIBUTE.finditer(said):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            words |= {w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w}
        if name == "class":
            classes = frozenset(value.lower().split())
        elif name == "id":
            own_id = value.strip().lower()
        elif name == "role":
            bad |= tag not in _HEADINGS and not ROLES.isdisjoint(value.lower().split())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            bad = True
    outer = tag in ("html", "body", "article", "main")
    by_class = not _READERS.isdisjoint(classes) or own_id in _COMMENT_IDS
    readers = by_class if outer else by_class or not _READERS.isdisjoint(words)
    named = tag not in _HEADINGS and (by_class or not outer and not MARKS.isdisjoint(classes))
    hinted = readers or named or not outer and not MARKS.isdisjoint(words)
    return frozenset(words), Marks(bad, named, hinted, readers, tag == "header" or not _HEADER.isdisjoint(classes))


_UNMARKED = Marks()
_PLAIN = {t: Marks(bad=t in DROPPED, head=t == "header") for t in (*DROPPED, "header")}


class _Stack:
    """Open elements, and where those of each tag and the blocks stand."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def place(self, tag: str) -> int:
        """Of the innermost element of this tag; 0 if none is open."""
        return self.at[tag][-1] if self.at.get(tag) else 0


def parse(page: str) -> Node:
    """The tree of blocks, dropped elements and texts, measured; tags within a line leave no node."""
    root = Node("", _NO_WORDS, _UNMARKED)
    stack, at, end, last = _Stack(root), 0, len(page), page.rfind(">")
    while at < end:
        if at > last:  # no tag ends here
            stack.nodes[-1].kids.append(page[at:] if page[at] != "<" else "")
            break
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        top = stack.nodes[-1]
        if m[7] is not None:
            top.kids.append(m[7])
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            place = stack.place(tag)
            if place and (tag in BLOCKS or place > stack.blocks[-1]):
                stack.cut(place)
            elif not place and tag in BLOCKS:
                top.kids.append(Node("hr", _NO_WORDS, _UNMARKED))
            continue
        if tag == "br":
            top.kids.append(" ")
            continue
        raw = _RAW_END.get(tag)
        if raw:
            close = raw.search(page, at)
            at = close.end() if close else end
            continue
        if tag in ("html", "body") and stack.place(tag):
            continue
        words, marks = _described(tag, m[3] or m[6] or "")
        if tag not in BLOCKS and not (marks.bad or marks.hinted):
            continue
        if tag in BLOCKS:
            if top.tag == "p" or (tag in _HEADINGS and top.tag in _HEADINGS):
                stack.cut(len(stack.nodes) - 1)
            closed = _CLOSED_BY.get(tag, ())
            while stack.nodes[stack.blocks[-1]].tag in closed:
                stack.cut(stack.blocks[-1])
        if tag == "body" and stack.nodes[-1].tag == "head":
            stack.cut(len(stack.nodes) - 1)
        node = Node(tag, words, marks)
        stack.nodes[-1].kids.append(node)
        if tag not in VOID:
            stack.push(node)
    return _measured(root)


def _measured(root: Node) -> Node:
    order = list(_walk(root))
    for n in reversed(order):
        below = [k for k in n.kids if type(k) is not str]
        n.size = sum(len(k) for k in n.kids if type(k) is str and not k.isspace()) + sum(k.size for k in below)
        n.holds = any(k.holds or k.tag in ("article", "main", "h1") for k in below)
        n.said = n.size if n.tag in _PARAGRAPHS else sum(k.said for k in below if k.seen())
    return root


def _walk(node: Node, seen: bool = False) -> Iterator[Node]:
    """The element and those below, in page order; if asked for, only what is seen."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(k for k in reversed(n.kids) if type(k) is not str and (not seen or k.seen()))


def marked_root(root: Node) -> Node | None:
    """The element that the page itself marks as its article."""
    seen = [n for n in _walk(root, True) if n.size]
    for found in ([n for n in seen if n.tag == "article"], [n for n in seen if n.tag == "main" or "main" in n.words and n.tag != "body"], [n for n in seen if "articlebody" in n.words]):
        if found:
            return max(found, key=lambda n: n.size)
    return None


def likely_root(root: Node) -> Node:
    """The deepest element that holds most of the text in paragraphs, or one whose name says so."""
    best = max((n for n in _walk(root, True) if n.tag not in ("", "html", "body") and not n.words.isdisjoint(_MAIN)), key=lambda n: n.size, default=None)
    if best is not None and best.size:
        return best
    at = root
    while True:
        kids = [k for k in at.kids if type(k) is not str and k.seen()]
        total, most = sum(k.said for k in kids), max(kids, key=lambda k: k.said, default=at)
        if not total or most.said < 0.7 * total or most.tag in _PARAGRAPHS:
            return at
        at = most


def _text(node: Node) -> str:
    return " ".join(" ".join(k for n in _walk(node) for k in n.kids if type(k) is str).split())


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


_ODDS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _sketch(text: str) -> str:
    """Eight numbers of 16 bits, the least of as many hashes of the text's shingles of five words; near copies share most of them."""
    raw = text.encode("utf-8", "surrogatepass")
    h = Words(raw, np.array([0, len(raw)]), BLANK).hashes()
    g = windows(h, min(5, len(h))) if len(h) else np.zeros(1, np.uint64)
    return "".join(f"{int((g * odd).min()) >> 16 & 0xFFFF:04x}" for odd in _ODDS)


def _own(n: Node) -> str:
    return " ".join("".join(k for k in n.kids if type(k) is str).split())


def _said(members: list[Node]) -> list[str]:
    """Digests of the different texts that the elements hold themselves, in order, and of the first and the last."""
    texts = [t for t in map(_own, members) if t]
    if len(texts) < 2:
        return [_digest(texts[0])] * 3 if texts else ["", "", ""]
    return [_digest("\n".join(dict.fromkeys(texts))), _digest(texts[0]), _digest(texts[-1])]


def noted(root: Node) -> tuple[list[Part], bool]:
    """A page's outline with its facts, and whether its main part, where it has to be inferred, is all of it."""
    main = marked_root(root)
    inferred = likely_root(root) if main is None else None
    key = _sketch(_text(main or inferred))
    tree = outline(root)
    todo = list(tree)
    while todo:
        p = todo.pop()
        todo += p.kids
        if p.sig != GROUP:
            p.texts, p.votes, p.pages = _said(p.nodes), int(any(n is inferred for n in p.nodes)), 1
            p.keys = [key] if p.texts[0] else []
        p.nodes = None
    return tree, inferred is root


@lru_cache(256)
def _unpacked(reader: str) -> tuple[list[Part], bool]:
    return read(reader)


def read_with(root: Node, reader: str) -> tuple[Node | None, set[int]]:
    """The main part of a page that matches its host's wrapper there, and the elements (by id()) whose texts are the template's."""
    tree, whole = _unpacked(reader)
    mains, fixed = [root] if whole else [], set()
    for x, y in matched(tree, outline(root)):
        if x.sig == GROUP:
            continue
        if x.votes:
            mains += y.nodes
        if any(x.texts):
            same, telling = [a == b != "" for a, b in zip(x.texts, _said(y.nodes))], [n for n in y.nodes if _own(n)]
            for nodes, alike in ((telling, same[0]), (telling[:1], same[1]), (telling[-1:], same[2])):
                fixed |= {id(n) for n in nodes if alike}
    return max(mains, key=lambda n: n.size, default=None), fixed


def text_of(root: Node, reader: str | None = None) -> str:
    """The main text of a parsed page, read with its host's wrapper."""
    main, fixed = read_with(root, reader) if reader else (None, set())
    main = marked_root(root) or main or likely_root(root)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    todo: list[tuple] = [(main, False)]
    while todo:
        item = todo.pop()
        if type(item) is str:
            held.append(item)
            continue
        n, header = item
        if n is None:
            flush()
            continue
        if (n.is_.bad or n.is_.named) and n is not main:
            if n.tag in BLOCKS:
                flush()
            continue
        header = header or (n is not main and n.is_.head)
        block = n.tag in BLOCKS
        if block:
            flush()
            todo.append((None, False))
        keep = n.tag in _HEADINGS or not header and id(n) not in fixed
        for k in reversed(n.kids):
            if type(k) is not str:
                todo.append((k, header and n.tag not in _HEADINGS))
            elif keep:
                todo.append(k)
    flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str | None:
    """The host of a url; None where there is none."""
    try:
        return urlsplit(url or "").hostname or None
    except ValueError:
        return None


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one row per host, of all its pages."""
    schema = "host string, wrapper string"

    def out(held: dict[str, Wrapper]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(held), pa.array([w.packed() for w in held.values()])], names=["host", "wrapper"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        parts = since = 0
        for b in batches:
            for url, page in zip(b.column(0).to_pylist(), b.column(1)):
                host = host_of(url)
                if host is None:
                    continue
                tree, whole = noted(parse(page.as_py() or ""))
                w = held.setdefault(host, Wrapper())
                w.add(tree, whole)
                since += len(tree) + 1
                if since > _PARTS_HELD // 100:
                    parts, since = sum(x.size() for x in held.values()), 0
                if parts > _PARTS_HELD:
                    yield out(held)
                    held, parts = {}, 0
        if held:
            yield out(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, w) for b in batches for h, w in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()))
        for host, group in itertools.groupby(rows, key=lambda x: x[0]):
            w = Wrapper()
            for _, said in group:
                w.merge(Wrapper.unpacked(said))
            yield out({host: w})

    local = pages.select(url_col, html_col).mapInArrow(fold, schema)
    spread = local.withColumn("at", F.pmod(F.xxhash64("wrapper"), F.lit(_SPREAD))).select("host", "at", "wrapper")
    first = spread.repartition("host", "at").sortWithinPartitions("host", "wrapper").mapInArrow(meet, schema)
    return first.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(meet, schema)


def host_readers(found: DataFrame) -> DataFrame:
    """(host, reader) of each wrapper that changes how a page is read."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [(h, r) for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in (Wrapper.unpacked(w).reader(),) if r is not None]
        yield pa.record_batch([pa.array([h for h, _ in got], pa.string()), pa.array([r for _, r in got], pa.string())], names=["host", "reader"])

    return scan(found, ["host", "wrapper"], run, "host string, reader string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, url, text) of every page."""
    readers = durable(host_readers(wrappers(pages, url_col, html_col)))
    size = readers.agg(F.sum(F.length("host") + F.length("reader"))).first()[0] or 0
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string"
    names = [id_col, url_col, "text"]

    def read(page: pa.Scalar, reader: str | None) -> str:
        return text_of(parse(page.as_py() or ""), reader)

    if size <= broadcast_bytes:
        known = {r["host"]: r["reader"] for r in readers.collect()}
        sent = pages.sparkSession.sparkContext.broadcast(known)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [read(p, sent.value.get(host_of(u) or "")) for u, p in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=names)

        return scan(pages, [id_col, url_col, html_col], run, schema)

    def hosts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=[id_col, url_col, "html", "host"])

    named = scan(pages, [id_col, url_col, html_col], hosts, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, html string, host string")
    joined = named.join(readers, "host", "left")

    def run_joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(batch.column(2), batch.column(3).to_pylist())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([read(p, reader) for p, reader in rows], pa.string())], names=names)

    return scan(joined, [id_col, url_col, "html", "reader"], run_joined, schema)


def report(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
