"""Pages to element tables: an HTML tree builder inside Arrow batches, one row for each element.

The builder follows the public HTML rules for void elements, raw text, character references, implied html, head, body,
tbody and end tags, and for formatting elements that stay open across blocks. It leaves out foster parenting in tables
and the re-parenting of misnested formatting end tags. An element with a child template that has shadowrootmode gets a
shadow tree. Whether an element can be seen is read from its static markup.

Defined results: a null or empty page gives the three implied elements; repeated pages give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import StructField, StructType

from .markup import VOID, attributes, tokens

#: Tags that the scan looks at; besides, elements with an id or the role of a button or link.
CANDIDATE_TAGS = frozenset("a button input select textarea span div p li h1 h2 h3 h4 h5 h6".split())
CANDIDATE_ROLES = frozenset(("button", "link"))
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
_IN_HEAD = frozenset("base link meta title script style template noscript".split())
_SCOPE_ENDS = frozenset("html table td th caption template".split())
_IMPLIED = frozenset("dd dt li option optgroup p rb rp rt rtc".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNSEEN = frozenset("head script style template title meta link base noscript".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "shadow", "nid", "post", "depth", "scan", "scope", "visible", "kids", "up", "sib", "idx", "cnt", "after", "row")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.shadow: Element | None = None

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]


class _Builder:
    def __init__(self):
        self.root = Element("html", {}, None)
        self.head = self.body = None
        self.stack = [self.root]
        self.formatting: list[Element | None] = []  # None: a marker

    def push(self, tag: str, attrs: dict[str, str]) -> Element:
        at = self.stack[-1]
        e = Element(tag, attrs, at)
        at.children.append(e)
        self.stack.append(e)
        return e

    def in_head(self) -> Element:
        if self.head is None:
            self.head = self.push("head", {})
        return self.head

    def in_body(self) -> None:
        if self.body is None:
            self.in_head()
            del self.stack[1:]
            self.body = self.push("body", {})

    def has(self, tag: str, ends: frozenset[str] = _SCOPE_ENDS) -> bool:
        for e in reversed(self.stack):
            if e.tag == tag:
                return True
            if e.tag in ends:
                return False
        return False

    def pop_to(self, tag: str) -> None:
        while len(self.stack) > 2 and self.stack.pop().tag != tag:
            pass

    def close_p(self) -> None:
        if self.has("p", _SCOPE_ENDS | {"button"}):
            self.pop_to("p")

    def reopen(self) -> None:
        """Formatting elements that a block's end closed stand again inside of the next content."""
        i = len(self.formatting)
        while i and self.formatting[i - 1] is not None and self.formatting[i - 1] not in self.stack:
            i -= 1
        for j in range(i, len(self.formatting)):
            old = self.formatting[j]
            self.formatting[j] = self.push(old.tag, dict(old.attrs))

    def text(self, s: str) -> None:
        at = self.stack[-1]
        if at.tag in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"):
            at.children.append(s)
            return
        if self.body is None:
            if not s.strip(" \t\n\f\r"):
                if self.head is not None:
                    at.children.append(s)
                return
            self.in_body()
        if s.strip(" \t\n\f\r"):
            self.reopen()
        self.stack[-1].children.append(s)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if tag == "head":
            if self.head is None:
                self.in_head().attrs.update(attrs)
            return
        if tag == "body":
            self.in_body()
            self.body.attrs = attrs | self.body.attrs
            return
        if self.body is None and tag in _IN_HEAD:
            self.in_head()
        else:
            self.in_body()
            if tag in _CLOSES_P:
                self.close_p()
            if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
                self.stack.pop()
            if tag == "li":
                self._close_item(("li",), ("ul", "ol", "menu", "dir"))
            elif tag in ("dd", "dt"):
                self._close_item(("dd", "dt"), ("dl",))
            elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
                self.stack.pop()
            elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                self._table_part(tag)
            elif tag == "a":
                for e in list(self.formatting):
                    if e is not None and e.tag == "a":
                        self.end("a")
                        if e in self.formatting:
                            self.formatting.remove(e)
            if tag not in _CLOSES_P and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "script", "style", "template", "option", "optgroup"):
                self.reopen()
        e = self.push(tag, attrs)
        if tag in VOID or closed and tag in ("svg", "path", "circle", "rect", "use", "g"):
            self.stack.pop()
        elif tag in _FORMATTING:
            same = [x for x in self.formatting if x is not None and x.tag == tag and x.attrs == attrs]
            if len(same) >= 3:
                self.formatting.remove(same[0])
            self.formatting.append(e)
        elif tag in ("template", "td", "th", "caption"):
            self.formatting.append(None)

    def _close_item(self, tags: tuple[str, ...], lists: tuple[str, ...]) -> None:
        for e in reversed(self.stack):
            if e.tag in tags:
                self.pop_to(e.tag)
                return
            if e.tag in lists or e.tag in _SCOPE_ENDS or e.tag in ("article", "section", "main", "nav", "aside", "body"):
                return

    def _table_part(self, tag: str) -> None:
        over = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, ("tbody", "thead", "tfoot"))
        for e in reversed(self.stack):
            if e.tag in over:
                self.end(e.tag)
                break
            if e.tag == "table":
                break
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {}, False)
        if tag == "tr" and self.stack[-1].tag == "table":
            self.push("tbody", {})

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and self.body is None:
                del self.stack[1:]
            return
        if tag == "p" and self.body is not None and not self.has("p", _SCOPE_ENDS | {"button"}):
            self.push("p", {})
        if tag in _FORMATTING:
            e = next((x for x in reversed(self.formatting) if x is not None and x.tag == tag), None)
            if e is None:
                return
            self.formatting.remove(e)
            if e in self.stack:
                del self.stack[self.stack.index(e) :]
            return
        tags = _HEADINGS if tag in _HEADINGS else {tag}
        for e in reversed(self.stack[1:]):
            if e.tag in tags:
                self.pop_to(e.tag)
                if tag in ("template", "td", "th", "caption") and None in self.formatting:
                    del self.formatting[len(self.formatting) - 1 - self.formatting[::-1].index(None) :]
                return
            if e.tag in _SCOPE_ENDS:
                return


def build(source: str) -> Element:
    b = _Builder()
    for kind, tag, rest in tokens(source):
        if kind == "text":
            b.text(rest)
        elif kind == "start":
            b.start(tag, attributes(rest) if rest else {}, rest.rstrip().endswith("/"))
        else:
            b.end(tag)
    b.in_body()
    _shadows(b.root)
    return b.root


def _shadows(root: Element) -> None:
    """Templates with shadowrootmode become their parent's shadow tree; other templates' content is no part of the page."""
    todo = [root]
    while todo:
        e = todo.pop()
        for c in e.elements():
            if c.tag == "template":
                mode = c.attrs.get("shadowrootmode", "").lower()
                if mode in ("open", "closed") and e.shadow is None:
                    e.children.remove(c)
                    if mode == "open":
                        e.shadow = c
                        todo.append(c)
                else:
                    c.children = []
            else:
                todo.append(c)


def _hidden(e: Element) -> tuple[bool, str | None, str | None]:
    """Whether an element takes itself and all below out of sight, and its own visibility and pointer-events."""
    style = dict(re.findall(r"([\w-]+)\s*:\s*([\w-]+)", e.attrs["style"].lower())) if "style" in e.attrs else {}
    gone = e.tag in _UNSEEN or "hidden" in e.attrs or e.tag == "input" and e.attrs.get("type", "").lower() == "hidden" or style.get("display") == "none"
    return gone, style.get("visibility"), style.get("pointer-events")


def number(root: Element) -> list[Element]:
    """All elements in document order (a shadow tree behind its host's start), numbered, with their place in the scan.

    The scan takes elements from a queue and puts behind each its shadow tree, its first child and its next sibling.
    """
    out: list[Element] = []
    todo: list[tuple] = [(root, -1, 0, False, "visible", "auto")]
    while todo:
        e, scope, depth, gone, visibility, pointer = todo.pop()
        e.nid, e.scope, e.depth = len(out), scope, depth
        out.append(e)
        own, v, p = _hidden(e)
        gone, visibility, pointer = gone or own, v or visibility, p or pointer
        e.visible = not gone and visibility == "visible" and pointer != "none"
        e.kids = e.elements()
        if e.kids:
            todo += [(c, scope, depth + 1, gone, visibility, pointer) for c in reversed(e.kids)]
        if e.shadow:
            e.shadow.kids = e.shadow.elements()
            todo += [(c, e.nid, depth + 1, gone, visibility, pointer) for c in reversed(e.shadow.kids)]
    for e in reversed(out):  # the last of all below is the last below its last child
        last = e.kids or (e.shadow.kids if e.shadow else ())
        e.post = last[-1].post if last else e.nid
    following = {}
    for e in out:
        for own in (e.kids, e.shadow.kids) if e.shadow else (e.kids,):
            for x, y in zip(own, own[1:], strict=False):
                following[x.nid] = y
    queue, n = [root], 0
    for e in queue:
        e.scan = n
        n += 1
        if isinstance(e, _Later):
            queue += e.then
            continue
        if e.shadow and e.shadow.kids:  # a shadow root waits in the queue like an element: its first child comes a turn later
            queue.append(_Later(e.shadow.kids[:1]))
        queue += e.kids[:1]
        if e.nid in following:
            queue.append(following[e.nid])
    return out


class _Later:
    """A shadow root in the queue of the scan."""

    def __init__(self, then: list[Element]):
        self.then, self.scan = then, -1


def content(e: Element) -> str:
    """All text below an element, without shadow trees."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return "".join(out)


def short_content(e: Element, most: int = 60) -> str | None:
    """The same, or null if it has more characters, white space aside."""
    out, todo, n = [], [e], 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            n += sum(map(len, x.split()))
            if n > most:
                return None
        else:
            todo.extend(reversed(x.children))
    return "".join(out)


def _direct(e: Element) -> str | None:
    """The first text child that isn't blank."""
    return next((c for c in _joined(e.children) if isinstance(c, str) and c.strip(_JS_SPACE)), None) if len(e.children) > len(e.kids) else None


def _short(text: str | None) -> str | None:
    """Trimmed; of a text that is too long to be asked for only so much that this is seen."""
    return text and text.strip(_JS_SPACE)[:60]


_JS_SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _joined(children: list) -> list:
    """Neighbouring strings are one text node."""
    out: list = []
    for c in children:
        if isinstance(c, str) and out and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(c)
    return out


#: Texts of up to so many characters, white space aside, are given whole as head, of others so much of their begin.
HEAD = 200
_SEEN = re.compile(f"[^{_JS_SPACE}]")
_BLANKS = re.compile(r"[ \t\r\n]+")
_PLAIN = re.compile(r"(?: ?[^ \t\r\n]++)*+ ?")


def text_spans(root: Element) -> tuple[str, str, dict[int, tuple[int, int, int, int, int]]]:
    """The text of the page without shadow trees, the same with runs of white space as one blank, and for each element:
    where its text begins and ends, how many characters of it aren't white space, where it begins and ends in the other."""
    pieces: list[str] = []
    blanks: list[str] = []
    spans: dict[int, tuple[int, int, int, int, int]] = {}
    at = solid = norm = 0
    open_ = False  # whether the last character of the other text isn't a blank
    todo: list[str | Element | tuple] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            pieces.append(x)
            at += len(x)
            if _PLAIN.fullmatch(x):  # nothing to be made one blank
                solid += len(x) - x.count(" ")
            else:
                solid += len(x) - sum(map(x.count, " \t\r\n"))
                x = _BLANKS.sub(" ", x)
            x = x if open_ else x.removeprefix(" ")
            if x:
                blanks.append(x)
                norm += len(x)
                open_ = x[-1] != " "
        elif isinstance(x, tuple):
            nid, from_, solid_from, norm_from = x
            spans[nid] = (from_, at, solid - solid_from, norm_from, norm)
        elif x.children:
            todo.append((x.nid, at, solid, norm))
            todo += reversed(x.children)
        else:
            spans[x.nid] = (at, at, 0, norm, norm)
    return "".join(pieces), "".join(blanks), spans


def head_of(text: str, start: int, end: int, solid: int) -> str:
    if solid <= HEAD:
        return text[start:end]
    seen = _SEEN.search(text, start, end)
    return text[seen.start() : min(end, seen.start() + HEAD)] if seen else ""


_PAIRS = pa.map_(pa.string(), pa.string())
_NEAR = pa.struct([("tag", pa.string()), ("attrs", _PAIRS), ("nid", pa.int32()), ("tag_idx", pa.int32()), ("tag_cnt", pa.int32())])
KINDS = {
    "page_id": pa.int64(), "nid": pa.int32(), "parent": pa.int32(), "tag": pa.string(), "attrs": _PAIRS, "pre": pa.int32(), "post": pa.int32(), "depth": pa.int32(), "sib_idx": pa.int32(),
    "tag_idx": pa.int32(), "tag_cnt": pa.int32(), "after": pa.map_(pa.string(), pa.int32()), "scan_seq": pa.int32(), "scope": pa.int32(), "direct_text": pa.string(), "text": pa.string(), "brief": pa.string(), "n_child": pa.int32(),
    "visible": pa.bool_(), "up": pa.list_(_NEAR), "hosts": pa.list_(pa.struct([("tag", pa.string()), ("attrs", _PAIRS)])),
    "text_from": pa.int32(), "text_to": pa.int32(), "solid": pa.int32(), "page_text": pa.string(), "fresh": pa.int32(),
    "head": pa.string(), "norm_from": pa.int32(), "norm_to": pa.int32(), "page_norm": pa.string(),
}
_SPANS = frozenset(("text_from", "text_to", "solid", "page_text", "head", "norm_from", "norm_to", "page_norm"))
_ROWS = 5_000


class _Page:
    """A parsed page, its elements numbered and placed."""

    def __init__(self, page_id, source: str, ask: frozenset[str], before: str | None, scan: bool = False):
        self.page_id, self.root = page_id, build(source)
        self.found = number(self.root)
        self.fresh: dict[int, int] = {}
        if "fresh" in ask:
            from .diff import freshness  # which needs this module

            self.fresh = freshness(before, self.found)
        root = self.root
        root.up, root.sib, root.idx, root.cnt, root.after = None, 0, 1, 1, {}
        for e in self.found:
            for up, group in ((e, e.kids), (None, e.shadow.kids)) if e.shadow else ((e, e.kids),):
                seen: dict[str, int] = {}
                for i, c in enumerate(group):
                    seen[c.tag] = n = seen.get(c.tag, 0) + 1
                    c.up, c.sib, c.idx = up, i, n
                for c in group:
                    c.cnt = seen[c.tag]
        some = [e for e in self.found if e.tag in CANDIDATE_TAGS or "id" in e.attrs or e.attrs.get("role") in CANDIDATE_ROLES] if scan or ask & {"text", "brief"} else []
        self.wanted = {e.tag for e in some} | {"label"} if ask & {"text", "brief"} else set()
        if scan or "after" in ask:
            self._count_after({e.tag for e in some} if scan else None)
        self.rows, self.below = self.found, None  # the elements that become rows, and those that name what is above them, if not all do
        if scan:
            self.rows, self.below = self._askable(some), {e.nid for e in some}
        self.whole, self.blanks, self.spans = text_spans(root) if ask & _SPANS else ("", "", {})

    def _count_after(self, tags: set[str] | None) -> None:
        """How many siblings of each tag follow; tags: of which only."""
        for e in self.found:
            for group in (e.kids, e.shadow.kids) if e.shadow else (e.kids,):
                left: dict[str, int] = {}
                for c in reversed(group):
                    c.after = dict(left)
                    if tags is None or c.tag in tags:
                        left[c.tag] = left.get(c.tag, 0) + 1

    def _askable(self, candidates: list[Element]) -> list[Element]:
        """The elements that locators of candidates may name or have to tell from others: those of the tags of candidates, of
        the two elements above them, and of earlier siblings; with a name; hosts; and the first one, which has the page's texts."""
        tags = {e.tag for e in self.found if e.after}
        for e in candidates:
            tags.update(x.tag for x in (e, e.up, e.up and e.up.up) if x)
        return [e for e in self.found if e.tag in tags or "name" in e.attrs or e.shadow or e is self.root]

    def span(self, e: Element) -> tuple:
        """text_from, text_to, solid, norm_from, norm_to, head."""
        if e.nid in self.spans:
            from_, to, solid, norm_from, norm_to = self.spans[e.nid]
            return from_, to, solid, norm_from, norm_to, head_of(self.whole, from_, to, solid)
        own = content(e)  # in a shadow tree
        solid = len(own) - sum(map(own.count, " \t\r\n"))
        return None, None, solid, None, None, head_of(own, 0, len(own), solid)


def _maps(rows: list[dict], kind: pa.MapType) -> pa.Array:
    offsets = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
    return pa.MapArray.from_arrays(offsets, pa.array(chain.from_iterable(rows), kind.key_type), pa.array(chain.from_iterable(r.values() for r in rows), kind.item_type))


def _lists(rows: list[list[int]], of: pa.Array) -> pa.Array:
    """Lists of the values that stand at these places."""
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), of.take(pa.array(chain.from_iterable(rows), pa.int32())))


_SLOTS = {"nid": "nid", "tag": "tag", "pre": "nid", "post": "post", "depth": "depth", "sib_idx": "sib", "tag_idx": "idx", "tag_cnt": "cnt", "scan_seq": "scan", "scope": "scope", "visible": "visible"}
_NEAR_NAMES = frozenset(f.name for f in _NEAR)
_SPAN = ("text_from", "text_to", "solid", "norm_from", "norm_to", "head")


def _batches(pages: list[_Page], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The elements of some pages; maps and structs are made column by column, and those of other elements taken from their rows."""
    every = [(p, e) for p in pages for e in p.rows]
    for i, (_, e) in enumerate(every):
        e.row = i
    asked = {c: slot for c, slot in _SLOTS.items() if c in schema.names or {"up", "hosts"} & set(schema.names) and c in _NEAR_NAMES} | {"nid": "nid", "tag": "tag"}
    slots = {c: pa.array(values, KINDS[c]) for c, values in zip(asked, zip(*map(attrgetter(*asked.values()), (e for _, e in every)), strict=True), strict=True)}
    attrs = _maps([e.attrs for _, e in every], _PAIRS) if {"attrs", "up", "hosts"} & set(schema.names) else None
    near = pa.StructArray.from_arrays([attrs if f.name == "attrs" else slots[f.name] for f in _NEAR], fields=list(_NEAR)) if {"up", "hosts"} & set(schema.names) else None

    def hosts(p: _Page, e: Element) -> list[int]:
        out = []
        while e.scope >= 0:
            e = p.found[e.scope]
            out.append(e.row)
        return out[::-1]

    made = {
        "page_id": lambda p, e: p.page_id, "parent": lambda p, e: e.up.nid if e.up else None, "direct_text": lambda p, e: _direct(e) if p.below is None else _short(_direct(e)), "n_child": lambda p, e: len(e.kids), "fresh": lambda p, e: p.fresh.get(e.nid),
        "text": lambda p, e: content(e) if e.tag in p.wanted else None, "brief": lambda p, e: None if e.tag in p.wanted else short_content(e),
        "page_text": lambda p, e: p.whole if e is p.root else None, "page_norm": lambda p, e: p.blanks if e is p.root else None,
    }
    for at in range(0, len(every), _ROWS):
        rows = every[at : at + _ROWS]
        spans = dict(zip(_SPAN, zip(*(p.span(e) for p, e in rows), strict=True), strict=True)) if set(schema.names) & set(_SPAN) else {}
        out = []
        for c, kind in zip(schema.names, schema.types, strict=True):
            if c in _SLOTS:
                out.append(slots[c][at : at + _ROWS])
            elif c in spans:
                out.append(pa.array(spans[c], kind))
            elif c == "attrs":
                out.append(attrs[at : at + _ROWS])
            elif c == "after":
                out.append(_maps([e.after for _, e in rows], kind))
            elif c == "up":
                above = ([x.row for x in (e.up, e.up and e.up.up) if x] if p.below is None or e.nid in p.below else () for p, e in rows)
                out.append(_lists(list(above), near))
            elif c == "hosts":
                out.append(_lists([hosts(p, e) for p, e in rows], pa.StructArray.from_arrays([near.field("tag"), near.field("attrs")], names=["tag", "attrs"])))
            else:
                out.append(pa.array([made[c](p, e) for p, e in rows], kind))
        yield pa.RecordBatch.from_arrays([x if x.type == k else x.cast(k) for x, k in zip(out, schema.types, strict=True)], schema=schema)


def _rows(page_id, source: str, columns: tuple[str, ...] = tuple(KINDS), before: str | None = None) -> Iterator[dict]:
    """The elements of one page."""
    for batch in _batches([_Page(page_id, source, frozenset(columns), before)], pa.schema([(c, KINDS[c]) for c in columns])):
        yield from batch.to_pylist()


def nodes(pages: DataFrame, html: str = "html", columns: tuple[str, ...] | None = None, before: str | None = None, scan: bool = False) -> DataFrame:
    """The elements of pages (page_id, html), one row each; scope is -1 in the document, else the shadow host's nid.

    up: parent and grandparent; after: for each tag how many siblings
    of it follow; hosts: shadow hosts from the outermost in. text is there for tags that can be
    scanned; brief is the text of others, if it is short. page_text: the text of the whole page, on its first element only,
    in which text_from and text_to say where an element's text is; page_norm, norm_from and norm_to: the same with runs of
    white space as one blank; solid: how many characters of the text aren't white space; head: the text if that is HEAD at
    most, else the begin of what is seen of it, up to HEAD characters. So the rows of deep pages don't repeat long texts.
    before: the column with what the page was, null if it wasn't known; then fresh says what is new (see diff).
    columns: those that are needed, the others are not made. Page ids keep their type.
    scan: only what operators.strategies.locators can ask of a page, which gives the same locators: elements that they don't
    name are left out, after counts tags that can be scanned, up is there for elements that can be scanned, and direct_text
    is trimmed and has no more than 60 characters (texts of 50 and more are never asked for).
    """
    columns = tuple(c for c in KINDS if c == "page_id" or (c == "fresh" and before is not None) or (c != "fresh" and (columns is None or c in columns)))
    rows = pages.select("page_id", F.coalesce(html, F.lit("")).alias("html"), *([F.col(before).alias("before")] if before is not None else []))
    tasks = pages.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:  # a small table in one file would keep one core busy
        rows = rows.repartition(tasks)
    id_type = to_arrow_type(pages.schema["page_id"].dataType)
    schema = pa.schema([(c, id_type if c == "page_id" else KINDS[c]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[_Page] = []
        n = 0
        for batch in batches:
            was = batch.column(2).to_pylist() if before is not None else [None] * batch.num_rows
            for page_id, source, old in zip(batch.column(0), batch.column(1), was, strict=True):
                some.append(_Page(page_id.as_py(), source.as_py(), frozenset(columns), old, scan))
                n += len(some[-1].found)
                if n >= _ROWS:
                    yield from _batches(some, schema)
                    some, n = [], 0
        if some:
            yield from _batches(some, schema)

    return rows.mapInArrow(run, StructType([StructField("page_id", pages.schema["page_id"].dataType), *from_arrow_schema(schema).fields[1:]]))
