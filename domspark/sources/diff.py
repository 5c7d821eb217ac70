"""Which elements of a page are new, by comparing it with what it was.

Subtrees are known by digests of their tags, attributes, texts and children, made from the leaves up. From the root down,
the children of two elements that are held to be the same are paired: first those with equal digests, then those with the
same tag and id, then those with the same tag, each kind in order. Pairs with equal digests are unchanged and aren't looked
into; a child without a partner is new, with all below it. Changes of attributes and texts make nothing new.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from hashlib import blake2b

from .dom import Element, build, number

SAME, NEW, WHOLE = 0, 1, 2


def digests(elements: Iterable[Element]) -> dict[int, bytes]:
    """By nid; elements in document order."""
    out: dict[int, bytes] = {}
    for e in reversed(list(elements)):
        h = blake2b(repr((e.tag, sorted(e.attrs.items()))).encode(), digest_size=16)
        for of in (e, *((e.shadow,) if e.shadow else ())):
            h.update(b"\x00")
            for c in of.children:
                h.update(b"\x01" + c.encode("utf-8", "surrogatepass") + b"\x02" if isinstance(c, str) else out[c.nid])
        out[e.nid] = h.digest()
    return out


def _pairs(old: list[Element], new: list[Element], keys: tuple[Callable, ...]) -> tuple[list[tuple[Element, Element]], list[Element]]:
    found = []
    for key in keys:
        waiting = defaultdict(list)
        for e in reversed(old):
            waiting[key(e, True)].append(e)
        paired, rest = set(), []
        for e in new:
            k = key(e, False)
            if k is not None and waiting.get(k):
                o = waiting[k].pop()
                paired.add(id(o))
                found.append((o, e))
            else:
                rest.append(e)
        old, new = [e for e in old if id(e) not in paired], rest
    return found, new


def new_roots(before: Element, after: list[Element]) -> set[int]:
    """nids of the topmost new elements; after: the elements of a numbered page, before: the root of what it was."""
    old = number(before)
    old_digest, new_digest = digests(old), digests(after)
    digest = lambda e, was: (old_digest if was else new_digest)[e.nid]
    keys = (digest, lambda e, was: (e.tag, e.attrs["id"]) if e.attrs.get("id") else None, lambda e, was: e.tag)
    fresh: set[int] = set()
    todo = [(before, after[0])] if digest(before, True) != digest(after[0], False) else []
    while todo:
        o, n = todo.pop()
        trees = [(o.elements(), n.elements())]
        if n.shadow:
            trees.append((o.shadow.elements() if o.shadow else [], n.shadow.elements()))
        for own, now in trees:
            found, rest = _pairs(own, now, keys)
            fresh.update(e.nid for e in rest)
            todo += [(x, y) for x, y in found if digest(x, True) != digest(y, False)]
    return fresh


def freshness(before: str | None, after: list[Element]) -> dict[int, int]:
    """NEW for the topmost new elements, SAME for others; of a page that wasn't known all are WHOLE."""
    if before is None:
        return {e.nid: WHOLE for e in after}
    roots = new_roots(build(before), after)
    return {e.nid: NEW if e.nid in roots else SAME for e in after}
