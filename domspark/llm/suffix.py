"""Deep-shallow sorting of many strings at once, and the prefixes that they share."""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey quicksort looks at, eight at a time, before blind tries take over.
SHALLOW = 32


class BlindTrie:
    """Strings by the first place where they differ; only one string is compared for each one inserted."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [len(strings[0]), {}, 0] if strings else [0, {}, 0]  # depth, children by byte, any string below

    def insert(self, i: int) -> None:
        s, path, node = self.strings[i], [], self.root
        while node[1]:
            path.append(node)
            down = node[1].get(s[node[0]]) if node[0] < len(s) else None
            if down is None:
                break
            node = down
        other = self.strings[node[2]]
        same = common(s, other)
        if same == len(s) == len(other):
            return
        # The place of the split is the first node on the path that is as deep as the common prefix.
        at = self.root
        parent = None
        while at[1] and at[0] < same:
            parent, at = at, at[1][s[at[0]]]
        if at[1] and at[0] == same:
            at[1][s[same]] = [len(s), {}, i]
            return
        split = [same, {self.strings[at[2]][same]: at, s[same]: [len(s), {}, i]}, at[2]]
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]]] = split

    def ordered(self) -> list[int]:
        """One string for each distinct one, in order."""
        out, todo = [], [self.root]
        while todo:
            depth, children, i = todo.pop()
            if children:
                todo += [children[b] for b in sorted(children, reverse=True)]
            else:
                out.append(i)
        return out


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def multikey_quicksort(keys: np.ndarray, words: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of keys within their groups by their first words, and numbers of the ties that are left.

    All segments are parted at once around a pivot of their own into less, equal and greater; equal rows go on with the
    next word, until a segment has one row or the words are used up.
    """
    order, segment = np.arange(len(keys)), np.unique(group, return_inverse=True)[1] if len(keys) else group.astype(np.int64)
    depth = np.zeros(int(segment.max(initial=-1)) + 1, np.int64)
    while True:
        size = np.bincount(segment, minlength=len(depth))
        active = (size > 1) & (depth < words)
        if not active.any():
            return order, segment
        at = np.flatnonzero(active[segment])
        own = segment[at]
        key = keys[order[at], depth[own]]
        first = np.cumsum(size) - size
        middle = first + size // 2
        pivot = np.zeros(len(depth), np.uint64)
        pivot[active] = keys[order[middle[active]], depth[active]]
        side = np.where(key < pivot[own], 0, np.where(key == pivot[own], 1, 2))
        part = np.full(len(order), 1)
        part[at] = side
        step = at[np.argsort(3 * own + side, kind="stable")]
        order[at], part[at] = order[step], part[step]
        both = 3 * segment + part
        edge = np.concatenate(([True], both[1:] != both[:-1]))
        parent, equal = segment[edge], part[edge] == 1
        depth = depth[parent] + (equal & active[parent])
        segment = np.cumsum(edge) - 1


def deep_shallow_sort(rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings within their groups, and how many first bytes each shares with the one before it.

    rows: a padded row of bytes for each string; size: their lengths; group: ascending. At the start of a group the
    shared length is -1.
    """
    n, width = rows.shape
    words = -(-min(width, SHALLOW) // 8)
    padded = np.zeros((n, max(1, -(-width // 8)) * 8), np.uint8)
    padded[:, :width] = rows
    order, tied = multikey_quicksort(padded.view(">u8").astype(np.uint64), words, group)
    # Deep: what is left shares a long prefix; a blind trie orders each such group.
    if width > SHALLOW and n:
        edge = np.flatnonzero(np.concatenate(([True], tied[1:] != tied[:-1], [True])))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a < 2:
                continue
            members = order[a:b]
            deep = rows[members, SHALLOW:]
            if (deep == deep[0]).all():
                continue
            strings = [d.tobytes() for d in deep]
            trie = BlindTrie(strings)
            for i in range(1, len(strings)):
                trie.insert(i)
            rank = {strings[i]: r for r, i in enumerate(trie.ordered())}
            place = np.fromiter((rank[s] for s in strings), np.int64, len(strings))
            order[a:b] = members[np.argsort(place, kind="stable")]
    # Equal rows: the shorter string first, since its padding isn't content.
    shared = np.zeros(max(0, n - 1), np.int64)
    if n > 1 and width:
        differs = rows[order[1:]] != rows[order[:-1]]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    block = np.cumsum(np.concatenate(([True], (shared < width) | (group[order[1:]] != group[order[:-1]])))[:n])
    order = order[np.lexsort((size[order], block))]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        lcp[1:] = np.minimum(shared, np.minimum(size[order[1:]], size[order[:-1]]))
        lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, lcp
