"""Byte-pair encoding by a deterministic automaton, compiled from the merges.

The automaton starts as one state with a loop for each byte. Each merge (u, v) -> w, in order, applies a gadget: the
state that u's arcs lead to is split, the copy loses its arc v, u's arcs go to the copy, and each state with an arc u
gets an arc w to where v led. In the end each byte string has exactly one path, its BPE encoding.

The states that merge number k takes the arc v from are those behind u and behind tokens that got u's arcs later; the
tokens that go with v are those that began with it later. With tokens put in order by their right parts, and again by
their left parts, both are runs. So a gadget is two runs, the bounds of all gadgets' first runs part the tokens into
states, and the table holds for each state the runs of arcs that it lacks. A word is encoded by one pass: the last arc of
the path to each place is the longest one for which the state at its begin has an arc; there is always exactly one.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces, small_batches, whole_text

#: How the vocabulary's authors split text into words before merging; fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Automaton:
    """label: of each arc; arc: by label; state: behind each token; lacks: bounds of the runs of arcs that a state lacks."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.label = {i: b for b, i in vocabulary.items()}
        self.special = dict(special or {})
        self.label |= {i: s.encode() for s, i in self.special.items()}
        self.arc = {b: i for b, i in vocabulary.items() if len(b) == 1}
        parts: dict[int, tuple[int, int, int]] = {}
        time: dict[tuple[int, int], int] = {}
        for k, (left, right) in enumerate(merges):
            u, v = self.arc.get(left), self.arc.get(right)
            # A merge whose pair no path holds side by side never applies: no split, no arcs.
            if u is None or v is None or not _side_by_side(parts, time, u, v):
                continue
            if left + right in self.arc:
                raise ValueError(f"two merges make {left + right!r}")
            w = vocabulary[left + right]
            self.arc[left + right] = w
            parts[w] = (u, v, k)
            time[u, v] = k
        self._compile(parts)
        # How long the arcs are that end with four given bytes, longest first; shorter arcs are looked up as they are.
        lengths: dict[bytes, set[int]] = {}
        for b in self.arc:
            if len(b) >= 4:
                lengths.setdefault(b[-4:], set()).add(len(b))
        self.lengths = {b: (*sorted(x, reverse=True), 3, 2, 1) for b, x in lengths.items()}

    def _compile(self, parts: dict[int, tuple[int, int, int]]) -> None:
        tokens = [*self.arc.values()]
        by_right, right = _ordered(tokens, parts, 1)
        by_left, left = _ordered(tokens, parts, 0)
        # The gadget of each merge: the run of tokens whose states lose arcs, and the run of these arcs. Of three equal
        # tokens the first two merge: at the time of (c, c) an arc cc is held back, one behind cc isn't.
        gadgets = np.array([(right(u, k + 1), by_right[u] + 1, left(v, k), by_left[v] + 1) for u, v, k in parts.values()], np.int64).reshape(-1, 4)
        bounds = np.unique(np.append(gadgets[:, :2], 0))
        place = np.array([by_right[t] for t in tokens])
        self.state = dict(zip(tokens, (np.searchsorted(bounds, place, "right") - 1).tolist(), strict=True))
        self.place = by_left
        first, last = np.searchsorted(bounds, gadgets[:, 0]), np.searchsorted(bounds, gadgets[:, 1])
        of = np.repeat(np.arange(len(gadgets)), last - first)
        state = np.arange(len(of)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[of]
        order = np.lexsort((gadgets[of, 2], state))
        self.lacks = [array("i") for _ in bounds]
        for z, a, b in zip(state[order].tolist(), gadgets[of[order], 2].tolist(), gadgets[of[order], 3].tolist(), strict=True):
            runs = self.lacks[z]
            if runs and a <= runs[-1]:
                runs[-1] = max(runs[-1], b)
            else:
                runs.extend((a, b))

    def has(self, u: int, t: int) -> bool:
        """Whether the state behind token u has an arc t."""
        return not bisect_right(self.lacks[self.state[u]], self.place[t]) & 1

    def encode(self, word: bytes) -> list[int]:
        """The labels' ids on the one path that spells word."""
        n, arc, lengths = len(word), self.arc.get, self.lengths.get
        whole = arc(word)
        if whole is not None:
            return [whole]
        lacks, state, place = self.lacks, self.state, self.place
        last, sizes = [0] * (n + 1), [0] * (n + 1)
        behind = [0] * (n + 1)  # the state at each place
        for end in range(1, n + 1):
            for size in lengths(word[max(0, end - 4) : end], (3, 2, 1)):
                if size > end:
                    continue
                t = arc(word[end - size : end])
                if t is not None and (size == end or not bisect_right(lacks[behind[end - size]], place[t]) & 1):
                    last[end], sizes[end], behind[end] = t, size, state[t]
                    break
            else:
                raise ValueError("a byte has no arc")
        path = []
        while n:
            path.append(last[n])
            n -= sizes[n]
        return path[::-1]

    def decode(self, ids) -> str:
        """The labels of the arcs, as text; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.label[int(i)] for i in ids).decode("utf-8", "replace")


def _side_by_side(parts: dict[int, tuple[int, int, int]], time: dict[tuple[int, int], int], u: int, t: int) -> bool:
    """Whether the state behind token u has an arc t after the merges so far (parts, and the time of each pair).

    The splits that made the state come from u, its right part, that one's right part and so on, each while it was the
    last token; an arc t stands where the arcs of its left parts stood when they were merged.
    """
    a, until_a = u, NEVER
    while True:
        c, until_c = t, NEVER
        while True:
            k = time.get((a, c), NEVER)
            if k < until_a and k <= until_c:
                return False
            if c not in parts:
                break
            c, _, until_c = parts[c]
        if a not in parts:
            return True
        _, a, until_a = parts[a]


def _ordered(tokens: list[int], parts: dict[int, tuple[int, int, int]], side: int) -> tuple[dict[int, int], Callable[[int, int], int]]:
    """Each token's place in an order where those made from it, on that side, stand before it, the earliest merge first.

    Also where the run begins that ends with a token and has those made from it from a time on.
    """
    made: dict[int, list[int]] = {}
    for w, x in parts.items():  # in order of time
        made.setdefault(x[side], []).append(w)
    place: dict[int, int] = {}
    start: dict[int, int] = {}
    for root in tokens:
        todo = [] if root in parts else [(root, 0)]
        while todo:
            x, i = todo.pop()
            if not i:
                start[x] = len(place)
            if i < len(made.get(x, ())):
                todo += [(x, i + 1), (made[x][i], 0)]
            else:
                place[x] = len(place)

    def begin(x: int, time: int) -> int:
        own = made.get(x, ())
        i = bisect_left(own, time, key=lambda w: parts[w][2])
        return start[own[i]] if i < len(own) else place[x]

    return place, begin


def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary file."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    letter = byte_letters()
    as_bytes = lambda s: bytes(letter[c] for c in s)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in read["model"]["merges"]]
    special = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
    vocabulary = {as_bytes(s): i for s, i in read["model"]["vocab"].items() if s not in special}
    return Automaton(vocabulary, [(as_bytes(a), as_bytes(b)) for a, b in pairs], special)


class Words(dict):
    """Encoded words: number of tokens, their ids as text, their labels. Emptied when full, so its memory is bounded."""

    def __init__(self, automaton: Automaton, most: int = 600_000, longest: int = 64):
        self.automaton, self.most, self.longest = automaton, most, longest

    def __missing__(self, word: str):
        ids = self.automaton.encode(word.encode())
        label = self.automaton.label
        found = (len(ids), ",".join(map(str, ids)), b"".join([label[i] for i in ids]))
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


_SPLIT = regex.compile(WORDS)


def encoded_words(text: str, words: Words) -> list[tuple[int, str, bytes]]:
    """What words has for each word of the text; strings of special tokens stand for themselves."""
    special = words.automaton.special
    if any(s in text for s in special):
        out = []
        for part in regex.split("(" + "|".join(regex.escape(s) for s in special) + ")", text):
            if part in special:
                i = special[part]
                out.append((1, str(i), words.automaton.label[i]))
            else:
                out += [words[w] for w in _SPLIT.findall(part)]
        return out
    return [words[w] for w in _SPLIT.findall(text)]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """For each row its doc_id, n_tokens, ids_sha256 and decoded_sha256, and with ids the token ids.

    A null or empty text has no tokens and the hash of nothing. Rows are mapped one by one, so repeated rows and null
    ids come back as they are, and other columns are not read.
    """
    small_batches(docs)
    automaton = load(path)  # goes along with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(automaton)
        first, second, third = itemgetter(0), itemgetter(1), itemgetter(2)
        for batch in pieces(batches, 500):
            n, by_id, by_text, all_ids = [], [], [], []
            for t in batch.column(1):
                found = encoded_words(t.as_py(), words)
                n.append(sum(map(first, found)))
                listed = ",".join(map(second, found))
                by_id.append(hashlib.sha256(listed.encode()).hexdigest())
                by_text.append(hashlib.sha256(b"".join(map(third, found)).decode("utf-8", "replace").encode()).hexdigest())
                if ids:
                    all_ids.append(np.array(listed.split(",") if listed else [], np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(by_id, pa.string()), pa.array(by_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        words.clear()  # only now can its memory go back
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id"), whole_text(text).alias("t")).mapInArrow(run, schema)


def op9_bpe(docs: DataFrame, path: str) -> DataFrame:
    return encode_documents(docs, path, ids=False)
