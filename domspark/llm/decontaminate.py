"""Benchmark decontamination by the q-gram lemma.

A window of L characters and a text that differs from it by e edits or less share at least L - q + 1 - q e q-grams, whose
diagonals (place in the text minus place in the item) differ by e at most. So q-grams of texts are looked up among those
of the items, hits are counted in diagonal bands that overlap by half, and only bands with enough hits are looked at:
windows that meet the bound are verified by a banded alignment. A text is contaminated where a window of an item (the
whole item if it is shorter) stands in it with the allowed edits.

Texts and items are held in plain form: letters and digits, lowered; each run of other characters is one blank. Windows
and edits are counted in it; reported places are those in the text itself. Defined results: null or empty texts and
items match nothing, and so do items of fewer than Q plain characters; an item or a row that is repeated matches each
time; a null id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_rows, pieces, whole_text

Q = 10
WINDOW = 80
RATE = 0.0625
BAND = 16
#: Items are sent to all tasks in slices of about this many characters, each 16 bytes: 64 MB.
MOST_SENT = 4_000_000
#: Hits that a task looks at together.
MOST_HITS = 1_000_000
_CHUNK = 1 << 18
_TOGETHER = 64  # windows that are aligned at once
_LETTER = np.array([chr(b).isalnum() for b in range(256)])


class Plain:
    """The plain form of a text: a byte for each character (equal characters, equal bytes), and their places in the text."""

    def __init__(self, text: str):
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.low = low
        try:
            code = np.frombuffer(low.encode("latin-1"), np.uint8)
            letter = _LETTER[code]
        except UnicodeEncodeError:
            c = np.frombuffer(low.encode("utf-32-le"), np.uint32)
            # Beyond Latin-1 characters count as letters but for punctuation, symbols and blanks (U+2000 to U+2BFF, U+3000 to U+303F).
            code = np.where(c < 256, c, (c * np.uint32(2654435761)) >> 24).astype(np.uint8)
            letter = np.where(c < 256, _LETTER[code], ~((c >= 0x2000) & (c < 0x2C00) | (c >= 0x3000) & (c < 0x3040)))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        code = np.where(letter, code, 32)
        if not keep.all():
            self.place, code = np.flatnonzero(keep), code[keep]
        else:
            self.place = None
        self.code, self.letter = code.astype(np.uint8), letter

    def __len__(self) -> int:
        return len(self.code)

    def at(self, i: int) -> int:
        return i if self.place is None else int(self.place[i])

    def string(self, a: int = 0, b: int | None = None) -> str:
        """Characters a to b of the plain form."""
        b = len(self) if b is None else b
        return "".join(self.low[p] if self.letter[p] else " " for p in map(self.at, range(a, b)))


def _gram_hashes(codes: bytes) -> np.ndarray:
    """A hash of the Q = 10 bytes from each place on."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    head = np.ndarray((n,), "<u8", codes, 0, (1,))
    tail = np.ndarray((n,), "<u8", codes, Q - 8, (1,))
    h = head * np.uint64(0x9E3779B97F4A7C15)
    h ^= tail * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def bounds(size: int) -> tuple[int, int, int]:
    """Window, edits and least number of shared q-grams for an item of that size."""
    window = min(size, WINDOW)
    edits = max(0, min(int(window * RATE), (window - Q) // Q))
    return window, edits, window - Q + 1 - Q * edits


class Items:
    """The q-grams of the items of a slice."""

    def __init__(self, ids: list, texts: list[str]):
        plain = [Plain(t) for t in texts]
        keep = [i for i, p in enumerate(plain) if len(p) >= Q]
        self.ids = [ids[i] for i in keep]
        self.texts = [plain[i].string() for i in keep]
        grams = [_gram_hashes(plain[i].code.tobytes()) for i in keep]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.zeros(0, np.int32)])[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.least = np.array([bounds(len(t))[2] for t in self.texts], np.int64)


def edits_within(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """The best place of pattern in text with at most so many edits: (edits, start, end), by a banded alignment.

    text is the pattern's expected place with a margin on both sides, and the band is as wide as both margins.
    """
    n, m = len(text), len(pattern)
    slack = max(0, n - m) + most
    big = most + 1
    cost = [0] * (n + 1)
    begin = list(range(n + 1))
    for i in range(1, m + 1):
        lo, hi = max(0, i - most), min(n, i + slack)
        new, came = [big] * (n + 1), [0] * (n + 1)
        if lo == 0:
            new[0], came[0] = i, 0
        c = pattern[i - 1]
        for j in range(max(1, lo), hi + 1):
            best, source = cost[j - 1] + (c != text[j - 1]), begin[j - 1]
            if cost[j] + 1 < best:
                best, source = cost[j] + 1, begin[j]
            if new[j - 1] + 1 < best:
                best, source = new[j - 1] + 1, came[j - 1]
            new[j], came[j] = best, source
        if min(new) > most:
            return None
        cost, begin = new, came
    end = min(range(n + 1), key=lambda j: (cost[j], j))
    return (cost[end], begin[end], end) if cost[end] <= most else None


def any_within(patterns: list[str], texts: list[str], most: int) -> np.ndarray:
    """Which patterns, all of one length, stand in their texts with at most so many edits; all are aligned at once, each in a band.

    The band has the diagonals on which a pattern can begin and still end in its text, and most more on both sides: its
    width is what a text has more than its pattern, not the text's length.
    """
    codes = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    want = np.stack([codes(p) for p in patterns])
    m, width = want.shape[1], int(size.max()) - want.shape[1] + 2 * most + 1
    if width <= 0:
        return np.zeros(len(texts), bool)
    # Row i and column k of the band stand for the text's first i + k - most characters.
    have = np.full((len(texts), m + width), 0xFFFFFFFF, np.uint32)
    for row, t in zip(have, texts, strict=True):
        c = codes(t)[: m + width - most]
        row[most : most + len(c)] = c
    column, big = np.arange(width, dtype=np.int32), np.int32(m + most + 1)
    read = column - most
    cost = np.where((read >= 0) & (read <= size[:, None]), 0, big).astype(np.int32)
    for i in range(m):
        new = cost + (have[:, i : i + width] != want[:, i : i + 1])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])  # a character of the pattern that the text lacks
        cost = np.minimum.accumulate(new - column, axis=1) + column  # characters that the text has besides
        if cost.min() > most:
            return np.zeros(len(texts), bool)
    return np.where(m + read <= size[:, None], cost, big).min(axis=1) <= most


def _verified(text: Plain, item: str, diagonal: np.ndarray, place: np.ndarray) -> tuple[int, int, int] | None:
    """(start, end, edits) of a window that the hits of a band allow and the alignment confirms; those with most hits come first."""
    window, edits, least = bounds(len(item))
    order = np.argsort(place, kind="stable")
    place, diagonal = place[order], diagonal[order]
    new = np.concatenate(([True], place[1:] != place[:-1]))
    distinct = np.concatenate(([0], np.cumsum(new)))
    s = np.arange(len(item) - window + 1)
    lo, hi = np.searchsorted(place, s, "left"), np.searchsorted(place, s + window - Q, "right")
    count = distinct[hi] - distinct[lo]
    good = s[count >= least]
    order = good[np.argsort(-count[good], kind="stable")].tolist()
    for at in range(0, len(order), _TOGETHER):
        tries = []
        for x in order[at : at + _TOGETHER]:
            here = diagonal[lo[x] : hi[x]]
            from_, to = max(0, x + int(here.min()) - edits), min(len(text), x + window + int(here.max()) + edits)
            if from_ < to:
                tries.append((item[x : x + window], from_, text.string(from_, to)))
        hit = any_within([p for p, _, _ in tries], [t for _, _, t in tries], edits) if tries else ()
        for (pattern, from_, piece), good_one in zip(tries, hit, strict=True):
            if good_one:
                cost, a, b = edits_within(pattern, piece, edits)
                return text.at(from_ + a), text.at(from_ + b - 1) + 1, cost
    return None


def _matches(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, shared q-grams, start, end, edits) for each item that a text contains."""
    at = 0
    while at < len(texts):
        first, plain, size = at, [], 0
        while at < len(texts) and (not plain or size + len(texts[at]) <= _CHUNK):
            plain.append(Plain(texts[at]))
            size += len(texts[at])
            at += 1
        starts = np.concatenate(([0], np.cumsum([len(p) for p in plain])))
        h = _gram_hashes(b"".join(p.code.tobytes() for p in plain))
        hit = np.flatnonzero(items.maybe[(h >> np.uint64(42)).astype(np.int64)])
        h = h[hit]
        lo, hi = np.searchsorted(items.hashes, h, "left"), np.searchsorted(items.hashes, h, "right")
        doc = np.searchsorted(starts, hit, "right") - 1
        times = np.where(hit + Q <= starts[doc + 1], hi - lo, 0)
        if not times.any():
            continue

        def hits(doc=doc, lo=lo, hit=hit, times=times, starts=starts) -> Iterator[tuple[np.ndarray, ...]]:
            """pair of text and item, item, place in the text, place in the item; a bounded number at once."""
            done = np.cumsum(times)
            a = 0
            while a < len(times):
                b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + MOST_HITS, "right")))
                n = times[a:b]
                which = np.repeat(lo[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                item = items.item[which].astype(np.int64)
                yield np.repeat(doc[a:b], n) * len(items.texts) + item, item, np.repeat(hit[a:b] - starts[doc[a:b]], n), items.place[which].astype(np.int64)
                a = b

        # First the pairs of text and item with enough hits at all, then their bands.
        some = [np.unique(pair, return_counts=True) for pair, *_ in hits()]
        key, back = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
        many = np.bincount(back, np.concatenate([n for _, n in some]))
        good = key[many >= items.least[key % len(items.texts)]]
        if not len(good):
            continue
        kept = [[x[np.isin(part[0], good)] for x in part] for part in hits()]
        pair, item, where, place = (np.concatenate(x) for x in zip(*kept, strict=True))
        done: set[int] = set()
        for shift in (0, BAND // 2):
            band = (where - place + shift) // BAND
            order = np.lexsort((band, pair))
            p, b = pair[order], band[order]
            edge = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (b[1:] != b[:-1]))))
            for x, y in zip(edge, [*edge[1:], len(p)], strict=True):
                here = order[x:y]
                key = int(p[x])
                if key in done or y - x < items.least[item[here[0]]]:
                    continue
                d, i = divmod(key, len(items.texts))
                found = _verified(plain[d], items.texts[i], where[here] - place[here], place[here])
                if found:
                    done.add(key)
                    yield first + d, i, y - x, *found


def _slices(benchmark: DataFrame) -> Iterator:
    """Broadcasts of items, each of about MOST_SENT characters at most, that hold the benchmark together."""
    benchmark = benchmark.select("item_id", whole_text().alias("t")).where(F.length("t") >= Q)
    n = max(1, -(-(benchmark.agg(F.sum(F.length("t"))).first()[0] or 0) // MOST_SENT))
    for s in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("t"), F.lit(n)) == s).orderBy("item_id", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in part], [r["t"] for r in part]))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """A row for each text and item that it contains: doc_id, item_id, shared, start, end, edits (characters, end exclusive)."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    types = to_arrow_type(benchmark.schema["item_id"].dataType)
    rows = docs.select("doc_id", whole_text(text).alias("t"))
    out = None
    for shared in _slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in pieces(batches, 1_000):
                found = list(_matches(batch.column(1).to_pylist(), items))
                index = pa.array([f[0] for f in found], pa.int64())
                numbers = [pa.array([int(f[j]) for f in found], pa.int64()) for j in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array([items.ids[f[1]] for f in found], types), *numbers], names=["doc_id", "item_id", "shared", "start", "end", "edits"])

        found = rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, shared long, start long, end long, edits long")
        out = found if out is None else out.union(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text contains no item; all columns, no shuffle."""
    at = docs.columns.index(text)
    for shared in _slices(benchmark):

        def change(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            dirty = {f[0] for f in _matches([x or "" for x in batch.column(at).to_pylist()], shared.value)}
            return batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

        docs = map_rows(docs, change)
    return docs
