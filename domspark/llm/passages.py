"""Documents that hold a passage of many words which another document holds too.

Passages are windows of WORDS words (A-Z lowered). As with substrings, windows are tied to their least gram, the anchor:
equal windows have equal anchors at equal places. The windows of a text that share an anchor are a span.

1. Spans whose anchor no other row has are dropped.
2. Of the rest, spans of equal words are one class, with its least and greatest row. A class that two rows have settles
   its rows.
3. A row without such a class may still share some windows of a span. Its spans are opened, and all other spans of their
   anchors with them: each window's hash is counted by its least and greatest row. The short passages that documents share
   among foreign text are found here.

All groups are reduced to two rows before they are shuffled, so that no passage is too common. Joins are merges at every
size, so that the job behaves on little data as on much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, pieces, scratch, settle
from .shingles import mix, word_hashes
from .windows import least_of_windows

#: The least length of a passage: more than 50 words.
WORDS = 51
GRAM = 8
#: Ids of texts are sent to all tasks up to this many; beyond, they are joined by a shuffle.
MOST_SENT = 1_000_000
_ROWS = 1_000
_CHUNK = 1 << 19
_BITS = 24  # of a place in a chunk of words
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes:
    """Hashes of any runs of some words: equal runs, equal hashes, wherever they stand."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        power, self.inverse = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _runs(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts a chunk at a time: the first one's place, the words' hashes, and where each text's words begin."""
    at = 0
    while at < len(texts):
        first, raw, size = at, [], 0
        while at < len(texts) and (not raw or size + len(texts[at]) <= _CHUNK):
            raw.append(texts[at].encode())
            size += len(raw[-1])
            at += 1
        yield first, *word_hashes(raw)


def word_spans(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """For chunks of texts: text, anchor's word, words before it, words from it on, anchor's hash, hash of all."""
    for first, words, bounds in _runs(texts):
        n = len(words)
        if n < WORDS:
            continue
        h = WordHashes(words)
        place = np.arange(n - GRAM + 1)
        g = h.of(place, place + GRAM)
        bits = max(_BITS, int(n).bit_length())
        anchor = (least_of_windows((g >> np.uint64(bits) << np.uint64(bits)) | place.astype(np.uint64), WORDS - GRAM + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
        start = np.flatnonzero(np.arange(len(anchor)) + WORDS <= bounds[1:][doc])
        if not len(start):
            continue
        m, d = anchor[start], doc[start]
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (d[1:] != d[:-1]) | (start[1:] != start[:-1] + 1)))
        head = np.flatnonzero(new)
        last = np.concatenate((head[1:], [len(start)])) - 1
        lo, hi, m, d = start[head], start[last] + WORDS, m[head], d[head]
        yield d + first, m - bounds[d], m - lo, hi - m, g[m], h.of(lo, hi)


def _spans_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            for text, place, left, right, anchor, whole in word_spans(batch.column(1).to_pylist()):
                small = [pa.array(x.astype(np.int32)) for x in (place, left, right)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *small, pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=["row", "place", "left", "right", "anchor", "whole"])

    return docs.select("row", "t").mapInArrow(run, "row long, place int, left int, right int, anchor long, whole long")


def _windows(texts: DataFrame) -> DataFrame:
    """w, row: the windows of spans, from row, t and the spans (place, left, right) to be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for i, (t, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words, _ = word_hashes([t.encode()])
                place, left, right = (np.array([s[x] for s in spans], np.int64) for x in ("place", "left", "right"))
                times = left + right - WORDS + 1
                start = np.repeat(place - left - np.cumsum(times) + times, times) + np.arange(times.sum())
                out.append((np.unique(WordHashes(words).of(start, start + WORDS)), np.int64(i)))
            if out:
                row = batch.column(0).take(pa.array(np.repeat([i for _, i in out], [len(w) for w, _ in out])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([w for w, _ in out]).view(np.int64)), row], names=["w", "row"])

    return texts.mapInArrow(run, "w long, row long")


def rows_with_passages(docs: DataFrame) -> DataFrame:
    """row of those docs (row, t) that share a passage with another row."""
    with scratch():
        every = settle(_spans_table(docs))
        size = every.count()
        common = every.groupBy("anchor").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count("*").alias("rows")).where("a < b").select("anchor", "rows")
        found = settle(by_key(every, settle(common, size), "anchor", "rows"), size)
        classes = settle(found.groupBy("whole", "anchor").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count("*").alias("rows")), size)
        several = settle(classes.where("a < b").groupBy("whole").agg(F.sum("rows").alias("rows")), size)
        settled = settle(by_key(found, several, "whole", "rows").select("row").distinct(), size)
        anchors = found.join(settled.hint("merge"), "row", "left_anti").select("anchor").distinct()
        anchors = settle(classes.groupBy("anchor").agg(F.count("*").alias("rows")).join(anchors.hint("merge"), "anchor"), size)
        # Of a class that several rows have, its least and greatest row stand for all.
        witness = by_key(classes.drop("rows"), anchors, "anchor", "rows").select("whole", F.explode(F.array_distinct(F.array("a", "b"))).alias("row"))
        opened = found.join(witness.hint("merge"), ["whole", "row"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("place", "left", "right")).alias("spans"))
        opened = settle(opened, size)
        ids = F.broadcast(opened.select("row")) if opened.count() <= MOST_SENT else opened.select("row")
        texts = docs.select("row", "t").join(ids, "row", "left_semi").dropDuplicates(["row"]).join(opened.hint("merge"), "row")
        windows = settle(_windows(texts.select("row", "t", "spans")), size)
        shared = settle(windows.groupBy("w").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count("*").alias("rows")).where("a < b").select("w", "rows"), size)
        # The rows that are settled stand for others only.
        late = by_key(settle(windows.join(settled.hint("merge"), "row", "left_anti"), size), shared, "w", "rows").select("row").distinct()
        return settle(settled.union(late), size, outer=True)
