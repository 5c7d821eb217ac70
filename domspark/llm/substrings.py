"""Removal of bytes that repeated substrings cover, by sorting suffixes at sampled places.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere in the corpus. Sorting all suffixes of all
texts would move each text many times; but equal strings hold the same least gram (by hash, the first of equals). So:

1. Each text is cut into windows' spans: the starts whose windows share a least gram (the anchor), with all bytes that
   these windows cover. Spans of equal anchor, reach and bytes are one class, kept as hashes. A class that occurs twice
   is repeated as a whole; an anchor that has one class that occurs once is not repeated at all.
2. The rest are the ends of repeated passages. Such a class's windows are parted into ranges by where the anchor lies in
   them (0, 1, 2-3, 4-7, ...). Windows of a range share its core, and only ranges whose core another class has are kept,
   with the bytes to both sides of the core. Equal ranges are added up before they meet in a task.
3. In each core's group both sides are sorted as suffixes (the left one backwards), deep-shallow. From the shared lengths
   of neighbours follows for each window which others agree with it on both sides: the repeated ones.
4. A core that more than MOST_ROWS ranges have goes to no single task: each of its windows is counted by core, place and
   hash, added up before they meet. Those that many ranges have are then sent to all tasks, the others are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, pieces, scratch, settle, small_batches, whole_text
from .passages import rows_with_passages
from .shingles import mix
from .suffix import deep_shallow_sort
from .windows import least_of_windows

LENGTH = 400
GRAM = 32
#: Ids, and rows with all cuts of a text, that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 1_000_000
MOST_CUTS = 10_000
#: Ranges of one core that one task sorts at most, and ranges with one window that a join brings together.
MOST_ROWS = 2_000
_CHUNK = 1 << 19
_ROWS = 1_000
_BITS = 28  # of a place in a chunk
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for chunks of up to n bytes."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, _CHUNK + 4096)
        made = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
        if n > 4 * _CHUNK:
            return made[0], made[1]
        _TABLES[:] = made
    return _TABLES[0], _TABLES[1]


class Hashes:
    """Hashes of any substrings of some bytes: equal strings, equal hashes, wherever they stand."""

    def __init__(self, raw: bytes):
        self.code = np.frombuffer(raw, np.uint8)
        power, self.inverse = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.code] * power[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.code) - k + 1
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n])


def spans(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: text, anchor's place, bytes to its left, bytes from it to the right, anchor's hash, hash of all."""
    at = 0
    while at < len(texts):
        own, size = [], 0
        while at < len(texts) and (not own or size + len(texts[at]) <= _CHUNK):
            if len(texts[at]) >= length:
                own.append(at)
                size += len(texts[at])
            at += 1
        if not own:
            continue
        sizes = np.array([len(texts[i]) for i in own])
        begin = np.cumsum(sizes) - sizes
        h = Hashes(b"".join(texts[i] for i in own))
        g = h.grams(gram)
        bits = max(_BITS, int(size).bit_length())
        order = (g >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(g), dtype=np.uint64)
        anchor = (least_of_windows(order, length - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(own)), sizes)[: len(anchor)]
        inside = np.arange(len(anchor)) + length <= (begin + sizes)[doc]
        start = np.flatnonzero(inside)
        m, d = anchor[start], doc[start]
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (d[1:] != d[:-1]) | (start[1:] != start[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(start)])) - 1
        lo, hi, m, d = start[first], start[last] + length, m[first], d[first]
        yield np.array(own)[d], m - begin[d], m - lo, hi - m, g[m], h.of(lo, hi)


def ranges(length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int]]:
    """First and last distance from a window's start to its anchor: 0, 1, 2-3, 4-7, ..."""
    out, lo = [(0, 0)], 1
    while lo <= length - gram:
        out.append((lo, min(2 * lo - 1, length - gram)))
        lo *= 2
    return out


def _spans_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for text, place, left, right, anchor, whole in spans(texts):
                numbers = [pa.array(x.astype(np.int64)) for x in (place, left, right)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *numbers, pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=["row", "place", "left", "right", "anchor", "whole"])

    return docs.select("row", "t").mapInArrow(run, "row long, place long, left long, right long, anchor long, whole long")


def _sides(found: DataFrame) -> DataFrame:
    """From row, t and the anchors in it (arrays): the ranges of each anchor with their core's hash and the bytes beside it."""
    table = ranges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            out: dict[str, list] = {x: [] for x in ("class", "n", "row", "place", "range", "core", "before", "behind")}
            for row, t, anchors in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = t.encode()
                h = Hashes(raw)
                m, left, right = (np.array([a[x] for a in anchors], np.int64) for x in ("place", "left", "right"))
                for j, (lo, hi) in enumerate(table):
                    fit = np.flatnonzero((lo <= left) & (LENGTH - hi <= right) & (np.maximum(lo, LENGTH - right) <= np.minimum(hi, left)))
                    a, b = m[fit] - lo, m[fit] + LENGTH - hi
                    core = mix(h.of(a, b) + np.uint64(j)).view(np.int64).tolist()
                    from_, to = m[fit] - np.minimum(hi, left[fit]), m[fit] + np.minimum(right[fit], LENGTH - lo)
                    for i, c, x, y, z, u in zip(fit.tolist(), core, from_.tolist(), a.tolist(), b.tolist(), to.tolist(), strict=True):
                        for key, value in (("class", anchors[i]["class"]), ("n", anchors[i]["n"]), ("row", row), ("place", anchors[i]["place"]), ("range", j), ("core", c), ("before", raw[x:y][::-1]), ("behind", raw[z:u])):
                            out[key].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k in ("before", "behind") else pa.int64()) for k, v in out.items()], names=[*out])

    return found.mapInArrow(run, "class long, n long, row long, place long, range long, core long, before binary, behind binary")


def repeated_windows(length: int, before: list[bytes], behind: list[bytes], n: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For rows of ranges with `length` bytes beside the core in all: which of the windows 0 to length are repeated.

    Window x holds x bytes before the core and length - x behind it. n: how often the row occurs; group: ascending.
    """
    count = len(n)

    def prefixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.zeros((count, length), np.uint8)
        size = np.fromiter(map(len, strings), np.int64, count)
        rows[np.arange(length) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
        return *deep_shallow_sort(rows, size, group), size

    (order_a, lcp_a, size_a), (order_b, lcp_b, size_b) = prefixes(before), prefixes(behind)
    out = np.zeros((count, length + 1), bool)
    a, b = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for x in range(length + 1):
        a[order_a] = np.cumsum(lcp_a < x)
        b[order_b] = np.cumsum(lcp_b < length - x)
        has = np.flatnonzero((size_a >= x) & (size_b >= length - x))
        _, back = np.unique(a[has] * (count + 1) + b[has], return_inverse=True)
        out[has, x] = np.bincount(back, n[has])[back] >= 2
    return out


def _resolve(parts: DataFrame) -> DataFrame:
    """part, first, last: the repeated windows of rows (part, core, range, before, behind, n), which share their core's group."""
    table = ranges()

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = rows["range"].to_numpy()
        for j in np.unique(kind):
            here = rows.filter(pa.array(kind == j))
            lo, hi = table[j]
            core = here["core"].to_numpy()
            group = np.cumsum(np.concatenate(([True], core[1:] != core[:-1]))) - 1
            hit = repeated_windows(hi - lo, here["before"].to_pylist(), here["behind"].to_pylist(), here["n"].to_numpy(), group)
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            yield pa.RecordBatch.from_arrays([here["part"].combine_chunks().take(pa.array(row)), pa.array(first + lo), pa.array(last + lo)], names=["part", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            core = rows["core"].to_numpy()
            cut = int(np.searchsorted(core, core[-1], "left"))  # the last group may go on in the next batch
            if cut:
                yield from solve(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut)
        if held is not None and len(held):
            yield from solve(held.combine_chunks())

    ordered = parts.select("part", "core", "range", "before", "behind", "n").repartition("core").sortWithinPartitions("core")
    return ordered.mapInArrow(run, "part long, first long, last long")


def _each_window(parts: DataFrame) -> DataFrame:
    """core, at, w, part, n: the windows of rows as _resolve has them; w is the hash of the bytes beside the core."""
    table = np.array(ranges())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            before, behind = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("before", "behind"))
            lo, hi = table[batch.column(batch.schema.get_field_index("range")).to_numpy()].T
            a, b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (before, behind))
            length = hi - lo
            least, most = np.maximum(0, length - b), np.minimum(length, a)
            times = most - least + 1
            row = np.repeat(np.arange(len(a)), times)
            x = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + least[row]
            start = (np.cumsum(a + b) - b)[row] - x
            w = Hashes(b"".join(y for pair in zip((s[::-1] for s in before), behind, strict=True) for y in pair)).of(start, start + length[row])
            core, part, n = (batch.column(batch.schema.get_field_index(k)).take(pa.array(row)) for k in ("core", "part", "n"))
            yield pa.RecordBatch.from_arrays([core, pa.array((x + lo[row]).astype(np.int32)), pa.array(w.view(np.int64)), part, n], names=["core", "at", "w", "part", "n"])

    return parts.select("part", "core", "range", "before", "behind", "n").mapInArrow(run, "core long, at int, w long, part long, n long")


def _resolve_crowded(parts: DataFrame) -> DataFrame:
    """The same as _resolve; no group of rows of one core or one window meets in a task."""
    key = ["core", "at", "w"]
    windows = _each_window(parts)
    counts = settle(windows.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1"))
    # So at most MOST_SENT windows are frequent, and a rare one brings few rows to its task.
    most = max(MOST_ROWS, (counts.agg(F.sum("rows")).first()[0] or 0) // MOST_SENT)
    frequent = F.broadcast(counts.where(F.col("rows") > most).select(*key))
    rare = windows.join(frequent, key, "left_anti").join(counts.where(F.col("rows") <= most).select(*key), key, "left_semi")
    hit = windows.join(frequent, key, "left_semi").union(rare).select("part", "at")
    run = F.col("at") - F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return hit.withColumn("run", run).groupBy("part", "run").agg(F.min("at").cast("long").alias("first"), F.max("at").cast("long").alias("last")).drop("run")


def covered(docs: DataFrame) -> tuple[DataFrame, int]:
    """row, start, end: bytes of texts (row, t) that repeated strings cover; spans may overlap. And how many anchors there are."""
    small_batches(docs)
    found = settle(_spans_table(docs).withColumn("class", F.xxhash64("anchor", "whole", "left", "right")))
    size = found.count()
    classes = found.groupBy("class", "anchor").agg(F.count("*").alias("n"), F.min(F.struct("row", "place", "left", "right")).alias("one"))
    classes = settle(classes.select("class", "anchor", "n", "one.*"), size)
    whole = by_key(found, classes.where("n > 1").select("class", "n"), "class", "n").select("row", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"))

    several = settle(classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("anchor", "k"), size)
    ends = by_key(classes, several, "anchor", "k")
    anchors = settle(ends.groupBy("row").agg(F.collect_list(F.struct("class", "n", "place", "left", "right")).alias("anchors")), size)
    few = anchors.count() <= MOST_SENT
    texts = docs.select("row", "t").where(F.octet_length("t") >= LENGTH)
    texts = texts.join(F.broadcast(anchors.select("row")) if few else anchors.select("row"), "row", "left_semi").groupBy("row").agg(F.first("t").alias("t"))
    sides = settle(_sides(texts.join(anchors, "row").select("row", "t", "anchors")).withColumn("part", F.xxhash64("core", "before", "behind")), size)
    alive = sides.groupBy("core").agg(F.sum("n").alias("k"), F.min("n").alias("least"), (F.count("*") > MOST_ROWS).alias("crowded"), F.count("*").alias("rows")).where("k > 1 and least = 1").select("core", "crowded", "rows")
    sides = settle(by_key(sides, settle(alive, size), "core", "rows"), size)
    parts = lambda some: sides.where(some).groupBy("part", "core", "range").agg(F.first("before").alias("before"), F.first("behind").alias("behind"), F.sum("n").alias("n"))
    windows = _resolve(parts("not crowded"))
    if not sides.where("crowded").isEmpty():
        windows = windows.union(_resolve_crowded(settle(parts("crowded"))))
    more = sides.where("n = 1").select("part", "row", "place").join(windows, "part")
    return whole.union(more.select("row", (F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first") + LENGTH).alias("end"))), size


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage and the kept bytes for each row of docs.

    passage: 1 if the text holds a passage of more than 50 words that a row of another id or text holds too, however few
    bytes it has; else 0. Nothing is removed for that alone. A null text is empty; texts of fewer than LENGTH bytes lose
    nothing. A repeated row repeats all its strings. Null ids stay null. Other columns are not read.
    """
    docs = docs.select("doc_id", whole_text(text).alias("t")).withColumn("row", F.xxhash64("doc_id", "t"))
    # Rows equal in id and text are one row to the joins, but each counts as an occurrence.
    with scratch():
        with scratch():
            found, size = covered(docs)
            cuts = settle(found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts")), size, outer=True)
        marks = rows_with_passages(docs).select("row", F.lit(1).alias("passage"))
        marks = settle(cuts.join(marks, "row", "full"), size, outer=True)
    few = marks.count() <= MOST_CUTS
    joined = docs.join(F.broadcast(marks) if few else marks, "row", "left").select("doc_id", "t", "cuts", F.coalesce("passage", F.lit(0)).alias("passage"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            out = []
            for t, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, kept, spans, removed = t.encode(), [], 0, 0
                end = -1
                for c in cuts or ():
                    if c["start"] > end:
                        kept.append(raw[max(end, 0) : c["start"]])
                        spans += 1
                        removed += c["end"] - c["start"]
                        end = c["end"]
                    elif c["end"] > end:
                        removed += c["end"] - end
                        end = c["end"]
                kept.append(raw[max(end, 0) :])
                kept = b"".join(kept)
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "passage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, passage int")


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).drop("kept")
