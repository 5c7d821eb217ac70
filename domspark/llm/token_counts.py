"""Token counts of sections: each document is encoded once, and its tokens' character spans are joined to the sections' spans.

A token that crosses a boundary is allocated by a named rule: "start" gives it to the section of its first character,
"majority" to the section that holds most of its characters (the earlier one if several do). A token that holds a part of
a character counts as holding that character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

RULES = ("start", "majority")
_ENCODER: dict[int, tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(key: int, ranks: dict[bytes, int], pattern: str):
    if key not in _ENCODER:
        import tiktoken

        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            size[i] = len(b)
        _ENCODER.clear()
        _ENCODER[key] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size)
    return _ENCODER[key]


def token_spans(text: str, encoder, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of the text."""
    ids = np.asarray(encoder.encode_ordinary(text), np.int64)
    end = np.cumsum(size[ids])
    start = end - size[ids]
    if text.isascii():
        return start, end
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    return char[start], char[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; bounds: the sections' first characters, ascending from 0."""
    first = np.searchsorted(bounds, start, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(bounds, end - 1, "right") - 1
    for i in np.flatnonzero(first != last):
        cuts = np.concatenate(([start[i]], bounds[first[i] + 1 : last[i] + 1], [end[i]]))
        first[i] += int(np.argmax(np.diff(cuts)))
    return first


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", rule: str = "majority", boundary: str = "\n") -> DataFrame:
    """A row for each section of each document: section, start, end, n_tokens, n_crossing (tokens that also touch another section).

    A section ends behind each boundary string. A null or empty text has one empty section without tokens. Repeated
    rows each give their sections; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # the vocabulary bounds its size
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _encoder(key, shared.value, pattern)
        for batch in batches:
            row, section, starts, ends, counts, crossing = [], [], [], [], [], []
            for k, t in enumerate(batch.column(1)):
                t = t.as_py()
                lengths = [len(x) + len(boundary) for x in t.split(boundary)]
                stop = np.minimum(np.cumsum(lengths), len(t))
                if len(stop) > 1 and stop[-1] == stop[-2]:
                    stop = stop[:-1]  # the text ends with a boundary
                begin = np.concatenate(([0], stop[:-1]))
                a, b = token_spans(t, encoder, size)
                n = len(begin)
                at = allocate(a, b, begin, rule)
                apart = np.searchsorted(begin, a, "right") != np.searchsorted(begin, b - 1, "right")
                row.append(np.full(n, k))
                section.append(np.arange(n))
                starts.append(begin)
                ends.append(stop)
                counts.append(np.bincount(at, minlength=n))
                crossing.append(np.bincount(at[apart], minlength=n))
            if not row:
                continue
            whole = lambda x: pa.array(np.concatenate(x).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(whole(row)), *map(whole, (section, starts, ends, counts, crossing))], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), whole_text(text).alias("t")).mapInArrow(run, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long")
