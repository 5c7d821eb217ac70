"""Tokens of two tokenizers for the same texts, aligned by the bytes that they cover.

Texts are split before runs of white space, where neither vocabulary can merge across (cut_characters looks through the
vocabularies for that). Each distinct segment is tokenised and aligned once, over all documents; its alignment is joined
back and documents are composed of their segments' alignments.

Documents are read in chunks of a bounded number of characters. A chunk numbers its distinct segments and keeps a
document as an array of these numbers. Distinct segments meet in buckets by their hash, where each is aligned, and go back
to their chunks from there. What is shuffled is never a row for a word, but arrays of a chunk's segments in a bucket. So
no key is hot: a segment is in a chunk, and a pair of tokens in a bucket, once at most.

Tokenizer A is byte-level BPE (a JSON file of the tokenizers library) and gets a space before the text; B is a
sentencepiece model that adds that space itself. Strings of special tokens in a text are plain text to both.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import give_back, pieces, settle, small_batches

#: Characters of texts that share a chunk, and bytes of texts for which there is one bucket of segments.
CHUNK, BUCKET = 32_000_000, 16_000_000
SPACE_PIECE = "▁"
#: Characters of the Unicode property White_Space, as the content of a class; fixed value.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Those and others that some engine takes for white space: no segment ends behind one.
ANY_WHITE = WHITE + "\\x1c-\\x1f\\u180e\\u200b\\ufeff"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Tokenizers:
    """Both tokenizers with the byte length of each token; made of the files' contents, which go along with a task."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letter = byte_letters()
        special = {t["content"] for t in json.loads(a_json).get("added_tokens", [])}
        size = {i: len(s.encode()) if s in special else sum(c in letter for c in s) for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_size = [size.get(i, 0) for i in range(max(size) + 1)]
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_size = [1 if self.b.is_byte(i) else len(p.replace(SPACE_PIECE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.whole = all(self.a.token_to_id(c) is not None for c in letter) and sum(map(self.b.is_byte, range(len(self.pieces)))) == 256
        self.known = {p for p in self.pieces if len(p) == 1}
        if SPACE_PIECE not in self.known:
            raise ValueError("B has no piece for a single space")
        self.space = [self.b.piece_to_id(SPACE_PIECE)]

    def cut_characters(self) -> str:
        """White space before which both vocabularies always part, if what stands before it is none.

        A: its word pattern ends each word there, and no token holds such a place. B: no piece holds it, so no merge
        crosses it, and (but for the space itself) none begins with a space and the character, so that a segment is
        encoded as by itself behind the space that B adds.
        """
        letter = byte_letters()
        spelt = [p for i, p in enumerate(self.pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        words = [bytes(letter[c] for c in s if c in letter).decode("utf-8", "ignore") for s in self.a.get_vocab(with_added_tokens=False)]
        inside = {m for p in spelt for m in re.findall(f"(?<=[^{ANY_WHITE}{SPACE_PIECE}])[{WHITE}{SPACE_PIECE}]", p)} | {m for w in words for m in re.findall(f"(?<=[^{ANY_WHITE}])[{WHITE}]", w)}
        behind = {p[1] for p in spelt if len(p) > 1 and p[0] == SPACE_PIECE}
        every = [chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c))]
        return "".join(c for c in every if c not in inside and (SPACE_PIECE not in inside if c == " " else c not in behind))

    def spelt(self, text: str) -> bool:
        """Whether both tokenizers' tokens spell a space and the text, byte for byte."""
        if not text or SPACE_PIECE in text or self.b.normalize(text).replace(SPACE_PIECE, " ") != " " + text:
            return False
        return self.whole or len(self.a.decode(self.a.encode(" " + text, add_special_tokens=False).ids).encode()) == len(text.encode()) + 1 and set(text.replace(" ", SPACE_PIECE)) <= self.known

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of segments, each of which begins with a character to cut before."""
        a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s.removeprefix(" ") for s in segments], num_threads=1)
        for s, x, y in zip(segments, a, b, strict=True):
            yield x, (y or self.space) if s[0] == " " else y[1:]  # B gives nothing for an empty text


class Aligned:
    """Alignments of segments, one behind the other.

    ids: those of A's and then B's tokens of each segment, with ends telling which of them end a group; n_a, n_b: how many
    of each a segment has; links: all pairs (a, b), n_links: how many a segment has.
    """

    def __init__(self, a: list[list[int]], b: list[list[int]], a_size: np.ndarray, b_size: np.ndarray):
        self.n_a, self.n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        flat = [np.fromiter((i for ids in x for i in ids), np.int64) for x in (a, b)]
        ends = [np.cumsum(size[ids]) for size, ids in zip((a_size, b_size), flat, strict=True)]
        segments = ends[0][np.cumsum(self.n_a) - 1]
        # Between two neighbouring ends, of whichever tokens, there is one token of each side: each such stretch is a link.
        stops, common = np.union1d(*ends), np.intersect1d(*ends)
        self.links = np.stack([ids[np.searchsorted(e, stops)] for ids, e in zip(flat, ends, strict=True)], 1)
        self.n_links = np.diff(np.searchsorted(stops, segments), prepend=-1)
        of = np.concatenate([np.repeat(np.arange(len(a)), n) for n in (self.n_a, self.n_b)])
        order = np.argsort(of, kind="stable")
        self.ids = np.concatenate(flat)[order]
        self.ends = np.concatenate([np.isin(e, common) for e in ends])[order]


def group_texts(ids: np.ndarray, ends: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
    """The groups of each segment as text: a1,a2|b1;a3|b2,b3."""
    size = n_a + n_b
    start = np.cumsum(size) - size
    segment = np.repeat(np.arange(len(size)), size)
    is_b = np.arange(len(ids)) - start[segment] >= n_a[segment]
    done = np.cumsum(ends) - ends
    group = done - done[start[segment] + np.where(is_b, n_a[segment], 0)]
    order = np.lexsort((is_b, group, segment))
    mark = np.where(ends, np.where(is_b, ";", "|"), ",").astype(object)
    texts = (ids.astype(str).astype(object) + mark)[order].tolist()
    return ["".join(texts[lo : lo + n])[:-1] for lo, n in zip(start.tolist(), size.tolist(), strict=True)]


class _Numbers(dict):
    """A number for each segment, in the order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_READY: dict[str, Tokenizers] = {}


def _tokenizers(key: str, a_json: str, b_model: bytes) -> Tokenizers:
    if key not in _READY:
        _READY.clear()
        _READY[key] = Tokenizers(a_json, b_model)
    return _READY[key]


def segment_pattern(cuts: str) -> re.Pattern:
    """Finds the segments of a space and a text: white space, what follows, and on up to a character to cut before."""
    rest = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{ANY_WHITE}]", c) and c not in cuts)
    return re.compile(f"[{ANY_WHITE}]+[^{ANY_WHITE}]*(?:[{re.escape(rest)}][{ANY_WHITE}]*[^{ANY_WHITE}]*)*")


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, of which the higher ones are almost empty; those that are empty are left out."""
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T
    return b"".join(p.tobytes() for p in planes[: max(1, -(-int(x.max()).bit_length() // 8))]) if len(x) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").reshape(-1)


def _table(rows: list[dict], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r.get(c) for r in rows], k) for c, k in schema], names=[c for c, _ in schema])


_SPLIT = "chunk long, d {}, n int, ids binary, bucket int, sizes binary, texts binary, local binary, times binary"
_BUCKETS = "own_bucket int, n int, n_a binary, n_b binary, ids binary, ends binary, members binary, chunks binary, local binary, links binary, pair int, a int, b int, times long"


def _chunks(docs: DataFrame, tokenizers, text: str, chunk: int, buckets: int) -> DataFrame:
    """Rows for documents (chunk, d, n, ids) and for a chunk's distinct segments in a bucket (chunk, bucket, n, sizes, texts, local, times).

    A chunk's most frequent segments have the smallest numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers()
        found = segment_pattern(both.cut_characters()).findall
        nothing = np.empty(0, np.int32)
        number, docs_of, ids_of, chars, done = _Numbers(), [], [], 0, 0

        def schema(d: pa.DataType) -> list[tuple[str, pa.DataType]]:
            return [("chunk", pa.int64()), ("d", d), ("n", pa.int32()), ("ids", pa.binary()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("sizes", "texts", "local", "times"))]

        def flush() -> Iterator[pa.RecordBatch]:
            at, d = (TaskContext.get().partitionId() << 32) + done, pa.concat_arrays(docs_of)
            times = np.bincount(np.concatenate(ids_of), minlength=len(number))
            place = np.empty(len(times), np.int64)
            place[np.argsort(-times, kind="stable")] = np.arange(len(times))
            for lo in range(0, len(d), 1_000):
                own = ids_of[lo : lo + 1_000]
                rows = _table([{"chunk": at, "n": len(ids), "ids": _packed(place[ids])} for ids in own], schema(d.type))
                yield from rows.set_column(1, "d", d.slice(lo, len(own))).to_batches()
            texts = [s.encode() for s in number]
            bucket = np.fromiter(map(crc32, texts), np.int64, len(texts)) % buckets
            ids_of.clear()
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                some = [texts[i] for i in own.tolist()]
                row = {"chunk": at, "n": len(own), "bucket": int(bucket[own[0]]), "sizes": _packed(np.array([len(s) for s in some])), "texts": b"".join(some), "local": _packed(place[own]), "times": _packed(times[own])}
                yield from _table([row], schema(d.type)).to_batches()

        for batch in pieces(batches, 200):
            docs_of.append(batch.column(0))
            for t in batch.column(1).to_pylist():
                own = found(" " + t) if t and both.spelt(t) else ()
                ids_of.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)) if own else nothing)
                chars += len(t or "")
            if chars >= chunk:
                yield from flush()
                number, docs_of, ids_of, chars, done = _Numbers(), [], [], 0, done + 1
        if docs_of:
            yield from flush()

    small_batches(docs)
    return docs.select(F.col("doc_id").alias("d"), F.col(text).alias("t")).mapInArrow(run, _SPLIT.format(kind))


def _aligned(of_chunks: DataFrame, tokenizers, part: int = 20_000) -> DataFrame:
    """Of each bucket, rows for some of its segments at once, and for its pairs of tokens (pair, a, b, times).

    A segment has members: the chunks that hold it, with its number there. links: the pairs' numbers in the bucket;
    times: how many links hold the pair, over all documents that hold the bucket's segments.
    """
    schema = [(c, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in _BUCKETS.split(", "))]

    def run(table: pa.Table) -> pa.Table:
        both = tokenizers()
        bucket, number, member, chunk, local, times = table.column("bucket")[0].as_py(), _Numbers(), [], [], [], []
        for r in table.select(["chunk", "n", "sizes", "texts", "local", "times"]).to_pylist():
            cut = np.cumsum(_unpacked(r["sizes"], r["n"])).tolist()
            member += [number[r["texts"][lo:hi]] for lo, hi in zip([0, *cut], cut, strict=False)]
            chunk.append(np.full(r["n"], r["chunk"], np.int64))
            local.append(_unpacked(r["local"], r["n"]))
            times.append(_unpacked(r["times"], r["n"]))
        member, chunk, local = np.array(member), np.concatenate(chunk), np.concatenate(local)
        total = np.bincount(member, np.concatenate(times), len(number)).astype(np.int64)
        order = np.lexsort((chunk, member))
        first = np.searchsorted(member[order], np.arange(len(number) + 1))
        segments, pairs, weights, rows = list(number), _Numbers(), [], []
        sizes = np.array(both.a_size), np.array(both.b_size)
        for lo in range(0, len(segments), part):
            hi = min(lo + part, len(segments))
            x = Aligned(*zip(*both.encode([s.decode() for s in segments[lo:hi]]), strict=True), *sizes)
            keys, inverse = np.unique((x.links[:, 0] << 32) + x.links[:, 1], return_inverse=True)
            known = np.array([pairs[k] for k in keys.tolist()])
            weights.append((known, np.bincount(inverse, np.repeat(total[lo:hi], x.n_links), len(keys)).astype(np.int64)))
            own = order[first[lo] : first[hi]]
            rows.append({"own_bucket": bucket, "n": hi - lo, "n_a": _packed(x.n_a), "n_b": _packed(x.n_b), "ids": _packed(x.ids), "ends": np.packbits(x.ends).tobytes(), "members": _packed(np.diff(first[lo : hi + 1])), "chunks": chunk[own].tobytes(), "local": local[own].astype("<i8").tobytes(), "links": _packed(known[inverse])})
        n = np.zeros(len(pairs), np.int64)
        for k, w in weights:
            np.add.at(n, k, w)
        keys = np.array(list(pairs), np.int64)
        m = len(keys)
        facts = {"own_bucket": np.full(m, bucket, np.int32), "pair": np.arange(m, dtype=np.int32), "a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32), "times": n}
        return pa.concat_tables([_table(rows, schema), pa.table([pa.array(facts[c], k) if c in facts else pa.nulls(m, k) for c, k in schema], names=[c for c, _ in schema])])

    return of_chunks.groupBy("bucket").applyInArrow(run, _BUCKETS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (links that hold the pair, over all documents), best (whether b has no pair of a higher count)."""
    each = pairs.groupBy("a", "b").agg(F.sum("times").alias("count"))
    return each.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _spans(n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of arrays of so many elements, one behind the other, where those of own are."""
    size = n[own]
    return np.repeat((np.cumsum(n) - n)[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _returned(segs: pa.Table, facts: pa.Table) -> pa.Table:
    """A bucket's segments with n_best and count_sum, as arrays for each chunk that holds them."""
    facts = facts.sort_by("pair")
    best, count = facts.column("best").to_numpy().astype(np.int64), facts.column("count").to_numpy()
    out = []
    for r in segs.to_pylist():
        n_a, n_b, members = (_unpacked(r[c], r["n"]) for c in ("n_a", "n_b", "members"))
        size = n_a + n_b
        ids, ends = _unpacked(r["ids"], size.sum()), np.unpackbits(np.frombuffer(r["ends"], np.uint8), count=size.sum())
        groups = np.add.reduceat(ends, np.cumsum(size) - size, dtype=np.int64) // 2
        n_links = size - groups
        links = _unpacked(r["links"], n_links.sum())
        at = np.cumsum(n_links) - n_links
        n_best, count_sum = np.add.reduceat(best[links], at), np.add.reduceat(count[links], at)
        chunks, local = np.frombuffer(r["chunks"], "<i8"), np.frombuffer(r["local"], "<i8")
        of = np.repeat(np.arange(r["n"]), members)
        order = np.argsort(chunks, kind="stable")
        cut = np.flatnonzero(np.diff(chunks[order], prepend=chunks[order[0]] - 1))
        for rows in np.split(order, cut[1:]):
            own = of[rows]
            tokens = _spans(size, own)
            out.append({"back_chunk": int(chunks[rows[0]]), "n": len(own), "local": _packed(local[rows]), "n_a": _packed(n_a[own]), "n_b": _packed(n_b[own]), "ids": _packed(ids[tokens]), "ends": np.packbits(ends[tokens]).tobytes(), "best": _packed(n_best[own]), "counts": _packed(count_sum[own])})
    return _table(out, _BACK_SCHEMA)


_BACK = "back_chunk long, n int, local binary, n_a binary, n_b binary, ids binary, ends binary, best binary, counts binary"
_BACK_SCHEMA = [(c, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in _BACK.split(", "))]


def _dictionary(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """By number in the chunk: the sums of SUMS, and the groups as text."""
    k = pa.compute.sum(back.column("n")).as_py() or 0
    sums, texts = np.zeros((k, len(SUMS)), np.int64), np.empty(k, object)
    for r in back.to_pylist():
        n_a, n_b, local, best, counts = (_unpacked(r[c], r["n"]) for c in ("n_a", "n_b", "local", "best", "counts"))
        size = n_a + n_b
        ends = np.unpackbits(np.frombuffer(r["ends"], np.uint8), count=size.sum()).astype(bool)
        groups = np.add.reduceat(ends, np.cumsum(size) - size, dtype=np.int64) // 2
        sums[local] = np.stack([n_a, n_b, groups, size - groups, best, counts], 1)
        texts[local] = group_texts(_unpacked(r["ids"], size.sum()), ends, n_a, n_b)
    return sums, texts


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", chunk: int = CHUNK, bucket: int = BUCKET, groups: bool = True) -> DataFrame:
    """For each row its doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with groups these as text.

    A null or empty text, and one that some token sequence doesn't spell, has no tokens: zeros, empty groups and hash.
    Rows count one by one, so repeated rows count each; other columns are not read. Of a very long text only its own
    segments and numbers stand in memory, as the text itself does. chunk, bucket: characters of texts that share a chunk,
    and for which there is one bucket.
    """
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    tokenizers = lambda: _tokenizers(key, a_json, b_model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chars = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    split = settle(_chunks(docs, tokenizers, text, chunk, max(1, -(-chars // bucket))))
    aligned = settle(_aligned(split.where("bucket is not null").drop("d", "ids"), tokenizers))
    pairs = aligned.where("pair is not null").select("own_bucket", "pair", "a", "b", "times")
    known = pairs.drop("times").join(pair_counts(pairs), ["a", "b"]).select(F.col("own_bucket").alias("bucket"), "pair", "count", "best")
    segs = aligned.where("pair is null").drop("pair", "a", "b", "times")
    back = segs.groupBy("own_bucket").cogroup(known.groupBy("bucket")).applyInArrow(_returned, _BACK)

    def compose(one: pa.Table, back: pa.Table) -> pa.Table:
        sums, texts = _dictionary(back)
        total, joined, hashes = [], [], []
        for ids, n in zip(one.column("ids"), one.column("n").to_pylist(), strict=True):
            ids = _unpacked(ids.as_py(), n)
            total.append(sums[ids].sum(0))
            text = ";".join(texts[ids].tolist())
            hashes.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            if groups:
                joined.append(text)
        del texts
        give_back()
        total = np.array(total, np.int64).reshape(-1, len(SUMS))
        columns = [one.column("d"), *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(len(SUMS))], pa.array(hashes, pa.string()), *([pa.array(joined, pa.string())] if groups else [])]
        return pa.table(columns, names=["doc_id", *SUMS, "groups_sha256", *(["groups"] if groups else [])])

    out = split.where("bucket is null").select("chunk", "d", "n", "ids").groupBy("chunk").cogroup(back.groupBy("back_chunk"))
    return out.applyInArrow(compose, f"doc_id {kind}, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string" + ", groups string" * groups)


def op13_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return align_documents(docs, a_path, b_path, groups=False)
