"""Language-model scoring by a lattice of pieces.

A word is a path from its first to its last byte; an arc is a piece of an existing vocabulary (or one byte), and its
weight the piece's log probability. All segmentations count: the forward recursion sums them in log space, so that the
result is the word's marginal probability; at each word's end stands an end piece. Weights start from the vocabulary's
own order and are re-estimated by expected counts (forward and backward), each time over all words that training texts
have: first for all classes together, at last for each class.
A word seen in training also has one arc for its whole, weighted by its discounted count; the discounts' mass is the
weight of entering the pieces. All this is learned for each of the most frequent values of lang (others and null
together), and a text's marginal probability is the sum over these classes, by their share of training texts, of the
product over its words and its end. A text's own lang is no input of its score. lattice_score is what the vocabulary's
pieces alone give, without arcs for whole words, each word by the classes' shares.

Defined results: a null or empty text has one token, the end. Repeated rows each get their result (rows with the same id
and text are told apart by their number only; the text is known by a digest of 128 bits). Null ids count as the empty string for the training fold. Other columns
are not read. Without training texts, words get the pieces' probability alone.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, settle, whole_text

#: Re-estimations of the piece weights for all classes together.
ROUNDS = 4
#: Classes besides the one for the rest.
MOST_CLASSES = 6
#: So many words at most are sent to all tasks; the others' weights are joined.
MOST_SENT = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CELLS = 300_000


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces for lower-cased words, and log probabilities that fall with their place in the vocabulary's order.

    A piece at the start of a word keeps its mark, U+2581. All single bytes are pieces. The last one is the word's end.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        b = piece.encode()
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or b != b.lower() or "▁" in piece[1:]:
            continue
        found[b] = 1 / (10 + max(0.0, -model.get_score(i)))
    for b in range(256):
        found.setdefault(bytes([b]), 1e-6)
    pieces = [*found, b""]
    weight = np.array([*found.values(), sum(found.values()) / 4])
    return pieces, np.log(weight / weight.sum())


class Lattice:
    """Finds pieces in many words at once by rolling hashes. log_p: the pieces' weights in each class."""

    def __init__(self, pieces: list[bytes], log_p: list[np.ndarray]):
        self.pieces, self.log_p = pieces, log_p
        hashes = np.array([self._hash(p) for p in pieces[:-1]], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(hashes)] = True
        self.longest = max(map(len, pieces))
        self.power = np.ones(self.longest + 1, np.uint64)
        for i in range(self.longest):
            self.power[i + 1 : i + 2] = self.power[i : i + 1] * _BASE

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)

    @staticmethod
    def _hash(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * int(_BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in words, their bytes as a matrix, and their lengths; words of a batch are about equally long."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        at = 0
        while at < len(order):
            n = max(1, _CELLS // max(1, int(lengths[order[min(len(order) - 1, at + _CELLS // 8)]]) + 3))
            take = order[at : at + n]
            size = lengths[take]
            take = take[: np.searchsorted(size, size[0] + size[0] // 2 + 4, "right")]  # no padding to a few long words
            size = size[: len(take)]
            width = int(size.max(initial=0))
            cells = starts[take][:, None] + np.arange(width)
            inside = np.arange(width) < size[:, None]
            matrix = np.where(inside, flat[np.minimum(cells, max(len(flat) - 1, 0))] if len(flat) else 0, 0).astype(np.uint8)
            yield take, matrix, size
            at += len(take)

    def _arcs(self, matrix: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each piece length the piece at each place, or -1; words begin with the mark U+2581."""
        n = len(matrix)
        w = np.concatenate([np.broadcast_to(np.frombuffer("▁".encode(), np.uint8), (n, 3)), matrix], axis=1)
        size = size + 3
        width = w.shape[1]
        h = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            h[:, j + 1] = h[:, j] * _BASE + (w[:, j].astype(np.uint64) + np.uint64(1))
        out = []
        for k in range(1, min(self.longest, width) + 1):
            key = h[:, k:] - h[:, :-k] * self.power[k]
            hit = self.maybe[self._slot(key)]
            hit &= np.arange(width - k + 1) + k <= size[:, None]
            piece = np.full(key.shape, -1, np.int32)
            where = np.flatnonzero(hit)
            got = key.ravel()[where]
            place = np.minimum(np.searchsorted(self.hashes, got), len(self.hashes) - 1)
            same = self.hashes[place] == got
            piece.ravel()[where[same]] = self.order[place[same]]
            out.append(piece)
        return out, size

    def _forward(self, arcs: list[np.ndarray], size: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        n, width = len(size), arcs[0].shape[1]
        weights = [np.where(a >= 0, log_p[a], -np.inf) for a in arcs]
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width + 1):
            terms = np.stack([alpha[:, j - k] + weights[k - 1][:, j - k] for k in range(1, min(len(arcs), j) + 1)])
            top = terms.max(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha[:, j] = np.where(np.isfinite(top), top + np.log(np.exp(terms - top).sum(axis=0)), -np.inf)
        return alpha, weights

    def _short(self, matrix: np.ndarray, log_p: np.ndarray) -> bool:
        """Whether no path through words of this width is too small for a double, so that no logarithms are needed."""
        return (matrix.shape[1] + 3) * -log_p.min() < 650

    def _sparse(self, matrix: np.ndarray, size: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For each piece length with arcs: the length, where the arcs of each place begin, and their words and pieces, places first."""
        n = len(matrix)
        w = np.concatenate([np.broadcast_to(np.frombuffer("▁".encode(), np.uint8)[:, None], (3, n)), matrix.T])
        size = size + 3
        width = len(w)
        h = np.zeros((width + 1, n), np.uint64)
        for j in range(width):
            h[j + 1] = h[j] * _BASE + (w[j].astype(np.uint64) + np.uint64(1))
        out = []
        for k in range(1, min(self.longest, width) + 1):
            key = h[k:] - h[:-k] * self.power[k]
            hit = self.maybe[self._slot(key)]
            hit &= (np.arange(width - k + 1) + k)[:, None] <= size
            where = np.flatnonzero(hit)
            got = key.ravel()[where]
            place = np.minimum(np.searchsorted(self.hashes, got), len(self.hashes) - 1)
            same = self.hashes[place] == got
            where = where[same]
            if len(where):
                out.append((k, np.searchsorted(where, np.arange(width - k + 2) * n), where % n, self.order[place[same]]))
        return out, size

    def _forward_short(self, arcs: list, n: int, width: int, log_p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """As _forward, without logarithms, places first; arcs as from _sparse."""
        p = np.exp(log_p)
        weights = [p[piece] for _, _, _, piece in arcs]
        alpha = np.zeros((width + 1, n))
        alpha[0] = 1
        for j in range(width):
            for (k, begin, word, _), w in zip(arcs, weights, strict=True):
                if j + k <= width and begin[j] < begin[j + 1]:  # each word has one arc of a length from a place
                    here = slice(begin[j], begin[j + 1])
                    alpha[j + k][word[here]] += alpha[j][word[here]] * w[here]
        return alpha, weights

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The marginal log10 probability of each word in each class, its end piece included."""
        out = np.zeros((len(self.log_p), len(words)))
        for take, matrix, size in self._batches(words):
            short = all(self._short(matrix, log_p) for log_p in self.log_p)
            arcs, size = self._sparse(matrix, size) if short else self._arcs(matrix, size)
            for log_p, row in zip(self.log_p, out, strict=True):
                if short:
                    alpha, _ = self._forward_short(arcs, len(take), matrix.shape[1] + 3, log_p)
                    row[take] = np.log10(alpha[size, np.arange(len(take))]) + log_p[-1] / math.log(10)
                    continue
                alpha, _ = self._forward(arcs, size, log_p)
                row[take] = (alpha[np.arange(len(take)), size] + log_p[-1]) / math.log(10)
        return out

    def expected(self, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, over all segmentations by their probability."""
        return self.expected_in(words, np.ones((1, len(words)), bool), log_p)[0]

    def expected_in(self, words: list[bytes], member: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """The same for several sets of words at once; member: a row for each set, a column for each word."""
        counts = np.zeros((len(member), len(self.pieces)))
        for take, matrix, size in self._batches(words):
            counts[:, -1] += member[:, take].sum(axis=1)
            n, width = len(size), matrix.shape[1] + 3
            if self._short(matrix, log_p):
                arcs, size = self._sparse(matrix, size)
                alpha, weights = self._forward_short(arcs, n, width, log_p)
                beta = (np.arange(width + 1)[:, None] == size).astype(float)
                beta /= alpha[size, np.arange(n)]
                for j in range(width - 1, -1, -1):
                    for (k, begin, word, piece), w in zip(arcs, weights, strict=True):
                        if j + k <= width and begin[j] < begin[j + 1]:
                            here = slice(begin[j], begin[j + 1])
                            own = word[here]
                            step = w[here] * beta[j + k][own]
                            beta[j][own] += step
                            w[here] = step * alpha[j][own]  # from now on the arc's share
                for (_, _, word, piece), share in zip(arcs, weights, strict=True):
                    own = take[word]
                    for z, of in enumerate(member):
                        counts[z] += np.bincount(piece, share * of[own], minlength=counts.shape[1])
                continue
            arcs, size = self._arcs(matrix, size)
            alpha, weights = self._forward(arcs, size, log_p)
            beta = np.full((n, width + 1), -np.inf)
            total = alpha[np.arange(n), size]
            for j in range(width, -1, -1):
                ends = np.where(size == j, 0.0, -np.inf)
                if j < width:
                    terms = np.stack([ends, *[weights[k - 1][:, j] + beta[:, j + k] for k in range(1, min(len(arcs), width - j) + 1)]])
                    top = terms.max(axis=0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ends = np.where(np.isfinite(top), top + np.log(np.exp(terms - top).sum(axis=0)), -np.inf)
                beta[:, j] = ends
            for k, (a, w) in enumerate(zip(arcs, weights, strict=True), 1):
                hit = a >= 0
                share = np.exp((alpha[:, : a.shape[1]] + w + beta[:, k : k + a.shape[1]] - total[:, None])[hit])
                piece, row = a[hit], take[np.nonzero(hit)[0]]
                for z, of in enumerate(member):
                    counts[z] += np.bincount(piece, share * of[row], minlength=counts.shape[1])
        return counts


def class_names(docs: DataFrame) -> tuple[list[str], list[float]]:
    """The most frequent values of lang among training texts, and the share of each and of the rest (if there are any), smoothed."""
    found = docs.where("not held_out").groupBy("lang").count()
    rows = [r for r in found.where("lang is not null").orderBy(F.desc("count"), "lang").limit(MOST_CLASSES).collect()]
    total = found.agg(F.sum("count")).first()[0] or 0
    names = [r["lang"] for r in rows]
    rest = total - sum(r["count"] for r in rows)
    n = [*(r["count"] for r in rows), *([rest] if rest or not rows else [])]
    return names, [(x + 0.5) / (total + 0.5 * len(n)) for x in n]


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """word, n (in all texts), c0, c1, ... (in training texts of each class); the end of a text is the empty word.

    docs: t, the class, or -1 outside of training.
    """
    names = ["word", "n", *(f"c{z}" for z in range(classes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter[bytes]] = [Counter() for _ in range(classes + 1)]  # the last one for texts outside of training

        def flush() -> Iterator[pa.RecordBatch]:
            for z, of in enumerate(counts):
                n = pa.array([*of.values()], pa.int64())
                nothing = pa.array(np.zeros(len(of), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([*of], pa.binary()), n, *(n if y == z else nothing for y in range(classes))], names=names)
                of.clear()

        for b in batches:
            for t, z in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts[z].update(t.as_py().encode().lower().split())
                counts[z][b""] += 1
            if sum(map(len, counts)) > 1_500_000:
                yield from flush()
        yield from flush()

    schema = ", ".join(["word binary", *(f"{x} long" for x in names[1:])])
    return docs.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(x).alias(x) for x in names[1:]])


def piece_weights(words: DataFrame, pieces: list[bytes], log_p: np.ndarray) -> list[np.ndarray]:
    """One re-estimation of the pieces' log probabilities for each class.

    words: word and one column for each class, which says whether the word counts there; all words count that are in any.
    """
    classes = len(words.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, [log_p])
        total = np.zeros((classes, len(pieces)))
        for b in batches:
            member = np.stack([b.column(1 + z).to_numpy(zero_copy_only=False) for z in range(classes)]).astype(bool)
            total += lattice.expected_in(b.column(0).to_pylist(), member, log_p)
        z, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(at), pa.array(total[z, at])], names=["z", "piece", "n"])

    got = words.mapInArrow(run, "z long, piece long, n double").groupBy("z", "piece").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((classes, len(pieces)), 0.1)  # no piece becomes impossible
    counts[got.z.to_numpy(np.int64), got.piece.to_numpy(np.int64)] += got.n.to_numpy()
    return list(np.log(counts / counts.sum(axis=1, keepdims=True)))


def learned_weights(words: DataFrame, pieces: list[bytes], log_p: np.ndarray, classes: int) -> list[np.ndarray]:
    """ROUNDS re-estimations over all distinct training words, and one over those of each class."""
    counts = [F.col(f"c{z}") > 0 for z in range(classes)]
    seen = words.where((F.col("word") != F.lit(b"")) & reduce(or_, counts))
    for _ in range(ROUNDS):
        log_p = piece_weights(seen.select("word", F.lit(True).alias("c")), pieces, log_p)[0]
    return piece_weights(seen.select("word", *[c.alias(f"c{z}") for z, c in enumerate(counts)]), pieces, log_p)


class Discounts:
    """Of one class: what counts of one, two and more lose, and the weight of entering the pieces."""

    def __init__(self, total: int, ends: int, ones: int, twos: int, threes: int, fours: int, more: int):
        n1, n2, n3, n4 = (max(1, x) for x in (ones, twos, threes, fours))
        y = n1 / (n1 + 2 * n2)
        self.cut = [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        lost = self.cut[0] * ones + self.cut[1] * twos + self.cut[2] * more
        # One more end is counted, and where no word was seen the pieces count as one.
        self.total = total + 1 + (total == ends)
        self.free = (lost + (total == ends)) / self.total
        self.end = math.log10((ends + 1) / self.total)

    def weight(self, c: Column, pieces: Column, is_word: Column) -> Column:
        own = (c - F.when(c == 1, self.cut[0]).when(c == 2, self.cut[1]).otherwise(self.cut[2])) / self.total
        through = math.log10(self.free) + pieces
        return F.when(~is_word, F.lit(self.end)).when(c == 0, through).otherwise(F.log10(own + F.pow(F.lit(10.0), through)))


def _log10_sum(logs: list[Column]) -> Column:
    """The logarithm of the sum of what logs are logarithms of."""
    best = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in logs), F.lit(0.0)))


def op1_lattice_likelihood(docs: DataFrame, path: str) -> DataFrame:
    docs = docs.select("doc_id", "lang", whole_text().alias("t"), (fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    names, share = class_names(docs)
    classes = range(len(share))
    z = F.when(F.col("held_out"), -1)
    for i, name in enumerate(names):
        z = z.when(F.col("lang") == name, i)
    pieces, log_p = read_pieces(path)
    counted = settle(count_words(docs.select("t", z.otherwise(len(names)).alias("z")), len(share)))
    weights = learned_weights(counted, pieces, log_p, len(share))
    in_class = ", ".join(f"c{i} long" for i in classes)
    by_pieces = ", ".join(f"p{i} float" for i in classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, weights)
        for b in batches:
            found = lattice.log10(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x.astype(np.float32)) for x in found)], names=[*b.schema.names, *(f"p{i}" for i in classes)])

    words = settle(counted.mapInArrow(run, f"word binary, n long, {in_class}, {by_pieces}"))
    discard(counted)
    is_word = F.col("word") != F.lit(b"")
    c = sum((F.col(f"c{i}") for i in classes), F.lit(0))
    sums = words.agg(
        F.sum(c).alias("N"), F.count(F.when(c > 0, 1)).alias("V"),
        *[f for i in classes for x in [F.col(f"c{i}")] for f in (
            F.sum(x).alias(f"total{i}"), F.sum(F.when(~is_word, x)).alias(f"ends{i}"),
            *[F.count(F.when(is_word & (x == k), 1)).alias(f"n{k}_{i}") for k in (1, 2, 3, 4)], F.count(F.when(is_word & (x > 2), 1)).alias(f"more{i}"))],
    ).first().asDict()
    total, distinct = sums["N"] or 0, sums["V"]
    spelt = [F.when(is_word, F.col(f"p{i}").cast("double")).otherwise(F.lit(float(weights[i][-1]) / math.log(10))) + math.log10(share[i]) for i in classes]
    weighed = words.select(
        "word", "n", _log10_sum(spelt).alias("l"), F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1))).alias("b"), (c > 0).cast("int").alias("k"),
        *[Discounts(*(sums[f"{x}{i}"] or 0 for x in ("total", "ends", "n1_", "n2_", "n3_", "n4_", "more"))).weight(F.col(f"c{i}"), F.col(f"p{i}").cast("double"), is_word).alias(f"w{i}") for i in classes],
    )
    values = ["k", "b", "l", *(f"w{i}" for i in classes)]

    # The words that occur most go to all tasks: as many as MOST_SENT allows, by steps of their count's logarithm.
    step = F.floor(8 * F.log2("n"))
    histogram = sorted(weighed.groupBy(step.alias("s")).count().collect(), reverse=True)
    least, sent = 1 << 30, 0
    for s, n in histogram:
        sent += n
        if sent > MOST_SENT:
            break
        least = s
    often = weighed.where(step >= least).select("word", *values).toArrow()
    frequent = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(often["word"].to_pylist())}, np.stack([often[x].to_numpy().astype(np.float64) for x in values], axis=1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table = frequent.value
        for batch in batches:
            at, key, word, tf, n, heads, sums = [], [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                raw = t.as_py().encode()
                h = hashlib.blake2b(raw, digest_size=16).digest()
                seen = Counter(raw.lower().split())
                seen[b""] += 1
                index = [place.get(x, -1) for x in seen]
                times = np.fromiter(seen.values(), np.int64, len(seen))
                index = np.asarray(index)
                sums.append(times[index >= 0] @ table[index[index >= 0]])
                rest = [(x, m) for (x, m), j in zip(seen.items(), index, strict=True) if j < 0]
                # A row's head joins nothing: no word holds a blank.
                heads.append(len(at))
                at += [i] * (len(rest) + 1)
                key += [h] * (len(rest) + 1)
                word += [b" %d " % i + h, *(x for x, _ in rest)]
                tf += [0, *(m for _, m in rest)]
                n.append(seen.total())
            index = pa.array(at, pa.int64())
            own = np.full(len(at), -1)
            own[heads] = np.arange(len(heads))
            own = pa.array(own, mask=own < 0)
            sums = np.array(sums).reshape(len(n), len(values))
            columns = [batch.column(0).take(index), pa.array(key, pa.binary()), batch.column(2).take(index), pa.array(word, pa.binary()), pa.array(tf, pa.int64()), pa.array(n, pa.int64()).take(own), *(pa.array(sums[:, j]).take(own) for j in range(len(values)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "held_out", "word", "tf", "tokens", *values])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "t", "held_out").mapInArrow(score, f"doc_id {kind}, h binary, held_out boolean, word binary, tf long, tokens long, " + ", ".join(f"{x} double" for x in values))
    rare = weighed.where(step < least).select(F.col("word").alias("_word"), *[F.col(x).alias(f"_{x}") for x in values])
    joined = parts.join(rare, F.col("word") == F.col("_word"), "left")
    rows = joined.groupBy("doc_id", "h", "held_out").agg(F.count("tokens").alias("rows"), F.sum("tokens").alias("n"), *[F.sum(F.coalesce(F.col(x), F.col("tf") * F.col(f"_{x}"))).alias(x) for x in values])
    each = rows.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    part = [F.col(f"w{i}") / F.col("rows") + math.log10(share[i]) for i in classes]
    return each.select("doc_id", "held_out", F.expr("n div rows").alias("n_tokens"), F.round(F.col("k") / F.col("rows")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("b") / F.col("rows")).alias("base_score"), _log10_sum(part).alias("score"), (F.col("l") / F.col("rows")).alias("lattice_score"))
