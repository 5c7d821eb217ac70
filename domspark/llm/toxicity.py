"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts (P) and texts of unknown label (U). With the class
prior pi and the logistic loss, the risk is pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1)): unlabelled texts count as
negative but for the share that the prior says is positive; when that part falls below zero, the step goes the other way.
Features of a text: its distinct words, and how many of them have each prefix of 3 to 6 letters.

The classifier is fitted on samples whose bounds are parameters (MOST_POSITIVE, MOST_UNLABELLED; rows are drawn by a
hash of their id); every row is scored from its whole text. Defined results: a null or empty text gets the score of no
words; without positive rows all texts get the prior (0 if there are no labels); null labels count as unlabelled;
repeated ids each get their score; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, scratch, settle, whole_text

BITS = 19
PREFIXES = (3, 4, 5, 6)
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000
LEAST_TEXTS = 5
LEAST_LIFT = 2.5
LEAST_SIGMAS = 4.0
_EDGE = ".,;:!?%$#&*|()[]{}\"'<>-_=/+"


def features(word: str) -> list[int]:
    """Hashed features of one word: itself and its prefixes."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(f"={word}".encode()) & mask, *[zlib.crc32(f"^{word[:k]}".encode()) & mask for k in PREFIXES if len(word) >= k]]


def distinct_words(text: str) -> set[str]:
    return {w.strip(_EDGE) for w in set(text.lower().split())} - {""}


def text_features(text: str, known: dict[str, list[int]]) -> np.ndarray:
    out: list[int] = []
    for w in distinct_words(text):
        if w not in known:
            if len(known) > 200_000:
                known.clear()
            known[w] = features(w)
        out += known[w]
    return np.asarray(out, np.int64)


def clear_features(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features that confirmed texts have clearly more often than others: beyond LEAST_LIFT times, and beyond chance.

    p, u: how many of the n_p confirmed and of the n_u unlabelled texts have each feature.
    """
    in_p, in_u = p / n_p, u / n_u
    chance = np.sqrt((in_u + 1 / n_u) / n_p)
    return np.flatnonzero((p >= LEAST_TEXTS) & (in_p >= LEAST_LIFT * in_u) & (in_p - in_u >= LEAST_SIGMAS * chance))


def risk(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores z, and the direction in which a step changes them: its gradient, but where the part
    that may not be negative is, the gradient of that part turned round."""
    n_p, n_u = int(is_p.sum()), int((~is_p).sum())
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    negative, positive = np.logaddexp(0, z), np.logaddexp(0, -z)  # the losses of calling a text negative, positive
    excess = negative[~is_p].mean() - prior * negative[is_p].mean()
    good = np.where(is_p, prior * (s - 1) / n_p, 0)
    bad = np.where(is_p, -prior * s / n_p, s / n_u)
    return prior * positive[is_p].mean() + max(0.0, excess), good + bad if excess >= 0 else -bad


def train(texts: list[np.ndarray], is_p: np.ndarray, prior: float, features: int, steps: int = 150, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept that lower the risk, by Adam over all rows at once. texts: the places of each one's features."""
    theta, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    flat = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    for step in range(1, steps + 1):
        _, g = risk(np.bincount(owner, theta[flat], minlength=len(texts)) + bias, is_p, prior)
        grad, grad_b = np.bincount(flat, g[owner], minlength=features) + decay * theta, g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b * grad_b
        a, b = 1 - 0.9**step, 1 - 0.999**step
        # Each feature kept is evidence for toxicity, so none may count against it.
        theta = np.maximum(theta - rate * (m / a) / (np.sqrt(v / b) + 1e-8), 0)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return theta, bias


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[np.ndarray, float]:
    """Train from the rows whose crc32(doc_id) modulo 4 isn't 2.

    The features of the samples are counted by tasks, and only those that are used come to the driver, so that what it
    gets does not depend on how long the texts are.
    """
    spark = docs.sparkSession
    learn = labels.where(fold(F.col("doc_id"), 4) != 2)
    n_all, n_p = learn.agg(F.count("toxic"), F.sum(F.col("toxic").cast("int"))).first()
    if not n_p:
        return np.zeros(1 << BITS), -30.0
    prior = min(max(n_p / n_all, 1e-4), 0.9)
    n_u = docs.count()
    lot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    share = lambda most, n: F.lit(int(1e6 * min(1.0, most / max(n, 1))))
    # The limit makes the bound of the broadcast certain; the hash alone meets it on average.
    chosen = learn.where((F.col("toxic") == 1) & (lot < share(MOST_POSITIVE, n_p))).select(F.col("doc_id").alias("_id")).distinct().limit(2 * MOST_POSITIVE)
    rows = docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", whole_text(text).alias("t"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left").withColumn("u", lot < share(MOST_UNLABELLED, n_u))
    rows = rows.where("_id is not null or u").select("doc_id", F.col("_id").isNotNull().alias("p"), "u", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            x = [text_features(t.as_py(), known).astype(np.int32).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), b.column(2), pa.array(x, pa.binary())], names=["doc_id", "p", "u", "x"])

    with scratch():
        # One row for each id drawn: the samples' bounds hold however often an id is repeated.
        sample = rows.mapInArrow(run, "doc_id string, p boolean, u boolean, x binary").groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"), F.max("x").alias("x"))
        sample = settle(sample, n_p + MOST_UNLABELLED)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, 1 << BITS), np.int64)
            for b in batches:
                for p, u, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    own = np.frombuffer(x, np.int32)  # a feature that a text has several times counts once here
                    n[0, own] += p
                    n[1, own] += u
            at = np.flatnonzero(n.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], names=["feature", "p", "u"])

        many_p, many_u = sample.agg(F.count(F.when(F.col("p"), 1)), F.count(F.when(F.col("u"), 1))).first()
        if not many_p or not many_u:
            return np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
        counts = sample.select("p", "u", "x").mapInArrow(count, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        counts = counts.where(F.col("p") >= LEAST_TEXTS).toArrow()
        at = counts["feature"].to_numpy()
        used = np.sort(at[clear_features(counts["p"].to_numpy(), counts["u"].to_numpy(), many_p, many_u)])
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        shared = spark.sparkContext.broadcast(place)  # 2 ** BITS numbers

        def only_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [shared.value[np.frombuffer(x, np.int32)] for x in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([o[o >= 0].tobytes() for o in own], pa.binary())], names=["doc_id", "p", "u", "x"])

        found = sample.mapInArrow(only_used, "doc_id string, p boolean, u boolean, x binary").toArrow().to_pandas().sort_values("doc_id")
    read = lambda which: [np.frombuffer(x, np.int32) for x in found.loc[found[which], "x"]]
    positive, unlabelled = read("p"), read("u")
    theta, bias = train([*positive, *unlabelled], np.arange(len(positive) + len(unlabelled)) < len(positive), prior, len(used))
    out = np.zeros(1 << BITS)
    out[used] = theta
    return out, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """For each row its doc_id and the probability that it is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        known: dict[str, float] = {}
        for b in batches:
            out = []
            for t in b.column(1):
                z = bias
                for word in distinct_words(t.as_py()):
                    if word in known:
                        z += known[word]
                    else:
                        if len(known) > 400_000:
                            known.clear()
                        x = known[word] = float(w[features(word)].sum())
                        z += x
                out.append(z)
            p = 1 / (1 + np.exp(-np.clip(np.asarray(out), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), whole_text(text).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")


def op10_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score(docs, *fit(docs, labels.select("doc_id", "toxic")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
