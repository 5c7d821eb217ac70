"""Centroid clustering with Yinyang's filters, exact in integers.

Centroids are put into groups once. Each vector keeps an upper bound of the distance to its centroid and for each group
a lower bound of the distance to the group's other centroids. When centroids move, bounds move with them: a vector whose
upper bound is below all lower bounds is left alone (global filter), of the others only groups whose bound isn't above
the upper bound are looked at (group filter), and their centroids are scanned exactly.

Bounds are floats with a margin, distances are exact: vectors and centroids are integers. Each round is one job over the
vectors' table, which it writes again with the new bounds; only vectors that changed their centroid are read for the new
sums. The driver holds centroids and their sums, k times d numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, settle

#: Of a component's size: a squared distance of 64 components fits a long below it; sums of products are exact in doubles below EXACT.
MOST, EXACT = 1 << 27, 1 << 22
#: Bounds are wrong by far less than this share.
MARGIN = 1e-9


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def kept_vectors(rows: DataFrame, vector: str, size: int, scale: int = 1024) -> DataFrame:
    """Rows of exactly size components, none null or non-finite; a component of more than MOST / scale isn't kept either."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float(MOST) / scale)
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == size)).where(F.forall(vector, lambda x: F.coalesce(good(x), F.lit(False))))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all c, exact; both int64."""
    if x.size and c.size and max(np.abs(x).max(), np.abs(c).max()) < EXACT:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few plain rounds over the centroids themselves, from the first ones on."""
    c = centroids.astype(np.float64)
    groups = min(groups, len(c))
    middle, of = c[:groups].copy(), np.zeros(len(c), np.int64)
    for _ in range(rounds):
        of = ((c[:, None] - middle) ** 2).sum(2).argmin(1) if groups else of
        for g in set(of.tolist()):
            middle[g] = c[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def first_pass(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals), upper bound, lower bounds."""
    d = squared(x, c)
    own = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, own].astype(np.float64)) * (1 + MARGIN)
    rest = np.sqrt(d.astype(np.float64)) * (1 - MARGIN)
    rest[rows, own] = np.inf
    lower = np.stack([rest[:, group == g].min(1) for g in range(group.max() + 1)], 1)
    return own, upper, lower


def next_pass(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after centroids moved so far (float, rounded up), from the numbers and bounds before."""
    own, lower = own.copy(), lower - np.array([moved[group == g].max() for g in range(group.max() + 1)])
    upper = upper + moved[own]
    upper, lower = upper * (1 + MARGIN), lower * np.where(lower > 0, 1 - MARGIN, 1 + MARGIN)  # infinite ones stay so
    near = np.flatnonzero(lower.min(1) <= upper)  # global filter
    if len(near):
        exact = ((x[near] - c[own[near]]) ** 2).sum(1)
        upper[near] = np.sqrt(exact.astype(np.float64)) * (1 + MARGIN)
        still = lower[near].min(1) <= upper[near]
        near, exact = near[still], exact[still]
    if not len(near):
        return own, upper, lower
    before, tight = own[near].copy(), upper[near].copy()
    start, best, best_d = before, before.copy(), exact.copy()
    scanned = []
    for g in range(group.max() + 1):  # group filter
        open_ = np.flatnonzero(lower[near, g] <= tight)
        if not len(open_):
            continue
        members = np.flatnonzero(group == g)
        d = squared(x[near[open_]], c[members])
        scanned.append((g, open_, members, d))
        at = d.argmin(1)
        least = d[np.arange(len(at)), at]
        better = (least < best_d[open_]) | ((least == best_d[open_]) & (members[at] < best[open_]))
        best[open_[better]], best_d[open_[better]] = members[at[better]], least[better]
    own[near] = best
    upper[near] = np.sqrt(best_d.astype(np.float64)) * (1 + MARGIN)
    for g, open_, members, d in scanned:
        f = np.sqrt(d.astype(np.float64)) * (1 - MARGIN)
        f[members == best[open_][:, None]] = np.inf
        lower[near[open_], g] = f.min(1)
    changed = np.flatnonzero(best != start)  # the old centroid is one of its group's others now
    old = group[start[changed]]
    lower[near[changed], old] = np.minimum(lower[near[changed], old], np.sqrt(exact[changed].astype(np.float64)) * (1 - MARGIN))
    return own, upper, lower


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).reshape(-1)), m.shape[1]).cast(pa.list_(pa.from_numpy_dtype(m.dtype)))


def _assigned(state: DataFrame, id_type: str, c: np.ndarray, group: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """One pass over the vectors; before: the centroids of the last one."""
    moved = None if before is None else np.sqrt(((c - before) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 5_000):
            x = _matrix(batch.column(1), "int64")
            if moved is None:
                last = np.full(len(x), -1, np.int32)
                own, upper, lower = first_pass(x, c, group)
            else:
                last = batch.column(2).to_numpy().astype(np.int32)
                own, upper, lower = next_pass(x, last, batch.column(4).to_numpy(), _matrix(batch.column(5), "float64"), c, group, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x), pa.array(own.astype(np.int32)), pa.array(last), pa.array(upper), _lists(lower)], names=["id", "v", "own", "last", "upper", "lower"])

    columns = ("id", "v") if before is None else ("id", "v", "own", "last", "upper", "lower")
    return state.select(*columns).mapInArrow(run, f"id {id_type}, v array<long>, own int, last int, upper double, lower array<double>")


def _change(state: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """What each centroid's sum and count gain by the vectors that changed; k times d rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            x = np.hstack([_matrix(batch.column(0), "int64"), np.ones((batch.num_rows, 1), np.int64)])
            last = batch.column(2).to_numpy()
            np.add.at(total, batch.column(1).to_numpy(), x)
            np.subtract.at(total, last[last >= 0], x[last >= 0])
        at, pos = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(total[at, pos])], names=["own", "pos", "x"])

    gained = np.zeros((k, d + 1), np.int64)
    parts = state.where("own <> last").select("v", "own", "last").mapInArrow(run, "own int, pos int, x long")
    for r in parts.groupBy("own", "pos").agg(F.sum("x").alias("x")).collect():
        gained[r.own, r.pos] = r.x
    return gained[:, :d], gained[:, d]


def yinyang(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, groups: int | None = None, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Centroids start as the k vectors with the smallest sha256 of seed and id (equal ones: by components; a null id counts
    as empty text). Each round assigns all vectors to the nearest centroid (of equals the smaller number) and takes the
    floor of the means; a centroid without vectors stays. groups: of centroids, by default one for four of them.

    Rows that kept_vectors leaves out have no row; repeated rows count each. With fewer vectors than k there are fewer
    centroids; an empty table gives an empty result. Other columns are not read.
    """
    id_type = rows.schema[vec_id].dataType.simpleString()
    state = kept_vectors(rows, vector, size, scale).select(F.col(vec_id).alias("id"), integers(F.col(vector), scale).alias("v"))
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    c = np.array([r.v for r in state.orderBy(order, "v").select("v").limit(k).collect()], np.int64).reshape(-1, size)
    if not len(c):
        return state.select(F.col("id").alias(vec_id), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    group = grouped(c, groups or -(-len(c) // 4))
    sums, counts, before = np.zeros_like(c), np.zeros(len(c), np.int64), None
    for _ in range(rounds):
        state, old = settle(_assigned(state, id_type, c, group, before)), state if before is not None else None
        if old is not None:
            discard(old)
        more, n = _change(state, len(c), size)
        sums, counts, before = sums + more, counts + n, c
        c = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
    last = settle(_assigned(state, id_type, c, group, before))
    if before is not None:
        discard(state)
    state = last
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    own = F.lit([[int(y) for y in x] for x in c])[F.col("own")]
    distance = F.aggregate(F.zip_with("v", own, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, y: s + y)
    found = state.select("id", "own", distance.alias("distance"))
    total = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    inertia = {r.own: r.x for r in found.groupBy("own").agg(total.alias("x")).collect()}
    of = lambda values: F.lit(values)[F.col("own")]
    return found.select(
        F.col("id").alias(vec_id), F.col("own").alias("cluster"), "distance", of([inertia.get(i, 0) for i in range(len(c))]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), 2**63 - 1)).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"),
    )
