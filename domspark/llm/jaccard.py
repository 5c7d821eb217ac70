"""Documents linked by the Jaccard similarity of their sets of word shingles, exactly, and their components.

The product of the document by n-gram matrix with its transpose is never formed whole:

1. Equal sets become one row of the matrix (a node). All later steps are about nodes.
2. Every order of the n-grams has this property: two sets of similarity t or more have k n-grams in common among the
   first n - ceil(t n) + k of each. Ordered by their hash, that part of each set is shuffled once, n-grams that a batch
   of texts has twice as one row, and nodes with fewer than k n-grams found elsewhere are dropped.
3. Of the nodes left, n-grams are ordered by how many nodes have them, rare ones first. With k = 1, each node's first
   n-grams that others have are its postings; two linked nodes share one.
4. In each posting list all nodes are held against one hub, and linked ones joined into components. Then the nodes that
   aren't of a short list's main component are held against those of other components. Long lists that are still open
   (many alike texts just below the bound) are multiplied block by block inside tasks, which give out linked pairs only.
5. Overlaps accumulate over blocks of n-grams; a pair leaves as soon as what is left can't lift it to the bound that
   follows from the two sizes.

Only links between nodes of one component are left out; no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ByteType, LongType, StructField, StructType

from .common import by_key, pieces, scratch, settle, small_batches, whole_text
from .components import components
from .shingles import mix, shingle_sets

#: Ids of texts are sent to all tasks up to this many; beyond, they are joined by a shuffle.
MOST_SENT = 2_000_000
BLOCKS = 8
#: Rows that a task works on at once.
ROWS = 1_000
#: Rounds of hubs before the lists that are still open are held against each other.
TURNS = 2
#: Lists of more nodes are not paired by a join but multiplied in blocks of so many rows and columns.
LONG = 48
BLOCK_ROWS = 256
COLUMNS = 4096


def _at_least(n, num: int, den: int):
    """ceil(n * num / den) for integers, numpy or Python."""
    return -(-n * num // den)


def _k(n):
    return 1 + n // 10


def _node(grams: np.ndarray) -> np.ndarray:
    """One number for a set; 0 for the empty one."""
    return mix(np.add.reduce(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True)).view(np.int64)


def _sets(docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """In one pass over the texts: kind 0: a row's id, text hash, node and size; 1: an n-gram of a node; 2: n-grams of a node found twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            texts = batch.column(2).to_pylist()
            nodes, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            grams, owners, seen = [], [], set()
            for i, x in enumerate(shingle_sets(texts, k)):
                sizes[i] = n = len(x)
                if not n:
                    continue
                nodes[i] = _node(x)[0]
                if int(nodes[i]) not in seen:
                    seen.add(int(nodes[i]))
                    first = x[: min(n, n - _at_least(n, num, den) + _k(n))]
                    grams.append(first)
                    owners.append(np.full(len(first), nodes[i]))
            flat = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
            owner = np.concatenate(owners) if owners else flat
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
            twice = ~new
            twice[:-1] |= ~new[1:]
            # An n-gram that this batch has twice counts for its nodes at once; one row without a node stands for it elsewhere.
            once = new
            node = np.where(twice, 0, owner)[once]
            known, times = np.unique(owner[twice], return_counts=True)
            m, e, c = len(texts), int(once.sum()), len(known)
            kind = np.repeat(np.array([0, 1, 2], np.int8), (m, e, c))
            null = lambda n: pa.nulls(n, pa.int64())
            join = lambda *parts: pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p, pa.int64()) for p in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.concat_arrays([batch.column(0).cast(id_type), pa.nulls(e + c, id_type)]), join(batch.column(1), null(e + c)), join(nodes, node, known), join(sizes, null(e), times), join(null(m), flat[once], null(c))],
                names=["kind", "doc_id", "text_hash", "node", "n", "gram"],
            )

    t = whole_text()
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = StructType([StructField("kind", ByteType()), StructField("doc_id", kind), *(StructField(x, LongType()) for x in ("text_hash", "node", "n", "gram"))])
    return docs.select("doc_id", F.xxhash64(t).alias("h"), t.alias("t")).mapInArrow(run, schema)


def _shared_grams(postings: DataFrame) -> DataFrame:
    """node, n: how many n-grams of each node stand in another row too. A list has a row per batch of texts at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the last row: its n-gram, and its node if nobody has shared it yet

        def out(nodes: np.ndarray) -> pa.RecordBatch:
            node, times = np.unique(nodes[nodes != 0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(times, pa.int64())], names=["node", "n"])

        for batch in batches:
            g, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(g):
                continue
            same = g[1:] == g[:-1]
            hit = np.zeros(len(g), bool)
            hit[1:] |= same
            hit[:-1] |= same
            more = []
            if last is not None and g[0] == last:
                hit[0] = True
                if held is not None:
                    more.append(held)
            last, held = g[-1], None if hit[-1] else node[-1]
            yield out(np.concatenate([node[hit], np.array(more, np.int64)]))

    ordered = postings.select("gram", "node").repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "node long, n long")


def _matrix(docs: DataFrame, k: int) -> DataFrame:
    """node, n, grams of distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            sets = list(shingle_sets(batch.column(0).to_pylist(), k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(x)[0] if len(x) else 0 for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                names=["node", "n", "grams"],
            )

    return docs.mapInArrow(run, "node long, n long, grams array<long>")


def _linked(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v, nu, nv) whose sets are similar enough, from rows (node, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, ROWS):
            nu, nv = part.column(2).to_numpy(), part.column(3).to_numpy()
            # |A and B| / |A or B| >= num / den, that is overlap * (num + den) >= num * (|A| + |B|)
            bound = _at_least(nu + nv, num, num + den)
            alive = bound <= np.minimum(nu, nv)
            sides = []
            for c in (part.column(4), part.column(5)):
                owner = np.repeat(np.arange(part.num_rows), np.diff(c.offsets.to_numpy()))
                value = c.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sides.append((owner, value, (value >> np.uint64(64 - 3)).astype(np.int64)))
            left = [np.bincount(o, minlength=part.num_rows) for o, _, _ in sides]
            overlap = np.zeros(part.num_rows, np.int64)
            for block in range(BLOCKS):
                owners, values = [], []
                for j, (o, v, b) in enumerate(sides):
                    here = (b == block) & alive[o]
                    owners.append(o[here])
                    values.append(v[here])
                    left[j] = left[j] - np.bincount(o[here], minlength=part.num_rows)
                o, v = np.concatenate(owners), np.concatenate(values)
                order = np.lexsort((v, o))
                o, v = o[order], v[order]
                overlap += np.bincount(o[1:][(o[1:] == o[:-1]) & (v[1:] == v[:-1])], minlength=part.num_rows)
                alive &= overlap + np.minimum(*left) >= bound
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(alive)), part.column(1).filter(pa.array(alive))], names=["u", "v"])

    one = rows.select(F.col("node").alias("u"), F.col("grams").alias("gu"))
    two = rows.select(F.col("node").alias("v"), F.col("grams").alias("gv"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "gu", "gv").mapInArrow(run, "u long, v long")


def _ordered(a: str, b: str, na: str, nb: str) -> list:
    swap = F.col(a) > F.col(b)
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return [pick(a, b).alias("u"), pick(b, a).alias("v"), pick(na, nb).alias("nu"), pick(nb, na).alias("nv")]


def node_components(docs: DataFrame, num: int = 4, den: int = 5, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n, text_hash) of all rows, and (node, root) of the nodes that have links. num / den: the least similarity."""
    small_batches(docs)
    with scratch():
        found = settle(_sets(docs, num, den, k))
        rows = settle(found.where("kind = 0").select("doc_id", "text_hash", "node", "n"), outer=True)
        size = rows.count()
        shared = _shared_grams(found.where("kind = 1")).union(found.where("kind = 2").select("node", "n")).groupBy("node").agg(F.sum("n").alias("shared"))
        least = F.ceil(F.col("n") * num / den).cast("long")  # the least size of a partner, and k of that size
        texts = rows.where("n > 0").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"))
        texts = settle(texts.join(shared, "node").where(F.col("shared") >= 1 + F.floor(least / 10)).select("text_hash"), size)
        few = texts.count() <= MOST_SENT
        t = docs.select(F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("t"))
        t = t.join(F.broadcast(texts) if few else texts, "text_hash", "left_semi").dropDuplicates(["text_hash"])
        matrix = settle(_matrix(t.select("t"), k).dropDuplicates(["node"]), outer=True)

    entries = matrix.select("node", "n", F.explode("grams").alias("gram"))
    often = entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    prefix = F.col("n") - F.ceil(F.col("n") * num / den).cast("long") + 1
    rows_left = entries.join(often, "gram").groupBy("node", "n").agg(F.collect_list(F.struct("df", "gram")).alias("g"))
    # N-grams that no other node has come first in the order and take up their part of the prefix.
    rows_left = rows_left.withColumn("take", (prefix - (F.col("n") - F.size("g"))).cast("int")).where("take > 0")
    kept = settle(rows_left.select("node", "n", F.transform("g", lambda x: x["gram"]).alias("grams"), F.transform(F.slice(F.array_sort("g"), F.lit(1), F.col("take")), lambda x: x["gram"]).alias("first")))
    # A set that the others vary has the largest part of its n-grams in common with them, so it makes a good hub.
    postings = settle(kept.select("node", "n", (F.size("grams") / F.col("n")).alias("part"), F.explode("first").alias("gram")))

    fits = lambda a, b: (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)
    links = tried = root = None
    for turn in range(TURNS):
        # Lists that lie in one component are done. In the others all members are held against one of the main component.
        placed = _open_lists(postings, root)
        sizes = placed.groupBy("gram", "root").agg(F.count("*").alias("m"))
        choice = F.xxhash64(F.lit(turn), "gram", "node") if turn else F.struct("part", F.xxhash64("node"))
        hubs = placed.join(sizes, ["gram", "root"]).groupBy("gram").agg(F.max(F.struct("m", choice.alias("c"), "node", "n", "root")).alias("x"))
        hubs = hubs.select("gram", F.col("x.node").alias("hub"), F.col("x.n").alias("nh"), F.col("x.root").alias("rh"))
        pairs = placed.join(hubs, "gram").where((F.col("root") != F.col("rh")) & fits("n", "nh")).select(*_ordered("node", "hub", "n", "nh")).distinct()
        pairs = settle(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), 4 * size)
        new = settle(_linked(pairs, kept, num, den), 4 * size)
        tried = pairs if tried is None else tried.union(pairs)
        if turn and new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        root = components(links, size)

    # Short lists that are still open: members outside the main component against those of other components.
    placed = settle(_open_lists(postings, root), 8 * size)
    sizes = placed.groupBy("gram", "root").agg(F.count("*").alias("m"))
    main = settle(sizes.groupBy("gram").agg(F.max(F.struct("m", "root")).alias("x"), F.sum("m").alias("all")).select("gram", F.col("x.root").alias("main"), "all"), 4 * size)
    short = main.where(F.col("all") <= LONG)
    minor = placed.join(short, "gram").where("root <> main").select("gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "main")
    other = placed.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs = minor.join(other, "gram").where((F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))) & fits("na", "nb"))
    rest = pairs.select(*_ordered("a", "b", "na", "nb")).distinct().join(tried, ["u", "v"], "left_anti")
    more = _linked(rest, kept, num, den)

    # Long ones: lists with members in common form a family, whose rows are multiplied block by block.
    long = placed.join(main.where(F.col("all") > LONG).select("gram"), "gram")
    first = long.groupBy("gram").agg(F.min("node").alias("least"))
    ties = settle(long.join(first, "gram").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), size)
    if not ties.isEmpty():
        more = more.union(_family_links(components(ties, size), long.select("node", "root").distinct(), kept, num, den))
    more = settle(more, size)
    if more.isEmpty():
        return rows, root
    return rows, components(links.union(more), size)


def _family_links(family: DataFrame, place: DataFrame, kept: DataFrame, num: int, den: int) -> DataFrame:
    """Linked pairs of different components within each family (node, root)."""
    members = family.select("node", F.col("root").alias("family")).join(place, "node").join(kept.select("node", "n", "grams"), "node")
    blocks = family.groupBy(F.col("root").alias("family")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "n", "root", "grams")

    def product(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        block, n, root, node = (part[c].to_numpy() for c in ("block", "n", "root", "node"))
        grams = part["grams"].combine_chunks()
        owner = np.repeat(np.arange(len(n)), np.diff(grams.offsets.to_numpy()))
        _, column = np.unique(grams.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        row_a, row_b = np.full(len(n), -1), np.full(len(n), -1)
        row_a[left], row_b[right] = np.arange(len(left)), np.arange(len(right))
        bound = _at_least(n[left][:, None] + n[right][None, :], num, num + den)
        alive = (bound <= np.minimum(n[left][:, None], n[right][None, :])) & (root[left][:, None] != root[right][None, :])
        overlap = np.zeros(alive.shape, np.float32)
        remain = np.bincount(owner, minlength=len(n))
        # Overlaps accumulate over blocks of columns; it ends when no pair can reach its bound.
        for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            here = (column >= at) & (column < at + COLUMNS)
            o, c = owner[here], column[here] - at
            remain = remain - np.bincount(o, minlength=len(n))
            a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            in_a, in_b = row_a[o] >= 0, row_b[o] >= 0
            a[row_a[o[in_a]], c[in_a]] = 1
            b[row_b[o[in_b]], c[in_b]] = 1
            overlap += a @ b.T
            alive &= overlap + np.minimum(remain[left][:, None], remain[right][None, :]) >= bound
            if not alive.any():
                break
        x, y = np.nonzero(alive)
        u, v = node[left[x]], node[right[y]]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return dealt.groupBy("family", "i", "j").applyInArrow(product, "u long, v long").distinct()


def _open_lists(postings: DataFrame, root: DataFrame | None) -> DataFrame:
    """The postings with their component so far, of lists that several components share."""
    if root is None:
        placed = postings.withColumn("root", F.col("node"))
    else:
        placed = postings.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("gram")
    return placed.join(several, "gram")


#: Parts that the nodes of one component are dealt into, so that no task gets all of a large one.
SALTS = 64


def _named(least: DataFrame, root: DataFrame) -> DataFrame:
    """node, least: of each node (node, least) the least value of its component.

    Values are settled per node first, then per component and part; each component's least value goes to every part.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("part")
    linked = settle(least.join(root, "node").select("node", "root", part, "least"), root.count())
    of_part = linked.groupBy("root", "part").agg(F.min("least").alias("least"))
    of_root = of_part.groupBy("root").agg(F.min("least").alias("least"), F.collect_list("part").alias("parts")).select("root", F.explode("parts").alias("part"), "least")
    named = linked.select("node", "root", "part").join(of_root, ["root", "part"]).select("node", "least")
    return named.union(least.join(root, "node", "left_anti").select("node", "least"))


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for each row of docs (doc_id, text).

    A null or empty text, or one without words, has an empty set and no links. A text of fewer than k words is one
    shingle. Repeated rows are copies of each other. Null ids stay null and count as larger than others.
    """
    with scratch():
        rows, root = node_components(docs.select("doc_id", "text"), num, den, k)
        nodes = settle(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), rows.count())
        named = _named(nodes.select("node", "least"), root).withColumnRenamed("least", "component_id").join(nodes.select("node", "rows"), "node")
        size = rows.count()
        rows, named = settle(rows, size, outer=True), settle(named, size, outer=True)
    linked = by_key(rows.where("n > 0"), named, "node", "rows").select("doc_id", "n", "component_id")
    return linked.union(rows.where("n = 0").select("doc_id", "n", "doc_id")).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, num: int = 4, den: int = 5, k: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near copies: of each component the row of the least id stays.

    Of rows equal in id and text one stays; texts without words have no copies and stay.
    """
    with scratch():
        rows, root = node_components(docs.select("doc_id", "text"), num, den, k)
        key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
        nodes = settle(rows.where("n > 0").groupBy("node").agg(F.min(key).alias("least"), F.count("*").alias("rows")), rows.count())
        first = settle(_named(nodes.select("node", "least"), root).withColumnRenamed("least", "first").join(nodes.select("node", "rows"), "node"), rows.count())
        gone = by_key(rows.where("n > 0"), first, "node", "rows").where((F.col("text_hash") != F.col("first.text_hash")) | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
        size = rows.count()
        gone = settle(gone.select(F.xxhash64("doc_id", "text_hash").alias("gone")).distinct(), size, outer=True)
        twice = settle(rows.where("n > 0").groupBy(F.xxhash64("doc_id", "text_hash").alias("twice")).count().where("count > 1").select("twice"), size, outer=True)
    send = lambda ids: F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    row = F.xxhash64("doc_id", F.xxhash64(whole_text()))
    left = docs.withColumn("_row", row).join(send(gone), F.col("_row") == F.col("gone"), "left_anti")
    if not twice.isEmpty():
        repeated = left.join(send(twice), F.col("_row") == F.col("twice"), "left_semi").dropDuplicates(["_row"])
        left = left.join(send(twice), F.col("_row") == F.col("twice"), "left_anti").union(repeated)
    return left.select(*docs.columns)
