"""Structural joins: which elements lie below others, from the places where elements begin and end.

Elements of a page are numbered in document order (pre), and an element's last descendant has the number post. So x lies
below a if a.pre < x.pre <= a.post. Intervals of a page nest or are disjoint, and all joins here are windows over rows in
the order of these places: nothing is paired, and rows grow with elements and questions, however deep pages are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def outermost(anchors: DataFrame, group: str) -> DataFrame:
    """Of the anchors (page_id, group, pre, post) of a group those that lie in no other."""
    w = Window.partitionBy("page_id", group).orderBy("pre").rowsBetween(*_BEFORE)
    return anchors.withColumn("_end", F.max("post").over(w)).where("_end is null or _end < pre").drop("_end")


def inside(anchors: DataFrame, rows: DataFrame, group: str, at: str = "at") -> DataFrame:
    """The rows (page_id, group, at, ...) whose place lies below an anchor (page_id, group, pre, post) of their group."""
    rest = [c for c in rows.columns if c not in ("page_id", group, at)]
    own = rows.select("page_id", group, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_post"), F.struct(*[F.col(c) for c in rest]).alias("_rest"))
    tops = anchors.select("page_id", group, F.col("pre").alias("_at"), F.lit(1).alias("_kind"), F.col("post").cast("int").alias("_post"), F.lit(None).cast(own.schema["_rest"].dataType).alias("_rest"))
    w = Window.partitionBy("page_id", group).orderBy("_at", "_kind").rowsBetween(*_BEFORE)
    found = own.union(tops).withColumn("_end", F.max("_post").over(w)).where("_kind = 0 and _end >= _at")
    return found.select("page_id", group, F.col("_at").alias(at), *[F.col(f"_rest.{c}").alias(c) for c in rest])


def counts_inside(anchors: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_id, q, n, first_nid: for pairs (page_id, q, a, b) how many members of b lie below an anchor of a.

    anchors: page_id, a, pre, post; members: page_id, b, at (where it counts as standing), nid. For each pair the fewer
    rows are moved: either the members look for anchors above them, or the anchors, of which only the outermost are
    needed, take the difference of two running counts of members. first_nid is right where members stand at their nid.
    """
    tops = outermost(anchors, "a")
    n_a, n_b = tops.groupBy("page_id", "a").agg(F.count("*").alias("_na")), members.groupBy("page_id", "b").agg(F.count("*").alias("_nb"))
    sized = pairs.join(n_a, ["page_id", "a"]).join(n_b, ["page_id", "b"])
    up, down = sized.where("_nb < _na").select("page_id", "q", "a", "b"), sized.where("_nb >= _na").select("page_id", "q", "a", "b")
    climbed = inside(tops, up.join(members, ["page_id", "b"]).select("page_id", "a", "at", "q", "nid"), "a").groupBy("page_id", "q").agg(F.count("*").alias("n"), F.min("nid").alias("first_nid"))

    nothing = F.lit(None).cast("int")
    ends = F.array(F.struct(F.col("pre").alias("at"), F.lit(-1).alias("sign"), F.col("post").alias("until")), F.struct(F.col("post").alias("at"), F.lit(1).alias("sign"), nothing.alias("until")))
    points = down.join(tops, ["page_id", "a"]).select("page_id", "q", "b", F.explode(ends).alias("e")).select("page_id", "b", "e.at", F.lit(1).alias("kind"), "q", "e.sign", "e.until", nothing.alias("nid"))
    stood = members.join(down.select("page_id", "b").distinct(), ["page_id", "b"], "left_semi").select("page_id", "b", "at", F.lit(0).alias("kind"), F.lit(None).cast(pairs.schema["q"].dataType).alias("q"), nothing.alias("sign"), nothing.alias("until"), F.col("nid").cast("int").alias("nid"))
    line = Window.partitionBy("page_id", "b")
    seen = F.count(F.when(F.col("kind") == 0, 1)).over(line.orderBy("at", "kind").rowsBetween(*_SO_FAR))
    behind = F.last(F.when(F.col("kind") == 0, F.struct("at", "nid")), ignorenulls=True).over(line.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(*_SO_FAR))
    counted = points.union(stood).withColumns({"seen": seen, "next": behind}).where("kind = 1")
    first = F.min(F.when((F.col("sign") == -1) & (F.col("next.at") <= F.col("until")), F.col("next.nid")))
    fallen = counted.groupBy("page_id", "q").agg(F.sum(F.col("sign") * F.col("seen")).alias("n"), first.alias("first_nid")).where("n > 0")
    return climbed.unionByName(fallen)
