"""Places, absolute paths and the order of the scan, from parent edges alone.

What an element has from all of its ancestors is put together by doubling: each element knows what it has up to some
ancestor and who that is, and takes over what that one knows. So n levels take log2(n) joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, settle_large


def places(edges: DataFrame) -> DataFrame:
    """edges (page_id, nid, parent, scope, tag, ...) with sib_idx, tag_idx and tag_cnt among the children of one element, or of one shadow root."""
    of = Window.partitionBy("page_id", "parent", "scope")
    of_tag = Window.partitionBy("page_id", "parent", "scope", "tag")
    return edges.withColumns({"sib_idx": F.row_number().over(of.orderBy("nid")) - 1, "tag_idx": F.row_number().over(of_tag.orderBy("nid")), "tag_cnt": F.count("*").over(of_tag).cast("int")})


def from_above(rows: DataFrame, value: str, up: str, join: Callable[[Column, Column], Column]) -> DataFrame:
    """rows (page_id, nid, value, up) with the values of all ancestors put before each value: join(upper, own).

    up: the next one above, null at the top. The tables between the steps are written, and deleted when they are used.
    """
    state = settle_large(rows)
    while not state.where(F.col(up).isNotNull()).isEmpty():
        above = state.select("page_id", F.col("nid").alias(up), F.col(value).alias("_upper"), F.col(up).alias("_next"))
        whole = state.join(above, ["page_id", up], "left").withColumns({value: F.when(F.col(up).isNull(), F.col(value)).otherwise(join(F.col("_upper"), F.col(value))), up: F.col("_next")})
        new = settle_large(whole.select(*rows.columns))
        discard(state)
        state = new
    return state


def absolute_paths(edges: DataFrame) -> DataFrame:
    """page_id, nid, path of elements (page_id, nid, parent, scope, tag): tags with places above one; a shadow tree's begin at its root."""
    step = F.concat(F.lit("/"), "tag", F.when(F.col("tag_idx") > 1, F.concat(F.lit("["), F.col("tag_idx").cast("string"), F.lit("]"))).otherwise(""))
    rows = places(edges).select("page_id", "nid", step.alias("path"), F.when(F.col("parent").isNotNull(), F.col("parent")).alias("up"))
    return from_above(rows, "path", "up", lambda upper, own: F.concat(upper, own)).select("page_id", "nid", "path")


def scan_order(edges: DataFrame) -> DataFrame:
    """page_id, nid, scan_seq of elements (page_id, nid, parent, scope, tag): when a scan by a queue comes to each.

    The scan puts behind each element its shadow tree, its first child and its next sibling. So an element's turn is the
    number of such steps that lead to it, and of equal turns the one is first whose way parts earlier: into a shadow tree
    before children, to children before siblings. Shadow trees' elements have their host as scope and none as parent.
    """
    shadow = F.col("parent").isNull() & (F.col("scope") >= 0)
    way = F.array(F.struct(F.when(shadow, 0).otherwise(1).alias("into"), F.col("sib_idx").alias("at")))
    rows = places(edges).select("page_id", "nid", F.when(shadow, F.col("scope")).otherwise(F.col("parent")).alias("up"), F.struct((1 + F.col("sib_idx") + shadow.cast("int")).alias("turn"), way.alias("way")).alias("order"))
    whole = from_above(rows, "order", "up", lambda upper, own: F.struct((upper["turn"] + own["turn"]).alias("turn"), F.concat(upper["way"], own["way"]).alias("way")))
    return whole.select("page_id", "nid", F.row_number().over(Window.partitionBy("page_id").orderBy("order.turn", "order.way")).alias("scan_rank"))
