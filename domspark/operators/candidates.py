"""Elements worth a locator: the scan, and the filters behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locators import INPUTS, UNNAMED, class_tokens, element_name, first_text, seen_line, short_line
from ..functions.text import xpath_normalize
from ..sources.dom import CANDIDATE_ROLES, CANDIDATE_TAGS, HEAD
from .intervals import inside


def is_candidate() -> Column:
    role = F.element_at("attrs", "role")
    return F.col("tag").isin(*sorted(CANDIDATE_TAGS)) | role.isin(*sorted(CANDIDATE_ROLES)) | F.map_contains_key("attrs", "id")


def described(nodes: DataFrame, quirks: bool = True) -> DataFrame:
    """nodes with etext, norm (as XPath sees the text), name, classes and candidate."""
    short = F.when(F.col("solid") <= HEAD, F.col("head"))  # longer texts are neither short nor ever asked for
    first = first_text(F.col("direct_text"), short, F.col("n_child"))  # a column of its own, so that it is made once
    out = nodes.withColumns({"etext": first, "_line": seen_line(F.col("head")), "norm": xpath_normalize(F.coalesce(short, F.lit(""))), "classes": class_tokens(F.col("attrs"), numeric=True), "candidate": is_candidate()})
    out = out.withColumn("etext", short_line(F.col("etext")))
    return out.withColumn("name", element_name(F.col("tag"), F.col("attrs"), F.col("head"), F.col("etext"), quirks, F.col("_line"))).drop("_line")


def is_chosen() -> Column:
    return F.col("candidate") & F.col("visible") & ((F.col("name") != UNNAMED) | F.col("tag").isin(*INPUTS))


def chosen(described: DataFrame) -> DataFrame:
    """Candidates that can be seen and have a name, or are inputs."""
    return described.where(is_chosen())


def added(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Of elements added as roots (page_id, nid): themselves, all below, and what is in their own shadow tree's light.

    What lies below is found by intervals, within one tree.
    """
    tops = roots.join(nodes, ["page_id", "nid"]).select("page_id", "nid", "pre", "post", "scope")
    below = inside(tops.select("page_id", "scope", "pre", "post"), nodes.select("page_id", "scope", F.col("pre").alias("at"), "nid"), "scope").select("page_id", "nid")
    own = nodes.join(tops.select("page_id", F.col("nid").alias("scope")).distinct(), ["page_id", "scope"], "left_semi").select("page_id", "nid")
    every = below.union(own).union(tops.select("page_id", "nid")).distinct()
    return nodes.join(every, ["page_id", "nid"], "left_semi")


def picked(located: DataFrame, page_id: int, nid: int) -> DataFrame:
    """One element of what was located; its counts have seen the whole page."""
    return located.where((F.col("page_id") == page_id) & (F.col("nid") == nid))
