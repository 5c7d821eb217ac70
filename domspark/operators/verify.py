"""How many elements of its page a locator finds, and the first of them.

Absolute paths of tags and places are compared with the elements' own paths; all other locators are resolved as joins.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selectors import compiled
from ..shared import settle_large
from .numbering import absolute_paths
from .resolve import COLUMNS as _RESOLVE
from .resolve import Known, _passed, common, parsed, resolved, resolved_common, split

#: What is needed of the elements.
COLUMNS = _RESOLVE
_PLAIN = r"^/(?i:html)(/[a-zA-Z][a-zA-Z0-9-]*(\[[1-9]\d*\])?)*$"


def _steps(path: Column) -> Column:
    return F.regexp_replace(path, r"\[\d+\]", "")


def _paths(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Absolute paths: steps without a place fit all of their tag. Only pages that are asked so have their paths made."""
    if asked.isEmpty():
        return asked.select("page_id", "type", "value", F.lit(0).cast("long").alias("matches"), F.lit(None).cast("int").alias("first_nid"))
    nodes = nodes.where("scope = -1").join(asked.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "nid", "parent", "scope", "tag")
    paths = asked.select("page_id", "type", "value", _steps(F.lower("value")).alias("tags"), F.split(F.lower("value"), "/").alias("want"))
    every = absolute_paths(nodes).select("page_id", "nid", _steps(F.col("path")).alias("tags"), F.split("path", "/").alias("have"))
    same = F.forall(F.zip_with("want", "have", lambda w, h: (w == h) | ~F.contains(w, F.lit("[")) | ((F.substring_index(w, "[1]", 1) == h) & w.endswith("[1]"))), lambda x: x)
    n = paths.join(every, ["page_id", "tags"]).where(same).groupBy("page_id", "type", "value").agg(F.count("*").alias("matches"), F.min("nid").alias("first_nid"))
    return asked.join(n, ["page_id", "type", "value"], "left").select("page_id", "type", "value", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), "first_nid")


def verified(nodes: DataFrame, locators: DataFrame) -> DataFrame:
    """locators (page_id, type, value), each once, with ok, matches, first_nid and verdict; those out of the grammar aren't ok."""
    asked, parts = settle_large(locators.select("page_id", "type", "value")), []
    known = {i: (t, v) for i, (t, v) in common(asked).items() if compiled(t, v) or not re.match(_PLAIN, v or "")}  # paths of too many steps are compared
    if known:
        often, words, asked = split(asked, known)
        parts.append(resolved_common(nodes, often, words, known))
    if not parts or not asked.isEmpty():
        plain = F.coalesce(F.col("type").isin("xpath", "xpath-abs") & F.col("value").rlike(_PLAIN), F.lit(False))
        asked = settle_large(asked.distinct().withColumn("plain", plain))
        parts += [resolved(nodes, asked.where("not plain").drop("plain")), _paths(nodes, asked.where("plain").drop("plain"))]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumns({"ok": F.col("matches").isNotNull(), "verdict": verdict(F.col("matches"))})


def first_matches(nodes: DataFrame, locators: DataFrame, strict: bool = False) -> DataFrame:
    """page_id, type, value, nid: the first element in document order that each locator finds, or null.

    Ids are compared as they are. Other kinds than id, css and xpath are read as CSS; strict: they find nothing.
    """
    known = F.col("type").isin("id", "css", "xpath", "xpath-abs") if strict else F.lit(True)
    return verified(nodes, locators).select("page_id", "type", "value", F.when(known, F.col("first_nid")).alias("nid"))


def verdict(matches: Column) -> Column:
    return F.when(matches.isNull(), "Err").when(matches == 1, "success-1").when(matches > 1, "success-multi").otherwise("error")


def _plain(s: str) -> str:
    """A CSS identifier without its escapes."""
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n\r\f]?|(.))", lambda m: chr(int(m[1], 16)) if m[1] else m[2], s)


def _is_segment(segment: str) -> Column:
    """Whether an element fits tag#id, tag.class.class or tag; * fits all."""
    tag, rest = re.match(r"((?:[^.#\\]|\\.)*)(.*)$", segment, re.S).groups()
    good = F.lit(True) if tag in ("", "*") else F.col("tag") == _plain(tag)
    for mark, name in re.findall(r"([.#])((?:[^.#\\]|\\.)+)", rest):
        value = _plain(name)
        has = F.element_at("attrs", "id") == value if mark == "#" else F.array_contains(F.split(F.element_at("attrs", "class"), r"\s+"), value)
        good = good & F.coalesce(has, F.lit(False))
    return good


def by_hops(nodes: DataFrame, hops: list[dict[str, str | None]]) -> DataFrame:
    """page_id, nid of the element that a path of shadow hosts and a leaf leads to on each page; pages without it have no row.

    Each hop takes the first element in its tree; a host without a shadow tree ends the path.
    """
    at = nodes.select("page_id").distinct().withColumn("tree", F.lit(-1))
    trees = nodes.where("scope >= 0").select("page_id", F.col("scope").alias("nid")).distinct()
    for hop in hops:
        leaf = hop["type"] == "leaf"
        hits = nodes.where(_is_segment(hop["selector"] if leaf else hop["host"])).join(at, "page_id").where(F.col("scope") == F.col("tree"))
        first = hits.groupBy("page_id").agg(F.min_by("nid", "pre").alias("nid"))
        if leaf:
            return first
        at = first.join(trees, ["page_id", "nid"], "left_semi").select("page_id", F.col("nid").alias("tree"))
    return nodes.select("page_id", "nid").limit(0)


def by_own_hops(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """stored (page_id, hops, ...) with hop_nid, the element that each row's own hops lead to, or null; of all rows at once.

    hops: array of (type, host, selector); each hop takes the first element that its segment fits in the tree so far, from
    the document on, a shadow hop goes on in that element's shadow tree, a leaf ends the way. In each round all rows go
    one hop further. Segments have to be selectors of one element; others lead nowhere. nodes is read several times: give a settled table.
    """
    segment = F.transform("hops", lambda h: F.struct(h["type"].alias("type"), F.when(h["type"] == "leaf", h["selector"]).otherwise(h["host"]).alias("s")))
    stored = settle_large(stored)
    asked = settle_large(stored.select("page_id", F.lit("css").alias("type"), F.posexplode(segment["s"]).alias("at", "value")))
    first = _first_of_segments(nodes, asked)
    trees = nodes.where("scope >= 0").select("page_id", F.col("scope").alias("nid"), F.lit(True).alias("_tree")).distinct()
    first = settle_large(first.join(trees, ["page_id", "nid"], "left").select("page_id", F.col("value").alias("_s"), F.col("scope").alias("_scope"), F.col("nid").alias("_nid"), "_tree"))
    depth = asked.agg(F.max("at") + 1).first()[0] or 0
    out = stored.withColumns({"_way": segment, "_scope": F.lit(-1), "hop_nid": F.lit(None).cast("int")})
    for i in range(depth):
        hop = F.get("_way", F.lit(i))
        here = out.withColumns({"_type": hop["type"], "_s": hop["s"]}).join(first, ["page_id", "_s", "_scope"], "left")
        here = here.withColumns({"hop_nid": F.coalesce("hop_nid", F.when(F.col("_type") == "leaf", F.col("_nid"))), "_scope": F.when((F.col("_type") != "leaf") & F.col("_tree"), F.col("_nid"))})
        out = here.select(*out.columns)
    return out.drop("_way", "_scope")


def _first_of_segments(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """page_id, value, scope, nid: the first element in each tree that fits the segments (page_id, type, value) that are asked on its page."""
    known, parts = common(asked), []
    single = {v: compiled(t, v)[0][0][0] for t, v in known.values() if compiled(t, v) and len(compiled(t, v)[0]) == len(compiled(t, v)[0][0]) == 1}
    keys = ["page_id", "value", "scope"]
    if single:
        values = sorted(single)
        value = F.get(F.array(*map(F.lit, values)), F.col("prefix").cast("int"))
        rows = Known(nodes, {x["sig"]: x for x in single.values()}, trees=True).rows([{"sig": single[v]["sig"], "prefix": i} for i, v in enumerate(values)], "prefix")
        parts.append(rows.groupBy("page_id", "prefix", "scope").agg(F.min("nid").alias("nid")).select("page_id", value.alias("value"), "scope", "nid"))
    rest = asked.where("value is not null" if not known else ~F.col("value").isin([v for _, v in known.values() if v is not None]))
    if not parts or not rest.isEmpty():
        one = settle_large(parsed(rest).where("size(paths) = 1 and size(paths[0]) = 1").select("page_id", "value", F.col("paths")[0][0].alias("x")).select("page_id", "value", "x.*"))
        tests = one.groupBy("page_id", "sig").agg(*[F.any_value(c).alias(c) for c in ("tag", "form", "key", "texts", "first", "then", "place")])
        passed = _passed(nodes, tests, False, False, trees=True)
        found = passed.groupBy("page_id", "sig", "scope").agg(F.min("nid").alias("nid")).join(one.select("page_id", "sig", "value"), ["page_id", "sig"])
        parts.append(found.groupBy(*keys).agg(F.min("nid").alias("nid")))
    return reduce(DataFrame.unionByName, parts)
