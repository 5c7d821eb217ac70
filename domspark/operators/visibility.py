"""Whether elements can be seen, by the page's own style sheets.

Rules of style elements are taken apart by task; their selectors are resolved like locators, all pages at once. Of each
property the cascade takes the declaration of the highest rank: important ones, then inline style, specificity, and order;
below all of them stands what browsers do by themselves. display: none hides all below an element (by intervals);
visibility and pointer-events are inherited from the nearest element above that has its own (by doubling).

Selectors out of the grammar of locators, linked sheets, and media rules other than all and screen are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import settle_large
from .intervals import inside
from .numbering import from_above
from .resolve import _texts, matched

PROPERTIES = ("display", "visibility", "pointer-events")
#: What isn't displayed by itself.
UNSEEN = ("head", "script", "style", "template", "title", "meta", "link", "base", "noscript")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility|pointer-events)\s*:\s*([\w-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)


def specificity(selector: str) -> tuple[int, int, int]:
    """Ids; classes, attributes and pseudo-classes; tags."""
    s = re.sub(r"""\[(?:[^\]"']|"[^"]*"|'[^']*')*\]""", "[]", re.sub(r"\\.", "x", selector))
    s = re.sub(r":not\(", " ", s).replace(")", " ")
    ids, marks = len(re.findall(r"#[\w-]+", s)), len(re.findall(r"\.[\w-]+|\[\]|:[\w-]+(?:\([^ ]*)?", s))
    return ids, marks, len(re.findall(r"[A-Za-z][\w-]*", re.sub(r"[#.:][\w-]+(?:\([^ ]*)?|\[\]", " ", s)))


def _blocks(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations, those inside of media rules for screens too."""
    css, at = re.sub(r"/\*[\s\S]*?(?:\*/|\Z)|<!--|-->", " ", css), 0
    shape = re.sub(r""""(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'""", lambda m: "s" * len(m[0]), css)  # braces in strings are none
    while (open_ := shape.find("{", at)) >= 0:
        depth, end = 1, open_ + 1
        while end < len(shape) and depth:
            depth += {"{": 1, "}": -1}.get(shape[end], 0)
            end += 1
        begin = max(at, shape.rfind(";", at, open_) + 1)
        head, body, at = css[begin:open_].strip(), css[open_ + 1 : end - (depth == 0)], end
        if not head.startswith("@"):
            yield head, body
        elif re.fullmatch(r"@media\s+(?:(?:only\s+)?screen|all)(?:\s*,\s*(?:print|screen|all))*", head, re.I):
            yield from _blocks(body)


def rules(css: str) -> list[dict]:
    """selector, ids, marks, tags, place, property, value, important of all declarations about visibility."""
    out = []
    for place, (head, body) in enumerate(_blocks(css)):
        for name, value, important in _DECLARATION.findall(body):
            for selector in re.findall(r"""(?:[^,("'\[]|\((?:[^()]|\([^()]*\))*\)|\[(?:[^\]"']|"[^"]*"|'[^']*')*\]|["'])+""", head):
                ids, marks, tags = specificity(selector)
                out.append({"selector": selector.strip(), "ids": ids, "marks": marks, "tags": tags, "place": place, "property": name.lower(), "value": value.lower(), "important": bool(important)})
    return out


_RULE = pa.list_(pa.struct([("selector", pa.string()), *((c, pa.int32()) for c in ("ids", "marks", "tags", "place")), ("property", pa.string()), ("value", pa.string()), ("important", pa.bool_())]))


def sheet_rules(nodes: DataFrame) -> DataFrame:
    """page_id, sheet (its element), and the columns of rules() of all style elements."""
    sheets = nodes.where("tag = 'style' and scope = -1").select("page_id", "nid", "text_from", "text_to")
    texts = _texts(nodes, sheets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sheets = batch.column(2).dictionary_encode()  # pages of a site have the same sheets
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(rules, sheets.dictionary.to_pylist()), _RULE).take(sheets.indices)], names=["page_id", "sheet", "rules"])

    kind = nodes.schema["page_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"page_id {kind}, sheet int, rules array<struct<selector:string,ids:int,marks:int,tags:int,place:int,property:string,value:string,important:boolean>>")
    return found.select("page_id", "sheet", F.explode("rules").alias("r")).select("page_id", "sheet", "r.*")


def _rank(important: Column, inline: int, ids: Column, marks: Column, tags: Column, sheet: Column, place: Column) -> Column:
    return F.struct(important.alias("important"), F.lit(inline).alias("inline"), ids.alias("ids"), marks.alias("marks"), tags.alias("tags"), sheet.alias("sheet"), place.alias("place"))


def _declared(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, nid, property, value: what the cascade leaves of each property that anything is said about."""
    zero = F.lit(0)
    hits = matched(nodes, found.select("page_id", F.lit("css").alias("type"), F.col("selector").alias("value"))).select("page_id", F.col("value").alias("selector"), "nid")
    by_rule = hits.join(found, ["page_id", "selector"]).select("page_id", "nid", "property", "value", _rank(F.col("important"), 0, F.col("ids"), F.col("marks"), F.col("tags"), F.col("sheet"), F.col("place")).alias("rank"))
    light = nodes.where("scope = -1").join(found.select("page_id").distinct(), "page_id", "left_semi")
    style = F.lower(F.coalesce(F.element_at("attrs", "style"), F.lit("")))

    def said_of(p: str) -> Column:
        values = F.regexp_extract_all(style, F.lit(rf"(?:^|;)\s*{p}\s*:\s*([\w-]+\s*(?:!\s*important)?)\s*(?=;|$)"), F.lit(1))
        return F.transform(values, lambda v, i: F.struct(F.lit(p).alias("property"), v.alias("value"), i.alias("place")))

    own = light.where(F.map_contains_key("attrs", "style")).select("page_id", "nid", F.explode(F.concat(*map(said_of, PROPERTIES))).alias("d"))
    inline = own.select("page_id", "nid", "d.property", F.regexp_extract("d.value", r"^[\w-]+", 0).alias("value"), _rank(F.contains("d.value", F.lit("!")), 1, zero, zero, zero, zero, F.col("d.place")).alias("rank"))
    by_itself = F.when((F.col("tag") == "input") & (F.lower(F.element_at("attrs", "type")) == "hidden"), True).when(F.col("tag").isin(*UNSEEN) | F.map_contains_key("attrs", "hidden"), False)
    default = light.withColumn("sure", by_itself).where("sure is not null").select("page_id", "nid", F.lit("display").alias("property"), F.lit("none").alias("value"), _rank(F.col("sure"), 2, zero, zero, zero, zero, zero).alias("rank"))
    default = default.withColumn("rank", F.when(F.col("rank.important"), F.col("rank")).otherwise(_rank(F.lit(False), -1, zero, zero, zero, zero, zero)))
    return by_rule.unionByName(inline).unionByName(default).groupBy("page_id", "nid", "property").agg(F.max_by("value", "rank").alias("value"))


def with_styles(nodes: DataFrame) -> DataFrame:
    """nodes with visible as style sheets have it, on pages that have any rule about it; elsewhere, and in shadow trees, as it was.

    nodes needs the columns of resolve and visible, and is read several times: give a settled table.
    """
    found = settle_large(sheet_rules(nodes))
    said = settle_large(_declared(nodes, found))
    light = nodes.where("scope = -1").join(found.select("page_id").distinct(), "page_id", "left_semi")
    tops = said.where("property = 'display' and value = 'none'").join(light.select("page_id", "nid", "post"), ["page_id", "nid"]).select("page_id", F.lit(0).alias("g"), F.col("nid").alias("pre"), "post")
    gone = inside(tops, light.select("page_id", F.lit(0).alias("g"), F.col("nid").alias("at"), "nid"), "g").select("page_id", "nid").union(tops.select("page_id", F.col("pre").alias("nid"))).distinct()
    inherited = said.where("property <> 'display' and value not in ('inherit', 'unset')").groupBy("page_id", "nid").agg(F.max(F.when(F.col("property") == "visibility", F.col("value"))).alias("v"), F.max(F.when(F.col("property") == "pointer-events", F.col("value"))).alias("p"))
    # Only elements that have a value of their own, or lie below one that has, inherit anything.
    places = light.select("page_id", "nid", "post", F.col("parent").alias("up")).join(inherited, ["page_id", "nid"], "left")
    places = settle_large(places.select("page_id", F.lit(0).alias("g"), "nid", "post", "up", F.struct("v", "p").alias("own"), F.coalesce("v", "p").isNotNull().alias("has")))
    below = inside(places.where("has").select("page_id", "g", F.col("nid").alias("pre"), "post"), places.where("not has").select("page_id", "g", F.col("nid").alias("at"), "nid", "own", "up"), "g")
    rows = below.select("page_id", "nid", "own", "up").unionByName(places.where("has").select("page_id", "nid", "own", "up"))
    some = rows.select("page_id", F.col("nid").alias("up"), F.lit(True).alias("known")).distinct()
    rows = rows.join(some, ["page_id", "up"], "left").select("page_id", "nid", "own", F.when(F.col("known"), F.col("up")).alias("up"))
    nearest = from_above(rows, "own", "up", lambda upper, own: F.struct(F.coalesce(own["v"], upper["v"]).alias("v"), F.coalesce(own["p"], upper["p"]).alias("p")))
    unseen = F.coalesce(F.col("own.v").isin("hidden", "collapse"), F.lit(False)) | F.coalesce(F.col("own.p") == "none", F.lit(False))
    hidden = gone.union(nearest.where(unseen).select("page_id", "nid")).distinct().withColumn("_hidden", F.lit(True))
    styled = found.select("page_id").distinct().withColumn("_styled", F.lit(True))
    out = nodes.join(hidden, ["page_id", "nid"], "left").join(styled, "page_id", "left")
    return out.withColumn("visible", F.when(F.col("_styled") & (F.col("scope") == -1), F.col("_hidden").isNull()).otherwise(F.col("visible"))).select(*nodes.columns)
