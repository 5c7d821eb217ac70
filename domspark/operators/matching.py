"""How many elements of its page a question finds.

A question is a locator taken apart. Its parts are forms, strings that an element fits or not:

    tag   tag|:place   tag|attr=value   *|attr=value   tag|.class   tag|~part of class   tag|&classes   tag|=text   tag|^part of text

own: the form of the element asked for. rel and akey: none, or "below" (an ancestor fits akey), "child" (the parent does),
"below2" (the parent fits mid, and an ancestor of it akey). text: what the element's text has to be besides. Only the
document itself is asked, no shadow trees.

All answers are counts by keys: each element gives one row for each form that is asked on its page, and what lies below
anchors is counted by intervals. No two elements, and no two questions, are ever paired, but for the distinct class
attributes and the texts of a tag within one page, which the two forms with "part of" are held against.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locators import class_tokens
from ..functions.text import xpath_normalize
from ..shared import settle_large
from ..sources.dom import HEAD
from .intervals import counts_inside

SEP = "\x01"
_BY_PARTS = r"^[^|]*\|[~&]"
QUESTION = ("rel", "akey", "mid", "own", "text")


def short_norm(nodes: DataFrame) -> Column:
    """The text as XPath sees it; null if it is longer than any that is asked for. A column of that name is taken as it is."""
    return F.col("short_norm") if "short_norm" in nodes.columns else F.when(F.col("solid") <= HEAD, xpath_normalize(F.col("head")))


def text_form(tag: Column, norm: Column) -> Column:
    return F.concat(tag, F.lit("|="), norm)


def class_form(tag: Column, tokens: Column) -> Column:
    """Of several classes at once, in any order."""
    return F.concat(tag, F.lit("|&"), F.array_join(F.array_sort(F.array_distinct(tokens)), " "))


def question(rel: Column | None, akey: Column | None, mid: Column | None, own: Column, text: Column | None = None) -> Column:
    """One string for a question; null if own is."""
    parts = [F.lit("") if x is None else F.coalesce(x.cast("string"), F.lit("")) for x in (rel, akey, mid, own, text)]
    return F.when(own.isNotNull(), F.concat_ws(SEP, *parts))


def forms(nodes: DataFrame, attributes: Sequence[str] | None = None, anywhere: Sequence[str] | None = None, steps: bool = True, more: Sequence[str] = ()) -> DataFrame:
    """page_id, form, nid, more: what each element fits, but for the forms with "part of" and of several classes.

    attributes: those that any question names, then there are no forms of others; anywhere: of these those that are asked
    of any tag, if not all. steps: whether tags and places are asked alone. more: columns of the elements to keep.
    """
    tag, attrs = F.col("tag"), F.col("attrs")
    norm = short_norm(nodes)
    tokens = F.col("classes") if "classes" in nodes.columns else class_tokens(attrs, numeric=True)
    pairs = F.map_entries(attrs) if attributes is None else F.filter(F.map_entries(attrs), lambda e: e["key"].isin(*attributes))
    named = F.transform(pairs, lambda e: F.concat(F.lit("|"), e["key"], F.lit("="), e["value"]))
    of_any = named if anywhere is None else F.transform(F.filter(pairs, lambda e: e["key"].isin(*anywhere)), lambda e: F.concat(F.lit("|"), e["key"], F.lit("="), e["value"]))
    none = F.array().cast("array<string>")
    own = [
        F.array(*([tag, F.concat(tag, F.lit("|:"), F.col("tag_idx").cast("string"))] if steps else []), text_form(tag, norm)),
        F.when(F.size(tokens) > 0, F.transform(F.array_distinct(tokens), lambda t: F.concat(tag, F.lit("|."), t))).otherwise(none),
        F.when(F.size(attrs) > 0, F.concat(F.transform(named, lambda p: F.concat(tag, p)), F.transform(of_any, lambda p: F.concat(F.lit("*"), p)))).otherwise(none),
    ]
    return nodes.where("scope = -1").select("page_id", "nid", *more, F.explode_outer(F.concat(*own)).alias("form")).where("form is not null")


def _fits(nodes: DataFrame, asked: DataFrame, by_parts: bool, attributes: Sequence[str] | None = None) -> DataFrame:
    """page_id, form, nid for the asked forms (page_id, form); by_parts: whether any is about parts of, or several, classes."""
    plain = forms(nodes, attributes).join(asked, ["page_id", "form"], "left_semi").select("page_id", "form", "nid")
    return plain.union(_by_class(nodes, asked)) if by_parts else plain


def _by_class(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """page_id, form, nid for those of the asked forms that are about parts of, or several, classes."""
    by_class = asked.where(F.col("form").rlike(_BY_PARTS)).select("page_id", "form", F.substring_index("form", "|", 1).alias("tag"), F.expr("substr(form, instr(form, '|') + 1, 1)").alias("sign"), F.expr("substr(form, instr(form, '|') + 2)").alias("want"))
    light = nodes.where("scope = -1").select("page_id", "nid", "tag", F.element_at("attrs", "class").alias("class")).where("class is not null")
    distinct = light.select("page_id", "tag", "class").distinct()
    tokens = class_tokens(F.create_map(F.lit("class"), F.col("class")), numeric=True)
    holds = F.when(F.col("sign") == "~", F.contains("class", "want")).otherwise(F.size(F.array_except(F.split("want", " "), tokens)) == 0)
    classes = by_class.join(distinct, ["page_id", "tag"]).where(holds).select("page_id", "form", "tag", "class")
    return classes.join(light, ["page_id", "tag", "class"]).select("page_id", "form", "nid")


def _some(df: DataFrame, q: Column) -> DataFrame:
    return df.groupBy("page_id", q.alias("q")).agg(F.count("*").alias("n"), F.min("nid").alias("first_nid"))


def asked_forms(questions: DataFrame) -> DataFrame:
    return questions.select("page_id", F.explode(F.array_compact(F.array("own", "akey", "mid"))).alias("form")).distinct()


def fitting(nodes: DataFrame, asked: DataFrame, by_parts: bool = True) -> DataFrame:
    """page_id, form, nid for the asked forms (page_id, form), written once; by_parts: whether any is about parts of, or several, classes."""
    return settle_large(_fits(nodes, asked, by_parts))


def kinds(questions: DataFrame) -> tuple[set[str], bool, bool]:
    """Which kinds of questions there are: their rels but none, whether any form is about parts of, or several, classes, and whether any is about parts of texts."""
    any_form = lambda pattern: F.max(F.coalesce(F.col("own").rlike(pattern), F.lit(False)) | F.coalesce(F.col("akey").rlike(pattern), F.lit(False)) | F.coalesce(F.col("mid").rlike(pattern), F.lit(False)))
    rels, by_parts, texts = questions.agg(F.collect_set(F.coalesce("rel", F.lit(""))), any_form(_BY_PARTS), any_form(r"^[^|]*\|\^")).first()
    return set(rels) & {"below", "child", "below2"}, bool(by_parts), bool(texts)


def counted(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """page_id, q, n, first_nid for questions (page_id, q, rel, akey, mid, own, text) that find any element; first_nid but for below2.

    First it looks which kinds of questions there are, so that only their parts are planned. Questions, and the elements
    that fit their forms, are written once and read by all parts.
    """
    questions = settle_large(questions)
    rels, by_parts, texts = kinds(questions)
    fits = fitting(nodes, asked_forms(questions), by_parts)
    found = _some(fits, question(None, None, None, F.col("form")))
    if rels:
        found = found.union(_anchored(nodes.where("scope = -1"), questions, fits))
    if texts:
        found = found.union(_parts(nodes, questions))
    return found


def finding_one(nodes: DataFrame, rows: DataFrame, marked: DataFrame, attributes: Sequence[str], anywhere: Sequence[str], more: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (page_id, nid, rel, akey, mid, own, text, ...) whose question finds one element, and page_id, form, nid, more for the marked forms (page_id, form).

    attributes, anywhere: what questions and marks name, as for forms(). Questions about an element's own form, forms and
    marks meet in windows of a page and form, where all are counted at once. So rows are neither joined nor told apart
    before; only those with anchors and parts of texts are.
    """
    rels, by_parts, texts = kinds(rows)
    anchored, in_part = F.col("rel").isNotNull(), F.col("rel").isNull() & F.col("own").rlike(r"^[^|]*\|\^")
    offered = forms(nodes, attributes, anywhere, bool(rels), more)
    asked = asked_forms(rows.where(anchored | F.col("own").rlike(_BY_PARTS))) if rels or by_parts else None
    if by_parts:
        offered = offered.unionByName(_by_class(nodes, asked), allowMissingColumns=True)
    marks = marked.select("page_id", "form", F.lit(2).alias("kind"))
    if rels:
        marks = marks.union(asked.select("page_id", "form", F.lit(2)))
    rest = [c for c in rows.columns if c not in ("page_id", "nid", *QUESTION)]
    own = rows.where(F.col("own").isNotNull() & ~anchored & ~in_part).select("page_id", "nid", F.col("own").alias("form"), F.lit(0).alias("kind"), F.struct(*rest).alias("row"))
    every = own.unionByName(offered.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("page_id", "form")
    met = every.withColumns({"n": F.count(F.when(F.col("kind") == 1, 1)).over(w), "last": F.max("kind").over(w)})
    met = settle_large(met.where("kind = 0 and n = 1 or kind = 1 and last = 2").drop("n", "last"))
    once, fits = met.where("kind = 0").select("page_id", "nid", "row.*"), met.where("kind = 1").select("page_id", "form", "nid", *more)
    asking = rows.withColumn("q", question(*map(F.col, QUESTION)))
    for some, which in ((bool(rels), anchored), (texts, in_part)):
        if not some:
            continue
        own = asking.where(which)
        if which is anchored:
            found = _anchored(nodes.where("scope = -1"), settle_large(own.select("page_id", "q", *QUESTION).dropDuplicates(["page_id", "q"])), fits.select("page_id", "form", "nid"))
        else:
            found = _parts(nodes, own)
        once = once.union(own.join(found.where("n = 1").select("page_id", "q"), ["page_id", "q"], "left_semi").select("page_id", "nid", *rest))
    return once, fits


def _anchored(light: DataFrame, questions: DataFrame, fits: DataFrame) -> DataFrame:
    """Elements below asked anchors, counted by intervals; a question's own form, parent's form and text name a set of members."""
    col = F.col
    named = lambda own, mid, text: F.concat_ws(SEP, own, F.coalesce(mid, F.lit("")), F.coalesce(text, F.lit("")))
    anchored = questions.where("rel in ('below', 'child', 'below2')").select("page_id", "q", "rel", "akey", "own", "mid", F.coalesce("text", F.lit("")).alias("text"))
    place = light.select("page_id", "nid", "post", "parent", F.coalesce(short_norm(light), F.lit("")).alias("norm"))
    tops = fits.join(anchored.select("page_id", col("akey").alias("form")).distinct(), ["page_id", "form"], "left_semi").join(place.select("page_id", "nid", "post"), ["page_id", "nid"]).select("page_id", col("form").alias("a"), col("nid").alias("pre"), "post")
    # Each element stands for its form, and once more for its form with its text.
    own = fits.join(anchored.select("page_id", col("own").alias("form")).distinct(), ["page_id", "form"], "left_semi").join(place, ["page_id", "nid"])
    own = own.select("page_id", col("form").alias("own"), "nid", "parent", F.explode(F.array_distinct(F.array(F.lit(""), col("norm")))).alias("text"))
    wanted = anchored.where("rel <> 'child'").select("page_id", "own", F.coalesce("mid", F.lit("")).alias("mid"), "text").distinct()
    alone = own.withColumn("mid", F.lit("")).join(wanted, ["page_id", "own", "mid", "text"], "left_semi").select("page_id", named(col("own"), col("mid"), col("text")).alias("b"), col("nid").alias("at"), "nid")
    mids = fits.join(wanted.where("mid <> ''").select("page_id", col("mid").alias("form")).distinct(), ["page_id", "form"], "left_semi").select("page_id", col("form").alias("mid"), col("nid").alias("parent"))
    under = own.join(mids, ["page_id", "parent"]).join(wanted, ["page_id", "own", "mid", "text"], "left_semi").select("page_id", named(col("own"), col("mid"), col("text")).alias("b"), col("parent").alias("at"), "nid")
    pairs = anchored.where("rel <> 'child'").select("page_id", "q", col("akey").alias("a"), named(col("own"), col("mid"), col("text")).alias("b"))
    found = counts_inside(tops, alone.union(under), pairs)
    parents = tops.select("page_id", col("a").alias("akey"), col("pre").alias("parent"))
    children = anchored.where("rel = 'child'").join(parents, ["page_id", "akey"]).join(own, ["page_id", "own", "parent", "text"])
    return found.unionByName(_some(children, col("q")))


def _parts(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """Parts of texts, each text of a page and tag held against the parts that are asked of them.

    Short texts stand in the row themselves, longer ones are cut out of the page's text one after the other, so that a row
    is no longer than its page, however deep that is.
    """
    parts = questions.where("rel is null and own like '%|^%'").select("page_id", "q", F.substring_index("own", "|", 1).alias("tag"), F.expr("substr(own, instr(own, '|') + 2)").alias("part"))
    parts = parts.groupBy("page_id", "tag").agg(F.collect_set(F.struct("q", "part")).alias("parts"))
    texts = nodes.where("scope = -1").groupBy("page_id", "tag").agg(F.collect_list(F.struct("nid", short_norm(nodes).alias("norm"), "norm_from", "norm_to")).alias("texts"))
    whole = nodes.where("page_norm is not null").select("page_id", "page_norm")
    cut = lambda t: F.coalesce(t["norm"], F.substring(F.col("page_norm"), t["norm_from"] + 1, t["norm_to"] - t["norm_from"]))
    held = lambda t, text: F.transform(F.filter("parts", lambda p: F.contains(text, p["part"])), lambda p: F.struct(p["q"].alias("q"), t["nid"].alias("nid")))
    hits = F.flatten(F.transform("texts", lambda t: F.get(F.transform(F.array(cut(t)), lambda text: held(t, text)), F.lit(0))))
    rows = parts.join(texts, ["page_id", "tag"]).join(whole, "page_id").select("page_id", F.explode(hits).alias("h"))
    return _some(rows.select("page_id", "h.nid", "h.q"), F.col("q"))
