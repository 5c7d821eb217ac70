"""Locators of elements: nine strategies, each kept where it finds exactly one element of its page.

Each candidate gives its possible locators as rows, with the question that each asks (see matching). All questions are
counted at once by keys; rows whose question finds one element stay. So nothing on a page is compared with everything
else on it, and no row holds more than its own element.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locators import PREFERRED, attribute, css_of, is_dynamic, stability, stable_attribute, xpath_of
from ..functions.text import css_escape, filled, xpath_literal
from ..shared import settle_large
from .candidates import described, is_chosen
from .matching import QUESTION, class_form, counted, finding_one, fitting, question, short_norm, text_form

LOCATOR = "array<struct<strategy:string,type:string,value:string>>"
#: What the strategies need of the elements.
COLUMNS = (
    "page_id", "nid", "pre", "post", "parent", "tag", "attrs", "sib_idx", "tag_idx", "tag_cnt", "after", "scan_seq", "scope", "direct_text", "head", "solid", "norm_from", "norm_to", "page_norm", "n_child", "visible", "up", "hosts",
)


def _text(c: Column) -> Column:
    return F.concat(F.lit("[normalize-space(.)="), xpath_literal(c), F.lit("]"))


def _form(tag: Column, s: Column, any_id: bool) -> Column:
    """The form of a stable attribute struct(attr, value); any_id: CSS asks for an id on any tag."""
    as_id = F.concat(F.lit("*") if any_id else tag, F.lit("|id="), s["value"])
    return F.when(s["attr"] == "id", as_id).when(s["attr"] == "class", F.concat(tag, F.lit("|."), s["value"])).otherwise(F.concat(tag, F.lit("|"), s["attr"], F.lit("="), s["value"]))


def _segment(tag: Column, attrs: Column, idx: Column, cnt: Column) -> Column:
    """A step of a chain: an id that isn't dynamic, else the first class without long numbers, else the place among equals."""
    own_id = attribute(attrs, "id")
    token = F.get(F.filter(F.split(F.coalesce(F.element_at(attrs, "class"), F.lit("")), r"\s+"), lambda t: (t != "") & ~t.rlike("[0-9]{5,}")), F.lit(0))
    return F.struct(tag.alias("tag"), F.when(~is_dynamic(own_id), own_id).alias("id"), token.alias("token"), F.when(cnt > 1, idx).alias("place"))


def _written(s: Column, css: bool) -> Column:
    """The step as CSS or XPath."""
    if css:
        place = F.concat(s["tag"], F.lit(":nth-of-type("), s["place"], F.lit(")"))
        return F.coalesce(F.concat(F.lit("#"), css_escape(s["id"])), F.concat(s["tag"], F.lit("."), css_escape(s["token"])), place, s["tag"])
    by_id = F.when(s["id"].isNotNull(), F.concat(F.lit("*[@id="), xpath_literal(s["id"]), F.lit("]")))
    by_class = F.when(s["token"].isNotNull(), F.concat(s["tag"], F.lit("[contains(@class, "), xpath_literal(s["token"]), F.lit(")]")))
    return F.coalesce(by_id, by_class, F.concat(s["tag"], F.lit("["), s["place"], F.lit("]")), s["tag"])


def _step_form(s: Column, css: bool) -> Column:
    """The form of a step."""
    token = F.concat(s["tag"], F.lit("|." if css else "|~"), s["token"])
    return F.coalesce(F.concat(F.lit("*|id="), s["id"]), token, F.concat(s["tag"], F.lit("|:"), s["place"].cast("string")), s["tag"])


def _try(strategy: str, kind: str, value: Column, when: Column, own: Column | None = None, rel: str | Column | None = None, akey: Column | None = None, mid: Column | None = None, text: Column | None = None, alt: int = 0) -> tuple[Column, list[Column]]:
    """A possible locator, where when holds; without own it is kept unasked. alt: of those at one place, the first that is unique counts."""
    parts = {"rel": F.lit(rel) if isinstance(rel, str) else rel, "akey": akey, "mid": mid, "own": own, "text": text}
    asked = [(F.lit(None) if x is None else x).cast("string").alias(k) for k, x in parts.items()]
    return when, [F.lit(strategy).alias("strategy"), F.lit(kind).alias("type"), value.alias("value"), F.lit(alt).alias("alt"), F.lit(own is None).alias("unasked"), *asked]


def _tries(priority: list[str]) -> list[tuple[tuple[Column, list[Column]], ...]]:
    """The possible locators of a candidate (columns of prepared, and _up, _top, _near, _far, _own_step, _mid_step, _clean), by place."""
    tag, attrs, etext = F.col("tag"), F.col("attrs"), F.col("etext")
    own_name, href, s = attribute(attrs, "name"), attribute(attrs, "href"), F.col("stable")
    sv, sa = s["value"], s["attr"]
    is_class, is_id = sa == "class", sa == "id"
    other = s.isNotNull() & ~is_class & ~is_id
    of = lambda t, a, v: F.concat(t, F.lit("|"), a, F.lit("="), v)
    any_tag = F.lit("*")
    out: list[tuple[tuple[Column, list[Column]], ...]] = []
    for a in filter(None, priority):
        v = attribute(attrs, a)
        out += [(_try("preferred", "css", F.concat(F.lit(f'[{a}="'), css_escape(v), F.lit('"]')), v.isNotNull()),), (_try("preferred", "xpath", F.concat(F.lit(f"//*[@{a}="), xpath_literal(v), F.lit("]")), v.isNotNull()),)]
    padded = xpath_literal(F.concat(F.lit(" "), sv, F.lit(" ")))
    of_class = F.concat(tag, F.lit("|."), sv)
    out += [
        (_try("class", "css", F.concat(tag, F.lit("."), css_escape(sv)), is_class, of_class),),
        (_try("class", "xpath", F.concat(F.lit("//"), tag, F.lit("[contains(concat(' ', normalize-space(@class), ' '), "), padded, F.lit(" )]")), is_class, of_class),),
        (_try("id", "id", sv, is_id),),
        (_try("id", "css", F.concat(F.lit("#"), css_escape(sv)), is_id, of(any_tag, F.lit("id"), sv)),),
        (_try("id", "xpath", F.concat(F.lit("//*[@id="), xpath_literal(sv), F.lit("]")), is_id, of(any_tag, F.lit("id"), sv)),),
        (_try("stable", "css", F.concat(tag, F.lit("["), sa, F.lit('="'), css_escape(sv), F.lit('"]')), other, of(tag, sa, sv)),),
        (_try("stable", "xpath", F.concat(F.lit("//"), tag, F.lit("[@"), sa, F.lit("="), xpath_literal(sv), F.lit("]")), other, of(tag, sa, sv)),),
        (_try("name", "css", F.concat(F.lit('[name="'), css_escape(own_name), F.lit('"]')), own_name.isNotNull(), of(any_tag, F.lit("name"), own_name)),),
        (_try("name", "xpath", F.concat(F.lit("//*[@name="), xpath_literal(own_name), F.lit("]")), own_name.isNotNull(), of(any_tag, F.lit("name"), own_name)),),
        (_try("text", "xpath", F.concat(F.lit("//"), tag, _text(etext)), etext.isNotNull(), text_form(tag, etext)),),
        (_try("text_part", "xpath", F.concat(F.lit("//"), tag, F.lit("[contains(normalize-space(.), "), xpath_literal(etext), F.lit(")]")), etext.isNotNull(), F.concat(tag, F.lit("|^"), etext)),),
    ]
    up, top, near, own, mid = (F.col(c) for c in ("_up", "_top", "_near", "_own_step", "_mid_step"))
    anchor, atag, two = F.coalesce(near, F.col("_far")), F.when(near.isNotNull(), up["tag"]).otherwise(top["tag"]), near.isNull() & own["id"].isNull()
    rel = F.when(two, "below2").otherwise("below")
    css = F.concat(css_of(atag, anchor["attr"], anchor["value"]), F.lit(" "), F.when(two, F.concat(_written(mid, True), F.lit(" > "))).otherwise(""), _written(own, True))
    xpath = F.concat(xpath_of(atag, anchor["attr"], anchor["value"]), F.lit("//"), F.when(two, F.concat(_written(mid, False), F.lit("/"))).otherwise(""), _written(own, False))
    has = anchor.isNotNull()
    asked = {c: (_step_form(own, c), rel, _form(atag, anchor, c), F.when(two, _step_form(mid, c))) for c in (True, False)}
    out += [
        (_try("chain", "css", css, has, *asked[True]),),
        (_try("chain", "xpath", xpath, has, *asked[False]), _try("chain", "xpath", F.concat(xpath, _text(etext)), has & etext.isNotNull(), *asked[False], etext, 1)),
    ]
    by_near, simple = _form(up["tag"], near, False), F.concat(xpath_of(up["tag"], near["attr"], near["value"]), F.lit("//"), tag)
    out += [
        (_try("parent", "xpath", F.concat(simple, _text(etext)), near.isNotNull() & etext.isNotNull(), tag, "below", by_near, None, etext), _try("parent", "xpath", simple, near.isNotNull(), tag, "below", by_near, None, None, 1)),
        (_try("parent", "css", F.concat(css_of(up["tag"], near["attr"], near["value"]), F.lit(" > "), tag), near.isNotNull(), tag, "child", _form(up["tag"], near, True)),),
    ]
    clean = F.col("_clean")
    is_a = (tag == "a") & href.isNotNull()
    out += [
        (_try("class_chain", "css", F.concat(tag, F.lit("."), F.array_join(F.transform(clean, css_escape), ".")), F.size(clean) > 0, F.when(F.size(F.array_distinct(clean)) == 1, F.concat(tag, F.lit("|."), F.get(clean, F.lit(0)))).otherwise(class_form(tag, clean))),),
        (_try("href", "css", F.concat(F.lit('a[href="'), css_escape(href), F.lit('"]')), is_a, of(tag, F.lit("href"), href)),),
        (_try("href", "xpath", F.concat(F.lit("//a[@href="), xpath_literal(href), F.lit("]")), is_a, of(tag, F.lit("href"), href)),),
    ]
    return out


def prepared(nodes: DataFrame, priority: list[str], quirks: bool = True) -> DataFrame:
    """What the strategies read of the elements, written once: instead of texts what is made of them, and whether they are wanted and chosen."""
    d = described(nodes, quirks).withColumns({"short_norm": short_norm(nodes), "stable": stable_attribute(F.col("attrs"), priority), "wanted": F.col("candidate") & F.col("visible")})
    if "scan_seq" in nodes.columns:  # all of COLUMNS
        d = d.withColumn("name", F.when(F.col("wanted"), F.col("name"))).withColumn("chosen", F.coalesce(is_chosen(), F.lit(False)))
        d = d.withColumns({c: F.when(F.col("chosen"), F.col(c)) for c in ("up", "hosts")})  # of others nobody asks
    spent = ("direct_text", "head", "solid", "n_child", "norm", "candidate", "visible", *(() if "scan_seq" in nodes.columns else ("name",)))
    return settle_large(d.drop(*spent))


def locators(nodes: DataFrame, priority: list[str] | None = None, quirks: bool = True, only: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """The chosen elements of each page with their ordered locators: page_id, nid, scan_seq, scope, name, tag, attrs, hosts, locators.

    locators: array of (strategy, type, value, stability), the first of equal ones only; elements without any are left out.
    only: the elements (page_id, nid) that get locators; these are held against the whole page all the same. where: the same
    as a condition on name, tag and attrs.
    nodes is read once. What is made of it, the possible locators and what they ask are written to the shared folder;
    scratch() around the use of the result deletes such tables.
    """
    priority = [a for a in priority or PREFERRED if a] or [""]
    d = prepared(nodes, priority, quirks)
    if where is not None:
        d = d.withColumns({c: F.col(c) & where for c in ("wanted", "chosen")})
    up, top = F.get(F.col("up"), F.lit(0)), F.get(F.col("up"), F.lit(1))
    usable = lambda e: e.isNotNull() & ~e["tag"].isin("body", "html")
    base = d.where("chosen")
    if only is not None:
        base = base.join(only.select("page_id", "nid").distinct(), ["page_id", "nid"], "left_semi")
    c = base.withColumns({"_up": up, "_top": top})
    up, top = F.col("_up"), F.col("_top")
    c = c.withColumns({
        "_near": F.when(usable(up), stable_attribute(up["attrs"], priority)), "_far": F.when(usable(up) & usable(top), stable_attribute(top["attrs"], priority)),
        "_own_step": _segment(F.col("tag"), F.col("attrs"), F.col("tag_idx"), F.col("tag_cnt")), "_mid_step": _segment(up["tag"], up["attrs"], up["tag_idx"], up["tag_cnt"]),
        "_clean": F.filter(F.col("classes"), lambda t: ~t.rlike("[0-9]{5,}")),
    })
    found = _tries(priority)
    # A few columns of tries at a time: one expression with all of them is more than a compiler takes.
    parts = [f"_part{i}" for i in range(0, len(found), 6)]
    placed = [[F.when(when, F.struct(F.lit(i).alias("place"), *x)) for when, x in alternatives] for i, alternatives in enumerate(found)]
    c = c.withColumns({name: F.array(*chain.from_iterable(placed[i : i + 6])) for name, i in zip(parts, range(0, len(found), 6), strict=True)})
    rows = c.select("page_id", "nid", F.explode_outer(F.concat(*parts)).alias("p")).where("p.value <> ''").select("page_id", "nid", "p.*")
    rows = settle_large(rows.withColumn("stability", stability(F.col("type"), F.col("value"))))
    anchors = _anchors(d)
    one = ("strategy", "type", "value", "stability")
    called = rows.where("not unasked").select("page_id", "nid", *QUESTION, "place", "alt", *one)
    attributes = list(dict.fromkeys([*priority, "id", "name", "href"]))
    once, fits = finding_one(d, called, anchors.select("page_id", F.col("akey").alias("form")), attributes, ("id", "name"), ("parent", "after"))
    kept = rows.where("unasked").select("page_id", "nid", "place", "alt", *one).unionByName(once)
    sibling = _sibling_locators(d, anchors, fits).select("page_id", "nid", F.lit(len(found)).alias("place"), F.lit(0).alias("alt"), F.lit("sibling").alias("strategy"), F.lit("xpath").alias("type"), F.col("sibling").alias("value"))
    sibling = sibling.withColumn("stability", stability(F.col("type"), F.col("value")))
    every = kept.union(sibling).groupBy("page_id", "nid").agg(F.array_sort(F.collect_list(F.struct("place", "alt", *one))).alias("found"))
    earlier = lambda x, i: F.slice(F.col("found"), F.lit(1), i)
    first = F.filter("found", lambda x, i: ~F.exists(earlier(x, i), lambda y: (y["place"] == x["place"]) | ((y["type"] == x["type"]) & (y["value"] == x["value"]))))
    plain = F.transform(first, lambda x: F.struct(*[x[k].alias(k) for k in one]))
    return base.select("page_id", "nid", "scan_seq", "scope", "name", "tag", "attrs", "hosts").join(every.select("page_id", "nid", plain.alias("locators")), ["page_id", "nid"])


def _anchors(d: DataFrame) -> DataFrame:
    """Elements (prepared) that a following-sibling step may start from, by their stable attribute and by their text: akey is the form, anchor the XPath."""
    attr, text = F.col("stable"), F.col("etext")
    by_attr = F.when(attr.isNotNull(), F.struct(F.lit(1).alias("better"), _form(F.col("tag"), attr, False).alias("akey"), xpath_of(F.col("tag"), attr["attr"], attr["value"]).alias("anchor")))
    by_text = F.when(text.isNotNull(), F.struct(F.lit(0).alias("better"), text_form(F.col("tag"), text).alias("akey"), F.concat(F.lit("//"), "tag", _text(text)).alias("anchor")))
    own = ("page_id", "nid", "parent", "scope", "sib_idx", "after")
    return d.where(F.col("parent").isNotNull() | (F.col("scope") >= 0)).where(F.size("after") > 0).select(*own, F.explode_outer(F.array(by_attr, by_text)).alias("a")).where("a is not null").select(*own, "a.*")


def _sibling_locators(d: DataFrame, anchors: DataFrame, fits: DataFrame) -> DataFrame:
    """page_id, nid, sibling: the nearest sibling before an element from which one following-sibling step finds only it.

    fits: page_id, form, parent, after of the elements that fit the anchors' forms, and maybe others.

    From an anchor with m siblings of a tag behind it, step k leads to the one with m - k of them behind it. Of all
    elements that fit an anchor, those that have the most behind them decide: the steps that none of the others can make
    lead to one element only. So each kind of anchor settles one run of elements, up to the end of their list, and each
    element takes the last anchor before it whose run has begun.
    """
    steps = fits.where("parent is not null").select("page_id", F.col("form").alias("akey"), "parent", F.explode("after").alias("tag", "m"))
    most = F.sort_array(F.collect_set(F.struct("m", (-F.col("parent")).alias("before"))), asc=False)
    best = steps.groupBy("page_id", "akey", "tag").agg(most.alias("most")).withColumns({"first": F.get("most", F.lit(0)), "next": F.coalesce(F.get("most", F.lit(1))["m"], F.lit(0))})
    best = best.select("page_id", "akey", "tag", F.col("first.m").alias("m"), (-F.col("first.before")).alias("parent"), "next")
    best = best.where("m > next")

    light = anchors.where("scope = -1").join(best.withColumnRenamed("parent", "at"), ["page_id", "akey"]).where(F.col("parent") == F.col("at")).where(F.element_at("after", F.col("tag")) == F.col("m"))
    # rest: so many of its tag are behind the first element of the run.
    light = light.select("page_id", "parent", "tag", (F.col("m") - F.col("next") - 1).alias("rest"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("nid"), F.struct("sib_idx", "better", "anchor", "m").alias("a"))
    wanted = d.where("wanted").select("page_id", "nid", "parent", "scope", "sib_idx", "tag", F.coalesce(F.element_at("after", F.col("tag")), F.lit(0)).alias("rest"))
    elements = wanted.where("scope = -1").select("page_id", "parent", "tag", "rest", F.lit(1).alias("kind"), "nid", F.lit(None).cast(light.schema["a"].dataType).alias("a"))
    so_far = Window.partitionBy("page_id", "parent", "tag").orderBy(F.desc("rest"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = light.union(elements).withColumn("b", F.max("a").over(so_far)).where("kind = 1 and b is not null")
    found = found.select("page_id", "nid", "tag", F.col("b.anchor").alias("anchor"), (F.col("b.m") - F.col("rest")).alias("k"))

    # In shadow trees siblings are seen, but the document is asked: each anchor before an element is tried. Few elements.
    inside = wanted.where("scope >= 0").select("page_id", "nid", F.coalesce("parent", F.lit(-1)).alias("parent"), "scope", F.col("sib_idx").alias("place"), "tag", "rest")
    before = anchors.where("scope >= 0").select("page_id", F.coalesce("parent", F.lit(-1)).alias("parent"), "scope", "sib_idx", "after", "better", "akey", "anchor")
    tried = inside.join(before, ["page_id", "parent", "scope"]).where("sib_idx < place").withColumn("k", F.element_at("after", F.col("tag")) - F.col("rest"))
    shadow = tried.join(best.select("page_id", "akey", "tag", "m", "next"), ["page_id", "akey", "tag"]).where("k > next and k <= m")
    shadow = shadow.groupBy("page_id", "nid", "tag").agg(F.max(F.struct("sib_idx", "better", "anchor", "k")).alias("b")).select("page_id", "nid", "tag", "b.anchor", "b.k")
    return found.union(shadow).select("page_id", "nid", "tag", F.concat("anchor", F.lit("/following-sibling::"), "tag", F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("sibling"))


def href_locators(nodes: DataFrame) -> DataFrame:
    """page_id, nid, href, css, xpath and their stability, of links whose address no other link of the page has."""
    links = nodes.where("tag = 'a'").select("page_id", "nid", "scope", F.element_at("attrs", "href").alias("href")).where("href <> ''")
    n = F.sum(F.when(F.col("scope") == -1, 1).otherwise(0)).over(Window.partitionBy("page_id", "href"))
    out = links.withColumn("n", n).where("n = 1").select("page_id", "nid", "href", F.concat(F.lit('a[href="'), css_escape(F.col("href")), F.lit('"]')).alias("css"), F.concat(F.lit("//a[@href="), xpath_literal(F.col("href")), F.lit("]")).alias("xpath"))
    return out.withColumns({"css_stability": stability(F.lit("css"), F.col("css")), "xpath_stability": stability(F.lit("xpath"), F.col("xpath"))})


def _class_list(attrs: Column) -> Column:
    return F.split(F.coalesce(F.element_at(attrs, "class"), F.lit("")), r"\s+")


def class_locators(nodes: DataFrame) -> DataFrame:
    """page_id, tag, token, css, xpath of classes that one element of a tag has."""
    tokens = nodes.where("scope = -1").select("page_id", "nid", "tag", F.explode(F.array_distinct(_class_list(F.col("attrs")))).alias("token")).where("token <> ''")
    one = tokens.groupBy("page_id", "tag", "token").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    padded = xpath_literal(F.concat(F.lit(" "), "token", F.lit(" ")))
    return one.withColumns({"css": F.concat("tag", F.lit("."), css_escape(F.col("token"))), "xpath": F.concat(F.lit("//"), "tag", F.lit("[contains(concat(' ', normalize-space(@class), ' '), "), padded, F.lit(" )]"))})


def text_counts(nodes: DataFrame, tag: str) -> DataFrame:
    """page_id, text, n_exact, n_part for the short texts of a tag's elements: how many elements equal and how many hold them."""
    own = nodes.where(F.col("tag") == tag)
    asked = described(own).where("etext is not null").select("page_id", F.col("etext").alias("short")).distinct()
    nothing = F.lit(None).cast("string")
    kinds = {"exact": text_form(F.lit(tag), F.col("short")), "part": F.concat(F.lit(f"{tag}|^"), "short")}
    each = asked.select("page_id", "short", F.explode(F.array(*[F.struct(F.lit(name).alias("what"), f.alias("own")) for name, f in kinds.items()])).alias("x")).select("page_id", "short", "x.*")
    each = each.withColumns({"q": question(None, None, None, F.col("own")), "rel": nothing, "akey": nothing, "mid": nothing, "text": nothing})
    n = each.join(counted(nodes.where((F.col("tag") == tag) | F.col("page_norm").isNotNull()), each), ["page_id", "q"], "left")
    count = lambda what: F.coalesce(F.max(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).cast("int").alias(f"n_{what}")
    return n.groupBy("page_id", F.col("short").alias("text")).agg(count("exact"), count("part"))


def sibling_locators(nodes: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """page_id, nid, tag, sibling of elements that one step from an earlier sibling finds alone."""
    d = prepared(nodes, priority or PREFERRED)
    anchors = _anchors(d)
    fits = fitting(d, anchors.select("page_id", F.col("akey").alias("form")).distinct(), by_parts=False)
    found = _sibling_locators(d, anchors, fits.join(d.where("scope = -1").select("page_id", "nid", "parent", "after"), ["page_id", "nid"]))
    return found.select("page_id", "nid", "tag", "sibling")


def unique_or_refined(css: Column, xpath: Column, n_css: Column, n_xpath: Column, text: Column, n_refined: Column) -> Column:
    """The CSS if it finds one element, else the XPath if it does, else the XPath with the text if that does, else the CSS."""
    pair = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    refined = F.concat(xpath, F.lit("[normalize-space(.)="), xpath_literal(text), F.lit("]"))
    return F.when(css.isNotNull() & (n_css == 1), pair("css", css)).when(xpath.isNotNull() & (n_xpath == 1), pair("xpath", xpath)).when(xpath.isNotNull() & text.isNotNull() & (n_refined == 1), pair("xpath", refined)).when(css.isNotNull(), pair("css", css)).otherwise(pair("xpath", xpath))
