"""Which elements of its page a locator finds: selectors and paths followed as joins, all locators of all pages at once.

Locators are taken apart into steps (functions.selectors). Steps that say the same of an element share one test; elements
that pass a test are found by a key (an id, an attribute, a class, a place, the length of a text, or the tag) and then
held against all of its conditions, which are data, evaluated by built-in functions. Paths that begin alike share their
beginning. Each step is a join by parent or by places among siblings, or one of operators.intervals. Texts are cut out of
their page's text only for elements whose test reads them. The last step below an anchor is counted, not listed.

Locators that a good part of the pages ask (MOST_COMMON of them at most) are taken apart once: their tests are column
expressions, so that elements need no keys for them, and their steps are broadcast instead of standing by each page.

Only the document itself is asked, no shadow trees. A locator out of the grammar has no matches, not zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.selectors import CSS_SPACE, compiled
from ..functions.text import xpath_normalize
from ..shared import settle_large
from ..sources.dom import HEAD
from .intervals import counts_inside, inside

#: What is needed of the elements.
COLUMNS = ("page_id", "nid", "post", "parent", "tag", "attrs", "sib_idx", "tag_idx", "tag_cnt", "scope", "text_from", "text_to", "solid", "page_text", "head")
#: So many locators at most are taken apart once for all pages; of more forms of keys than these, elements have all of theirs.
MOST_COMMON, MOST_FORMS = 64, 200
_VALUE = pa.list_(pa.struct([("k", pa.string()), ("s", pa.string())]))
_DNF = pa.list_(pa.list_(pa.struct([("op", pa.string()), ("neg", pa.bool_()), ("left", _VALUE), ("right", _VALUE)])))
_PATHS = pa.list_(pa.list_(pa.struct([*((c, pa.string()) for c in ("axis", "tag", "form", "key")), *((c, pa.int64()) for c in ("sig", "prefix", "before")), ("texts", pa.bool_()), ("first", _DNF), ("place", pa.int32()), ("then", _DNF)])))


def parsed(locators: DataFrame) -> DataFrame:
    """locators (page_id, type, value), each once, with paths (null out of the grammar) and pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            place = {r: i for i, r in enumerate(dict.fromkeys(rows))}
            found, at = [compiled(*r) or (None, None) for r in place], pa.array([place[r] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], _PATHS).take(at), pa.array([x[1] for x in found], pa.int32()).take(at)], names=["page_id", "type", "value", "paths", "pick"])

    id_type = locators.schema["page_id"].dataType.simpleString()
    return locators.select("page_id", "type", "value").distinct().mapInArrow(run, f"page_id {id_type}, type string, value string, paths {from_arrow_type(_PATHS).simpleString()}, pick int")


def _value(parts: Column) -> Column:
    attr = lambda p: F.coalesce(F.element_at("attrs", p["s"]), F.lit(""))
    own = lambda p: F.coalesce(F.col("own_text"), F.lit(""))
    one = lambda p: (
        F.when(p["k"] == "lit", p["s"]).when(p["k"] == "@", attr(p)).when(p["k"] == "n@", xpath_normalize(attr(p))).when(p["k"] == ".", own(p)).when(p["k"] == "n.", xpath_normalize(own(p)))
        .when(p["k"] == "tag", F.col("tag")).when(p["k"] == "tag_idx", F.col("tag_idx").cast("string")).when(p["k"] == "tag_cnt", F.col("tag_cnt").cast("string")).when(p["k"] == "sib_idx", F.col("sib_idx").cast("string"))
    )
    return F.array_join(F.transform(parts, one), "")


def _holds(dnf: Column) -> Column:
    def atom(a: Column) -> Column:
        left, right = _value(a["left"]), _value(a["right"])
        found = (
            F.when(a["op"] == "has", F.map_contains_key("attrs", F.get(a["left"], F.lit(0))["s"])).when(a["op"] == "eq", left == right).when(a["op"] == "contains", F.contains(left, right))
            .when(a["op"] == "starts", F.startswith(left, right)).when(a["op"] == "ends", F.endswith(left, right)).when(a["op"] == "token", F.array_contains(F.split(left, f"[{CSS_SPACE}]+"), right))
        )
        return F.coalesce(found, F.lit(False)) != a["neg"]

    return F.exists(dnf, lambda conj: F.forall(conj, atom))


def _said(parts: list) -> Column:
    """The same as _value() of parts that are known; own_norm is the element's text with white space as XPath has it."""
    some = [_part(p["k"], p["s"]) for p in parts]
    return some[0] if len(some) == 1 else F.concat(F.lit(""), *some)


def _part(kind: str, s: str) -> Column:
    attr, own = F.coalesce(F.element_at("attrs", s), F.lit("")), F.coalesce(F.col("own_text"), F.lit(""))
    made = {"lit": lambda: F.lit(s), "@": lambda: attr, "n@": lambda: xpath_normalize(attr), ".": lambda: own, "n.": lambda: F.coalesce(F.col("own_norm"), F.lit("")), "tag": lambda: F.col("tag")}
    return made[kind]() if kind in made else F.col(kind).cast("string")


def _known_holds(dnf: list) -> Column:
    """The same as _holds() of conditions that are known."""

    def atom(a: dict) -> Column:
        left, right = _said(a["left"]), _said(a["right"])
        found = {
            "has": lambda: F.map_contains_key("attrs", a["left"][0]["s"]), "eq": lambda: left == right, "contains": lambda: F.contains(left, right), "starts": lambda: F.startswith(left, right),
            "ends": lambda: F.endswith(left, right), "token": lambda: F.array_contains(F.split(left, f"[{CSS_SPACE}]+"), right),
        }[a["op"]]()
        return F.coalesce(found, F.lit(False)) != F.lit(a["neg"])

    return reduce(or_, [reduce(and_, map(atom, conj), F.lit(True)) for conj in dnf], F.lit(False))


def _keys(light: DataFrame, tests: DataFrame) -> DataFrame:
    """page_id, key, nid; keys as hashes, and only of the forms that any test asks for."""
    tag, attrs = F.col("tag"), F.col("attrs")
    forms = {r.form for r in tests.select("form").distinct().limit(MOST_FORMS).collect()}
    solid = F.coalesce(F.col("solid"), F.lit(0)).cast("string") if "solid" in light.columns else F.lit("0")
    every = len(forms) == MOST_FORMS
    names = sorted(f[1:] for f in forms if f[0] == "@")
    if every:
        by_attr = F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit("*|"), e["key"], F.lit("="), e["value"]))
    else:
        by_attr = F.array_compact(F.array(F.lit(None).cast("string"), *[F.concat(F.lit(f"*|{x}="), F.element_at(attrs, x)) for x in names]))
    by_class = F.transform(F.array_distinct(F.split(F.coalesce(F.element_at(attrs, "class"), F.lit("")), f"[{CSS_SPACE}]+")), lambda t: F.concat(F.lit("*|."), t))
    plain = {"*": F.lit("*"), "tag": tag, ":": F.concat(tag, F.lit("|:"), F.col("tag_idx").cast("string")), "~": F.concat(tag, F.lit("|~"), solid), "*~": F.concat(F.lit("*|~"), solid)}
    lists = [F.array(k) for form, k in plain.items() if every or form in forms] + ([by_class] if every or "." in forms else []) + ([by_attr] if every or names else [])
    return light.select("page_id", "nid", F.explode(F.concat(*(lists or [F.array(tag)]))).alias("key")).withColumn("key", F.xxhash64("key"))


def _texts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, nid, own_text for the wanted (page_id, nid, text_from, text_to): cut out of the page's text, of which no row has a copy."""
    spans = wanted.groupBy("page_id").agg(F.collect_set(F.struct("nid", "text_from", "text_to")).alias("spans"))
    whole = nodes.where("page_text is not null").select("page_id", "page_text").join(spans, "page_id")
    return whole.select("page_id", "page_text", F.explode("spans").alias("x")).select("page_id", "x.nid", F.substring(F.col("page_text"), F.col("x.text_from") + 1, F.col("x.text_to") - F.col("x.text_from")).alias("own_text"))


def _with_texts(nodes: DataFrame, rows: DataFrame, wanted: Column) -> DataFrame:
    """rows (elements) with own_text where wanted; that of a short text is its head, only longer ones are cut out of the page's."""
    short = F.when(wanted & (F.col("solid") <= HEAD), F.col("head")) if "head" in rows.columns else F.lit(None).cast("string")
    long = wanted & F.col("text_from").isNotNull() & short.isNull()
    read = rows.where(long).select("page_id", "nid", "text_from", "text_to").distinct()
    if read.isEmpty():
        return rows.withColumn("own_text", short)
    cut = _texts(nodes, read).withColumnRenamed("own_text", "_cut")
    return rows.join(cut, ["page_id", "nid"], "left").withColumn("own_text", F.coalesce(short, F.when(wanted, F.col("_cut")))).drop("_cut")


def _light(nodes: DataFrame, trees: bool) -> DataFrame:
    """What tests may read of the elements; nothing else goes along with them."""
    return (nodes if trees else nodes.where("scope = -1")).select(*[c for c in COLUMNS if c in nodes.columns and c != "page_text"])


def _passed(nodes: DataFrame, tests: DataFrame, texts: bool, places: bool, trees: bool = False) -> DataFrame:
    """page_id, sig, nid, post, parent, sib_idx: the elements that pass each test; with trees also scope, and those of shadow trees."""
    light = _light(nodes, trees)
    keyed = _keys(light, tests).join(tests.select("page_id", F.xxhash64("key").alias("key"), "sig"), ["page_id", "key"]).select("page_id", "sig", "nid").distinct()
    rows = keyed.join(light, ["page_id", "nid"]).join(tests.drop("key", "form").withColumnRenamed("tag", "asked_tag"), ["page_id", "sig"])
    rows = rows.where("asked_tag = '*' or asked_tag = tag")
    if texts:
        rows = _with_texts(nodes, settle_large(rows), F.col("texts"))
    else:
        rows = rows.withColumn("own_text", F.lit(None).cast("string"))
    rows = rows.where(_holds(F.col("first")))
    if places:
        w = Window.partitionBy("page_id", "sig", "parent")
        at, n = F.row_number().over(w.orderBy("sib_idx")), F.count("*").over(w)
        rows = rows.withColumns({"_at": at, "_n": n}).where("place is null or place = _at or place = -1 and _at = _n").where(_holds(F.col("then")))
    return rows.select("page_id", "sig", "nid", "post", "parent", "sib_idx", *(["scope"] if trees else []))


def _bits(holds: list[Column]) -> list[Column]:
    """Which of some conditions hold, as bits of as many numbers as it takes."""
    one = lambda some: reduce(lambda x, y: x.bitwiseOR(y), [F.when(c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, c in enumerate(some)])
    return [one(holds[i : i + 32]) for i in range(0, len(holds), 32)]


class Known:
    """Elements that pass tests which are known, by sig, and asked of all pages; with trees also those of shadow trees."""

    def __init__(self, nodes: DataFrame, tests: dict[int, dict], trees: bool = False):
        self.tests, self.sigs = tests, list(tests)
        self.columns = ["page_id", "nid", "post", "parent", "sib_idx", *(["scope"] if trees else [])]
        light = _light(nodes, trees)
        # A text of another length than the one that is asked for isn't looked at.
        length = {sig: int(t["key"].rpartition("~")[2]) for sig, t in tests.items() if t["form"] in ("~", "*~")}
        fits = {sig: (F.col("tag") == t["tag"] if t["tag"] != "*" else F.lit(True)) & (F.coalesce("solid", F.lit(0)) == length[sig] if sig in length else F.lit(True)) for sig, t in tests.items()}
        reading = [fits[sig] for sig, t in tests.items() if t["texts"]]
        light = _with_texts(nodes, light, reduce(or_, reading)) if reading else light.withColumn("own_text", F.lit(None).cast("string"))
        first = _bits([fits[sig] & _known_holds(t["first"]) for sig, t in tests.items()])
        then = _bits([_known_holds(t["then"]) if t["place"] is not None else F.lit(False) for t in tests.values()])
        # A lambda among them keeps these columns out of whole-stage code: one method for all tests is too long to be compiled.
        apart = F.exists(F.array("nid"), lambda x: x >= 0)
        bits = [*[c.alias(f"first{i}") for i, c in enumerate(first)], *[c.alias(f"then{i}") for i, c in enumerate(then)]]
        self.table = settle_large(light.withColumn("own_norm", xpath_normalize(F.col("own_text"))).select(*self.columns, *bits, apart.alias("apart")))

    def _has(self, sig: int, kind: str = "first") -> Column:
        at = self.sigs.index(sig)
        return F.col(f"{kind}{at // 32}").bitwiseAND(F.lit(1 << at % 32).cast("long")) != 0

    def rows(self, steps: list[dict], *names: str) -> DataFrame:
        """A row for each element and step (sig, and what else is named) whose test it passes."""

        def of(some: list[dict], table: DataFrame, kept: Callable[[dict], Column]) -> DataFrame:
            said = lambda s: F.struct(*[F.lit(s[n]).cast("int" if n == "place" else "boolean" if n == "more" else "long").alias(n) for n in names])
            rows = table.where(reduce(or_, map(kept, some))).select(*self.columns, F.explode(F.array(*[F.when(kept(s), said(s)) for s in some])).alias("s"))
            return rows.where("s is not null").select(*self.columns, "s.*")

        placed = {s["sig"] for s in steps if self.tests[s["sig"]]["place"] is not None}
        free = [s for s in steps if s["sig"] not in placed]
        parts = [of(free, self.table, lambda s: self._has(s["sig"]))] if free else []
        for sig in sorted(placed):
            place, w = self.tests[sig]["place"], Window.partitionBy("page_id", "parent")
            some = self.table.where(self._has(sig)).withColumns({"_at": F.row_number().over(w.orderBy("sib_idx")), "_n": F.count("*").over(w)})
            some = some.where((F.col("_at") == (place if place > 0 else F.col("_n"))) & self._has(sig, "then"))
            parts.append(of([s for s in steps if s["sig"] == sig], some, lambda s: self._has(s["sig"])))
        return reduce(DataFrame.unionByName, parts)


def _siblings(anchors: DataFrame, passed: DataFrame, after: bool) -> DataFrame:
    """Siblings after or before anchors; with a place, the k-th such of each anchor."""
    near = F.min("sib_idx") if after else F.max("sib_idx")
    some = anchors.where("place is null").groupBy("page_id", "prefix", "sig", "parent").agg(near.alias("edge"))
    beyond = F.col("sib_idx") > F.col("edge") if after else F.col("sib_idx") < F.col("edge")
    free = some.join(passed, ["page_id", "sig", "parent"]).where(beyond).select("page_id", "prefix", "nid", "post", "parent", "sib_idx")
    # How many of a test's elements stand before each anchor (and up to it, for those after it) gives the rank to look for.
    w = Window.partitionBy("page_id", "sig", "parent")
    asked = anchors.where("place is not null")
    lists = passed.join(asked.select("page_id", "sig", "parent").distinct(), ["page_id", "sig", "parent"], "left_semi")
    ranked = lists.withColumns({"rank": F.row_number().over(w.orderBy("sib_idx")), "all": F.count("*").over(w)})
    points = asked.select("page_id", "sig", "parent", "sib_idx", F.lit(1 if after else -1).alias("kind"), "prefix", "place")
    line = lists.select("page_id", "sig", "parent", "sib_idx", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("int").alias("place")).union(points)
    seen = F.count(F.when(F.col("kind") == 0, 1)).over(w.orderBy("sib_idx", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumn("seen", seen).where("kind <> 0").select("page_id", "sig", "parent", "prefix", "place", "seen")
    if after:
        found = line.join(ranked, ["page_id", "sig", "parent"]).where("rank > seen and (rank = seen + place or place = -1 and rank = all)")
    else:
        found = line.join(ranked, ["page_id", "sig", "parent"]).where("rank <= seen and (rank = seen - place + 1 or place = -1 and rank = 1)")
    return free.union(found.select("page_id", "prefix", "nid", "post", "parent", "sib_idx")).dropDuplicates(["page_id", "prefix", "nid"])


def _moved(front: DataFrame, passed: DataFrame, steps: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """The elements at the end of steps (before, prefix, sig, place, of each page or of all) along an axis from those in front (page_id, prefix, nid, post, ...)."""
    out = ["page_id", "prefix", "nid", "post", "parent", "sib_idx"]
    anchors = front.withColumnRenamed("prefix", "before")
    if axis == "below":
        return _below(front, passed.join(steps, [*by, "sig"]))
    a = anchors.join(steps, [*by, "before"])
    if axis in ("after", "before"):
        return _siblings(a, passed, axis == "after")
    if axis == "child":
        return a.select("page_id", "prefix", "sig", F.col("nid").alias("parent")).join(passed, ["page_id", "sig", "parent"]).select(*out)
    if axis == "next":
        return a.select("page_id", "prefix", "sig", "parent", (F.col("sib_idx") + 1).alias("sib_idx")).join(passed, ["page_id", "sig", "parent", "sib_idx"]).select(*out)
    up = a.where("parent is not null").select("page_id", "prefix", "sig", F.col("parent").alias("nid")).distinct()
    return up.join(passed, ["page_id", "sig", "nid"]).select(*out)


def common(locators: DataFrame) -> dict[int, tuple[str, str]]:
    """Type and value of the locators that a good part of the pages ask, by a number; locators is read several times: give a settled table."""
    kind = F.xxhash64("type", "value")
    often = locators.groupBy(kind.alias("h")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    some = [r.h for r in often if r.n > 1 and 4 * r.n >= often[0].n]
    return dict(enumerate((r.type, r.value) for r in locators.where(kind.isin(some)).select("type", "value").distinct().collect())) if some else {}


def split(locators: DataFrame, known: dict[int, tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """page_id, number, each once, of the locators that are known; their number, type, value; and the rows of others."""
    words = [[i, t, v, compiled(t, v) is not None] for i, (t, v) in known.items()]
    words = F.broadcast(_inline(locators.sparkSession, words, "number int, _type string, _value string, known boolean"))
    same = F.col("type").eqNullSafe(F.col("_type")) & F.col("value").eqNullSafe(F.col("_value"))
    return locators.join(words, same).select("page_id", "number").distinct(), words, locators.join(words, same, "left_anti")


def resolved_common(nodes: DataFrame, often: DataFrame, words: DataFrame, known: dict[int, tuple[str, str]]) -> DataFrame:
    """The same as resolved() for locators that are known, as split() gives them."""
    keys = ["page_id", "number"]
    answers = _counted(*_known_answers(nodes, known, False))
    rows = often.join(answers, keys, "left") if answers is not None else often.withColumns({"n": F.lit(0), "first_nid": F.lit(None).cast("int")})
    return _of_number(rows.join(words, "number").withColumnsRenamed({"_type": "type", "_value": "value"}))


def resolved(nodes: DataFrame, locators: DataFrame) -> DataFrame:
    """page_id, type, value, matches, first_nid of locators (page_id, type, value), each once.

    matches: how many elements of the page the locator finds, null if it is out of the grammar; first_nid: the first of
    them. Both read nodes several times: give a settled table. A locator of a page that nodes doesn't have finds nothing.
    """
    asked = _numbered(locators)
    answers = _counted(*_asked_answers(nodes, asked, False))
    result = asked.select("page_id", "type", "value", "number", F.col("paths").isNotNull().alias("known"))
    if answers is None:
        return _of_number(result.withColumns({"n": F.lit(0), "first_nid": F.lit(None).cast("int")}))
    return _of_number(result.join(answers, ["page_id", "number"], "left"))


def _of_number(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "type", "value", F.when(F.col("known"), F.coalesce("n", F.lit(0))).cast("long").alias("matches"), "first_nid")


def matched(nodes: DataFrame, locators: DataFrame) -> DataFrame:
    """page_id, type, value, nid: all elements that locators find; none of a locator out of the grammar. Both are read several times: give settled tables."""
    known, parts = common(locators), []
    if known:
        often, words, locators = split(locators, known)
        _, found = _known_answers(nodes, known, True)
        if found is not None:
            parts.append(often.join(found.select("page_id", "number", "nid"), ["page_id", "number"]).join(words, "number").select("page_id", F.col("_type").alias("type"), F.col("_value").alias("value"), "nid"))
    if not parts or not locators.isEmpty():
        asked = _numbered(locators)
        _, found = _asked_answers(nodes, asked, True)
        names = asked.select("page_id", "type", "value", "number")
        parts.append(names.withColumn("nid", F.lit(0)).drop("number").limit(0) if found is None else names.join(found.select("page_id", "number", "nid"), ["page_id", "number"]).drop("number"))
    return reduce(DataFrame.unionByName, parts)


def _below(front: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (page_id, before, prefix, nid, ...) that lie below an element in front of the way before."""
    out = ["prefix", "nid", "post", "parent", "sib_idx"]
    tops = front.select("page_id", F.col("prefix").alias("before"), F.col("nid").alias("pre"), "post")
    return inside(tops, rows.select("page_id", "before", F.col("nid").alias("at"), *out), "before").select("page_id", *out)


def _numbered(locators: DataFrame) -> DataFrame:
    """Parsed locators, written, with a number each: types may be null."""
    return settle_large(parsed(locators).withColumn("number", F.monotonically_increasing_id()))


def _counted(counts: DataFrame | None, several: DataFrame | None) -> DataFrame | None:
    """page_id, number, n, first_nid."""
    listed = [several.groupBy("page_id", "number").agg(F.count("*").alias("n"), F.min("nid").alias("first_nid"))] if several is not None else []
    return reduce(DataFrame.unionByName, [*([counts] if counts is not None else []), *listed]) if counts is not None or listed else None


def _asked_answers(nodes: DataFrame, asked: DataFrame, listing: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """n and first_nid of parsed locators that are counted, and nid of those that are listed: of several paths, with a pick, or listing."""
    paths = asked.where("paths is not null").select("page_id", "number", "pick", F.size("paths").alias("alts"), F.explode("paths").alias("path"))
    listed = (F.col("alts") > 1) | F.col("pick").isNotNull() | F.lit(listing)
    every = paths.select("page_id", listed.alias("listed"), F.size("path").alias("n"), F.posexplode("path").alias("i", "s")).select("page_id", "i", ((F.col("i") + 1 < F.col("n")) | F.col("listed")).alias("more"), "s.*")
    free = F.when(~F.col("axis").isin("after", "before"), F.col("place"))
    steps = settle_large(every.groupBy("page_id", "i", "prefix", "axis", "before", "sig", "place").agg(F.max("more").alias("more")))
    tests = settle_large(every.select("page_id", "sig", "tag", "form", "key", "texts", "first", "then", free.alias("place")).dropDuplicates(["page_id", "sig"]))
    kinds = {(r.i, r.axis): r.more for r in steps.groupBy("i", "axis").agg(F.max("more").alias("more")).collect()}
    some = tests.agg(F.max("texts").alias("texts"), F.max(F.col("place").isNotNull()).alias("places")).first()
    passed = settle_large(_passed(nodes, tests, bool(some.texts), bool(some.places)))
    last = paths.select("page_id", "number", "pick", listed.alias("listed"), F.element_at("path", -1)["prefix"].alias("prefix"))
    return _answers(kinds, steps, passed, last)


def _known_answers(nodes: DataFrame, known: dict[int, tuple[str, str]], listing: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """The same for locators that are known, as if all pages asked them."""
    spark, steps, tests, last = nodes.sparkSession, {}, {}, []
    for number, locator in known.items():
        paths, pick = compiled(*locator) or ([], None)
        listed = listing or len(paths) > 1 or pick is not None
        for path in paths:
            for i, s in enumerate(path):
                more = i + 1 < len(path) or listed or bool((i, s["prefix"]) in steps and steps[i, s["prefix"]]["more"])
                steps[i, s["prefix"]] = s | {"more": more}
                tests[s["sig"]] = s | {"place": s["place"] if s["axis"] not in ("after", "before") else None}
            last.append((number, pick, listed, path[-1]["prefix"]))
    if not steps:
        return None, None
    passed, levels = Known(nodes, tests), {}
    for (i, _), s in steps.items():
        levels.setdefault(i, {}).setdefault(s["axis"], []).append(s)
    counts, fronts, front, out = [], [], None, ["page_id", "prefix", "nid", "post", "parent", "sib_idx"]
    for i, axes in sorted(levels.items()):
        parts, more = [], any(s["more"] for some in axes.values() for s in some)
        for axis, some in sorted(axes.items()):
            if i == 0:
                parts.append(passed.rows(some, "prefix", "more").where(F.lit(True) if axis == "any" else F.col("parent").isNull()).select(*out, "more"))
            elif axis in ("after", "before") and any(s["place"] is not None for s in some):
                table = F.broadcast(_inline(spark, [[s["before"], s["prefix"], s["sig"], s["place"]] for s in some], "before long, prefix long, sig long, place int"))
                parts.append(_moved(front, passed.rows(list({s["sig"]: s for s in some}.values()), "sig"), table, axis, []))
            else:
                parts.append(_along(front, passed.rows(some, "before", "prefix"), axis).select(*out))
        new = reduce(DataFrame.unionByName, parts)
        counts.append(new if i == 0 or not more else settle_large(new))
        if more:
            front = settle_large(new.where("more").drop("more")) if i == 0 else counts[-1]
            fronts.append(front)
    last = [x for x in last if x[2]], [x for x in last if not x[2]]
    of = lambda rows, some: rows.select("page_id", F.explode(F.create_map(*[c for p, n in _grouped(some).items() for c in (F.lit(p), F.array(*map(F.lit, n)))])[F.col("prefix")]).alias("number"), "nid")
    single = None
    if last[1]:
        ends = [x[3] for x in last[1]]
        single = reduce(DataFrame.unionByName, [c.where(F.col("prefix").isin(ends)).select("page_id", "prefix", "nid") for c in counts])
        single = of(single, last[1]).groupBy("page_id", "number").agg(F.count("*").alias("n"), F.min("nid").alias("first_nid"))
    if not last[0]:
        return single, None
    found = reduce(DataFrame.unionByName, [f.select("page_id", "prefix", "nid") for f in fronts]).where(F.col("prefix").isin([x[3] for x in last[0]]))
    picks = {x[0]: x[1] for x in last[0] if x[1] is not None}
    several = of(found, last[0]).distinct()
    if picks:
        w, pick = Window.partitionBy("page_id", "number"), F.create_map(*[F.lit(x) for kv in picks.items() for x in kv])[F.col("number")]
        several = several.withColumns({"at": F.row_number().over(w.orderBy("nid")), "all": F.count("*").over(w), "pick": pick}).where("pick is null or pick = at or pick = -1 and at = all")
    return single, several.select("page_id", "number", "nid")


def _grouped(last: list[tuple]) -> dict[int, list[int]]:
    """The numbers of the locators that end with each prefix."""
    out: dict[int, list[int]] = {}
    for number, _, _, prefix in last:
        out.setdefault(prefix, []).append(number)
    return out


def _inline(spark, rows: list[list], schema: str) -> DataFrame:
    """A few rows without a task of Python's."""
    one = [F.struct(*[F.lit(x) for x in r]).cast(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>") for r in rows]
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*one)).alias("r")).select("r.*")


def _along(front: DataFrame, rows: DataFrame, axis: str) -> DataFrame:
    """The rows (page_id, before, prefix, nid, ...) that stand along an axis from an element in front of the way before."""
    anchors = front.withColumnRenamed("prefix", "before")
    if axis == "below":
        return _below(front, rows)
    if axis in ("after", "before"):
        near = anchors.groupBy("page_id", "before", "parent").agg((F.min("sib_idx") if axis == "after" else F.max("sib_idx")).alias("edge"))
        return rows.join(near, ["page_id", "before", "parent"]).where(F.col("sib_idx") > F.col("edge") if axis == "after" else F.col("sib_idx") < F.col("edge"))
    own = {"child": ["parent"], "next": ["parent", "sib_idx"], "up": ["nid"]}[axis]
    places = {"child": [F.col("nid").alias("parent")], "next": ["parent", (F.col("sib_idx") + 1).alias("sib_idx")], "up": [F.col("parent").alias("nid")]}[axis]
    return rows.join(anchors.select("page_id", "before", *places), ["page_id", "before", *own], "left_semi")


def _answers(kinds: dict[tuple[int, str], bool], steps: DataFrame, passed: DataFrame, last: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """page_id, number, n, first_nid of paths that are counted, and page_id, number, nid of those that are listed.

    kinds: which axes there are in which step, and whether more follows; passed: the elements that pass the steps' tests; last: where paths end.
    """
    counts, fronts, front, out = [], [], None, ["page_id", "prefix", "nid", "post", "parent", "sib_idx"]
    some = lambda df: df.groupBy("page_id", F.col("prefix").alias("q")).agg(F.count("*").alias("n"), F.min("nid").alias("first_nid"))
    for i in range(max((i for i, _ in kinds), default=-1) + 1):
        axes = sorted(axis for at, axis in kinds if at == i)
        own, more = steps.where(F.col("i") == i).drop("i"), any(kinds[i, axis] for axis in axes)
        if i == 0:
            new = own.join(passed, ["page_id", "sig"]).where("axis = 'any' or parent is null").select(*out, "more")
            counts.append(some(new))
            new = new.where("more").drop("more")
        else:
            own = {axis: own.where(F.col("axis") == axis).drop("axis") for axis in axes}
            parts = [_moved(front, passed, own[axis], axis, ["page_id"]) for axis in axes if axis != "below"]
            if "below" in axes:
                tops = front.select("page_id", F.col("prefix").alias("a"), F.col("nid").alias("pre"), "post")
                ends = own["below"].where("not more").select("page_id", F.col("prefix").alias("q"), F.col("before").alias("a"), F.col("sig").alias("b"))
                counts.append(counts_inside(tops, passed.select("page_id", F.col("sig").alias("b"), F.col("nid").alias("at"), "nid"), ends))
                if kinds[i, "below"]:
                    parts.append(_moved(front, passed, own["below"].where("more"), "below", ["page_id"]))
            if not parts:
                break
            new = settle_large(reduce(DataFrame.unionByName, parts))
            counts.append(some(new))
        front = settle_large(new) if i == 0 and more else new
        fronts.append(front)
    if not counts:
        return None, None
    every = reduce(DataFrame.unionByName, counts)
    single = last.where("not listed").select("page_id", "number", F.col("prefix").alias("q")).join(every, ["page_id", "q"]).select("page_id", "number", "n", "first_nid")
    found = reduce(DataFrame.unionByName, [f.select("page_id", "prefix", "nid") for f in fronts])
    several = last.where("listed").join(found, ["page_id", "prefix"]).select("page_id", "number", "pick", "nid").distinct()
    w = Window.partitionBy("page_id", "number")
    several = several.withColumns({"at": F.row_number().over(w.orderBy("nid")), "all": F.count("*").over(w)}).where("pick is null or pick = at or pick = -1 and at = all")
    return single, several
