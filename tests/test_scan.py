"""The scan's own table of elements: less than the page has, with the same locators."""

import random

from pyspark.sql import functions as F

from domspark.operators import matching
from domspark.operators.strategies import COLUMNS, locators, prepared
from domspark.sources.dom import nodes

KEYS = ("page_id", "nid", "scan_seq", "scope", "name", "tag")


def located(n):
    return sorted((*(r[k] for k in KEYS), sorted(r["attrs"].items()), str(r["hosts"]), [tuple(x) for x in r["locators"]]) for r in locators(n).collect())


def some_page(rng):
    out, left = [], []
    for _ in range(rng.randrange(10, 40)):
        tag = rng.choice(["p", "div", "span", "a", "b", "i", "em", "section", "ul", "li", "x-card", "svg", "button", "img"])
        attrs = "".join(f' {a}="{rng.choice(v)}"' for a, v in {"id": "uvw", "class": ["c", "d", "c d", "e12345"], "name": "nm", "href": ["/1", "/2"], "data-cy": "yz", "role": ["link", "note"], "title": "ts", "hidden": "h"}.items() if rng.random() < 0.15)
        shadow = '<template shadowrootmode="open"><b>in</b><a class="c">deep</a></template>' if rng.random() < 0.1 else ""
        out.append(f"<{tag}{attrs}>{shadow}{rng.choice(['', 'one', 'two', 'three four', ' one '])}")
        left.append(tag)
        while left and rng.random() < 0.55:
            out.append(f"</{left.pop()}>")
    return '<meta name="n"><title>one</title>' + "".join(out)


def test_pruned_elements_give_the_same_locators(spark, pages):
    rng = random.Random(7)
    own = pages("<p>a<b>x</b><b>y</b><br></p><i>k</i><p>b</p><em name='m'>z</em><input name='m'>", *[some_page(rng) for _ in range(120)])
    whole, scan = nodes(own, columns=COLUMNS), nodes(own, columns=COLUMNS, scan=True)
    want = located(whole)
    assert len(want) > 500 and any(x[0] == "sibling" for r in want for x in r[-1])
    assert located(scan) == want
    assert scan.count() < whole.count()
    first = [r.tag for r in scan.where("page_id = 1").orderBy("nid").collect()]
    assert first == ["html", "body", "p", "i", "p", "em", "input"]  # neither head nor b nor br, of which no locator can speak


def test_forms_that_nobody_asks_for_are_not_made(spark, pages):
    d = prepared(nodes(pages('<a href="/1" rel="x" id="i">t</a>'), columns=COLUMNS), ["data-cy"])
    every = {r.form for r in matching.forms(d).where("nid > 2").collect()}
    some = {r.form for r in matching.forms(d, ["id", "href"]).where("nid > 2").collect()}
    assert some == {"a", "a|:1", "a|=t", "a|id=i", "*|id=i", "a|href=/1", "*|href=/1"}
    assert every == some | {"a|rel=x", "*|rel=x"}


def test_elements_without_later_siblings_are_no_anchors(spark, pages):
    from domspark.operators.strategies import _anchors

    d = prepared(nodes(pages("<ul><li>a</li><li>b</li></ul><p>c</p>"), columns=COLUMNS), ["data-cy"])
    assert sorted(r.akey for r in _anchors(d).select(F.col("akey")).collect()) == ["li|=a", "ul|=ab"]  # neither b nor c, which nothing follows


def test_dynamic_strings_are_told_by_one_pattern(spark):
    import re

    from domspark.functions.locators import is_dynamic

    rng = random.Random(3)
    parts = ["uuid", "GUID", "Token", "session", "deadbe", "abc12", "1234", "12345", "__", "ember", "react-", "ext-gen", "-", "_", ".", " ", "x", "ü", "g", "ſ", "\n", "F00", "f00"]
    strings = ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(3_000)] + ["", "\nember", "toKen", "toKen"]
    old = ("[0-9]{5,}", "(?<![A-Za-z0-9_])(?i:uuid|guid|token|session)(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])[a-f0-9]{6,}(?![A-Za-z0-9_])", r"\A(ext-gen|j_id|ui-id|yui_|ember|react-|__|mx_)")
    got = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string").select("i", is_dynamic(F.col("s")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: any(re.search(p, s, re.ASCII) for p in old) for i, s in enumerate(strings)}
    pattern = spark.range(1).select(is_dynamic(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert pattern.count("RLIKE") == 1


def test_questions_about_own_forms_are_counted_where_forms_and_marks_meet(spark, pages, monkeypatch):
    from domspark.operators import strategies

    written = []
    for module in (strategies, matching):
        settle = module.settle_large
        monkeypatch.setattr(module, "settle_large", lambda df, settle=settle: written.append(df.columns) or settle(df))
    own = pages("<ul><li>a</li><li>b</li></ul>", '<p class="c">one</p><a href="/1">x</a><a href="/1">x</a>')
    got = {(r.page_id, r.name): [tuple(x)[:3] for x in r.locators] for r in locators(nodes(own, columns=COLUMNS, scan=True)).collect()}
    assert got[1, "b"] == [("text", "xpath", "//li[normalize-space(.)='b']"), ("text_part", "xpath", "//li[contains(normalize-space(.), 'b')]"), ("sibling", "xpath", "//li[normalize-space(.)='a']/following-sibling::li[1]")]
    assert (2, "one") in got
    assert len(written) == 3  # elements, possible locators, and what met: questions and fitting elements are no tables of their own
    d = prepared(nodes(own, columns=COLUMNS), ["data-cy"])
    assert {r.form for r in matching.forms(d, ["href"], (), steps=False).where("page_id = 2").collect()} == {"html|=onexx", "body|=onexx", "head|=", "p|=one", "p|.c", "a|=x", "a|href=/1"}


def test_a_search_locates_what_it_can_find_only(spark, pages):
    from domspark.operators.entries import entries, upsert
    from domspark.operators.review import may_be_named, name_search

    rng = random.Random(11)
    own = pages('<p id="i">One</p><a::b id="x">y</a::b><b id="z" title="y::a">ONE::</b><i id="u">none</i><p id="j">One</p>', *[some_page(rng) for _ in range(40)])
    n = nodes(own, columns=COLUMNS, scan=True)
    rows = lambda df: sorted((r.page_id, r.id, r.name, r.tag, r.ord, [tuple(x) for x in r.locators]) for r in df.collect())
    for term in ("one", "Y", "::"):
        some = locators(n, where=may_be_named(term))
        want = rows(name_search(upsert(None, entries(locators(n))), term))
        assert want and rows(name_search(upsert(None, entries(some)), term)) == want
    assert some.count() < locators(n).count()


def test_the_scan_has_no_more_of_own_texts_than_is_asked_for(spark, pages):
    long = "w " * 40
    n = nodes(pages(f"<p> {long}</p><p>  short </p>"), columns=COLUMNS, scan=True)
    assert [r.direct_text for r in n.where("tag = 'p'").orderBy("nid").collect()] == [long[:60], "short"]


def test_an_entry_is_not_merged_before_its_writes_meet(spark, pages):
    from domspark.operators.entries import entries, upsert

    n = nodes(pages("<p id='a'>x</p><p id='b'>x</p><p id='c'>y</p>"), columns=COLUMNS, scan=True)
    store = upsert(None, entries(locators(n)))
    got = {r.id: (r.ord["seq"] < r.seq, r.locators[0]["value"]) for r in store.collect()}
    assert got == {"x::p": (True, "b"), "y::p": (False, "c")}
    assert "max_by" not in store._jdf.queryExecution().optimizedPlan().toString()
