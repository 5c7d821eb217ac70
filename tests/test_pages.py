import pytest
from pyspark.sql import functions as F

from domspark.operators import entries as E
from domspark.operators import export, review
from domspark.operators.candidates import added
from domspark.operators.strategies import locators
from domspark.operators.verify import verified
from domspark.sources import dom

GOLDEN = '<html><head><title>t</title></head><body><form id="login"><label for="u">User</label><input id="u" name="user" type="text"><button data-testid="go" class="btn primary">Sign in</button></form><ul id="menu"><li><a href="/a">Home</a></li><li><a href="/b">Home</a></li></ul></body></html>'
BUTTON = [
    ("css", '[data-testid="go"]', 85), ("xpath", "//*[@data-testid='go']", 85), ("css", 'button[data-testid="go"]', 85), ("xpath", "//button[@data-testid='go']", 85), ("xpath", "//button[normalize-space(.)='Sign in']", 55),
    ("xpath", "//button[contains(normalize-space(.), 'Sign in')]", 45), ("css", "#login button.btn", 60), ("xpath", "//form[@id='login']//button[contains(@class, 'btn')]", 50), ("xpath", "//form[@id='login']//button[normalize-space(.)='Sign in']", 55),
    ("css", "#login > button", 60), ("css", "button.btn.primary", 60), ("xpath", "//input[@id='u']/following-sibling::button[1]", 45),
]


@pytest.fixture(scope="module")
def found(spark):
    n = dom.nodes(spark.createDataFrame([(1, GOLDEN)], "page_id long, html string"))
    e = E.entries(locators(n)).cache()
    return n, e


def test_scan_order_and_entries(found):
    rows = found[1].orderBy("seq").collect()
    assert [r.id for r in rows] == ["UserSign in::form", "HomeHome::ul", "user::input", "Home::li", "Sign in::button", "Home::a", "Home::li", "Home::a"]
    button = rows[4]
    assert [tuple(x) for x in button.locators] == BUTTON
    assert [tuple(h) for h in button.hops] == [("leaf", None, "button.btn.primary")]
    assert [x.value for x in rows[7].locators] == ["#menu li:nth-of-type(2) > a", "//ul[@id='menu']//li[2]/a", 'a[href="\\/b"]', "//a[@href='/b']"]


def test_upsert_keeps_the_first_place_and_the_last_row(found):
    once = E.upsert(None, found[1])
    rows = once.orderBy("ord").collect()
    assert [r.id for r in rows] == ["UserSign in::form", "HomeHome::ul", "user::input", "Home::li", "Sign in::button", "Home::a"]
    assert rows[5].locators[2].value == 'a[href="\\/b"]'
    again = E.upsert(once, found[1], batch=1)
    assert [r.id for r in again.orderBy("ord").collect()] == [r.id for r in rows]


def test_review(found):
    store = E.upsert(None, found[1])
    row = store.where("id = 'Sign in::button'").select(review.best_locator(F.col("locators")).alias("b"), review.last_by_type(F.col("locators")).alias("m"), review.sorted_locators(F.col("locators")).alias("s")).first()
    assert row.b.value == '[data-testid="go"]'
    assert row.m == {"css": "button.btn.primary", "xpath": "//input[@id='u']/following-sibling::button[1]"}
    assert [x.type for x in row.s] == ["css"] * 5 + ["xpath"] * 7
    assert review.name_search(store, "SIGN IN").count() == 2
    assert review.ranked(store, "ord").first().id == "Sign in::button"


def test_json_export(found, tmp_path):
    import json

    store = E.upsert(None, found[1])
    export.write_rows(export.json_rows(store), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).rstrip("\n")
    assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    assert [x["name"] for x in json.loads(text)][:2] == ["UserSign in", "HomeHome"]
    assert export.json_rows(store.limit(0)).count() == 0


def test_export_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "ROWS_PER_FILE", 100, raising=False)
    rows = spark.range(1000).selectExpr("1 AS part", "id AS ord", "cast(id AS string) AS row").repartition(3)
    export.write_rows(rows, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 5
    assert "".join(p.read_text() for p in files).split() == [str(i) for i in range(1000)]


def test_text_export(found):
    store = E.upsert(None, found[1])
    rows = [r.row for r in export.text_rows(store, "Report").orderBy("part", "ord").collect()]
    assert rows[0].startswith("Report\n=") and "Total Locators: 6" in rows[0]
    assert rows[1].startswith("--- Element 1 ---\nID: UserSign in::form\nName: UserSign in\nTag: <form>\nHops: ")
    assert " [ID] [stability=80]\n login\n\n" in rows[1]


def test_each_unique_locator_finds_one_element(found):
    n, e = found
    asked = e.select("page_id", F.explode("locators").alias("x")).select("page_id", "x.type", "x.value")
    rows = verified(n, asked).collect()
    assert {r.verdict for r in rows} == {"success-1"}
    assert len(rows) == len({(x.type, x.value) for r in e.collect() for x in r.locators})


def test_verdicts(found, spark):
    asked = {
        ("xpath-abs", "/html/body/ul/li/a"): (2, "success-multi"), ("xpath-abs", "/html/body/ul/li[2]/a"): (1, "success-1"), ("css", "li"): (2, "success-multi"), ("css", "#none"): (0, "error"), ("css", "a:hover"): (None, "Err"),
        ("xpath", "//li["): (None, "Err"), ("css", "ul > li"): (2, "success-multi"), ("css", "#menu a"): (2, "success-multi"), ("css", "#menu > a"): (0, "error"), ("xpath", "//a[normalize-space(.)='Home']"): (2, "success-multi"),
        ("xpath", "//ul[@id='menu']//li[2]/a[normalize-space(.)='Home']"): (1, "success-1"), ("xpath", "//label[normalize-space(.)='User']/following-sibling::button[1]"): (1, "success-1"),
        ("xpath", "//button[contains(@class, 'prim')]"): (1, "success-1"), ("css", "button.primary.btn"): (1, "success-1"), ("css", "button.btn.none"): (0, "error"), ("id", "u"): (1, "success-1"), ("css", 'a[href="\\2f a"]'): (1, "success-1"),
    }
    rows = verified(found[0], spark.createDataFrame([(1, *k) for k in asked], "page_id long, type string, value string")).collect()
    assert {(r.type, r.value): (r.matches, r.verdict) for r in rows} == asked


def plain_siblings(rows):
    """By trying each earlier sibling of each element, the nearest first; rows: one page's elements."""
    light = [r for r in rows if r.scope == -1]

    def following(p, tag, k):
        behind = [r for r in light if r.parent == p.parent and r.sib_idx > p.sib_idx and r.tag == tag]
        return behind[k - 1].nid if len(behind) >= k else None

    out = {}
    for e in light:
        if e.parent is None or not e.wanted:
            continue
        before, k = sorted((r for r in light if r.parent == e.parent and r.sib_idx < e.sib_idx), key=lambda r: -r.sib_idx), 1
        for p in before:
            for fits in ([lambda r, p=p: r.tag == p.tag and p.attr in r.attrs and r.attrs[p.attr] == p.value] if p.attr else []) + ([lambda r, p=p: r.tag == p.tag and r.norm == p.etext] if p.etext else []):
                ends = {following(q, e.tag, k) for q in light if fits(q)} - {None}
                if len(ends) == 1 and e.nid not in out:
                    out[e.nid] = (p.sib_idx, k)
            if p.tag == e.tag:
                k += 1
    return out


def test_siblings_by_trying_all(spark, pages):
    import random

    from domspark.functions.locators import PREFERRED, stable_attribute
    from domspark.operators.candidates import described
    from domspark.operators.strategies import sibling_locators

    rng = random.Random(3)
    html = []
    for _ in range(12):
        def some(depth):
            kids = "".join(some(depth - 1) for _ in range(rng.randint(0, 5))) if depth else rng.choice(["", "x", "y", "z"])
            tag = rng.choice(["div", "p", "li", "b"]) if depth else rng.choice(["p", "span", "b"])
            attr = rng.choice(["", "", f' data-cy="{rng.randint(0, 3)}"', f' id="i{rng.randint(0, 4)}"'])
            return f"<{tag}{attr}>{kids}</{tag}>"
        html.append("<div>" + "".join(some(2) for _ in range(4)) + "</div>")
    n = dom.nodes(pages(*html))
    s = stable_attribute(F.col("attrs"), PREFERRED)
    rows = described(n).select("page_id", "nid", "parent", "scope", "sib_idx", "tag", "attrs", "norm", "etext", s["attr"].alias("attr"), s["value"].alias("value"), (F.col("candidate") & F.col("visible")).alias("wanted")).collect()
    want = {(p, nid): k for p in range(1, 13) for nid, (_, k) in plain_siblings([r for r in rows if r.page_id == p]).items()}
    got = {(r.page_id, r.nid): int(r.sibling.rpartition("[")[2][:-1]) for r in sibling_locators(n).collect()}
    assert got == want


def test_a_page_of_many_elements(pages):
    html = "<ul id='l'>" + "".join(f"<li><span>t{i}</span></li>" for i in range(4_000)) + "</ul>"
    e = locators(dom.nodes(pages(html)))
    assert e.where("tag = 'span'").select(F.min(F.size("locators"))).first()[0] >= 2
    assert e.where("tag = 'li'").count() == 4_000


def test_trees():
    def show(html):
        return [(r["tag"], r["parent"], r["text"]) for r in dom._rows(1, html)]

    assert show("<p><b>a<br><p>c") == [("html", None, None), ("head", 0, None), ("body", 0, None), ("p", 2, "a"), ("b", 3, None), ("br", 4, None), ("p", 2, "c"), ("b", 6, None)]
    assert [t for t, *_ in show("<ul><li>a<li>b<ul><li>c</ul></ul>")] == ["html", "head", "body", "ul", "li", "li", "ul", "li"]
    assert show("")[-1][0] == "body"
    assert [t for t, *_ in show("<table><tr><td>x<td>y</table>")][3:] == ["table", "tbody", "tr", "td", "td"]
    rows = list(dom._rows(1, '<script>var t="</p>";</script><title>a &amp; b</title><div hidden><p>x</p></div>'))
    assert [r["visible"] for r in rows if r["tag"] == "p"] == [False]
    assert len(rows) == 7


def test_shadow_tree(spark, pages):
    n = dom.nodes(pages('<div id="host"><template shadowrootmode="open"><button id="in">Go</button></template></div>'))
    row = E.entries(locators(n)).where("tag = 'button'").first()
    assert [tuple(h) for h in row.hops] == [("shadow", "div#host", None), ("leaf", None, "button#in")]
    assert [x.type for x in row.locators] == ["id"]  # selectors of the document don't look into shadow trees


def test_added_elements(spark, pages):
    n = dom.nodes(pages("<div><p>a</p><p>b</p></div><p>c</p>")).cache()
    top = n.where("tag = 'div'").select("page_id", "nid")
    assert sorted(r.text for r in added(n, top).where("tag = 'p'").collect()) == ["a", "b"]


def test_missing_pages(spark):
    n = dom.nodes(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string"))
    assert n.count() == 6
    assert locators(n).count() == 0


def test_hops_lead_back(pages):
    from domspark.operators.verify import by_hops

    n = dom.nodes(pages('<div id="host"><template shadowrootmode="open"><p><button class="a 1b">Go</button></p></template></div><button>Other</button>', "<p>x</p>"))
    hops = [{"type": "shadow", "host": "div#host"}, {"type": "leaf", "selector": "button.a.\\31 b"}]
    got = [(r.page_id, r.nid) for r in by_hops(n, hops).collect()]
    assert got == [(1, n.where("page_id = 1 and tag = 'button' and scope >= 0").first().nid)]
    assert by_hops(n, [{"type": "shadow", "host": "button"}, hops[1]]).count() == 0


def test_first_matches(found, spark):
    from domspark.operators.verify import first_matches

    n = found[0]
    nid = lambda where: n.where(where).agg(F.min("nid")).first()[0]
    asked = spark.createDataFrame([(1, "css", "a"), (1, "other", "a"), (1, "id", "menu"), (1, "xpath", "//li[normalize-space(.)='Home']"), (1, "css", "#none"), (1, "xpath", "//li[")], "page_id long, type string, value string")
    want = {("css", "a"): nid("tag = 'a'"), ("other", "a"): nid("tag = 'a'"), ("id", "menu"): nid("tag = 'ul'"), ("xpath", "//li[normalize-space(.)='Home']"): nid("tag = 'li'"), ("css", "#none"): None, ("xpath", "//li["): None}
    assert {(r.type, r.value): r.nid for r in first_matches(n, asked).collect()} == want
    assert {(r.type, r.value): r.nid for r in first_matches(n, asked, strict=True).collect()} == want | {("other", "a"): None}


def test_preferred_attributes_from_a_setting(found):
    from domspark.functions.locators import PREFERRED, preferred_attributes

    assert preferred_attributes(None) == preferred_attributes("") == PREFERRED
    assert preferred_attributes(" data-x , name,,") == ["data-x", "name", "", ""]
    assert preferred_attributes("", changed=True) == [""]
    e = locators(found[0], preferred_attributes("", changed=True))
    assert [x.strategy for x in e.where("tag = 'button'").first().locators][:2] == ["class", "class"]
