"""Numbering, hops in bulk, visibility by style sheets, and named reports, against plain versions."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from domspark.operators import entries as E
from domspark.operators import export, numbering
from domspark.operators.verify import by_own_hops
from domspark.operators.visibility import rules, specificity, with_styles
from domspark.sources import dom


def shadowed(rng, depth=4):
    def some(d):
        kids = "".join(some(d - 1) for _ in range(rng.randint(0, 3))) if d else "t"
        shadow = f'<template shadowrootmode="open">{"".join(some(d - 1) for _ in range(rng.randint(0, 3)))}</template>' if d and rng.random() < 0.3 else ""
        attrs = rng.choice(["", "", f' id="i{rng.randint(0, 3)}"', f' class="{rng.choice(["a", "a 1b", "c"])}"'])
        tag = rng.choice(["div", "span", "b"])
        return f"<{tag}{attrs}>{shadow}{kids}</{tag}>"

    return "".join(some(depth) for _ in range(3))


@pytest.fixture(scope="module")
def shadow_nodes(spark):
    rng = random.Random(5)
    html = [shadowed(rng) for _ in range(6)] + ["", "<i>" * 90]
    return html, dom.nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).cache()


def test_numbers_from_parent_edges(shadow_nodes):
    html, n = shadow_nodes
    edges = n.select("page_id", "nid", "parent", "scope", "tag")
    kept = n.select("page_id", "nid", "sib_idx", "tag_idx", "tag_cnt", "scan_seq").collect()
    assert sorted(numbering.places(edges).select("page_id", "nid", "sib_idx", "tag_idx", "tag_cnt").collect()) == sorted(r[:5] for r in kept)
    got = {(r.page_id, r.nid): r.scan_rank for r in numbering.scan_order(edges).collect()}
    for p in range(len(html)):
        by_scan = [r.nid for r in sorted((r for r in kept if r.page_id == p), key=lambda r: r.scan_seq)]
        assert sorted((nid for q, nid in got if q == p), key=lambda nid, p=p: got[p, nid]) == by_scan
    paths = {(r.page_id, r.nid): r.path for r in numbering.absolute_paths(edges).collect()}
    of = {(r.page_id, r.nid): r for r in n.collect()}
    for (p, nid), r in of.items():
        want, x = "", r
        while x is not None:
            want = f"/{x.tag}" + (f"[{x.tag_idx}]" if x.tag_idx > 1 else "") + want
            x = of.get((p, x.parent))
        assert paths[p, nid] == want


def first_in_tree(rows, scope, segment):
    tag, _, rest = segment.partition("#")
    if rest:
        fits = lambda r: r.attrs.get("id") == rest
    else:
        tag, *classes = segment.replace("\\31 b", "1b").split(".")
        fits = lambda r: set(classes) <= set(r.attrs.get("class", "").split())
    return next((r.nid for r in rows if r.scope == scope and r.tag == tag and fits(r)), None)


def test_hops_of_all_elements(spark, shadow_nodes):
    html, n = shadow_nodes
    stored = n.select("page_id", "nid", E.own_hops().alias("hops"))
    odd = [(0, -1, [("leaf", None, "none")]), (0, -2, [("shadow", "html", None), ("leaf", None, "b")]), (0, -3, [("leaf", None, "b:hover")]), (99, -4, [("leaf", None, "b")]), (0, -5, [])]
    rows = by_own_hops(n, stored.unionByName(spark.createDataFrame(odd, stored.schema))).collect()
    pages = {p: sorted((r for r in n.where(f"page_id = {p}").collect()), key=lambda r: r.nid) for p in range(len(html))}
    hit = 0
    for r in rows:
        scope, to = -1, None
        for h in r.hops if r.nid >= 0 else []:
            to = first_in_tree(pages[r.page_id], scope, h.selector or h.host)
            if h.type == "shadow":
                scope = to if any(x.scope == to for x in pages[r.page_id]) else -9
        assert r.hop_nid == to
        hit += to == r.nid
    assert len(rows) == n.count() + 5 and hit > 50


def test_rules_of_style_sheets():
    css = """@import "x{"; /* p { display: none } */ #a .b > p:not(.c), ul li[x="a,b"] { color: red; DISPLAY : none !important ; visibility:hidden }
        @media print { p { display: none } } @media screen { p { pointer-events: none } } @font-face { display: none } a { display:none; """
    got = [(r["selector"], (r["ids"], r["marks"], r["tags"]), r["property"], r["value"], r["important"]) for r in rules(css)]
    assert got == [
        ("#a .b > p:not(.c)", (1, 2, 1), "display", "none", True), ('ul li[x="a,b"]', (0, 1, 2), "display", "none", True), ("#a .b > p:not(.c)", (1, 2, 1), "visibility", "hidden", False), ('ul li[x="a,b"]', (0, 1, 2), "visibility", "hidden", False),
        ("p", (0, 0, 1), "pointer-events", "none", False), ("a", (0, 0, 1), "display", "none", False),
    ]
    assert [specificity(s) for s in ("*", "li:nth-of-type(2)", "a.b.c#d", "[x] + p ~ .y", "a:not(#x)")] == [(0, 0, 0), (0, 1, 1), (1, 2, 1), (0, 2, 1), (1, 0, 1)]


def test_visibility_by_rules(spark, pages):
    html = [
        "<style>.a{visibility:hidden} .b{visibility:visible}</style>" + "<div class=a>" * 3 + "<i>1</i><div class=b><i>2</i><div class=a><i>3</i><p style='visibility:inherit'>4</p></div></div>",
        "<div style='display:none'><i>plain page: as it was</i></div><p>x</p>",
        "<style>[hidden]{display:block} input{display:block} p{display:none!important}</style><p style='display:block'>1</p><i hidden>2</i><input type=hidden><b style='display:none'>3</b>",
        "<style>b{display:none} b.x{display:inline} b{display:none}</style><b class=x>1</b><b>2</b><div><template shadowrootmode='open'><b>3</b></template></div>",
        "<style>i{display:none}</style><style>i{display:block}</style><i>1</i>",
        None,
    ]
    n = dom.nodes(pages(*html)).cache()
    got = {(r.page_id, r.text or r.brief): r.visible for r in with_styles(n).where("tag in ('i', 'p', 'b')").collect()}
    assert got == {
        (1, "1"): False, (1, "2"): True, (1, "3"): False, (1, "4"): False, (2, "plain page: as it was"): False, (2, "x"): True, (3, "1"): False, (3, "2"): True, (3, "3"): False, (4, "1"): True, (4, "2"): False, (4, "3"): True, (5, "1"): True,
    }
    assert not with_styles(n).where("tag = 'input'").first().visible and with_styles(n).count() == n.count()


def test_named_reports(spark, tmp_path):
    kind = "page_id long, seq int, id string, name string, tag string, locators array<struct<type:string,value:string,stability:int>>, hops array<struct<type:string,host:string,selector:string>>"
    rows = [(1, i, f"n{i}::a", f'n "{i}"', "a", [("css", f"#x{i}", 80), ("xpath", "//a", None)], [("leaf", None, "a")]) for i in range(300)]
    store = E.upsert(None, spark.createDataFrame(rows, kind).repartition(5))
    now = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone(timedelta(hours=2)))
    export.ROWS_PER_FILE, old = 70, export.ROWS_PER_FILE
    try:
        names = export.save_json(store, str(tmp_path), now), export.save_text(store, str(tmp_path), now, "Title")
        export.save_json(store.limit(0), str(tmp_path / "none"), now)
    finally:
        export.ROWS_PER_FILE = old
    assert names == ("locators-2024-05-06T05-08-09.json", "report-2024-05-06T05-08-09.txt")
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(names)  # no parts are left, and no file of an empty store
    assert (tmp_path / names[0]).read_text() == json.dumps([{"name": r[3], "tag": "a", "locators": {"css": r[5][0][1], "xpath": "//a"}} for r in rows], indent=2)
    text = "Title\n" + "=" * 49 + "\n\nTotal Locators: 300\n\n"
    for i, r in enumerate(rows, 1):
        text += f'--- Element {i} ---\nID: {r[2]}\nName: {r[3]}\nTag: <a>\nHops: [{{"type":"leaf","selector":"a"}}]\n\n [CSS] [stability=80]\n {r[5][0][1]}\n\n [XPATH]\n //a\n\n---------------------\n\n'
    assert (tmp_path / names[1]).read_text() == text


def test_numbers_of_entries_whatever_ids_pages_have(spark, monkeypatch):
    monkeypatch.setattr(export, "ROWS_PER_FILE", 10)
    rows = spark.createDataFrame([(f"page {i % 9}", i, f"n{i}::a", f"n{i}", "a", [], None) for i in range(95)], "page_id string, seq int, id string, name string, tag string, locators array<struct<type:string,value:string,stability:int>>, hops array<string>")
    store = E.upsert(None, rows)
    got = [r.row.split()[2] for r in export.text_rows(store, "T").where("part = 1").orderBy("ord").collect()]
    assert got == [str(i) for i in range(1, 96)]


def test_entries_of_deep_pages_have_no_long_rows(pages):
    n = dom.nodes(pages("<i>" * 5_000 + "x"), columns=("nid", "post", "parent", "scope", "tag"))
    assert n.count() == 5_003 and numbering.places(n).agg(F.max("tag_cnt")).first()[0] == 1
