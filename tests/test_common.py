"""Locators that many pages ask are taken apart once, and find the same."""

import random

from test_resolve import css, fitting, follow, page, tree, xpath

from domspark.operators import resolve
from domspark.operators.verify import verified
from domspark.operators.visibility import rules, sheet_rules
from domspark.sources import dom


def test_locators_that_all_pages_ask(spark, pages, monkeypatch):
    rng = random.Random(5)
    html = [page(rng) for _ in range(4)]
    trees = [tree(h) for h in html]
    want = {}
    for i in range(100):
        own = range(4) if i < 60 else [rng.randrange(4)]  # the last ones are asked of one page each
        text, steps = xpath(rng) if i % 2 else css(rng)
        for p in own:
            found = (follow if i % 2 else fitting)(*trees[p], steps)
            want[p + 1, "xpath" if i % 2 else "css", text] = (len(found), found[0].nid if found else None)
    want |= {(p, "xpath", f"({text})[last()]"): (1, 2) for p in range(1, 5) for text in ("/html/body",)} | {(p, "css", "a:hover"): (None, None) for p in range(1, 5)} | {(p, "xpath", "/HTML/body[1]"): (1, 2) for p in range(1, 5)}
    asked = spark.createDataFrame(list(want), "page_id long, type string, value string")
    assert len(resolve.common(asked)) > 40
    n = dom.nodes(pages(*html)).cache()
    got = {(r.page_id, r.type, r.value): (r.matches, r.first_nid) for r in verified(n, asked.union(asked)).collect()}
    taken = {k: v for k, v in got.items() if v[0] is not None}
    assert set(got) == set(want) and {k: (v, want[k]) for k, v in taken.items() if v != want[k]} == {} and len(taken) > 0.9 * len(want)
    parsed = []
    monkeypatch.setattr(resolve, "parsed", lambda df: parsed.append(df) or 1 / 0)
    assert verified(n, asked.where("value = 'a:hover'")).count() == 4 and not parsed


def test_sheets_of_many_pages(spark, pages):
    sheets = ["p { display: none }", "p, b { visibility: hidden }", "p { display: none }", ""]
    n = dom.nodes(pages(*[f"<style>{s}</style><p>x</p>" for s in sheets], "<p>none</p>"))
    got = sorted((r.page_id, r.selector, r.property) for r in sheet_rules(n).collect())
    assert got == sorted((i, r["selector"], r["property"]) for i, s in enumerate(sheets, 1) for r in rules(s))


def test_tests_take_no_other_columns_along(spark, pages):
    n = dom.nodes(pages("<p>x</p>"))
    assert {"up", "hosts", "after"} <= set(n.columns) and set(resolve._light(n, False).columns) == set(resolve.COLUMNS) - {"page_text"}
