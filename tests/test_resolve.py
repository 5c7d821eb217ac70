"""Locators against a plain evaluator, which knows what each random locator means and never reads its text."""

import random

from pyspark.sql import functions as F

from domspark.operators.intervals import counts_inside, inside
from domspark.operators.strategies import locators
from domspark.operators.verify import verified
from domspark.sources import dom

TAGS, WORDS = ["div", "p", "li", "b", "span"], ["Save", "it's", "all  of", "x", "hello", ""]
ASCII = " \t\r\n\f"


def page(rng, depth=4):
    def some(d):
        kids = "".join(some(d - 1) if rng.random() < 0.8 else f"<i>{rng.choice(WORDS)}</i> " for _ in range(rng.randint(0, 4))) if d else rng.choice(WORDS)
        attrs = "".join(f' {a}="{v}"' for a, v in (("class", rng.choice(["x", "x y", "btn  x", "primary"])), ("id", f"i{rng.randint(0, 3)}"), ("name", rng.choice(["n1", "n2", ""]))) if rng.random() < 0.4)
        tag = rng.choice(["div", "span", "b"] if d else TAGS)
        return f"<{tag}{attrs}>{kids}</{tag}>"

    return "<div>" + "".join(some(depth - 1) for _ in range(4)) + "</div>"


def tree(html):
    root = dom.build(html)
    every = dom.number(root)
    parent = {c: e for e in every for c in e.elements()}
    return root, every, parent


def norm(s):
    return " ".join(w for w in s.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w)


def quoted(s):
    return f'"{s}"' if "'" in s else f"'{s}'"


def xpath_condition(rng, depth=0):
    """Text and meaning of a condition."""
    w = rng.choice(["Save", "it's", "all of", "x", "hello", "a"])
    a, v = rng.choice(["class", "id", "name"]), rng.choice(["x", "i1", "n1", "btn  x", ""])
    own = lambda e: dom.content(e)
    kinds = [
        (f"@{a}={quoted(v)}", lambda e: e.attrs.get(a) == v), (f"@{a} != {quoted(v)}", lambda e: a in e.attrs and e.attrs[a] != v), (f"@{a}", lambda e: a in e.attrs), (f"not(@{a})", lambda e: a not in e.attrs),
        (f"normalize-space(.)={quoted(w)}", lambda e: norm(own(e)) == w), (f"contains(normalize-space(.), {quoted(w)})", lambda e: w in norm(own(e))), (f"contains(., {quoted(w)})", lambda e: w in own(e)), (f".={quoted(w)}", lambda e: own(e) == w),
        (f"contains(@{a}, {quoted(v)})", lambda e: v in e.attrs.get(a, "")), (f"starts-with(@{a}, {quoted(v)})", lambda e: e.attrs.get(a, "").startswith(v)), ("normalize-space()", lambda e: norm(own(e)) != ""),
        ("contains(concat(' ', normalize-space(@class), ' '), ' x ')", lambda e: " x " in f" {norm(e.attrs.get('class', ''))} "), (f"concat(@{a}, '-', @class) = '{v}-x'", lambda e: f"{e.attrs.get(a, '')}-{e.attrs.get('class', '')}" == f"{v}-x"),
        ("@id = @name", lambda e: "id" in e.attrs and e.attrs["id"] == e.attrs.get("name")),
    ]
    if depth < 2 and rng.random() < 0.3:
        (s, f), (t, g) = xpath_condition(rng, depth + 1), xpath_condition(rng, depth + 1)
        return rng.choice([(f"({s} or {t})", lambda e: f(e) or g(e)), (f"({s} and {t})", lambda e: f(e) and g(e)), (f"not({s} and {t})", lambda e: not (f(e) and g(e))), (f"{s} and not({t})", lambda e: f(e) and not g(e))])
    return rng.choice(kinds)


def xpath(rng):
    """Text, and steps (slash, axis, tag, predicates (condition or place))."""
    text, steps = "", []
    for i in range(rng.randint(1, 4)):
        slash = rng.choice(["//", "/"]) if i else "//"
        axis = rng.choice(["child"] * 5 + ["following-sibling", "preceding-sibling", "parent", "descendant"]) if i and slash == "/" else "child"
        tag, preds, shown = rng.choice([*TAGS, "*"]), [], ""
        if rng.random() < 0.6:
            s, f = xpath_condition(rng)
            preds.append(f)
            shown += f"[{s}]"
        if rng.random() < 0.4 and axis not in ("parent", "descendant"):
            n = rng.choice([1, 2, 3, -1])
            preds.append(n)
            shown += f"[{'last()' if n == -1 else rng.choice(['', 'position()='])}{n if n > 0 else ''}]" if n > 0 else "[last()]"
            if rng.random() < 0.3 and axis == "child":
                s, f = xpath_condition(rng)
                preds.append(f)
                shown += f"[{s}]"
        text += slash + (f"{axis}::" if axis != "child" or rng.random() < 0.1 else "") + tag + shown
        steps.append((slash, axis, tag, preds))
    return text, steps


def follow(root, every, parent, steps):
    def along(e, axis):
        if axis == "child":
            return [root] if e is None else e.elements()
        if axis == "descendant":
            return [x for x in every if x is not e and e.nid < x.nid <= e.post]
        if axis == "parent":
            return [parent[e]] if e in parent else []
        kids = parent[e].elements() if e in parent else [e]
        at = kids.index(e)
        return kids[at + 1 :] if axis == "following-sibling" else kids[:at][::-1]

    here = [None]  # the document
    for slash, axis, tag, preds in steps:
        if slash == "//":
            here = [x for c in here for x in ([None, *every] if c is None else [e for e in every if c.nid <= e.nid <= c.post])]
        found = set()
        for c in here:
            some = [e for e in along(c, axis) if tag in ("*", e.tag)]
            for p in preds:
                some = [e for k, e in enumerate(some, 1) if (k == p or p == -1 and k == len(some) if isinstance(p, int) else p(e))]
            found.update(some)
        here = sorted(found, key=lambda e: e.nid)
    return here


def css_compound(rng):
    tag = rng.choice([*TAGS, "*", ""])
    a, v = rng.choice(["class", "id", "name"]), rng.choice(["x", "i1", "n1", "bt", "primary"])
    at = lambda e: e.attrs.get(a)
    place = lambda e, own: own(e)
    parts = [
        (".x", lambda e, t: "x" in e.attrs.get("class", "").split()), ("#i1", lambda e, t: e.attrs.get("id") == "i1"), ("#\\69 2", lambda e, t: e.attrs.get("id") == "i2"), (f"[{a}]", lambda e, t: at(e) is not None), (f'[{a}="{v}"]', lambda e, t: at(e) == v),
        (f"[{a}^='{v}']", lambda e, t: (at(e) or "").startswith(v)), (f"[{a}$={v}]", lambda e, t: (at(e) or "").endswith(v)), (f"[ {a} *= '{v}' ]", lambda e, t: v in (at(e) or "")), (f"[{a}~={v}]", lambda e, t: v in (at(e) or "").split()), ("[name*='']", lambda e, t: False),
        (":nth-of-type(2)", lambda e, t: place(e, t)[1] == 2), (":nth-child(2)", lambda e, t: place(e, t)[0] == 2), (":first-child", lambda e, t: place(e, t)[0] == 1), (":last-of-type", lambda e, t: place(e, t)[1] == place(e, t)[2]), (":not(.x)", lambda e, t: "x" not in e.attrs.get("class", "").split()),
        (":not(div#i1)", lambda e, t: not (e.tag == "div" and e.attrs.get("id") == "i1")), (":only-of-type", lambda e, t: place(e, t)[2] == 1),
    ]
    some = [rng.choice(parts) for _ in range(rng.randint(0 if tag else 1, 2))]
    return tag + "".join(s for s, _ in some), lambda e, t: (tag in ("", "*") or e.tag == tag) and all(f(e, t) for _, f in some)


def css(rng):
    text, steps = css_compound(rng)[0], None
    first = css_compound(rng)
    text, steps = first[0], [(None, first[1])]
    for _ in range(rng.randint(0, 3)):
        sign, (s, f) = rng.choice([" ", " > ", ">", " + ", "~"]), css_compound(rng)
        text, steps = text + sign + s, [*steps, (sign.strip() or " ", f)]
    return text, steps


def fitting(root, every, parent, steps):
    kids = {e: (parent[e].elements() if e in parent else [e]) for e in every}
    places = lambda e: (kids[e].index(e) + 1, [x for x in kids[e] if x.tag == e.tag].index(e) + 1, sum(x.tag == e.tag for x in kids[e]))

    def fits(e, i):
        sign, f = steps[i]
        if not f(e, places):
            return False
        if i == 0:
            return True
        if sign in (" ", ">"):
            up = parent.get(e)
            while up is not None:
                if fits(up, i - 1):
                    return True
                up = parent.get(up) if sign == " " else None
            return False
        before = kids[e][: kids[e].index(e)]
        return any(fits(x, i - 1) for x in (before if sign == "~" else before[-1:]))

    return [e for e in every if fits(e, len(steps) - 1)]


def test_random_locators_on_random_pages(spark, pages):
    rng = random.Random(11)
    html = [page(rng) for _ in range(5)]
    trees = [tree(h) for h in html]
    want, rows = {}, []
    while len(want) < 900:
        p = rng.randrange(len(html))
        if rng.random() < 0.55:
            text, steps = xpath(rng)
            found, kind = follow(*trees[p], steps), "xpath"
            if rng.random() < 0.1:
                n = rng.choice([1, 2, -1])
                text, found = f"({text})[{n if n > 0 else 'last()'}]", (found[n - 1 : n] if n > 0 else found[-1:])
            elif rng.random() < 0.1:
                more, others = xpath(rng)
                text, found = f"{text} | {more}", sorted({*found, *follow(*trees[p], others)}, key=lambda e: e.nid)
        else:
            text, steps = css(rng)
            found, kind = fitting(*trees[p], steps), "css"
            if rng.random() < 0.15:
                more, others = css(rng)
                text, found = f"{text}, {more}", sorted({*found, *fitting(*trees[p], others)}, key=lambda e: e.nid)
        want[p + 1, kind, text] = (len(found), found[0].nid if found else None)
    rows = spark.createDataFrame(list(want), "page_id long, type string, value string")
    got = {(r.page_id, r.type, r.value): (r.matches, r.first_nid) for r in verified(dom.nodes(pages(*html)), rows).collect()}
    taken = {k: v for k, v in got.items() if v[0] is not None}
    assert {k: (v, want[k]) for k, v in taken.items() if v != want[k]} == {}
    assert set(got) == set(want) and len(taken) > 850 and sum(n > 1 for n, _ in taken.values()) > 150 and sum(n == 1 for n, _ in taken.values()) > 40


def test_what_cannot_be_answered_is_an_error(spark, pages):
    odd = {
        "css": ["a:hover", "#1a", "p >", "> p", "p,,b", "[x", "p::before", ":has(p)", "p:nth-child(2n+1)", "", " ", "[a=b i]", ".1"],
        "xpath": ["//li[", "//p[text()='x']", "count(//p)", "//p[position()<2]", "//p/@id", "//p/ancestor::div", "//p[1][2]", "", "//", "//p[string-length(.)=1]", "//p]", "//following::p", "//p[.//b]", "//text()", "/".join([""] + ["p"] * 40) + "[@a]"],
    }
    rows = [(1, k, v) for k, values in odd.items() for v in values] + [(1, "css", None), (1, None, "p")]
    got = {(r.type, r.value): (r.matches, r.ok, r.verdict) for r in verified(dom.nodes(pages("<p>x</p>")), spark.createDataFrame(rows, "page_id long, type string, value string")).collect()}
    assert {k: v for k, v in got.items() if v != (None, False, "Err")} == {(None, "p"): (1, True, "success-1")}


def test_long_texts_and_pages_that_are_not_there(spark, pages):
    long = "word " * 90
    n = dom.nodes(pages(f"<form id='f'><button class='btn'>{long}</button><b>{long}</b></form>", ""))
    asked = [(1, "xpath", f"//form[@id='f']//button[contains(@class, 'btn')][normalize-space(.)='{long.strip()}']"), (1, "xpath", f"//b[normalize-space(.)='{long.strip()}']"), (7, "css", "p"), (7, "xpath", "/html/body"), (2, "css", "p"), (2, "xpath", "/HTML/body[1]")]
    got = {(r.page_id, r.value): r.matches for r in verified(n, spark.createDataFrame(asked, "page_id long, type string, value string")).collect()}
    assert [got[p, v] for p, _, v in asked] == [1, 1, 0, 0, 0, 1]
    assert verified(n, spark.createDataFrame([], "page_id long, type string, value string")).count() == 0


def test_intervals(spark):
    rng = random.Random(2)
    spans = []

    def grow(pre):
        at = pre
        for _ in range(rng.randint(0, 3) if len(spans) < 60 else 0):
            at = grow(at + 1)
        spans.append((pre, at))
        return at

    for _ in range(20):
        grow(spans[-1][1] + 1 if spans else 0)
    anchors = [(1, rng.choice("abc"), *s) for s in spans if rng.random() < 0.7]
    members = [(1, rng.choice("xyz"), s[0], s[0]) for s in spans if rng.random() < 0.7]
    pairs = [(1, a + b, a, b) for a in "abcd" for b in "xyzw"]
    below = lambda a, at: any(x[1] == a and x[2] < at <= x[3] for x in anchors)
    tops = spark.createDataFrame(anchors, "page_id long, a string, pre int, post int")
    got = {r.q: (r.n, r.first_nid) for r in counts_inside(tops, spark.createDataFrame(members, "page_id long, b string, at int, nid int"), spark.createDataFrame(pairs, "page_id long, q string, a string, b string")).collect()}
    want = {a + b: [m[3] for m in members if m[1] == b and below(a, m[2])] for _, _, a, b in pairs}
    assert got == {q: (len(v), min(v)) for q, v in want.items() if v}
    rows = [(1, m[1].translate(str.maketrans("xyz", "abc")), m[2], m[3]) for m in members]
    inner = inside(tops, spark.createDataFrame(rows, "page_id long, a string, at int, own int"), "a").collect()
    assert sorted((r.a, r.own) for r in inner) == sorted((a, o) for _, a, at, o in rows if below(a, at))


def test_deep_pages_take_linear_rows(spark, pages):
    deep = 2_000
    html = "".join(f"<section id='s{i}'>" for i in range(deep)) + "<b>t</b>"
    n = dom.nodes(pages(html), columns=("page_id", "nid", "post", "parent", "tag", "attrs", "sib_idx", "tag_idx", "tag_cnt", "scope", "text_from", "text_to", "solid", "page_text", "path"))
    asked = [(1, "css", f"#s{i} section") for i in range(0, deep, 7)] + [(1, "css", "section section b"), (1, "xpath", f"//section[@id='s{deep - 1}'][normalize-space(.)='t']"), (1, "css", "section section")]
    got = {r.value: r.matches for r in verified(n.drop("path").withColumn("path", F.lit("")), spark.createDataFrame(asked, "page_id long, type string, value string")).collect()}
    assert [got[f"#s{i} section"] for i in range(0, deep, 7)] == [deep - 1 - i for i in range(0, deep, 7)]
    assert [got[v] for _, _, v in asked[-3:]] == [1, 1, deep - 1]


def test_the_scans_locators_find_their_elements_alone(spark, pages):
    """What the strategies count by keys, the resolver finds by steps."""
    rng = random.Random(21)
    odd = [
        """<div id="12345x"><b id="it's">it's "both"</b><b>it's</b><button data-testid='a"b' class="btn 99999 x">Go</button><button data-testid="c">Go</button></div>""",
        "<ul class=x><li>a<li>b<li id=react-1>c</ul><ul class=x><li>d<li>a</ul><p name=n>x<p name=n>y",
        """<div id="dup"><span>1</span></div><div id="dup"><span>2</span><template shadowrootmode="open"><span class="in">s</span></template></div>""",
    ]
    n = dom.nodes(pages(*odd, *[page(rng) for _ in range(6)])).cache()
    found = locators(n).where("scope = -1").select("page_id", "nid", F.explode("locators").alias("x")).select("page_id", "nid", "x.*").where("strategy <> 'preferred' and type <> 'id'").cache()  # which are kept unasked
    hit = {(r.page_id, r.type, r.value): (r.matches, r.first_nid) for r in verified(n, found).collect()}
    rows = found.collect()
    assert {(r.strategy, r.type, r.value, hit[r.page_id, r.type, r.value]) for r in rows if hit[r.page_id, r.type, r.value] != (1, r.nid)} == set()
    assert len({r.strategy for r in rows}) >= 8 and len(rows) > 200
