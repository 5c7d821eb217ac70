"""What is new on a page, and the store that follows pages by it."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from domspark.operators.candidates import added
from domspark.operators.strategies import locators
from domspark.sources import diff, dom
from domspark.streaming import changes as C
from domspark.streaming import store

SNAPSHOT = "page_id long, html string"


def fresh(before, after):
    found = diff.freshness(before, dom.number(dom.build(after)))
    every = dom.number(dom.build(after))
    return [dom.content(e) or e.tag for e in every if found[e.nid]]


def test_new_elements():
    page = "<div id=a><p>one</p><p>two</p></div>"
    assert fresh(page, page) == [] and len(fresh(None, page)) == 6
    assert fresh(page, "<div id=a><p>one</p><p>between</p><p>two</p></div>") == ["between"]
    assert fresh(page, "<div id=a class=x><p>one!</p><p title=t>two</p></div>") == []  # neither attributes nor texts
    assert fresh(page, "<nav><b>n</b></nav><div id=a><p>two</p></div>") == ["n"]
    assert fresh(page, "<div id=b><p>three</p></div><div id=a><p>one</p><p>two</p></div>") == ["three"]
    assert fresh("<div></div>", '<div><template shadowrootmode="open"><b>s</b></template></div>') == ["s"]
    deep = "<div>" * 3_000
    assert fresh(deep, deep + "<b>end</b>") == ["end"]


def grown(rng, html):
    """html with an element put in somewhere, and where that is: a marker in its text."""
    mark = f"m{rng.randrange(10**9)}"
    spots = [i for i in range(len(html)) if html.startswith("<", i)]
    at = rng.choice(spots)
    tag = rng.choice(["p", "span", "li"])
    return html[:at] + f'<{tag} class="{rng.choice("xyz")}">{rng.choice(["t1", "t2", mark])}<b>{mark}</b></{tag}>' + html[at:], mark


def test_added_elements_have_the_locators_of_a_whole_scan(spark):
    rng = random.Random(9)
    before = {i: "<ul id=u><li class=x>t1</li><li>t2</li></ul><div><span class=y>t1</span></div>" for i in range(12)}
    after, marks = {}, {}
    for i, html in before.items():
        for _ in range(rng.randint(1, 3)):
            html, mark = grown(rng, html)
            marks.setdefault(i, []).append(mark)
        after[i] = html
    rows = spark.createDataFrame([(i, after[i], before[i]) for i in after], "page_id long, html string, before string")
    n = dom.nodes(rows, before="before").cache()
    new = added(n, n.where("fresh = 1").select("page_id", "nid")).select("page_id", "nid").cache()
    texts = {i: [r.text or r.brief for r in n.where(f"page_id = {i} and fresh = 1").collect()] for i in after}
    assert all(any(m in t for t in texts[i]) for i, ms in marks.items() for m in ms)
    flat = lambda df: sorted((r.page_id, r.nid, tuple(map(tuple, r.locators))) for r in df.select("page_id", "nid", "locators").collect())
    whole = locators(n).join(new, ["page_id", "nid"], "left_semi")
    assert flat(locators(n, only=new)) == flat(whole) and whole.count() > 12


def test_store_follows_pages(spark, tmp_path):
    path, check, source = str(tmp_path / "store"), str(tmp_path / "check"), str(tmp_path / "in")
    first = [(1, "<p>one</p><a href='/a'>A</a>"), (2, "<p>x</p>")]
    second = [(1, "<p>one</p><a href='/a'>A</a><a href='/b'>B</a>"), (2, "<p>x</p>"), (3, "<p>new page</p>")]
    for part in (first, second):
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(source)
        C.follow(spark.readStream.schema(SNAPSHOT).parquet(source), path, check, incremental=True).awaitTermination()
    rows = {(r.page_id, r.id): r for r in C.read_store(spark, path).collect()}
    assert set(rows) == {(1, "one::p"), (1, "A::a"), (1, "B::a"), (2, "x::p"), (3, "new page::p")}
    assert {k for k, r in rows.items() if r.ord.batch == 1} == {(1, "B::a"), (3, "new page::p")}  # only what was new was written
    feed = store.manifest(f"{path}/entries")["version"]
    q = C.entry_changes(spark, path, since=feed - 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.page_id, r.id, r.op) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "B::a", "insert"), (3, "new page::p", "insert")]
    # A batch that is run again, or that broke off between its two writes, changes nothing.
    C.write_over(spark.createDataFrame(second, SNAPSHOT), 1, path, incremental=True)
    assert store.manifest(f"{path}/entries")["version"] == feed


def test_debounced_scan(spark, tmp_path):
    t0, schema = datetime(2024, 1, 1), "page_id long, html string, ts timestamp"
    parts = [[(1, "<p>a</p>", 0), (1, "<p>a</p><p>b</p>", 300), (1, "<p>c</p>", 700)], [(1, "<p>c</p><p>d</p>", 5_000)], [(2, "<p>end</p>", 100_000)], [(2, "<p>end</p>", 300_000)]]
    for part in parts:
        spark.createDataFrame([(p, h, t0 + timedelta(milliseconds=ms)) for p, h, ms in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        C.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), incremental=True, debounce="10 seconds").awaitTermination()
    rows = C.read_store(spark, str(tmp_path / "store")).where("page_id = 1").orderBy(F.col("ord")).collect()
    assert [r.id for r in rows] == ["c::p", "d::p"]  # the states inside of the burst were passed over
