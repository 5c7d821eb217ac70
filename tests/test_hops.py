"""The hops of many pages: their segments are read once, and hosts of pages' own still lead to their elements."""

from pyspark.sql import functions as F

from domspark.operators import verify
from domspark.operators.entries import own_hops
from domspark.operators.verify import by_own_hops
from domspark.sources import dom

COLUMNS = ("nid", "post", "parent", "tag", "attrs", "sib_idx", "tag_idx", "tag_cnt", "scope", "hosts")


def test_hops_of_pages_alike_and_of_others(spark, pages, monkeypatch):
    alike = '<div class="card"><template shadowrootmode="open"><b class="x">1</b><b class="x">2</b></template></div><p>t</p>'
    html = [alike, alike, alike, alike.replace("card", "other"), '<div class="card"><p>no tree</p></div>']
    n = dom.nodes(pages(*html), columns=COLUMNS)
    stored = n.where("nid > 2").select("page_id", "nid", own_hops().alias("hops"))
    odd = spark.createDataFrame([(5, 90, [("shadow", "div.card", None), ("leaf", None, "p")]), (1, 91, [("shadow", "div.card", None)]), (1, 92, []), (9, 93, [("leaf", None, "p")])], stored.schema)
    got = {(r.page_id, r.nid): r.hop_nid for r in by_own_hops(n, stored.unionByName(odd)).collect()}
    shadow = {3: 3, 4: 4, 5: 4, 6: 6}
    assert got == {(p, i): x for p in range(1, 5) for i, x in shadow.items()} | {(5, 3): 3, (5, 4): 4, (5, 90): None, (1, 91): None, (1, 92): None, (9, 93): None}
    monkeypatch.setattr(verify, "parsed", lambda df: 1 / 0)
    assert by_own_hops(n, stored.where("page_id < 4")).where(F.col("hop_nid").isNotNull()).count() == 12
