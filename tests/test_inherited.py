"""What elements inherit from style sheets, where only those below a value of their own are looked at."""

from domspark.operators import visibility
from domspark.operators.visibility import with_styles
from domspark.sources import dom

DEEP = "<style>.off { visibility: hidden } .on { visibility: visible }</style><p>a</p>" + "<b>" * 3 + '<div class="off"><i>1</i><u class="on"><s>2</s><s class="off"><q>3</q></s></u></div><em>4</em>'


def test_only_what_can_inherit_is_followed(spark, pages, monkeypatch):
    n = dom.nodes(pages(DEEP, "<p>x</p>", "<div style='visibility:hidden'><i>y</i></div>")).cache()
    followed = []
    real = visibility.from_above
    monkeypatch.setattr(visibility, "from_above", lambda rows, *rest: followed.append(rows) or real(rows, *rest))
    got = {(r.page_id, r.tag): r.visible for r in with_styles(n).where("tag in ('p', 'i', 'u', 's', 'q', 'em') and not (tag = 's' and tag_idx = 2)").collect()}
    assert got == {(1, "p"): True, (1, "i"): False, (1, "u"): True, (1, "s"): True, (1, "q"): False, (1, "em"): True, (2, "p"): True, (3, "i"): False}
    assert {r.page_id for r in followed[0].collect()} == {1} and followed[0].count() == 6
