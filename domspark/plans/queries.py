"""Registered queries over whole tables, and what a second engine needs to give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import locators as L
from ..functions.text import css_escape, js_trim, xpath_literal, xpath_normalize
from ..operators import entries as E
from ..operators import export as X
from ..operators import numbering
from ..operators import review as R
from ..operators import strategies as S
from ..operators.candidates import described, is_chosen
from ..operators.verify import COLUMNS as VERIFY_COLUMNS
from ..operators.verify import by_hops, by_own_hops, verified
from ..operators.visibility import with_styles
from ..shared import settle, settle_large
from ..sources.dom import nodes
from ..streaming.changes import debounced
from .oracles import SQL  # noqa: F401


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return nodes(_table(spark, d, "pages"), columns=columns or S.COLUMNS)


def _kept_nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Parsed once, read several times."""
    return settle_large(_nodes(spark, d, *columns))


def _strings(spark: SparkSession, d: str) -> DataFrame:
    """id, s: strings of several kinds, made from parts and customers."""
    part = _table(spark, d, "part")
    made = F.expr("""CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '''s "', p_brand, '"') WHEN 2 THEN concat('it''s ', p_type)
        WHEN 3 THEN concat('ember', p_partkey) WHEN 4 THEN concat(p_brand, '/', p_size, '?a=', p_partkey * 7919) ELSE concat('[data-testid="', p_name, '"][name="', p_size, '"]') END""")
    customer = _table(spark, d, "customer")
    return part.select(F.col("p_partkey").alias("id"), made.alias("s")).union(customer.select(-F.col("c_custkey"), "c_name"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, d).withColumn("type", F.expr("CASE pmod(id, 5) WHEN 0 THEN 'id' WHEN 1 THEN 'css' WHEN 2 THEN 'xpath' WHEN 3 THEN 'xpath-abs' ELSE 'name' END"))


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(
        "p_partkey", F.expr("""map_filter(map('data-cy', CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_name, ' ') END, 'id', CASE WHEN p_partkey % 4 < 2 THEN concat('item-', p_partkey * 37) END,
        'class', CASE WHEN p_partkey % 5 < 4 THEN concat(' c', p_partkey * 101, '  ', replace(p_brand, '#', '-'), ' x') END), (k, v) -> v IS NOT NULL)""").alias("attrs")
    )


def _located(spark: SparkSession, d: str, where: Column | None = None) -> DataFrame:
    return S.locators(nodes(_table(spark, d, "pages"), columns=S.COLUMNS, scan=True), where=where)


def _store(spark: SparkSession, d: str) -> DataFrame:
    return E.upsert(None, E.entries(_located(spark, d)))


def _flat(locators):
    return F.array_join(F.transform(locators, lambda x: F.concat(x["type"], F.lit(" "), x["value"], F.lit(" "), x["stability"].cast("string"))), "\n")


def href_locators(spark, d):
    return S.href_locators(_nodes(spark, d, "nid", "tag", "attrs", "scope")).drop("nid")


def href_unique_counts(spark, d):
    return S.href_locators(_nodes(spark, d, "nid", "tag", "attrs", "scope")).groupBy("page_id").agg(F.count("*").alias("n_unique"))


def link_texts(spark, d):
    return S.text_counts(_kept_nodes(spark, d, "nid", "tag", "attrs", "tag_idx", "scope", "direct_text", "head", "solid", "norm_from", "norm_to", "page_norm", "n_child"), "a")


def following_sibling_li(spark, d):
    columns = ("nid", "parent", "tag", "attrs", "sib_idx", "tag_idx", "after", "scope", "direct_text", "head", "solid", "n_child", "visible")
    return S.sibling_locators(_nodes(spark, d, *columns)).where("tag = 'li'").select("page_id", "sibling")


def class_locators(spark, d):
    return S.class_locators(_nodes(spark, d, "nid", "tag", "attrs", "scope"))


def entries_upsert(spark, d):
    return _store(spark, d).select("page_id", "id", "name", "tag", _flat(F.col("locators")).alias("locators"))


def entry_rank(spark, d):
    w = Window.partitionBy("page_id").orderBy(F.desc("stab"), "seq")
    return _store(spark, d).withColumn("stab", R.best_stability(F.col("locators"))).select("page_id", "id", "stab", F.row_number().over(w).alias("place"))


def best_locator(spark, d):
    best = R.best_locator(F.col("locators"))
    return _store(spark, d).withColumn("b", best).select("page_id", "id", F.col("b.type").alias("type"), F.col("b.value").alias("value"), F.col("b.stability").alias("stability"))


def name_search(spark, d):
    found = E.upsert(None, E.entries(_located(spark, d, R.may_be_named("An"))))
    return R.name_search(found, "An").select("page_id", "id")


def clean_export(spark, d):
    clean = _store(spark, d).withColumn("m", R.last_by_type(F.col("locators")))
    return clean.select("page_id", "name", "tag", F.element_at("m", "css").alias("css"), F.element_at("m", "xpath").alias("xpath"))


#: Asked of each page besides its own locators: what finds several elements, none, or can't be asked.
ASKED = (
    ("css", "li"), ("css", "div.none"), ("xpath", "//li["), ("css", "a:hover"), ("xpath-abs", "/html/body/nav/ul/li/a"), ("xpath-abs", "/html/body/nav/ul/li[2]/a"), ("css", "ul > li"), ("css", "nav a"), ("css", "nav > a"),
    ("xpath", "//nav//li[2]/a"), ("xpath", "//li[1]/following-sibling::li[2]"), ("xpath", "//ul//li[contains(@class, 'x')]"), ("xpath", "//div[contains(@class, 'a')]"),
)


def verify_counts(spark, d):
    n = _kept_nodes(spark, d, *S.COLUMNS, *VERIFY_COLUMNS)
    own = S.locators(n).select("page_id", F.explode("locators").alias("x")).select("page_id", "x.type", "x.value")
    more = _table(spark, d, "pages").select("page_id", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in ASKED])).alias("x")).select("page_id", "x.*")
    return verified(n, own.union(more)).select("page_id", "type", "value", F.coalesce("matches", F.lit(-1)).alias("matches"), "verdict")


def sorted_locators(spark, d):
    return R.with_snippets(_store(spark, d), "playwright").select("page_id", "id", "place", "locator.type", "locator.value", "code")


def entry_delete(spark, d):
    return E.deleted(_store(spark, d), "para::a").select("page_id", "id")


def json_export(spark, d):
    return X.json_rows(settle(_store(spark, d))).select("row")


def text_export(spark, d):
    return X.text_rows(settle(_store(spark, d)), "Report").select("row")


def absolute_paths(spark, d):
    n = described(_nodes(spark, d, "nid", "parent", "scope", "tag", "attrs", "direct_text", "head", "solid", "n_child", "visible"))
    n = settle_large(n.select("page_id", "nid", "parent", "scope", "tag", F.when(is_chosen(), F.col("name")).alias("name")))
    return n.where("name is not null").select("page_id", "nid", "name", "tag").join(numbering.absolute_paths(n.drop("name")), ["page_id", "nid"]).select("page_id", "name", "tag", "path")


def accessible_names(spark, d):
    n = _kept_nodes(spark, d, "nid", "pre", "parent", "scope", "tag", "attrs", "text")
    paths = numbering.absolute_paths(n.select("page_id", "nid", "parent", "scope", "tag"))
    own = n.where("tag in ('li', 'a', 'div', 'h1', 'p')").select("page_id", "nid", "tag").join(paths, ["page_id", "nid"])
    return R.accessible_name(n).join(own, ["page_id", "nid"]).select("page_id", "tag", "path", "accessible_name")


def hop_leaves(spark, d):
    return by_hops(_kept_nodes(spark, d, "nid", "pre", "tag", "attrs", "scope"), [{"type": "leaf", "selector": "div.ad"}])


def snippets(language: str):
    def run(spark, d):
        return _typed(spark, d).select("id", L.snippet(language, F.col("type"), F.col("s")).alias("code"))

    return run


def stable_attr_pick(spark, d):
    return _attributes(spark, d).withColumn("x", L.stable_attribute(F.col("attrs"), L.PREFERRED)).select("p_partkey", F.col("x.attr").alias("attr"), F.col("x.value").alias("value"))


def debounce_events(spark, d):
    return debounced(_table(spark, d, "events"), "user_id", gap="6 hours").select("user_id", F.col("first").cast("timestamp_ntz").alias("first_ts"), F.col("last").cast("timestamp_ntz").alias("last_ts"), "n")


def form_pages(parts: DataFrame) -> DataFrame:
    """page_id, html: a page with a form and a menu for each part; every other one has a second button."""
    html = F.expr("""concat('<form id="login"><label for="u">User</label><input id="u" name="user', p_partkey, '" type="text"><button data-testid="go', p_partkey, '" class="btn primary">Save ', p_partkey % 7, '</button>',
        CASE WHEN p_partkey % 2 = 0 THEN '<button class="btn">Cancel</button>' ELSE '' END, '</form><ul id="menu"><li><a href="/a', p_partkey, '">Home</a></li><li><a href="/b', p_partkey, '">Home</a></li></ul>')""")
    return parts.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def form_scan(spark, d):
    found = S.locators(nodes(form_pages(_table(spark, d, "part")), columns=S.COLUMNS))
    return found.select("page_id", "name", "tag", F.posexplode("locators").alias("place", "x")).select("page_id", "name", "tag", "place", "x.*")


def form_verify(spark, d):
    n = settle_large(nodes(form_pages(_table(spark, d, "part")), columns=VERIFY_COLUMNS))
    asked = n.select("page_id").distinct().select("page_id", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in FORM_ASKED])).alias("x")).select("page_id", "x.*")
    tag = n.select("page_id", F.col("nid").alias("first_nid"), F.col("tag").alias("first_tag"))
    return verified(n, asked).join(tag, ["page_id", "first_nid"], "left").select("page_id", "type", "value", F.coalesce("matches", F.lit(-1)).alias("matches"), "verdict", "first_tag")


#: Asked of each form page; plans.oracles says how many elements each finds.
FORM_ASKED = (
    ("css", "#login button.btn"), ("css", "#login > button"), ("css", "button.primary.btn"), ("css", "#menu li:nth-of-type(2) > a"), ("css", "form input"), ("id", "u"), ("xpath", "//form[@id='login']//button[contains(@class, 'prim')]"),
    ("xpath", "//form[@id='login']//button[normalize-space(.)='Cancel']"), ("xpath", "//input[@id='u']/following-sibling::button[2]"), ("xpath", "//ul[@id='menu']//li/a[normalize-space(.)='Home']"), ("xpath", "//label[normalize-space(.)='User']"),
    ("xpath", "//form[@id='login']//button[contains(normalize-space(.), 'Save')]"), ("xpath", "//*[contains(normalize-space(.), 'Save')]"), ("xpath", "//*[contains(@class, 'prim')]"), ("xpath", "//*"), ("xpath", "//label[contains(normalize-space(.), 'User')]/following-sibling::button[1]"),
    ("xpath", "(//a)[2]"), ("xpath", "//a/.."), ("css", "button:not(.primary)"), ("css", "label + input"), ("css", "input ~ button, ul"), ("css", "a[href^='/a']"), ("css", "a:hover"), ("xpath", "//li["), ("xpath", "//button[last()]"), ("xpath", "//ul//a[not(@class) and starts-with(@href, '/b')]"),
    ("xpath", "//button[contains(@class, 'btn')][2]/preceding-sibling::button[1]"), ("xpath-abs", "/html/body/ul/li[2]"), ("xpath", "//li[position()=2]/a[. = 'Home']"), ("css", "ul > li > a"), ("xpath", "//input/parent::form | //ul"),
)


def shadow_pages(parts: DataFrame) -> DataFrame:
    """page_id, html: a page with a shadow tree inside of a shadow tree for each part; every other one has a second link."""
    html = F.expr("""concat('<div id="host" class="card"><template shadowrootmode="open"><button class="b">Go ', p_partkey, '</button><span class="in"><template shadowrootmode="open"><a href="/x', p_partkey, '">Deep</a></template></span>',
        '<button class="b">Again</button></template></div><a href="/y">Light</a>', CASE WHEN p_partkey % 2 = 0 THEN '<a href="/z">Other</a>' ELSE '' END)""")
    return parts.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def hop_returns(spark, d):
    n = settle_large(nodes(shadow_pages(_table(spark, d, "part")), columns=("nid", "post", "parent", "tag", "attrs", "sib_idx", "tag_idx", "tag_cnt", "scope", "hosts")))
    stored = n.where("tag in ('div', 'button', 'span', 'a')").select("page_id", "nid", "tag", E.own_hops().alias("hops"))
    return by_own_hops(n, stored).select("page_id", "nid", "tag", F.size("hops").alias("n_hops"), "hop_nid")


def scan_order(spark, d):
    n = nodes(shadow_pages(_table(spark, d, "part")), columns=("nid", "parent", "scope", "tag"))
    return numbering.scan_order(settle_large(n)).select("page_id", "nid", "scan_rank")


def styled_pages(parts: DataFrame) -> DataFrame:
    """page_id, html: a page for each part that hides elements by its style sheets; .v1 is hidden only there."""
    html = F.expr("""concat('<style>.off { display: none } #menu .x, #none { visibility: hidden } p { pointer-events: none } /* .no {display:none} */ #keep p { pointer-events: auto !important } @media print { * { display: none } }',
        ' @media screen { .v1 { display: none } } div.card { display: block } .card { display: none } em[data-k] { display: none; } em { display: block } a:hover { display: none }</style>',
        '<div class="off"><b>b1</b></div><ul id="menu"><li class="x">li1<span style="visibility:visible">span1</span></li><li>li2</li></ul><p>p1</p><div id="keep"><p style="pointer-events:none">p2</p></div>',
        '<section class="v', p_partkey % 3, '"><i>i1</i></section><div class="card">card</div><h2 class="card">h2</h2><em data-k="1">em1</em><em hidden>em2</em><a href="/" style="display:none">a1</a><style>h2.card { display: block }</style>')""")
    return parts.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def visible_elements(spark, d):
    n = settle_large(nodes(styled_pages(_table(spark, d, "part")), columns=(*VERIFY_COLUMNS, "visible")))
    return with_styles(n).select("page_id", "nid", "tag", "visible")


def label_pages(parts: DataFrame) -> DataFrame:
    """page_id, html: a page for each part whose elements have their names from labels, other elements, attributes, or themselves."""
    html = F.expr("""concat('<label for="u', p_partkey % 2, '">User ', p_partkey, '</label><input id="u0"><input id="u1" title="T"><span id="t">  Ref text </span><button aria-labelledby="t">B</button>',
        '<button aria-labelledby="none" title=" Tip ">B2</button><img alt="Pic"><input id="z" aria-label=" Own "><p>Plain</p><p></p>')""")
    return parts.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def label_names(spark, d):
    n = settle_large(nodes(label_pages(_table(spark, d, "part")), columns=("nid", "pre", "tag", "attrs", "text", "scope")))
    own = n.where("nid > 2").select("page_id", "nid", "tag")
    return own.join(R.accessible_name(n), ["page_id", "nid"])


def url_gate(spark, d):
    url = F.expr("CASE page_id % 4 WHEN 1 THEN 'ftp://' || page_id WHEN 2 THEN 'file:///' || page_id WHEN 3 THEN 'about:blank' ELSE url END")
    return _table(spark, d, "pages").select("page_id", R.openable(url).alias("openable"))


def attribute_priorities(spark, d):
    setting = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'data-x, title ,' || p_size WHEN 1 THEN p_brand || ' ,class,data-x,class' END")
    return _table(spark, d, "part").select("p_partkey", F.array_join(L.attribute_priorities(setting), "|").alias("priority"))


def file_stamps(spark, d):
    return _table(spark, d, "events").select("event_id", X.file_stamp(F.col("ts")).alias("stamp"))


def scan_counts(spark, d):
    found = settle_large(E.entries(_located(spark, d)))
    kept = E.upsert(None, found).groupBy("page_id").agg(F.count("*").alias("n_kept"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_scanned")).join(kept, "page_id")


def full_scan(spark, d):
    return _located(spark, d).select("page_id", "name", "tag", F.posexplode("locators").alias("place", "x")).select("page_id", "name", "tag", "place", "x.*")


QUERIES = {
    "score_synthetic": lambda s, d: _typed(s, d).select("id", L.stability(F.col("type"), F.col("s")).alias("stability")),
    "dynamic_flags": lambda s, d: _strings(s, d).select("id", L.is_dynamic(F.col("s")).alias("dynamic")),
    "xpath_literal": lambda s, d: _strings(s, d).select("id", xpath_literal(F.col("s")).alias("literal")),
    "css_escape": lambda s, d: _strings(s, d).select("id", css_escape(F.col("s")).alias("escaped")),
    "attr_css": lambda s, d: _strings(s, d).select("id", L.css_of(F.lit("p"), F.expr("CASE pmod(id, 3) WHEN 0 THEN 'id' WHEN 1 THEN 'class' ELSE 'title' END"), F.col("s")).alias("css")),
    "attr_xpath": lambda s, d: _strings(s, d).select("id", L.xpath_of(F.lit("p"), F.expr("CASE pmod(id, 3) WHEN 0 THEN 'id' WHEN 1 THEN 'class' ELSE 'title' END"), F.col("s")).alias("xpath")),
    "text_normalize": lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(xpath_normalize(F.col("text"))).alias("normalized"), F.md5(js_trim(F.col("text"))).alias("trimmed")),
    "stable_attr_pick": stable_attr_pick,
    **{f"snippets_{x}": snippets(x) for x in L.SNIPPETS},
    "href_locators": href_locators,
    "href_unique_counts": href_unique_counts,
    "link_texts": link_texts,
    "following_sibling_li": following_sibling_li,
    "class_locators": class_locators,
    "entries_upsert": entries_upsert,
    "entry_rank": entry_rank,
    "best_locator": best_locator,
    "name_search": name_search,
    "clean_export": clean_export,
    "verify_counts": verify_counts,
    "sorted_locators": sorted_locators,
    "entry_delete": entry_delete,
    "json_export": json_export,
    "text_export": text_export,
    "absolute_paths": absolute_paths,
    "accessible_names": accessible_names,
    "hop_leaves": hop_leaves,
    "debounce_events": debounce_events,
    "full_scan": full_scan,
    "form_scan": form_scan,
    "form_verify": form_verify,
    "label_names": label_names,
    "url_gate": url_gate,
    "attribute_priorities": attribute_priorities,
    "file_stamps": file_stamps,
    "scan_counts": scan_counts,
    "hop_returns": hop_returns,
    "scan_order": scan_order,
    "visible_elements": visible_elements,
}
