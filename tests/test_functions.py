import pytest
from pyspark.sql import functions as F

from domspark.functions import locators as L
from domspark.functions import text as T

SCORES = [
    ("id", "main", 80), ("id", "", 10), ("css", '[data-testid="go"]', 85), ("css", '[name="q"]', 70), ("xpath", "//*[@name='q']", 70), ("xpath", "//a[normalize-space(.)='Home']", 55),
    ("xpath", "//a[contains(normalize-space(.), 'Home')]", 45), ("css", "nav ul > li:nth-of-type(2)", 45), ("xpath", "//li[normalize-space(.)='A']/following-sibling::li[1]", 40),
    ("xpath-abs", "/html/body/div[2]", 10), ("xpath-abs", "//x[12345]", 0), ("id", "ember123", 55), ("id", "session", 55), ("id", "facade", 55), ("id", "react-root", 55), ("css", "#react-root", 60),
    ("css", 'a[href="\\/item\\/12345"]', 35), ("css", '[data-testid="x"][name="session"]', 70), ("css", '[data-cy="a"][name="b"][placeholder="c"]', 100), ("xpath", "//*[@class='a b']", 55), ("name", "foo", 50),
]


def values(spark, column, *rows, schema="v string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_stability(spark):
    got = values(spark, L.stability(F.col("k"), F.col("v")), *[(k, v) for k, v, _ in SCORES], schema="k string, v string")
    assert got == [s for *_, s in SCORES]


def test_dynamic_words_have_ascii_edges(spark):
    assert values(spark, L.is_dynamic(F.col("v")), "éabcdef", "_abcdef", "", None, "decade", "DECADE", "a12345") == [True, False, False, False, True, False, True]


@pytest.mark.parametrize(("s", "want"), [("/für,a.b c", "\\/für\\,a\\.b\\ c"), ("1a", "\\31 a"), ("-2b", "-\\32 b"), ("-", "\\-"), ("a\tb", "a\\9 b"), ("", ""), ("--x_", "--x_"), ("a\x00b", "a�b"), ("😀x", "😀x")])
def test_css_escape(spark, s, want):
    assert values(spark, T.css_escape(F.col("v")), s) == [want]


def test_xpath_literal(spark):
    assert values(spark, T.xpath_literal(F.col("v")), "a", "it's", "a'b\"c", None) == ["'a'", '"it\'s"', "concat('a',\"'\",'b\"c')", "''"]


def test_white_space(spark):
    assert values(spark, T.js_trim(F.col("v")), " \t a  b ﻿\n") == ["a  b"]
    assert values(spark, T.xpath_normalize(F.col("v")), "  a \r\n b\t") == ["  a b"]
    assert values(spark, T.js_length(F.col("v")), "a😀") == [3]


def test_stable_attribute(spark):
    pick = lambda attrs, pr=None: values(spark, F.struct(L.stable_attribute(F.col("v"), pr)), (attrs,), schema="v map<string,string>")[0][0]
    assert pick({"id": "a12345", "class": "x12345 ok"}, L.PREFERRED) == ("class", "ok")
    assert pick({"data-cy": " z ", "id": "a"}, L.PREFERRED) == ("data-cy", "z")
    assert pick({"role": "x", "id": "a"}) == ("role", "x")
    assert pick({}, L.PREFERRED) is None
    assert L.attribute_priority([" a ", "role"])[:3] == ["a", "role", "data-testid"]


def test_names(spark):
    name = lambda tag, attrs, text=None, quirks=True: values(spark, L.element_name(F.col("t"), F.col("a"), F.col("x"), L.element_text(F.lit(None).cast("string"), F.col("x"), F.lit(0)), quirks), (tag, attrs, text), schema="t string, a map<string,string>, x string")[0]
    assert name("input", {"id": "USERNAME", "placeholder": "p"}) == "p"
    assert name("input", {"id": "USERNAME", "placeholder": "p"}, quirks=False) == "USERNAME"
    assert name("div", {"aria-label": "l", "name": "n"}) == "l"
    assert name("div", {"name": "n"}) == L.UNNAMED
    assert name("p", {}, "  hello\nworld ") == "hello"


def test_snippets(spark):
    code = lambda lang, kind: values(spark, L.snippet(lang, F.lit(kind), F.col("v")), 'a[b="c"]')[0]
    assert code("python", "css") == "driver.find_element(By.CSS_SELECTOR, \"a[b='c']\")"
    assert code("playwright", "xpath") == "page.locator(\"xpath=a[b='c']\")"
    assert code("ruby", "css") == "a[b='c']"
