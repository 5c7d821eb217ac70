"""Stable attributes, locator text, stability scores, names and code snippets, as built-in column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import css_escape, filled, first_line, js_length, js_trim, xpath_literal

#: Attributes that are preferred, and the order in which others count as stable.
PREFERRED = ["data-testid", "data-cy", "data-qa", "data-test"]
ATTRIBUTE_ORDER = [
    "data-testid", "data-test", "data-qa", "data-cy", "aria-label", "aria-labelledby", "role",
    "name", "placeholder", "alt", "title", "type", "id", "class",
]
INPUTS = ("input", "textarea", "select")
UNNAMED = "Unnamed Element"
#: Elements with a name property.
NAMED = ("a", "button", "embed", "fieldset", "form", "frame", "iframe", "img", "input", "map", "meta", "object", "output", "param", "select", "slot", "textarea")


def attribute(attrs: Column, name: str) -> Column:
    return filled(F.element_at(attrs, name))


def is_dynamic(s: Column) -> Column:
    """Whether a string looks generated: digits in a row, words of tokens, hex words, prefixes of frameworks; ASCII word edges."""
    # One pattern, as it is asked of every locator; what a word may begin with is looked at before the edge in front of it.
    word = "(?=[a-f0-9UGTSugts])(?<![A-Za-z0-9_])(?:(?i:uuid|guid|token|session)|[a-f0-9]{6,})(?![A-Za-z0-9_])"
    return F.coalesce(s.rlike(f"[0-9]{{5}}|{word}|^(?:ext-gen|j_id|ui-id|yui_|ember|react-|__|mx_)"), F.lit(False))


def class_tokens(attrs: Column, numeric: bool = False) -> Column:
    """Tokens of the class attribute; without numeric, only those without five digits in a row."""
    split = F.filter(F.split(F.coalesce(F.element_at(attrs, "class"), F.lit("")), r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"), lambda t: t != "")
    return split if numeric else F.filter(split, lambda t: ~t.rlike("[0-9]{5,}"))


def stable_attribute(attrs: Column, priority: list[str] | None = None) -> Column:
    """struct(attr, value): the first filled one by priority (not a dynamic id), else an id, else a class token; or null."""
    found = []
    for name in priority or ATTRIBUTE_ORDER:
        if not name:
            continue
        v = F.element_at(attrs, name)
        good = js_trim(v) != ""
        if name == "id":
            good = good & ~is_dynamic(v)
        found.append(F.when(good, F.struct(F.lit(name).alias("attr"), js_trim(v).alias("value"))))
    own_id = attribute(attrs, "id")
    found.append(F.when(own_id.isNotNull() & ~is_dynamic(own_id), F.struct(F.lit("id").alias("attr"), own_id.alias("value"))))
    token = F.get(F.filter(class_tokens(attrs, numeric=True), lambda t: ~is_dynamic(t) & (js_length(t) <= 40)), F.lit(0))
    found.append(F.when(token.isNotNull(), F.struct(F.lit("class").alias("attr"), token.alias("value"))))
    return F.when(F.size(attrs) > 0, F.coalesce(*found))


def preferred_attributes(setting: str | None, changed: bool = False) -> list[str]:
    """The list that a setting's text names: parted by commas, trimmed. Without a text the default holds; a text that was
    changed to nothing names one attribute without a name, which no element has."""
    if not setting and not changed:
        return PREFERRED
    return [name.strip() for name in (setting or "").split(",")]


def attribute_priority(preferred: list[str] | None) -> list[str]:
    """The preferred attributes and then the others, each once."""
    return list(dict.fromkeys([*(p.strip() for p in preferred), *ATTRIBUTE_ORDER])) if preferred is not None else ATTRIBUTE_ORDER


def attribute_priorities(setting: Column) -> Column:
    """The same for settings that are data: the attributes that a text names, parted by commas, and then the others, each once."""
    fixed = F.array(*map(F.lit, ATTRIBUTE_ORDER))
    return F.when(setting.isNull(), fixed).otherwise(F.array_distinct(F.concat(F.transform(F.split(setting, ","), js_trim), fixed)))


def css_of(tag: Column, attr: Column, value: Column) -> Column:
    v = css_escape(value)
    return F.when(attr == "id", F.concat(F.lit("#"), v)).when(attr == "class", F.concat(tag, F.lit("."), v)).otherwise(F.concat(tag, F.lit("["), attr, F.lit('="'), v, F.lit('"]')))


def xpath_of(tag: Column, attr: Column, value: Column) -> Column:
    padded = xpath_literal(F.concat(F.lit(" "), value, F.lit(" ")))
    return F.when(attr == "class", F.concat(F.lit("//"), tag, F.lit("[contains(concat(' ', normalize-space(@class), ' '), "), padded, F.lit(")]"))).otherwise(
        F.concat(F.lit("//"), tag, F.lit("[@"), attr, F.lit("="), xpath_literal(value), F.lit("]"))
    )


def stability(kind: Column, value: Column) -> Column:
    """0 to 100; fixed points for a locator's kind and for what its text holds."""
    low, small = F.lower(F.coalesce(kind, F.lit(""))), F.lower(value)
    holds = lambda s, *of: reduce(or_, [F.contains(s, F.lit(x)) for x in of])
    points = F.when(low == "id", 80).when(low.isin("css", "xpath"), 60).when(low == "xpath-abs", 10).otherwise(50)
    for test, n in (
        (holds(small, "data-test", "data-qa", "data-cy") | holds(value, "aria-"), 25),
        (holds(value, "[name=", "@name="), 10),
        (holds(value, "[placeholder="), 5),
        (holds(small, "contains("), -10),
        (holds(small, "normalize-space("), -5),
        (holds(value, ":nth-of-type", "following-sibling::"), -15),
        (holds(value, "class='") & value.rlike(r"(?<![A-Za-z0-9_])class='[^']+[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF][^']+'"), -5),
        (is_dynamic(value), -25),
    ):
        points = points + F.when(test, n).otherwise(0)
    return F.when(filled(value).isNull(), 10).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), points))).cast("int")


def element_text(direct: Column, text: Column, n_child: Column) -> Column:
    """The short text of an element: its first own text, or all of it; null if blank, of 50 characters or more, or of lines."""
    return short_line(first_text(direct, text, n_child))


def first_text(direct: Column, text: Column, n_child: Column) -> Column:
    whole = js_trim(F.coalesce(text, F.lit("")))
    return F.when(direct.isNotNull(), js_trim(direct)).when(n_child == 0, whole).when(js_length(whole) < 50, first_line(whole))


def short_line(t: Column) -> Column:
    return F.when((t != "") & (js_length(t) < 50) & ~F.contains(t, F.lit("\n")), t)


def seen_line(text: Column) -> Column:
    """The first line that a text shows."""
    return first_line(js_trim(F.coalesce(text, F.lit(""))))


def element_name(tag: Column, attrs: Column, text: Column, etext: Column, quirks: bool = True, line: Column | None = None) -> Column:
    """What to call an element. quirks: ids of inputs are also turned down for runs of capitals and some other characters.
    line: seen_line(text), if there is a column of it."""
    name = F.when(tag.isin(*NAMED), attribute(attrs, "name"))
    own_id = attribute(attrs, "id")
    runs = "[0-copy]{5,}" if quirks else "[0-9]{5,}"
    line = seen_line(text) if line is None else line
    as_input = F.when(tag.isin(*INPUTS), F.coalesce(name, F.when(~own_id.rlike(runs), own_id), attribute(attrs, "placeholder")))
    return F.coalesce(
        as_input, etext, F.when((line != "") & (js_length(line) < 30), line), attribute(attrs, "aria-label"), attribute(attrs, "title"), F.when(~own_id.rlike("[0-9]{5,}"), own_id), name, F.lit(UNNAMED)
    )


def css_segment(tag: Column, attrs: Column) -> Column:
    """tag#id, else tag.classes, else the tag; * without an element."""
    own_id, tokens = attribute(attrs, "id"), class_tokens(attrs, numeric=True)
    with_id = F.concat(tag, F.lit("#"), css_escape(own_id))
    with_class = F.concat(tag, F.lit("."), F.array_join(F.transform(tokens, css_escape), "."))
    return F.when(tag.isNull(), F.lit("*")).when(own_id.isNotNull(), with_id).when(F.size(tokens) > 0, with_class).otherwise(tag)


#: How each language writes a locator; {} is its text.
SNIPPETS = {
    "java": {"id": 'driver.findElement(By.id("{}"))', "css": 'driver.findElement(By.cssSelector("{}"))', "xpath": 'driver.findElement(By.xpath("{}"))'},
    "python": {"id": 'driver.find_element(By.ID, "{}")', "css": 'driver.find_element(By.CSS_SELECTOR, "{}")', "xpath": 'driver.find_element(By.XPATH, "{}")'},
    "javascript": {"id": 'driver.findElement(By.id("{}"))', "css": 'driver.findElement(By.css("{}"))', "xpath": 'driver.findElement(By.xpath("{}"))'},
    "playwright": {"id": 'page.locator("#{}")', "css": 'page.locator("{}")', "xpath": 'page.locator("xpath={}")'},
    "cypress": {"id": 'cy.get("#{}")', "css": 'cy.get("{}")', "xpath": 'cy.xpath("{}")'},
}


def snippet(language: str, kind: Column, value: Column) -> Column:
    """Test code that finds the locator; an unknown kind or language gives the locator itself."""
    v = F.replace(value, F.lit('"'), F.lit("'"))
    out = v
    for k, form in SNIPPETS.get(language, {}).items():
        head, tail = form.split("{}")
        out = F.when(kind == k, F.concat(F.lit(head), v, F.lit(tail))).otherwise(out)
    return out
