"""The registered queries as SQL of DuckDB, written from the rules and not from the Spark code."""

from __future__ import annotations

STRINGS = """strings AS (
  SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || '''s "' || p_brand || '"' WHEN 2 THEN 'it''s ' || p_type
    WHEN 3 THEN 'ember' || p_partkey WHEN 4 THEN p_brand || '/' || p_size || '?a=' || (p_partkey * 7919) ELSE '[data-testid="' || p_name || '"][name="' || p_size || '"]' END AS s FROM part
  UNION ALL SELECT -c_custkey, c_name FROM customer),
typed AS (SELECT id, s, CASE ((id % 5) + 5) % 5 WHEN 0 THEN 'id' WHEN 1 THEN 'css' WHEN 2 THEN 'xpath' WHEN 3 THEN 'xpath-abs' ELSE 'name' END AS type FROM strings)"""


def dynamic(s: str) -> str:
    return rf"(regexp_matches({s}, '[0-9]{{5,}}') OR regexp_matches({s}, '(?i)\b(uuid|guid|token|session)\b') OR regexp_matches({s}, '\b[a-f0-9]{{6,}}\b') OR regexp_matches({s}, '^(ext-gen|j_id|ui-id|yui_|ember|react-|__|mx_)'))"


def score(kind: str, s: str) -> str:
    return rf"""CAST(CASE WHEN coalesce({s}, '') = '' THEN 10 ELSE greatest(0, least(100,
      CASE lower({kind}) WHEN 'id' THEN 80 WHEN 'css' THEN 60 WHEN 'xpath' THEN 60 WHEN 'xpath-abs' THEN 10 ELSE 50 END
      + CASE WHEN regexp_matches({s}, '(?i)data-(test|qa|cy|testid)') OR contains({s}, 'aria-') THEN 25 ELSE 0 END
      + CASE WHEN contains({s}, '[name=') OR contains({s}, '@name=') THEN 10 ELSE 0 END + CASE WHEN contains({s}, '[placeholder=') THEN 5 ELSE 0 END
      - CASE WHEN contains(lower({s}), 'contains(') THEN 10 ELSE 0 END - CASE WHEN contains(lower({s}), 'normalize-space(') THEN 5 ELSE 0 END
      - CASE WHEN contains({s}, ':nth-of-type') OR contains({s}, 'following-sibling::') THEN 15 ELSE 0 END
      - CASE WHEN regexp_matches({s}, '\bclass=''[^'']+\s[^'']+''') THEN 5 ELSE 0 END - CASE WHEN {dynamic(s)} THEN 25 ELSE 0 END)) END AS INTEGER)"""


def literal(s: str) -> str:
    return f"""CASE WHEN NOT contains({s}, '''') THEN '''' || {s} || '''' WHEN NOT contains({s}, '"') THEN '"' || {s} || '"' ELSE 'concat(''' || replace({s}, '''', ''',"''",''') || ''')' END"""


def escaped(s: str) -> str:
    return rf"""CASE WHEN {s} = '-' THEN '\-' WHEN regexp_matches({s}, '^[0-9]') THEN '\3' || {s}[1] || ' ' || regexp_replace({s}[2:], '([^a-zA-Z0-9_\x{{80}}-\x{{10FFFF}}-])', '\\\1', 'g')
      ELSE regexp_replace({s}, '([^a-zA-Z0-9_\x{{80}}-\x{{10FFFF}}-])', '\\\1', 'g') END"""


ATTR = "CASE ((id % 3) + 3) % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'class' ELSE 'title' END"

LINKS = r"""raw AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS txt,
    unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">')))) AS k FROM pages),
plain AS (SELECT page_id, k, replace(replace(href, '&quot;', '"'), '&amp;', '&') AS href, trim(replace(replace(txt, '&quot;', '"'), '&amp;', '&')) AS txt FROM raw),
links AS (SELECT *, count(*) OVER (PARTITION BY page_id, href) AS n_href, count(*) OVER (PARTITION BY page_id, txt) AS n_txt,
    (SELECT count(*) FROM plain q WHERE q.page_id = p.page_id AND contains(q.txt, p.txt)) AS n_part FROM plain p)"""

#: All elements of the tables' pages that a scan looks at. They have one form: a list of links, an advert, an article with a
#: heading and paragraphs. k: the place in the scan; grp and pos: the list of siblings and the place in it; path: from the root.
ELEMENTS = rf"""{LINKS},
text_of AS (SELECT page_id, html, string_split(regexp_extract(html, '(?s)</h1>(.*?)(?:</article>|<footer>)', 1), '<p>')[2:] AS ps FROM pages),
every AS (
  SELECT page_id, 'li' AS tag, 10 * (5 + k) + 1 AS k, 'ul' AS grp, k AS pos, txt AS raw, NULL AS href, '/html/body/nav/ul/li' || CASE WHEN k > 0 THEN '[' || (k + 1) || ']' ELSE '' END AS path FROM plain
  UNION ALL SELECT page_id, 'a', 10 * (6 + k), 'li' || k, 0, txt, href, '/html/body/nav/ul/li' || CASE WHEN k > 0 THEN '[' || (k + 1) || ']' ELSE '' END || '/a' FROM plain
  UNION ALL SELECT page_id, 'nav', 30, 'body', 0, string_agg(txt, '' ORDER BY k), NULL, '/html/body/nav' FROM plain GROUP BY page_id
  UNION ALL SELECT page_id, 'div', 42, 'body', 1, regexp_extract(html, '<div class="ad">([^<]*)', 1), NULL, '/html/body/div' FROM pages
  UNION ALL SELECT page_id, 'h1', 62, 'article', 0, regexp_extract(html, '<h1>([^<]*)', 1), NULL, '/html/body/article/h1' FROM pages
  UNION ALL SELECT page_id, 'p', 10 * (7 + i) + 2, 'article', i + 1, ps[i + 1], NULL, '/html/body/article/p' || CASE WHEN i > 0 THEN '[' || (i + 1) || ']' ELSE '' END FROM (SELECT page_id, ps, unnest(range(len(ps))) AS i FROM text_of)),
plain_text AS (SELECT page_id, tag, k, grp, pos, href, path, trim(CASE WHEN tag IN ('li', 'a', 'nav') THEN raw ELSE replace(replace(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&amp(;|$)', '&amp;', 'g'), '&quot;', '"'), '&amp;', '&') END, ' ' || chr(10)) AS whole FROM every),
els AS (SELECT *, trim(regexp_replace(whole, '[ \t\r\n]+', ' ', 'g')) AS txt, trim(string_split(whole, chr(10))[1]) AS line FROM plain_text),
counts AS (SELECT *, whole <> '' AND length(whole) < 50 AND NOT contains(whole, chr(10)) AS short, count(*) OVER (PARTITION BY page_id, tag, txt) AS n_txt, count(*) OVER (PARTITION BY page_id, tag, href) AS n_href,
    (SELECT count(*) FROM els q WHERE q.page_id = e.page_id AND q.tag = e.tag AND contains(q.txt, e.txt)) AS n_part FROM els e),
pairs AS (SELECT b.page_id, b.k, b.tag, b.grp, a.pos AS near, a.tag AS atag, a.txt AS atxt, a.short, (SELECT count(*) FROM els c WHERE c.page_id = a.page_id AND c.grp = a.grp AND c.tag = b.tag AND c.pos > a.pos AND c.pos <= b.pos) AS step
  FROM counts a JOIN els b ON a.page_id = b.page_id AND a.grp = b.grp AND a.pos < b.pos),
once AS (SELECT page_id, atag, atxt, tag, step FROM pairs GROUP BY page_id, atag, atxt, tag, step HAVING count(DISTINCT k) = 1),
siblings AS (SELECT p.page_id, p.k, arg_max('//' || atag || '[normalize-space(.)=' || {literal("atxt")} || ']/following-sibling::' || tag || '[' || step || ']', near) AS sibling
  FROM pairs p JOIN once o USING (page_id, atag, atxt, tag, step) WHERE p.short GROUP BY p.page_id, p.k)"""

_FOUND = f"""located AS (SELECT e.page_id, e.k, e.tag, e.path, CASE WHEN short THEN whole ELSE line END AS name, CASE WHEN short THEN whole ELSE line END || '::' || tag AS id, list_filter([
    CASE WHEN tag = 'div' THEN {{'strategy': 'class', 'type': 'css', 'value': 'div.ad'}} END,
    CASE WHEN tag = 'div' THEN {{'strategy': 'class', 'type': 'xpath', 'value': '//div[contains(concat('' '', normalize-space(@class), '' ''), '' ad '' )]'}} END,
    CASE WHEN short AND n_txt = 1 THEN {{'strategy': 'text', 'type': 'xpath', 'value': '//' || tag || '[normalize-space(.)=' || {literal("txt")} || ']'}} END,
    CASE WHEN short AND n_part = 1 THEN {{'strategy': 'text_part', 'type': 'xpath', 'value': '//' || tag || '[contains(normalize-space(.), ' || {literal("txt")} || ')]'}} END,
    CASE WHEN href <> '' AND n_href = 1 THEN {{'strategy': 'href', 'type': 'css', 'value': 'a[href="' || {escaped("href")} || '"]'}} END,
    CASE WHEN href <> '' AND n_href = 1 THEN {{'strategy': 'href', 'type': 'xpath', 'value': '//a[@href=' || {literal("href")} || ']'}} END,
    CASE WHEN sibling IS NOT NULL THEN {{'strategy': 'sibling', 'type': 'xpath', 'value': sibling}} END], lambda x: x IS NOT NULL) AS found
  FROM counts e LEFT JOIN siblings s ON e.page_id = s.page_id AND e.k = s.k WHERE (short OR line <> '' AND length(line) < 30) AND tag <> 'nav'),
scan AS (SELECT page_id, k, name, tag, i, x.strategy AS strategy, x.type AS type, x.value AS value, {score("x.type", "x.value")} AS stability FROM (SELECT page_id, k, name, tag, unnest(found) AS x, unnest(range(len(found))) AS i FROM located)),
store AS (SELECT page_id, id, name, tag, found, k, first FROM (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY k DESC) AS r, min(k) OVER (PARTITION BY page_id, id) AS first FROM located WHERE len(found) > 0) WHERE r = 1),
items AS (SELECT page_id, id, name, tag, k, first, unnest(found) AS x, unnest(range(len(found))) AS i FROM store),
scored AS (SELECT page_id, id, name, tag, k, first, i, x.type AS type, x.value AS value, {score("x.type", "x.value")} AS stability FROM items)"""

WITH_STORE = f"WITH {ELEMENTS}, {_FOUND}"


#: The locators of the form pages, as the rules give them by hand; $k is the page, $m its number modulo 7. Variant 0: pages with a second button.
_BOTH = (
    ("form", None, (("id", "id", "login"), ("id", "css", "#login"), ("id", "xpath", "//*[@id='login']"), ("text", "xpath", "//form[normalize-space(.)='UserSave $m$c']"), ("text_part", "xpath", "//form[contains(normalize-space(.), 'UserSave $m$c')]"))),
    ("ul", "HomeHome", (("id", "id", "menu"), ("id", "css", "#menu"), ("id", "xpath", "//*[@id='menu']"), ("text", "xpath", "//ul[normalize-space(.)='HomeHome']"), ("text_part", "xpath", "//ul[contains(normalize-space(.), 'HomeHome')]"),
        ("sibling", "xpath", "//form[@id='login']/following-sibling::ul[1]"))),
    ("input", "user$k", (("id", "id", "u"), ("id", "css", "#u"), ("id", "xpath", "//*[@id='u']"), ("name", "css", '[name="user$k"]'), ("name", "xpath", "//*[@name='user$k']"), ("chain", "css", "#login #u"), ("chain", "xpath", "//form[@id='login']//*[@id='u']"),
        ("parent", "xpath", "//form[@id='login']//input"), ("parent", "css", "#login > input"), ("sibling", "xpath", "//label[normalize-space(.)='User']/following-sibling::input[1]"))),
    ("li", "Home", (("chain", "css", "#menu li:nth-of-type(1)"), ("chain", "xpath", "//ul[@id='menu']//li[1]"))),
    ("li", "Home", (("chain", "css", "#menu li:nth-of-type(2)"), ("chain", "xpath", "//ul[@id='menu']//li[2]"), ("sibling", "xpath", "//li[normalize-space(.)='Home']/following-sibling::li[1]"))),
    ("a", "Home", (("chain", "css", "#menu li:nth-of-type(1) > a"), ("chain", "xpath", "//ul[@id='menu']//li[1]/a"), ("href", "css", 'a[href="\\/a$k"]'), ("href", "xpath", "//a[@href='/a$k']"))),
    ("a", "Home", (("chain", "css", "#menu li:nth-of-type(2) > a"), ("chain", "xpath", "//ul[@id='menu']//li[2]/a"), ("href", "css", 'a[href="\\/b$k"]'), ("href", "xpath", "//a[@href='/b$k']"))),
)
_SAVE = (
    ("preferred", "css", '[data-testid="go$k"]'), ("preferred", "xpath", "//*[@data-testid='go$k']"), ("stable", "css", 'button[data-testid="go$k"]'), ("stable", "xpath", "//button[@data-testid='go$k']"),
    ("text", "xpath", "//button[normalize-space(.)='Save $m']"), ("text_part", "xpath", "//button[contains(normalize-space(.), 'Save $m')]"),
)
_SAVE_END = (("class_chain", "css", "button.btn.primary"), ("sibling", "xpath", "//input[@id='u']/following-sibling::button[1]"))
_FORMS = {
    1: (*_BOTH, ("button", "Save $m", (*_SAVE, ("chain", "css", "#login button.btn"), ("chain", "xpath", "//form[@id='login']//button[contains(@class, 'btn')]"), ("parent", "xpath", "//form[@id='login']//button[normalize-space(.)='Save $m']"), ("parent", "css", "#login > button"), *_SAVE_END))),
    0: (*_BOTH, ("button", "Save $m", (*_SAVE, ("chain", "xpath", "//form[@id='login']//button[contains(@class, 'btn')][normalize-space(.)='Save $m']"), ("parent", "xpath", "//form[@id='login']//button[normalize-space(.)='Save $m']"), *_SAVE_END)),
        ("button", "Cancel", (("text", "xpath", "//button[normalize-space(.)='Cancel']"), ("text_part", "xpath", "//button[contains(normalize-space(.), 'Cancel')]"), ("chain", "xpath", "//form[@id='login']//button[contains(@class, 'btn')][normalize-space(.)='Cancel']"),
            ("parent", "xpath", "//form[@id='login']//button[normalize-space(.)='Cancel']"), ("sibling", "xpath", "//button[@data-testid='go$k']/following-sibling::button[1]")))),
}
#: How many elements the questions of plans.queries find in pages with one and with two buttons, and the first one's tag.
_FORM_COUNTS = {
    "#login button.btn": (1, 2, "button"), "#login > button": (1, 2, "button"), "button.primary.btn": (1, 1, "button"), "#menu li:nth-of-type(2) > a": (1, 1, "a"), "form input": (1, 1, "input"), "u": (1, 1, "input"),
    "//form[@id='login']//button[contains(@class, 'prim')]": (1, 1, "button"), "//form[@id='login']//button[normalize-space(.)='Cancel']": (0, 1, "button"), "//input[@id='u']/following-sibling::button[2]": (0, 1, "button"),
    "//ul[@id='menu']//li/a[normalize-space(.)='Home']": (2, 2, "a"), "//label[normalize-space(.)='User']": (1, 1, "label"),
    "//form[@id='login']//button[contains(normalize-space(.), 'Save')]": (1, 1, "button"), "//*[contains(normalize-space(.), 'Save')]": (4, 4, "html"), "//*[contains(@class, 'prim')]": (1, 1, "button"), "//*": (12, 13, "html"),
    "//label[contains(normalize-space(.), 'User')]/following-sibling::button[1]": (1, 1, "button"), "(//a)[2]": (1, 1, "a"), "//a/..": (2, 2, "li"), "button:not(.primary)": (0, 1, "button"), "label + input": (1, 1, "input"), "input ~ button, ul": (2, 3, "button"),
    "a[href^='/a']": (1, 1, "a"), "a:hover": (None, None, None), "//li[": (None, None, None), "//button[last()]": (1, 1, "button"), "//ul//a[not(@class) and starts-with(@href, '/b')]": (1, 1, "a"), "//button[contains(@class, 'btn')][2]/preceding-sibling::button[1]": (0, 1, "button"),
    "/html/body/ul/li[2]": (1, 1, "li"), "//li[position()=2]/a[. = 'Home']": (1, 1, "a"), "ul > li > a": (2, 2, "a"), "//input/parent::form | //ul": (2, 2, "form"),
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form_scan() -> str:
    filled = lambda s: f"replace(replace(replace({s}, '$k', CAST(p_partkey AS VARCHAR)), '$m', CAST(p_partkey % 7 AS VARCHAR)), '$c', CASE WHEN p_partkey % 2 = 0 THEN 'Cancel' ELSE '' END)"
    rows = ", ".join(
        f"({variant}, {_quoted(name or 'UserSave $m$c')}, '{tag}', {place}, '{strategy}', '{kind}', {_quoted(value)})"
        for variant, elements in _FORMS.items() for tag, name, found in elements for place, (strategy, kind, value) in enumerate(found)
    )
    return f"""WITH f(variant, name, tag, place, strategy, type, value) AS (VALUES {rows}), t AS (SELECT p_partkey AS page_id, {filled("name")} AS name, tag, CAST(place AS INTEGER) AS place, strategy, type, {filled("value")} AS value FROM part JOIN f ON p_partkey % 2 = variant)
      SELECT page_id, name, tag, place, strategy, type, value, {score("type", "value")} AS stability FROM t"""


def _form_verify() -> str:
    kind = lambda v: "id" if v == "u" else "xpath" if v.startswith(("//", "(")) else "xpath-abs" if v[0] == "/" else "css"
    sql = lambda x: "NULL" if x is None else str(x)
    rows = ", ".join(f"('{kind(v)}', {_quoted(v)}, {sql(one)}, {sql(two)}, '{tag}')" for v, (one, two, tag) in _FORM_COUNTS.items())
    return f"""WITH f(type, value, one, two, tag) AS (VALUES {rows}), t AS (SELECT p_partkey AS page_id, type, value, CAST(CASE WHEN p_partkey % 2 = 0 THEN two ELSE one END AS BIGINT) AS matches, tag FROM part, f)
      SELECT page_id, type, value, coalesce(matches, -1) AS matches, CASE WHEN matches = 1 THEN 'success-1' WHEN matches > 1 THEN 'success-multi' WHEN matches = 0 THEN 'error' ELSE 'Err' END AS verdict, CASE WHEN matches > 0 THEN tag END AS first_tag FROM t"""


#: Elements of plans.queries' pages with shadow trees, by their numbers: tag, hops, where the hops lead, turn in the scan's queue.
_SHADOW = ((0, "html", 1, 0, 1), (1, "head", 1, 1, 2), (2, "body", 1, 2, 3), (3, "div", 1, 3, 4), (4, "button", 2, 4, 6), (5, "span", 2, 5, 7), (6, "a", 3, 6, 9), (7, "button", 2, 4, 8), (8, "a", 1, 8, 5), (9, "a", 1, 8, 0))


def _shadow(columns: str, where: str) -> str:
    rows = ", ".join(f"({nid}, '{tag}', {hops}, {to}, {turn})" for nid, tag, hops, to, turn in _SHADOW)
    # On pages with two links the second one's turn comes with the shadow tree's first button.
    return f"""WITH f(nid, tag, n_hops, hop_nid, turn) AS (VALUES {rows}), t AS (SELECT p_partkey AS page_id, f.*, p_partkey % 2 = 0 AS two FROM part, f WHERE nid < 9 OR p_partkey % 2 = 0)
      SELECT page_id, {columns} FROM t WHERE {where}"""


#: Elements of the styled pages: tag, and whether they can be seen; 2: unless the section is of class v1.
_STYLED = (
    ("html", 1), ("head", 0), ("style", 0), ("body", 1), ("div", 0), ("b", 0), ("ul", 1), ("li", 0), ("span", 1), ("li", 1), ("p", 0), ("div", 1), ("p", 1), ("section", 2), ("i", 2), ("div", 1), ("h2", 1), ("em", 0), ("em", 1), ("a", 0), ("style", 0),
)


def _labels() -> str:
    """$k is the page; the label is the first input's on even pages and the second one's on odd ones."""
    names = (("label", "User $k", "User $k"), ("input", "User $k", None), ("input", "T", "User $k"), ("span", "Ref text", "Ref text"), ("button", "Ref text", "Ref text"), ("button", "Tip", "Tip"), ("img", "Pic", "Pic"), ("input", "Own", "Own"), ("p", "Plain", "Plain"), ("p", None, None))
    sql = lambda s: "NULL" if s is None else _quoted(s)
    rows = ", ".join(f"({i}, '{tag}', {sql(even)}, {sql(odd)})" for i, (tag, even, odd) in enumerate(names, 3))
    return f"""WITH f(nid, tag, even, odd) AS (VALUES {rows})
      SELECT p_partkey AS page_id, nid, tag, replace(CASE WHEN p_partkey % 2 = 0 THEN even ELSE odd END, '$k', CAST(p_partkey AS VARCHAR)) AS accessible_name FROM part, f"""


def _priorities() -> str:
    order = ["data-testid", "data-test", "data-qa", "data-cy", "aria-label", "aria-labelledby", "role", "name", "placeholder", "alt", "title", "type", "id", "class"]
    return f"""WITH s AS (SELECT p_partkey, list_transform(string_split(CASE p_partkey % 3 WHEN 0 THEN 'data-x, title ,' || p_size WHEN 1 THEN p_brand || ' ,class,data-x,class' END, ','), lambda x: trim(x)) AS own FROM part),
      l AS (SELECT p_partkey, coalesce(own, []) || {order} AS l FROM s), e AS (SELECT p_partkey, unnest(l) AS x, unnest(range(len(l))) AS i FROM l), f AS (SELECT p_partkey, x, min(i) AS i FROM e GROUP BY p_partkey, x)
      SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS priority FROM f GROUP BY p_partkey"""


def _styled() -> str:
    rows = ", ".join(f"({i}, '{tag}', {seen})" for i, (tag, seen) in enumerate(_STYLED))
    return f"WITH f(nid, tag, seen) AS (VALUES {rows}) SELECT p_partkey AS page_id, nid, tag, seen = 1 OR seen = 2 AND p_partkey % 3 <> 1 AS visible FROM part, f"


def _snippet(language: str) -> str:
    forms = {
        "java": ('driver.findElement(By.id("', '"))', 'driver.findElement(By.cssSelector("', '"))', 'driver.findElement(By.xpath("', '"))'),
        "python": ('driver.find_element(By.ID, "', '")', 'driver.find_element(By.CSS_SELECTOR, "', '")', 'driver.find_element(By.XPATH, "', '")'),
        "javascript": ('driver.findElement(By.id("', '"))', 'driver.findElement(By.css("', '"))', 'driver.findElement(By.xpath("', '"))'),
        "playwright": ('page.locator("#', '")', 'page.locator("', '")', 'page.locator("xpath=', '")'),
        "cypress": ('cy.get("#', '")', 'cy.get("', '")', 'cy.xpath("', '")'),
    }[language]
    v = "replace(s, '\"', '''')"
    cases = " ".join(f"WHEN '{k}' THEN '{forms[2 * i]}' || {v} || '{forms[2 * i + 1]}'" for i, k in enumerate(("id", "css", "xpath")))
    return f"WITH {STRINGS} SELECT id, CASE type {cases} ELSE {v} END AS code FROM typed"


SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

SQL = {
    "score_synthetic": f"WITH {STRINGS} SELECT id, {score('type', 's')} AS stability FROM typed",
    "dynamic_flags": f"WITH {STRINGS} SELECT id, {dynamic('s')} AS dynamic FROM strings",
    "xpath_literal": f"WITH {STRINGS} SELECT id, {literal('s')} AS literal FROM strings",
    "css_escape": f"WITH {STRINGS} SELECT id, {escaped('s')} AS escaped FROM strings",
    "attr_css": f"WITH {STRINGS} SELECT id, CASE {ATTR} WHEN 'id' THEN '#' || {escaped('s')} WHEN 'class' THEN 'p.' || {escaped('s')} ELSE 'p[title=\"' || {escaped('s')} || '\"]' END AS css FROM strings",
    "attr_xpath": f"""WITH {STRINGS}, t AS (SELECT id, s, ' ' || s || ' ' AS padded FROM strings) SELECT id, CASE {ATTR} WHEN 'class' THEN '//p[contains(concat('' '', normalize-space(@class), '' ''), ' || {literal("padded")} || ')]'
      ELSE '//p[@' || {ATTR} || '=' || {literal("s")} || ']' END AS xpath FROM t""",
    "text_normalize": rf"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ')) AS normalized, md5(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS trimmed FROM documents""",
    "stable_attr_pick": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name || ' ' END AS cy, CASE WHEN p_partkey % 4 < 2 THEN 'item-' || (p_partkey * 37) END AS own,
        CASE WHEN p_partkey % 5 < 4 THEN [t for t in ['c' || (p_partkey * 101), replace(p_brand, '#', '-'), 'x'] if NOT """ + dynamic("t") + """ AND length(t) <= 40] END AS tokens FROM part)
      SELECT p_partkey, CASE WHEN trim(cy) <> '' THEN 'data-cy' WHEN own IS NOT NULL AND NOT """ + dynamic("own") + """ THEN 'id' WHEN len(tokens) > 0 THEN 'class' END AS attr,
        CASE WHEN trim(cy) <> '' THEN trim(cy) WHEN own IS NOT NULL AND NOT """ + dynamic("own") + """ THEN own WHEN len(tokens) > 0 THEN tokens[1] END AS value FROM t""",
    **{f"snippets_{x}": _snippet(x) for x in ("java", "python", "javascript", "playwright", "cypress")},
    "href_locators": f"""WITH {LINKS}, t AS (SELECT page_id, href, 'a[href="' || {escaped("href")} || '"]' AS css, '//a[@href=' || {literal("href")} || ']' AS xpath FROM links WHERE n_href = 1 AND href <> '')
      SELECT page_id, href, css, xpath, {score("'css'", "css")} AS css_stability, {score("'xpath'", "xpath")} AS xpath_stability FROM t""",
    "href_unique_counts": f"WITH {LINKS} SELECT page_id, count(*) AS n_unique FROM links WHERE n_href = 1 AND href <> '' GROUP BY page_id",
    "link_texts": f"WITH {LINKS} SELECT DISTINCT page_id, txt AS text, CAST(n_txt AS INTEGER) AS n_exact, CAST(n_part AS INTEGER) AS n_part FROM links WHERE txt <> '' AND length(txt) < 50",
    "following_sibling_li": f"""WITH {LINKS}, pairs AS (SELECT b.page_id, b.k AS j, b.k - a.k AS step, a.txt AS t FROM links a JOIN links b ON a.page_id = b.page_id AND a.k < b.k),
      once AS (SELECT page_id, t, step FROM pairs GROUP BY page_id, t, step HAVING count(DISTINCT j) = 1),
      best AS (SELECT p.page_id, p.j, min(p.step) AS step FROM pairs p JOIN once o ON p.page_id = o.page_id AND p.t = o.t AND p.step = o.step WHERE p.t <> '' AND length(p.t) < 50 GROUP BY p.page_id, p.j)
      SELECT p.page_id, '//li[normalize-space(.)=' || {literal("p.t")} || ']/following-sibling::li[' || p.step || ']' AS sibling FROM best b JOIN pairs p ON b.page_id = p.page_id AND b.j = p.j AND b.step = p.step""",
    "class_locators": """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<div class="([^"]*)">', 1)) AS c FROM pages)
      SELECT page_id, 'div' AS tag, c AS token, 'div.' || c AS css, '//div[contains(concat('' '', normalize-space(@class), '' ''), '' ' || c || ' '' )]' AS xpath FROM t GROUP BY page_id, c HAVING count(*) = 1""",
    "full_scan": f"{WITH_STORE} SELECT page_id, name, tag, CAST(i AS INTEGER) AS place, strategy, type, value, stability FROM scan",
    "form_scan": _form_scan(),
    "form_verify": _form_verify(),
    "label_names": _labels(),
    "url_gate": "SELECT page_id, page_id % 4 = 2 OR page_id % 4 = 0 AND regexp_matches(url, '^(https?|file):') AS openable FROM pages",
    "attribute_priorities": _priorities(),
    "file_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS stamp FROM events",
    "scan_counts": f"{WITH_STORE}, n AS (SELECT page_id, count(*) AS n_scanned FROM located WHERE len(found) > 0 GROUP BY page_id) SELECT page_id, n_scanned, count(*) AS n_kept FROM n JOIN store USING (page_id) GROUP BY page_id, n_scanned",
    "hop_returns": _shadow("CAST(nid AS INTEGER) AS nid, tag, CAST(n_hops AS INTEGER) AS n_hops, CAST(hop_nid AS INTEGER) AS hop_nid", "nid > 2"),
    "scan_order": _shadow("CAST(nid AS INTEGER) AS nid, CAST(CASE WHEN nid = 9 THEN 7 WHEN two AND turn > 6 THEN turn + 1 ELSE turn END AS INTEGER) AS scan_rank", "true"),
    "visible_elements": _styled(),
    "entries_upsert": f"{WITH_STORE} SELECT page_id, id, name, tag, string_agg(type || ' ' || value || ' ' || stability, chr(10) ORDER BY i) AS locators FROM scored GROUP BY page_id, id, name, tag",
    "entry_rank": f"{WITH_STORE}, m AS (SELECT page_id, id, k, max(stability) AS stab FROM scored GROUP BY page_id, id, k) SELECT page_id, id, stab, CAST(row_number() OVER (PARTITION BY page_id ORDER BY stab DESC, k) AS INTEGER) AS place FROM m",
    "best_locator": f"{WITH_STORE} SELECT page_id, id, type, value, stability FROM (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY stability DESC, i) AS r FROM scored) WHERE r = 1",
    "name_search": f"{WITH_STORE} SELECT page_id, id FROM store WHERE contains(lower(name), 'an')",
    "clean_export": f"{WITH_STORE} SELECT page_id, name, tag, arg_max(value, i) FILTER (type = 'css') AS css, arg_max(value, i) FILTER (type = 'xpath') AS xpath FROM scored GROUP BY page_id, name, tag",
    "sorted_locators": f"""{WITH_STORE} SELECT page_id, id, CAST(row_number() OVER (PARTITION BY page_id, id ORDER BY list_position(['id', 'css', 'xpath'], type), stability DESC, i) - 1 AS INTEGER) AS place, type, value,
      'page.locator("' || CASE type WHEN 'css' THEN '' ELSE 'xpath=' END || replace(value, '"', chr(39)) || '")' AS code FROM scored""",
    "entry_delete": f"{WITH_STORE} SELECT page_id, id FROM store WHERE id <> 'para::a'",
    "json_export": f"""{WITH_STORE}, v AS (SELECT page_id, first, name, tag, min(i) AS i, type, arg_max(value, i) AS value FROM scored GROUP BY page_id, first, name, tag, type),
      r AS (SELECT page_id, first, name, tag, '  {{' || chr(10) || '    "name": ' || to_json(name) || ',' || chr(10) || '    "tag": ' || to_json(tag) || ',' || chr(10) || '    "locators": {{' || chr(10)
          || string_agg('      ' || to_json(type) || ': ' || to_json(value), ',' || chr(10) ORDER BY i) || chr(10) || '    }}' || chr(10) || '  }}' AS row FROM v GROUP BY page_id, first, name, tag)
      SELECT CASE WHEN row_number() OVER (ORDER BY page_id, first) = count(*) OVER () THEN row ELSE row || ',' END AS row FROM r UNION ALL SELECT '[' UNION ALL SELECT ']'""",
    "text_export": f"""{WITH_STORE}, r AS (SELECT page_id, first, name, tag, id, string_agg(' [' || upper(type) || '] [stability=' || stability || ']' || chr(10) || ' ' || value || chr(10) || chr(10), '' ORDER BY i) AS body FROM scored GROUP BY page_id, first, name, tag, id)
      SELECT '--- Element ' || row_number() OVER (ORDER BY page_id, first) || ' ---' || chr(10) || 'ID: ' || id || chr(10) || 'Name: ' || name || chr(10) || 'Tag: <' || tag || '>' || chr(10) || 'Hops: [{{"type":"leaf","selector":"'
        || CASE tag WHEN 'div' THEN 'div.ad' ELSE tag END || '"}}]' || chr(10) || chr(10) || body || '---------------------' || chr(10) AS row FROM r
      UNION ALL SELECT 'Report' || chr(10) || repeat('=', 49) || chr(10) || chr(10) || 'Total Locators: ' || count(*) || chr(10) FROM r""",
    "absolute_paths": f"{WITH_STORE} SELECT page_id, name, tag, path FROM located",
    "accessible_names": f"WITH {ELEMENTS} SELECT page_id, tag, path, nullif(whole, '') AS accessible_name FROM els WHERE tag <> 'nav'",
    "hop_leaves": f"WITH {LINKS} SELECT page_id, CAST(9 + 2 * count(*) AS INTEGER) AS nid FROM plain GROUP BY page_id",
    "verify_counts": f"""{WITH_STORE}, n AS (SELECT page_id, count(*) AS n FROM plain GROUP BY page_id),
      asked AS (SELECT DISTINCT page_id, type, value, 1 AS matches FROM scan
        UNION ALL SELECT page_id, 'css', 'li', n FROM n UNION ALL SELECT page_id, 'css', 'div.none', 0 FROM n UNION ALL SELECT page_id, 'xpath', '//li[', NULL FROM n UNION ALL SELECT page_id, 'css', 'a:hover', NULL FROM n
        UNION ALL SELECT page_id, 'xpath-abs', '/html/body/nav/ul/li/a', n FROM n UNION ALL SELECT page_id, 'xpath-abs', '/html/body/nav/ul/li[2]/a', least(1, n - 1) FROM n UNION ALL SELECT page_id, 'css', 'ul > li', n FROM n
        UNION ALL SELECT page_id, 'css', 'nav a', n FROM n UNION ALL SELECT page_id, 'css', 'nav > a', 0 FROM n UNION ALL SELECT page_id, 'xpath', '//nav//li[2]/a', least(1, n - 1) FROM n
        UNION ALL SELECT page_id, 'xpath', '//li[1]/following-sibling::li[2]', greatest(0, least(1, n - 2)) FROM n
        UNION ALL SELECT page_id, 'xpath', '//ul//li[contains(@class, ''x'')]', 0 FROM n UNION ALL SELECT page_id, 'xpath', '//div[contains(@class, ''a'')]', 1 FROM n)
      SELECT page_id, type, value, CAST(coalesce(matches, -1) AS BIGINT) AS matches, CASE WHEN matches IS NULL THEN 'Err' WHEN matches = 1 THEN 'success-1' WHEN matches > 1 THEN 'success-multi' ELSE 'error' END AS verdict FROM asked""",
    "debounce_events": """WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM t)
      SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, island""",
}
