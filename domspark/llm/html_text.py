"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. First pass: blocks inside of menus, footers, adverts and the like are bad,
and so are blocks of links; inside of an article a doubtful name makes only those blocks bad that aren't prose; blocks that are long enough and hold stop words are good; short ones, and long ones without
stop words, stay open. Second pass: open blocks take the label of the nearest decided blocks: of both if they agree, else
of the nearer one (at equal distance the good one). Where a page marks an article or main part, only its blocks are
looked at, and an open block without decided neighbours is good in it.

Defined results: a null or empty page has an empty text; repeated rows each give theirs; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.markup import RAW_TEXT, VOID, attributes, tokens
from .common import pieces
from .quality import STOP_WORDS

LONG = 15
STOP_DENSITY = 0.12
LINK_DENSITY = 0.5

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that hold no part of an article.
BAD_TAGS = frozenset("head nav footer aside form button select option textarea noscript template svg math canvas object audio video map menu dialog search script style xmp iframe noembed noframes title fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note".split())
#: Parts of class names and ids that name what isn't article.
BAD_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer foot masthead topbar toolbar pagination pager ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register search share sharing social related recommended recommendations comment comments commentlist discussion replies reply respond disqus feedback widget copyright legal disclaimer skip hidden".split()
)
#: Those of them that also name parts of articles: inside of one they only count against blocks that aren't prose.
DOUBTFUL_NAMES = frozenset("side search share sharing discussion register login legal skip alert feedback".split())
_INSERTED = frozenset("ad ads advert advertisement comment comments promo related reply replies sponsored teaser".split())
_STOP = frozenset(STOP_WORDS)
_WORD = re.compile(r"\w+")
_BETWEEN = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    bad: bool
    doubtful: bool
    main: bool
    heading: bool


def _is_doubtful(attrs: dict[str, str], in_main: bool) -> bool:
    names = _BETWEEN.split(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    return in_main and not DOUBTFUL_NAMES.isdisjoint(names)


def _is_bad(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in BAD_TAGS or tag == "header" and not in_main:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    names = _BETWEEN.split(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    if tag in ("article", "main", "body", "html"):
        # Comments and teasers are often articles of their own; the names of the whole page say less.
        return tag == "article" and not _INSERTED.isdisjoint(names)
    named = BAD_NAMES.intersection(names)
    if in_main:
        named -= DOUBTFUL_NAMES
    return attrs.get("role", "").lower() in BAD_ROLES or bool(named) or "header" in names and not in_main


def blocks(source: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    # Open elements that matter: (tag, makes its content bad, doubtful, begins a main part); p and li end with the next block too.
    stack: list[tuple[str, bool, bool, bool]] = []
    bad = doubtful = main = links = link_depth = 0
    heading = False

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            n = len(_WORD.findall(text))
            out.append(Block(text, n, len(_WORD.findall(" ".join(link_parts))), bad > 0, doubtful > 0, main > 0, heading))
        parts.clear()
        link_parts.clear()

    def pop() -> None:
        nonlocal bad, doubtful, main, links
        _, was_bad, was_doubtful, was_main = stack.pop()
        bad -= was_bad
        doubtful -= was_doubtful
        main -= was_main
        if len(stack) < link_depth:  # a link that nothing closed ends with the block that it began in
            links = 0

    for kind, tag, rest in tokens(source):
        if kind == "text":
            parts.append(rest)
            if links:
                link_parts.append(rest)
            continue
        if tag == "br" or tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block or tag in BAD_TAGS:
            close()
        if kind == "start":
            if block:
                heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag not in ("a", "b"):
                    pop()
                if tag in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == tag:
                    pop()
            attrs = attributes(rest) if rest.strip() else {}
            if tag == "a":  # ends the one before, and goes on in the blocks inside of it
                links, link_depth = int("href" in attrs), len(stack)
            is_bad = _is_bad(tag, attrs, main > 0)
            if not block and is_bad and tag not in BAD_TAGS:
                close()
            is_main = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
            # Inline elements matter only if their content is bad.
            if block or is_bad or is_main:
                if not rest.rstrip().endswith("/") or tag not in ("svg", "math"):
                    is_doubtful = _is_doubtful(attrs, main > 0)
                    stack.append((tag, is_bad, is_doubtful, is_main))
                    bad += is_bad
                    doubtful += is_doubtful
                    main += is_main
        else:
            if block:
                heading = False
            if tag == "a":
                links = 0
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at >= 0:
                if not block and tag not in RAW_TEXT:
                    close()
                while len(stack) > at:
                    pop()
    close()
    return out


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is part of the main text."""
    some_main = any(b.main and not b.bad for b in found)
    first: list[bool | None] = []
    for b in found:
        stop = sum(w in _STOP for w in _WORD.findall(b.text.lower()))
        if b.bad or some_main and not b.main:
            first.append(False)
        elif b.words and b.link_words > LINK_DENSITY * b.words and (b.words < LONG or b.link_words > 0.8 * b.words):
            first.append(False)
        elif b.words >= LONG and stop >= STOP_DENSITY * b.words:
            first.append(True)
        elif b.doubtful:
            first.append(False)
        else:
            first.append(None)
    # In a marked part only its own blocks are neighbours.
    decided = [x is not None and (not some_main or b.main and not b.bad) for x, b in zip(first, found, strict=True)]

    def nearest(order: range) -> list[int | None]:
        out: list[int | None] = [None] * len(found)
        last = None
        for i in order:
            out[i] = last
            if decided[i]:
                last = i
        return out

    before, behind = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    alone = some_main or not any(b.words >= LONG or b.bad for b in found)
    out = []
    for i, label in enumerate(first):
        if label is None:
            sides = [(-abs(j - i), first[j]) for j in (before[i], behind[i]) if j is not None]
            label = max(sides)[1] if sides else alone
        out.append(bool(label))
    return out


def main_text(source: str) -> str:
    found = blocks(source)
    return " ".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1_000):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.coalesce(html, F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
