"""Secret scans: three base patterns, and literals that flow to sensitive names in source or configuration syntax.

A text is lexed into strings (with escapes; triple-quoted and back-quoted ones over lines), comments and assignment signs
(=, :, :=, =>, +=); signs in strings count for nothing. Each sign gives a name (before it; a quoted key too) and its terms
(behind it: strings, bare values, names, and sums of those). Comments are read the same way, with names of their own.

Constants are propagated in order: a name stands for what was last assigned to it, += adds to it, and a name that is only
assigned further down stands for its first assignment there. So assignments point to assignments; from the most sensitive
names down, each is visited once and passes its score on to its literals. A literal with a sensitive name's score and
enough of a secret's form (LEAST_SCORE in all) is reported as "literal", unless a base span covers it. By the form, literals
of fewer than 6 characters, with blanks, or that are placeholders are none.

Defined results: a null or empty text has no spans; repeated rows each give their own result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names and what they add to a literal's score.
NAME_SCORE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3, "authkey": 3, "bearer": 2, "auth": 1, "key": 1, "pass": 1, "salt": 1, "signature": 1}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|0+|change_?me|example|placeholder|your[_-].*|none|null|true|false|todo|test|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w*\)?s?)$")
LEAST_SCORE = 5

_STRING = r"""(?P<string>\"{3}[\s\S]*?(?:\"{3}|\Z)|'{3}[\s\S]*?(?:'{3}|\Z)|"(?:[^"\\\n]|\\[\s\S])*"|(?<!\w)'(?:[^'\\\n]|\\[\s\S])*'|(?<!\w)`(?:[^`\\]|\\[\s\S])*`)"""
_SIGN = r"(?P<sign>:=|=>|\+=|[=!<>]=+|=|:)"
_COMMENT = r"(?P<comment>(?:^|(?<=\s))\#[^\n]*|(?<![:\w])//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_QUOTE = r"""(?P<quote>\"{3}|'{3}|"|(?<!\w)['`])"""
_CODE, _REMARK = re.compile(f"{_COMMENT}|{_QUOTE}|{_SIGN}", re.A | re.M), re.compile(f"{_QUOTE}|{_SIGN}", re.A)
#: What may stand in a string up to its quote.
_INSIDE = {'"': re.compile(r'(?:[^"\\\n]|\\[\s\S])*+'), "'": re.compile(r"(?:[^'\\\n]|\\[\s\S])*+"), "`": re.compile(r"(?:[^`\\]|\\[\s\S])*+")}
_TERM = re.compile(rf"(?:[ \t(]|\\\n)*(?:{_STRING}|(?P<name>[A-Za-z_$][\w.$]*)(?![\w+/=-])|(?P<bare>[\w+/=.$-]+))", re.A)
_PLUS = re.compile(r"[ \t]*(?:\+(?!=)|\.\.|&)[ \t]*\n?|[ \t]+(?=[\"'])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> int:
    """The best of the name's parts, and of neighbouring parts together (api_key, accessKey)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    both = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((NAME_SCORE.get(p, 0) for p in parts + both), default=0)


def literal_score(value: str) -> int:
    if len(value) < 6 or PLACEHOLDER.match(value) or " " in value:
        return -9
    kinds = sum(any(map(test, value)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return (n >= 8) + (n >= 16) + (kinds >= 2) + (entropy >= 3)


def _name_before(text: str, at: int) -> str:
    """The name that ends before at, behind quotes, brackets and blanks."""
    while at and text[at - 1] in " \t":
        at -= 1
    while at and text[at - 1] in "\"'])":
        at -= 1
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_-.$") and text[at - 1].isascii():
        at -= 1
    return text[at:end].strip("-.")


def lexed(pattern: re.Pattern, text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of comments, strings and signs, in order and in linear time.

    A quote that nothing closes is no string. All quotes up to where the search for its end stopped are escaped, so each of
    them would stop there too: they aren't tried.
    """
    closed_not_before = dict.fromkeys(_INSIDE, -1)
    while m := pattern.search(text, start, end):
        kind, a, start = m.lastgroup, m.start(), m.end()
        if kind == "quote" and len(m[0]) == 3:
            stop = text.find(m[0], start, end)
            kind, start = "string", end if stop < 0 else stop + 3
        elif kind == "quote":
            if a < closed_not_before[m[0]]:
                continue
            stop = _INSIDE[m[0]].match(text, start, end).end()
            if stop == end or text[stop] != m[0]:
                closed_not_before[m[0]] = stop
                continue
            kind, start = "string", stop + 1
        yield kind, a, start


Terms = list[tuple[str, int, int]]


def _inner(text: str, a: int, b: int) -> tuple[int, int]:
    """A string's place without its quotes."""
    k = 3 if b - a >= 6 and text[a : a + 3] in ('"""', "'''") else 1
    return a + k, max(a + k, b - k if text[b - k : b] == text[a : a + k] else b)


def pairs(text: str) -> tuple[list[tuple[str, bool, Terms]], list[tuple[str, bool, Terms]]]:
    """The assignments in code, and those in comments: names, whether they add, and the terms ("name" or "literal", start, end)."""
    remarks: list[tuple[int, int]] = []

    def read(pattern: re.Pattern, start: int, end: int) -> Iterator[tuple[str, bool, Terms]]:
        last = (-1, -1)  # the last string
        done = start  # signs before this place belong to a term
        for kind, a, b in lexed(pattern, text, start, end):
            if kind == "comment":
                remarks.append((a, b))
                continue
            if kind == "string":
                last = (a, b)
                continue
            sign = text[a:b]
            if sign not in ("=", ":", ":=", "=>", "+=") or a < done:
                continue
            key = _key_before(text, a, last)
            if not key or not (key[0].isalpha() or key[0] in "_$"):
                continue
            at, terms = b, []
            while term := _TERM.match(text, at, end):
                kind = term.lastgroup
                a, b = term.span(kind)
                terms.append(("name", a, b) if kind == "name" else ("literal", *(_inner(text, a, b) if kind == "string" else (a, b))))
                done = term.end()
                if not (plus := _PLUS.match(text, term.end(), end)):
                    break
                at = plus.end()
            if terms:
                yield key, sign == "+=", terms

    code = list(read(_CODE, 0, len(text)))
    return code, [x for a, b in remarks for x in read(_REMARK, a, b)]


def _key_before(text: str, at: int, last: tuple[int, int]) -> str:
    """The name before a sign; a string's content if that stands there."""
    end = at
    while end and text[end - 1] in " \t])":
        end -= 1
    return text[slice(*_inner(text, *last))].strip() if last[1] == end > 0 else _name_before(text, at)


def flows(found: list[tuple[str, bool, Terms]], text: str) -> dict[tuple[int, int], int]:
    """Spans of literals, and the best score of a name that each reaches. Linear in the number of terms."""
    first: dict[str, int] = {}
    for i, (name, _, _) in enumerate(found):
        first.setdefault(name, i)
    now: dict[str, int] = {}
    sources: list[list[int]] = []
    literals: list[list[tuple[int, int]]] = []
    for i, (name, adds, terms) in enumerate(found):
        to, own = [], []
        for kind, a, b in terms:
            used = now.get(text[a:b], first.get(text[a:b])) if kind == "name" else None
            # A bare word that names nothing here is a value, as configuration files have them.
            if used is None:
                own.append((a, b))
            else:
                to.append(used)
        if adds and name in now:
            to.append(now[name])
        sources.append(to)
        literals.append(own)
        now[name] = i
    out: dict[tuple[int, int], int] = {}
    seen = bytearray(len(found))
    scores = [name_score(name) for name, _, _ in found]
    for score in range(max(scores, default=0), -1, -1):
        todo = [i for i, s in enumerate(scores) if s == score]
        while todo:
            i = todo.pop()
            if not seen[i]:
                seen[i] = 1
                todo += sources[i]
                for span in literals[i]:
                    out[span] = max(out.get(span, 0), score)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those of literals that flow to sensitive names."""
    if "=" not in text and ":" not in text:
        return base
    starts = [a for a, _, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))  # the furthest end of the spans up to each
    more: set[tuple[int, int, int]] = set()
    for found in pairs(text):
        for (a, b), score in flows(found, text).items():
            k = bisect_right(starts, a)
            if score and score + literal_score(text[a:b]) >= LEAST_SCORE and not (k and ends[k - 1] >= b):
                more.add((a, 3, b))
    return sorted([*base, *more])


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with the mark in place of each span; overlapping spans get one mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """For each row its doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal and the redacted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py()
                base = base_spans(t)
                spans = all_spans(t, base)
                n = Counter(k for _, k, _ in spans)
                rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), n[3], redacted(t, spans, mark)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "redacted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), whole_text(text).alias("t")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long, redacted string")


def without_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """docs with the mark in place of each span of its texts, and, where docs has that column, the texts' new lengths; a null text stays null."""
    at, n_at = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redacted(t, all_spans(t, base_spans(t)), mark) for t in batch.column(at).to_pylist()]
        columns = [*batch.columns]
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if n_at is not None:
            columns[n_at] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column(n_at).to_pylist(), strict=True)], batch.schema.field(n_at).type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_rows(docs, change)


def op8_secret_scans(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("redacted")
