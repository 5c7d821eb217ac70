"""A tokenizer for HTML as it is found: start tags, end tags and text; comments and declarations are passed over."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose content is text up to their own end tag, and those of them in which character references count.
RAW_TEXT = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"))
WITH_REFERENCES = frozenset(("textarea", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW_TEXT}


def attributes(source: str) -> dict[str, str]:
    """Names (lowered) and values; of a repeated name the first value holds."""
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", characters), ("start", tag, attribute source) and ("end", tag, "") in order."""
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", "", html.unescape(source[at:])
            return
        if lt > at:
            yield "text", "", html.unescape(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
        elif tag := _TAG.match(source, lt) or _LOOSE_TAG.match(source, lt):
            name, at = tag[2].lower(), tag.end()
            if tag[1]:
                yield "end", name, ""
                continue
            yield "start", name, tag[3]
            if name in RAW_TEXT:
                close = _END_OF[name].search(source, at)
                body = source[at : close.start() if close else n]
                at = close.end() if close else n
                if body:
                    yield "text", "", html.unescape(body) if name in WITH_REFERENCES else body
                yield "end", name, ""
        elif re.match(r"</?[a-zA-Z]", source[lt : lt + 3]):
            return  # a tag that the end of the input cuts off
        else:
            yield "text", "", "<"
            at = lt + 1
