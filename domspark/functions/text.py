"""Strings as browsers and XPath see them, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ECMAScript, as a character class's content.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

_SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def filled(s: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(s, F.lit(""))


def js_trim(s: Column) -> Column:
    return F.btrim(s, F.lit(_SPACES))


def js_length(s: Column) -> Column:
    """In UTF-16 units."""
    return F.when(F.octet_length(s) == F.length(s), F.length(s)).otherwise((F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int"))


def first_line(s: Column) -> Column:
    return js_trim(F.substring_index(s, "\n", 1))


def xpath_normalize(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def xpath_literal(s: Column) -> Column:
    """The string as an XPath expression; null as the empty one."""
    single, double = F.lit("'"), F.lit('"')
    both = F.concat(F.lit("concat('"), F.replace(s, single, F.lit("',\"'\",'")), F.lit("')"))
    return F.when(s.isNull(), F.lit("''")).when(~F.contains(s, single), F.concat(single, s, single)).when(~F.contains(s, double), F.concat(double, s, double)).otherwise(both)


def css_escape(s: Column) -> Column:
    """An identifier as CSSOM serialises it."""
    as_hex = lambda c: F.concat(F.lit("\\"), F.lower(F.hex(F.ascii(c))), F.lit(" "))
    plain = F.regexp_replace(s, r"([\x20-\x2C\x2E\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E])", r"\\$1")
    # Control characters and leading digits, character by character; rare.
    chars = F.split(s, "(?!^)")

    def one(c: Column, i: Column) -> Column:
        digit = c.rlike("^[0-9]$") & ((i == 0) | ((i == 1) & (F.substring(s, 1, 1) == "-")))
        return (
            F.when(c == F.lit("\x00"), F.lit("�"))
            .when(c.rlike(r"^[\x01-\x1F\x7F]$") | digit, as_hex(c))
            .otherwise(F.regexp_replace(c, r"([\x20-\x2C\x2E\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E])", r"\\$1"))
        )

    slow = F.array_join(F.transform(chars, one), "")
    return F.when(s == "-", F.lit("\\-")).when(s.rlike(r"^-?[0-9]|[\x00-\x1F\x7F]"), slow).otherwise(plain)
