"""Classification symbols as Column expressions: canonical and printed form, level, truncation."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five levels, in order, and the kind codes of scheme entries.
LEVELS = ("section", "class", "subclass", "group", "subgroup")
KIND_LEVEL = {"s": "section", "c": "class", "u": "subclass", "m": "group"}
# The two accepted forms of a symbol. A digit is any Unicode decimal digit.
CANONICAL = r"^[A-H](\p{Nd}{2}([A-Z](\p{Nd}{4}\p{Nd}{6})?)?)?$"
PRINTED = r"^([A-H]\p{Nd}{2}[A-Z])[\s\x1c-\x1f\x85\p{Z}]*(\p{Nd}{1,4})/(\p{Nd}{2,6})$"
IN_TEXT = r"[A-H]\d{2}[A-Z]\s?\d{1,4}/\d{2,6}"
# What Unicode-aware stripping removes.
EDGE = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"

_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd" and c < 0x10000]
_DIGIT_FROM = "".join(_DIGITS)
_DIGIT_TO = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, EDGE, "")


def try_normalize(c: Column) -> Column:
    """The canonical form, or NULL where the symbol is in no accepted form (NULL in, NULL out)."""
    s = F.upper(strip(c))
    group = F.translate(F.regexp_extract(s, PRINTED, 2), _DIGIT_FROM, _DIGIT_TO)
    printed = F.concat(F.regexp_extract(s, PRINTED, 1), F.lpad(group, 4, "0"), F.rpad(F.regexp_extract(s, PRINTED, 3), 6, "0"))
    return F.when(s.rlike(CANONICAL), s).when(s.rlike(PRINTED), printed)


def normalize(c: Column) -> Column:
    """Like try_normalize, but a symbol in no accepted form stops the query."""
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(try_normalize(c), F.raise_error(F.concat(F.lit("not a symbol: "), c)).cast("string"))
    )


def pretty(c: Column) -> Column:
    """The printed form of a canonical 14-character symbol; anything else as it is."""
    tail = F.regexp_replace(F.substring(c, 9, 6), "0+$", "")
    return F.when(
        F.length(c) == 14,
        F.concat(F.substring(c, 1, 4), F.lit(" "), F.substring(c, 5, 4).cast("int").cast("string"), F.lit("/"), F.when(F.length(tail) < 2, F.rpad(tail, 2, "0")).otherwise(tail)),
    ).otherwise(c)


def level(c: Column) -> Column:
    """The level by length alone; NULL for other lengths."""
    return (
        F.when(F.length(c) == 1, "section")
        .when(F.length(c) == 3, "class")
        .when(F.length(c) == 4, "subclass")
        .when((F.length(c) == 14) & (F.substring(c, 9, 6) == "000000"), "group")
        .when(F.length(c) == 14, "subgroup")
    )


def label(c: Column) -> Column:
    """What a symbol adds to its parent's: the section, the class's digits, the subclass's letter, the group's number, "/" and the rest."""
    p = pretty(c)
    return (
        F.when(F.length(c) == 3, F.substring(c, 2, 2))
        .when(F.length(c) == 4, F.substring(c, 4, 1))
        .when(level(c) == "group", F.substring(c, 5, 4).cast("int").cast("string"))
        .when(level(c) == "subgroup", F.concat(F.lit("/"), F.substring_index(p, "/", -1)))
        .otherwise(c)
    )


def level_of_kind(c: Column) -> Column:
    """The level of an entry's kind code; digits are subgroups, other codes have none."""
    out = F.when(c.rlike(r"^\p{Nd}+$"), "subgroup")
    for kind, name in KIND_LEVEL.items():
        out = out.when(c == kind, name)
    return out


def truncate(c: Column, to: str) -> Column:
    """The ancestor of a symbol at one of the levels."""
    if to not in LEVELS:
        raise ValueError(f"unknown level: {to}")
    if to == "subgroup":
        return c
    if to == "group":
        return F.when(F.length(c) == 14, F.concat(F.substring(c, 1, 8), F.lit("000000"))).otherwise(c)
    return F.substring(c, 1, {"section": 1, "class": 3, "subclass": 4}[to])


def extract(c: Column) -> Column:
    """All printed symbols inside a text, as printed."""
    return F.regexp_extract_all(c, F.lit(IN_TEXT), 0)
