"""One consistent form for texts that look the same.

Look-alike letters, widths, typefaces, joined letters and blanks are mapped inside the JVM; what remains (combining marks
against composed letters, characters without a glyph) is left to the UNICODE collation, which tells case and accents apart.
Values are grouped under it in SQL, each class gets a canonical member, and the member is joined back.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.session import cut

# Letters of other scripts that are drawn like a Latin letter, by that letter.
ALIKE = {
    "A": "АΑᎪ", "B": "ВΒ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅᏚՏ", "T": "ТΤᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "Ë": "Ё", "ë": "ё", "Ï": "Ї", "ï": "ї", "ó": "ό", "Ó": "Ό", "-": "‐‑", "’": "ʼ", "μ": "µ",
}
# Compatibility forms that are no visible difference; superscripts, subscripts, fractions and circled signs are.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def _build() -> tuple[str, str, list[tuple[str, str]]]:
    """(characters, their replacements, joined letters and their parts), by rule from the Unicode data and from ALIKE."""
    one = {alike: to for to, many in ALIKE.items() for alike in many}
    joined = []
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x1F200), *range(0x1FBF0, 0x1FBFA)]:
        c = chr(code)
        if c in one:
            continue
        if unicodedata.category(c) == "Zs":
            one[c] = " "
            continue
        kind, *_ = unicodedata.decomposition(c).split(" ") if unicodedata.decomposition(c) else [""]
        to = unicodedata.normalize("NFKC", c)
        if kind in _SAME_LOOK and len(to) == 1 and to != c:
            one[c] = one.get(to, to)
        elif kind == "<compat>" and 0xFB00 <= code <= 0xFB06:
            joined.append((c, to))
    one["\t"] = " "
    return "".join(one), "".join(one.values()), joined


_FROM, _TO, _JOINED = _build()
# Controls that are blanks or end lines; the collation ignores the others.
_BLANK = "\t\n\x0b\x0c\r\x85"


def _coarse() -> tuple[str, str]:
    """(characters, what they become), by rule: composed letters their bases, then, with nothing left of them, marks, characters without a glyph and Hangul."""
    base, gone = {}, []
    for code in [*range(0x20), *range(0x7F, 0xD800), *range(0xE000, 0x1F000), *range(0xE0000, 0xE01F0)]:
        c = chr(code)
        first = unicodedata.normalize("NFD", c)[0]
        if unicodedata.category(c) in ("Mn", "Me", "Mc", "Cf", "Cc") or unicodedata.category(c) == "Cn" and (code < 0x10000 or code >= 0xE0000) or 0x1100 <= code < 0x1200 or 0xAC00 <= code < 0xD7B0:
            gone.append(c)
        elif first != c:
            base[c] = first
    return "".join(base) + "".join(gone), "".join(base.values())


_FINE, _ROUGH = _coarse()
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def rough(c: Column) -> Column:
    """A number that texts of one look share, and few others do: sorting by it first spares most comparisons under the collation."""
    return F.xxhash64(F.translate(c, _FINE, _ROUGH))


def mapped(c: Column) -> Column:
    """The text with every look-alike replaced; NULL for NULL."""
    c = F.translate(c, _FROM, _TO)
    for joined, parts in _JOINED:
        c = F.replace(c, F.lit(joined), F.lit(parts))
    return c


def classes(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, text), with the hash of the canonical member of each row's class as ``class`` and that of its text as ``h``.

    A class holds the rows of a key whose texts look the same. Its member is the least of those that the mapping leaves as
    they are, else the least. The aggregation combines before it shuffles, and the join back is on a unique side, so that one
    hot key or class only makes its partitions larger, which adaptive execution splits.
    """
    spark = rows.sparkSession
    m = rows.where("text is not null").select("key", "id", "text", mapped(F.col("text")).alias("plain"))
    return spark.sql(
        """WITH m AS (SELECT key, id, text, xxhash64(text) h, text <> plain changed, collate(plain, 'UNICODE') look FROM {m}),
        c AS (SELECT key, look, min(struct(changed, text)).text member FROM m GROUP BY key, look)
        SELECT m.key, m.id, m.h, xxhash64(c.member) class, c.member FROM m JOIN c ON m.key <=> c.key AND m.look = c.look""",
        m=m,
    )


def repeated(rows: DataFrame) -> DataFrame:
    """The rows of those keys under which there are different texts; only hashes are shuffled to find the keys."""
    h = F.xxhash64("text")
    keys = rows.where("text is not null and key is not null").groupBy("key").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("key")
    return rows.join(keys, "key", "left_semi")


def same_look_pairs(rows: DataFrame) -> DataFrame:
    """(key_a, key_b): ids, key_a < key_b, of rows of one key whose texts look the same but are not the same string.

    ``rows`` has key, id, text. Rows without key or text are in no pair; an empty text looks like one of characters without a glyph.
    """
    # Only hashes and ids are kept, so that the texts are read and compared once.
    m = cut(classes(repeated(rows)).select("key", "class", "id", "h"))
    many = m.groupBy("key", "class").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key", "class")
    m = m.join(many, ["key", "class"], "left_semi")
    a = m.select("key", "class", F.col("id").alias("key_a"), F.col("h").alias("ha"))
    b = m.select("key", "class", F.col("id").alias("key_b"), F.col("h").alias("hb"))
    return a.join(b, ["key", "class"]).where("key_a < key_b and ha <> hb").select("key_a", "key_b")


def class_sizes(rows: DataFrame) -> DataFrame:
    """(key, class, rows, texts, member) of the classes of one key that hold different texts: how many rows and texts, and the canonical member.

    One row a class, however many rows look alike, where ``same_look_pairs`` has one for each two of them.
    """
    c = classes(repeated(rows)).select("key", "class", "h", "member")
    per = c.groupBy("key", "class", "h").agg(F.count("*").alias("n"), F.first("member").alias("member"))
    return per.groupBy("key", "class").agg(F.sum("n").alias("rows"), F.count("*").alias("texts"), F.first("member").alias("member")).where("texts > 1")


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    # What has no glyph goes, and marks join their letters.
    return s.map(lambda t: t if t is None or t.isascii() and not _CONTROL.search(t) else unicodedata.normalize("NFC", "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc") and not 0xFE00 <= ord(c) <= 0xFE0F and c != "͏" or c in _BLANK)))


def consistent(rows: DataFrame) -> DataFrame:
    """(id, text, member): each row's text in the one consistent form of its class, over all rows; NULL texts stay NULL.

    ``member`` is the canonical member, as it stands, and ``text`` the same with look-alikes mapped and marks composed.
    """
    m = rows.where("text is not null").select("id", "text", mapped(F.col("text")).alias("plain")).withColumn("rough", rough(F.col("plain")))
    out = rows.sparkSession.sql(
        """WITH m AS (SELECT id, rough, text <> plain changed, text, plain, collate(plain, 'UNICODE') look FROM {m}),
        c AS (SELECT rough, look, min(struct(changed, text, plain)) best FROM m GROUP BY rough, look)
        SELECT m.id, c.best.plain plain, c.best.text member FROM m JOIN c ON m.rough = c.rough AND m.look = c.look""",
        m=m,
    ).select("id", _compose("plain").alias("text"), "member")
    return out.unionByName(rows.where("text is null").select("id", "text", F.col("text").alias("member")))
