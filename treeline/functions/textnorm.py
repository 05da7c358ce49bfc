"""Text normalisation as Column expressions. White space is Unicode's, NULL gives NULL unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A white-space character as Unicode sees it, with the four separators that Java's class leaves out.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
_BREAK = rf"\n{WS}*\n"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def clean(c: Column) -> Column:
    """squeeze, with NULL as an empty text."""
    return squeeze(F.coalesce(c, F.lit("")))


def paragraphs(c: Column) -> Column:
    """The parts between blank lines that are not blank themselves."""
    return F.filter(F.split(c, _BREAK), lambda p: p.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"))


def collapse(c: Column) -> Column:
    """White space collapsed in each paragraph, with blank lines kept between them."""
    return F.array_join(F.transform(paragraphs(c), squeeze), "\n\n")


def is_shouting(c: Column, threshold: float = 0.6) -> Column:
    """Whether more than the share of the letters are capitals; a text without letters is not."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    return (letters > 0) & (F.length(F.regexp_replace(c, r"\P{Lu}", "")) / letters > threshold)


def calm(c: Column) -> Column:
    """A shouting text in small letters, any other as it is."""
    return F.when(is_shouting(c), F.lower(c)).otherwise(c)


def normalize_query(c: Column) -> Column:
    """What is embedded of a query: each paragraph collapsed, and calmed on its own."""
    return F.array_join(F.transform(F.transform(paragraphs(c), squeeze), calm), "\n\n")


# Fixed values of printed titles: the division that holds the text, elements that are no part of it (their opening and closing
# tags), the tag of an edition, and what stands before a section's title.
TEXT_DIVISION = '<div class="txt'
NO_TITLE = (("<span>", "</span>"), ('<a rel="versions"', "</a>"))
EDITION = r"\[\d{4}\.\d{2}\]"
SECTION = r"(?iu)^\s*SE[ÇC][ÃA]O\s+[A-H]\s*[—–-]\s*"


def _without(pieces: Column, opening: str, closing: str) -> Column:
    """Markup without the elements of one tag, which do not nest; an element that is never closed stays."""
    parts = F.split(pieces, _literal(opening))
    end = lambda p: F.instr(p, F.lit(closing))
    rest = lambda p: F.when(end(p) > 0, F.concat(F.lit(" "), F.substring(p, end(p) + len(closing), F.length(p)))).otherwise(F.concat(F.lit(opening), p))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), rest), ""))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def clean_title(html: Column, kind: Column) -> Column:
    """A printed title without version links, edition tags, cross references and markup; entities stay.

    Only what follows the first text division counts, where there is one outside of references; a section (kind "s") loses its
    printed prefix. The markup is taken apart from the outside in: elements that are no title, the division, what tags are left,
    and then the brackets that stand around nothing.
    """
    t = html
    for opening, closing in NO_TITLE:
        t = _without(t, opening, closing)
    inside = F.instr(t, F.lit(TEXT_DIVISION))
    rest = F.substring(t, inside + len(TEXT_DIVISION), F.length(t))
    # Behind the opening tag, whose class may have more than one name.
    t = F.when((inside > 0) & rest.rlike('^[^"]*">'), F.regexp_replace(rest, '^[^"]*">', "")).otherwise(t)
    text = F.array_join(F.split(t, "<[^>]+>"), " ")
    t = squeeze(F.regexp_replace(text, rf"\(\s*\)|{EDITION}", " "))
    t = F.when(kind == "s", F.regexp_replace(t, SECTION, "")).otherwise(t)
    return F.regexp_replace(t, r"^[ ;]+|[ ;]+$", "")


def alnum(c: Column) -> Column:
    """Only letters and digits, in small letters."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def strip_repeated_title(abstract: Column, title: Column) -> Column:
    """The abstract without the title that it begins with, compared by letters and digits alone."""
    key = alnum(title)
    repeats = (F.length(key) > 0) & F.startswith(alnum(abstract), key)
    # In hundreds of hundreds, each atomic: one count of them all would recurse once a letter and overflow the stack on a long title.
    one = r"(?:[^\p{L}\p{N}]*+[\p{L}\p{N}])"
    hundred = f"(?>{one}{{100}})"
    n, times = F.length(key), lambda what, k: F.concat(F.lit(what + "{"), k.cast("int").cast("string"), F.lit("}"))
    pattern = F.concat(F.lit("^"), times(f"(?>{hundred}{{100}})", F.floor(n / 10_000)), times(hundred, F.floor(n % 10_000 / 100)), times(one, n % 100))
    return F.when(repeats, F.regexp_replace(F.regexp_replace(abstract, pattern, F.lit("")), r"^[ .:;,\-]+", "")).otherwise(abstract)


def sentences(c: Column) -> Column:
    """Cut behind . ! ? ; : and the white space after it."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?;:]){WS}+(?=\S)"), squeeze), lambda s: s != "")


def text_hash(c: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def model_slug(c: Column) -> Column:
    """A model's name for file names: runs of other characters as one dash, in small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9.]+", "-"), r"^-+|-+$", ""))
