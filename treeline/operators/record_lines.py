"""Delimited records, one per line, with the reason why a line fails and where.

A recursive-descent grammar: record = field {sep field}; field = quoted | bare. At a broken quote the parser notes the
place and resumes at the next validated record start (an identifier, the separator, a language, the separator, a date).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "lang", "published", "ipc", "title", "abstract", "source", "tags")
REASONS = ("quoting", "columns", "value")
_CANON = re.compile(r"[A-H](?:\d{2}(?:[A-Z](?:\d{4}\d{6})?)?)?")
_PRINTED = re.compile(r"([A-H]\d{2}[A-Z])\s*(\d{1,4})/(\d{2,6})")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_BAD_CHAR = re.compile("[�\x00-\x08\x0b-\x1f\x7f]")
SCHEMA = (
    "line_id long, record_no int, recovered boolean, reason string, error_at int, error_column int, detail string, id string, lang string, "
    "published date, ipc array<string>, title string, abstract string, source string, tags array<string>"
)


def canonical_symbol(s: str) -> str | None:
    """The canonical form of a symbol, or None."""
    s = s.strip().upper()
    if _CANON.fullmatch(s):
        return s
    m = _PRINTED.fullmatch(s)
    return m and f"{m[1]}{int(m[2]):04d}{m[3].ljust(6, '0')}"


class Grammar:
    """The grammar for one separator."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        self.sep = sep
        self.quoted = re.compile(rf'"([^"]*(?:""[^"]*)*)"(?={s}|\Z)')
        self.bare = re.compile(rf'[^"{s}]*(?={s}|\Z)')
        self.anchor = re.compile(rf'(?:(?<=\n)|(?<={s}))"?rpi[0-9]+:[^"{s}\n]+"?{s}"?[a-z]{{2}}"?{s}"?[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"?{s}')

    def field(self, text: str, at: int) -> tuple[str | None, int]:
        """(value, end), or (None, place of the error)."""
        if text.startswith('"', at):
            if m := self.quoted.match(text, at):
                return m[1].replace('""', '"'), m.end()
            return None, at
        if m := self.bare.match(text, at):
            return m[0], m.end()
        return None, text.index('"', at)

    def record(self, text: str, at: int, end: int | None = None) -> tuple[list[str], int, int | None]:
        """(fields, end, place of the error or None)."""
        fields: list[str] = []
        while True:
            value, at = self.field(text, at)
            if value is None:
                return fields, at, at
            fields.append(value)
            if at >= len(text):
                return fields, at, None
            at += len(self.sep)

    def resume(self, text: str, after: int) -> Iterator[list[str]]:
        """Whole records that start at validated anchors behind a broken quote."""
        starts = [m.start() for m in self.anchor.finditer(text, after + 1)]
        for i, at in enumerate(starts):
            stop = starts[i + 1] - 1 if i + 1 < len(starts) else len(text)
            fields, _, bad = self.record(text[at:stop], 0)
            if bad is None:
                yield fields


@lru_cache(maxsize=64)
def grammar(sep: str) -> Grammar:
    return Grammar(sep)


def typed(fields: list[str]) -> tuple[dict | None, int, str]:
    """(record, column of the first invalid value, what is wrong with it)."""
    record: dict = dict(zip(COLUMNS, fields))
    try:
        if not _DATE.fullmatch(record["published"]):
            raise ValueError
        record["published"] = dt.date.fromisoformat(record["published"])
    except ValueError:
        return None, 2, "published is no date"
    ipc = [canonical_symbol(s) for s in record["ipc"].split("|")]
    if not all(ipc):
        return None, 3, "ipc holds an unknown symbol"
    tags = record["tags"].split("|") if record["tags"] else []
    if bool(record["abstract"].strip()) != ("abstract" in tags):
        return None, 5, "abstract and tags disagree"
    if _BAD_CHAR.search(record["abstract"]):
        return None, 5, "abstract holds a damaged character"
    return record | {"ipc": ipc, "tags": tags}, -1, ""


def parse_line(line: str | None, sep: str | None) -> list[dict]:
    """The outcome of one line: nothing for a blank one, a record, or an error followed by what was recovered behind it."""
    if line is None:
        return []
    line = line[:-1] if line.endswith("\r") else line
    if not line.strip():
        return []
    g = grammar(sep or ";")
    fields, end, bad = g.record(line, 0)
    if bad is not None:
        out = [{"record_no": 0, "recovered": False, "reason": "quoting", "error_at": bad, "error_column": len(fields), "detail": "a quote is out of place"}]
        for more in g.resume(line, bad):
            if len(more) == len(COLUMNS) and (found := typed(more)[0]):
                out.append(found | {"record_no": len(out), "recovered": True})
        return out
    if len(fields) != len(COLUMNS):
        return [{"record_no": 0, "recovered": False, "reason": "columns", "error_at": end, "error_column": len(fields), "detail": f"{len(fields)} columns"}]
    record, column, detail = typed(fields)
    if record is None:
        at = sum(map(len, fields[:column])) + column * len(g.sep)
        return [{"record_no": 0, "recovered": False, "reason": "value", "error_at": at, "error_column": column, "detail": detail}]
    return [record | {"record_no": 0, "recovered": False}]


_ARROW = pa.schema([
    ("line_id", pa.int64()), ("record_no", pa.int32()), ("recovered", pa.bool_()), ("reason", pa.string()), ("error_at", pa.int32()), ("error_column", pa.int32()), ("detail", pa.string()),
    ("id", pa.string()), ("lang", pa.string()), ("published", pa.date32()), ("ipc", pa.list_(pa.string())), ("title", pa.string()), ("abstract", pa.string()), ("source", pa.string()), ("tags", pa.list_(pa.string())),
])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for line_id, sep, line in zip(*(b.column(i).to_pylist() for i in range(3))):
            for row in parse_line(line, sep):
                row["line_id"] = line_id
                out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line's records and errors; ``lines`` has line_id, sep and line, other columns are not read.

    A good line gives one row without reason. A bad one gives a row with the first reason that applies of quoting, columns and
    value, its place (0-based character and column), and a row for each whole record found behind a broken quote. NULL and blank
    lines give nothing; a NULL separator counts as ";"; repeated lines are kept.
    """
    return lines.select("line_id", "sep", "line").mapInArrow(_parse, SCHEMA)


def bad_lines(lines: DataFrame) -> DataFrame:
    """line_id and reason of the lines that are not valid."""
    return parse_lines(lines).where(F.col("reason").isNotNull()).select("line_id", "reason")


def good_records(lines: DataFrame) -> DataFrame:
    """The typed records of the valid lines."""
    return parse_lines(lines).where("reason is null and not recovered").select("line_id", *COLUMNS)
