"""Long texts cut into chunks that an embedder takes whole: at paragraphs, sentences, and words where nothing else helps.

A paragraph is a row of units, and a chunk a range of it. How far a range can reach is found by search: over prefix sums for a
counter whose counts add up, such as that of words, else by doubling and halving steps over the joined text, so that a text is
counted a logarithmic number of times and not once for each unit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import textnorm

# What stands between paragraphs, and between sentences.
PARAGRAPH_BREAK = r"\n\s*\n"
SENTENCE_BREAK = r"(?<=[.!?;:])\s+(?=\S)"
Counter = Callable[[str], int]


def count_words(text: str) -> int:
    return len(text.split())


#: Counters whose count of parts joined by blanks is the sum of the parts' counts.
ADDITIVE: set[Counter] = {count_words}


class Row:
    """A row of texts, ranges of which are joined by blanks; the more texts, the more they count."""

    def __init__(self, texts: list[str], count: Counter):
        self.texts, self.count = texts, count
        self.sums = [0, *accumulate(map(count, texts))] if count in ADDITIVE else None

    def join(self, start: int, end: int) -> str:
        return " ".join(self.texts[start:end])

    def fits(self, start: int, end: int, limit: int) -> bool:
        return (self.sums[end] - self.sums[start] if self.sums else self.count(self.join(start, end))) <= limit

    def reach(self, start: int, limit: int) -> int:
        """The farthest end of a range from ``start`` within the limit, which is at least one text long."""
        n = len(self.texts)
        if self.sums:
            return max(start + 1, bisect_right(self.sums, self.sums[start] + limit, start + 1) - 1)
        step, end = 1, start + 1
        while end + step <= n and self.fits(start, end + step, limit):
            end, step = end + step, step * 2
        while step:
            if end + step <= n and self.fits(start, end + step, limit):
                end += step
            step //= 2
        return end

    def ranges(self, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
        """Ranges within the limit that cover the row. Each begins with up to ``overlap`` texts of the one before, as many as leave room for a new one."""
        start, end = 0, self.reach(0, limit)
        while True:
            yield start, end
            if end == len(self.texts):
                return
            start = next(s for s in range(max(end - overlap, start), end + 1) if s == end or self.fits(s, end + 1, limit))
            end = self.reach(start, limit)


def chunks(text: str | None, limit: int | None, count: Counter = count_words, overlap: int = 1) -> list[str]:
    """The chunks of a text: paragraphs are never merged; the last ``overlap`` units of a full chunk begin the next one.

    Units are sentences, and pieces of those above the limit, each of as many words as fit; a single word above it stays whole.
    ``limit`` None makes each paragraph one chunk. NULL, empty and blank texts have none.
    """
    paragraphs = [p.strip() for p in re.split(PARAGRAPH_BREAK, text or "") if p.strip()]
    if limit is None:
        return [" ".join(p.split()) for p in paragraphs]
    out = []
    for p in paragraphs:
        units = []
        for s in re.split(SENTENCE_BREAK, p):
            words = None if count(s) <= limit else Row(s.split(), count)
            units += [s] if words is None else [words.join(*r) for r in words.ranges(limit, 0)]
        row = Row(units, count)
        out += [row.join(*r) for r in row.ranges(limit, max(overlap, 0))]
    return out


def chunk(rows: DataFrame, id_col: str, text_col: str, limit: int | None, count: Counter = count_words, overlap: int = 1) -> DataFrame:
    """(id, chunk, n_chunks, text): a row for each chunk, from 0; texts without any have no row."""
    schema = pa.schema([(id_col, pa.int64()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = chunks(t, limit, count, overlap)
                out += [(i, n, len(c), x) for n, x in enumerate(c)]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], schema.types[j]) for j in range(4)], schema=schema)

    return rows.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, chunk int, n_chunks int, text string")


def paragraph_chunks(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chunk without a limit, in the JVM: one chunk a paragraph."""
    p = rows.select(id_col, F.transform(textnorm.paragraphs(F.col(text_col)), textnorm.squeeze).alias("p"))
    return p.select(id_col, F.size("p").alias("n_chunks"), F.posexplode("p").alias("chunk", "text")).select(id_col, "chunk", "n_chunks", "text")
