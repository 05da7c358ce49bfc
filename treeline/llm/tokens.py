"""Encoding of whole texts with a public tokenizer, token places in the text, and decoding.

The tokenizers library gives the ids, for every vocabulary that it reads. Where the vocabulary splits a text by its byte-level
step alone, merges never cross words, so that each different word is encoded once per worker, in batches, and the ids are those
of the whole text; any other vocabulary gets whole texts. A byte-level token stands for bytes, written with one printable
character for each; places are computed from the bytes, so that a token may begin or end inside a character.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; queries may name another folder.
FOLDER = os.environ.get("TREELINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: how the library's byte-level step splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SLICE = 4_000_000


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The printable character of each byte: bytes that print stand for themselves, the others follow from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A tokenizer with the ids of the words that it has seen, where its words can be told apart without it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not path.endswith(".json"):
            raise ValueError(f"not a vocabulary of the tokenizers library (.json): {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        ordinary = [t for t in spec.get("added_tokens") or [] if not t["special"]]
        #: Whether ids of words make up the ids of a text.
        self.by_word = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step["add_prefix_space"] and not spec.get("normalizer") and not ordinary
        #: What ends a word in the vocabulary, written as a blank when decoding.
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.split = regex.compile(WORDS).findall
        self.seen: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for an empty or NULL one."""
        batch = lambda t: [e.ids for e in self.tokenizer.encode_batch_fast(t, add_special_tokens=False)]
        if not self.by_word:
            return batch([t or "" for t in texts])
        if len(self.seen) > 400_000:
            self.seen.clear()
        seen, out, long = self.seen, [], {}
        for text in texts:
            words = self.split(text) if text else []
            try:
                out.append([i for w in words for i in seen[w]])
                continue
            except KeyError:
                new = [w for w in dict.fromkeys(words) if w not in seen]
            for w, ids in zip(new, batch(new)):
                (seen if len(w) < 48 else long)[w] = ids
            out.append([i for w in words for i in (seen[w] if w in seen else long[w])])
            long.clear()
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    @lru_cache(maxsize=1)
    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        table = byte_table()
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            ends = bool(self.end) and token.endswith(self.end)
            token = token[: -len(self.end)] if ends else token
            out[i] = (bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()) + b" " * ends
        return out

    def places(self, text: str | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters; a token of a part of a character has that whole character."""
        if not ids:
            return np.array([], np.int32), np.array([], np.int32)
        if not self.by_word:
            # The text may have been changed before it was split, which only the library can follow.
            at = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int32)
            return at[:, 0], at[:, 1]
        pieces = self.pieces()
        ends = np.cumsum([len(pieces[i]) for i in ids])
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[starts].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no whole character become U+FFFD. A vocabulary with word ends gives its words with a blank behind each."""
        pieces = self.pieces()
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")

    def decode_parts(self, parts: list[list[int]]) -> list[str]:
        """The texts of consecutive pieces of one text; a character that is split between two goes to the one that completes it."""
        import codecs

        pieces, reader = self.pieces(), codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(b"".join([pieces[i] for i in p]), n == len(parts) - 1) for n, p in enumerate(parts)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a few megabytes of text each, so that what a batch gives stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _ids(lists: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.fromiter((i for x in lists for i in x), np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) of every row, without special tokens; NULL and empty texts have an empty list. Other columns are not read."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _ids(e.encode_all(texts[i:j]))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, ids array<int>")


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, starts, ends): the place of each token in its text, in characters; empty for NULL and empty texts."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                both = [e.places(t, ids) for t, ids in zip(texts[i:j], e.encode_all(texts[i:j]))]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s, _ in both])]).astype(np.int32))
                cols = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in both]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], names=[id_col, "starts", "ends"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, starts array<int>, ends array<int>")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n): the number of tokens of each row; 0 for NULL and empty texts."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [len(ids) for i, j in slices(texts) for ids in e.encode_all(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, n long")


def decode(ids: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, text) from (id, ids); an empty or NULL list gives an empty text."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return ids.select(F.col(id_col).cast("long"), "ids").mapInArrow(run, f"{id_col} long, text string")
