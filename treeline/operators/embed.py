"""Embedders and rerankers by name, and the deterministic ones as plans."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import vectors


class Embedder(Protocol):
    """What a model needs: unit vectors of passages and queries, and how it counts tokens."""

    name: str
    dim: int
    max_tokens: int | None

    def embed_passages(self, texts: list[str]) -> list[list[float]]: ...
    def embed_queries(self, texts: list[str]) -> list[list[float]]: ...
    def count_tokens(self, text: str) -> int: ...


class Reranker(Protocol):
    """Raw logits of a query's candidate texts."""

    name: str

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Counts of words at their hash modulo the dimension, as unit vectors; the plan hash_embed gives the same."""

    max_tokens: int | None = None

    def __init__(self, dim: int = 64, max_tokens: int | None = None):
        self.dim, self.name, self.max_tokens = dim, f"hash:{dim}", max_tokens

    def _one(self, text: str) -> list[float]:
        import hashlib

        v = [0.0] * self.dim
        for t in re.findall("[a-z0-9]+", text.lower()):
            v[int(hashlib.md5(t.encode()).hexdigest(), 16) % self.dim] += 1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    def embed_passages(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    embed_queries = embed_passages

    def count_tokens(self, text: str) -> int:
        return len(re.findall("[a-z0-9]+", text.lower()))


class HashReranker:
    """Eight times the cosine of the hash vectors, less one half."""

    def __init__(self, dim: int = 64):
        self.embedder, self.name = HashEmbedder(dim), f"hash:{dim}"
        # Candidates come back for many queries.
        self.vector = lru_cache(maxsize=20_000)(lambda t: np.array(self.embedder._one(t)))

    def score(self, query: str, texts: list[str]) -> list[float]:
        return (8 * (np.array([self.vector(t) for t in texts]).reshape(len(texts), -1) @ self.vector(query) - 0.5)).tolist() if texts else []


def prefixes(model: str) -> tuple[str, str]:
    """What a model wants before queries and passages. The strings are fixed values of the public models."""
    m = model.lower()
    if "e5" in m:
        return "query: ", "passage: "
    if re.search(r"bge-.*-en", m):
        return "Represent this sentence for searching relevant passages: ", ""
    return "", ""


class SentenceTransformerEmbedder:
    """A sentence-transformers model; the library is imported when it is first used."""

    def __init__(self, model: str, batch: int = 64):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("the backend st needs the package sentence-transformers") from e
        self.model, self.batch = SentenceTransformer(model), batch
        self.query_prefix, self.passage_prefix = prefixes(model)
        size = getattr(self.model, "get_embedding_dimension", None) or self.model.get_sentence_embedding_dimension
        self.name, self.dim, self.max_tokens = f"st:{model}", size(), self.model.max_seq_length

    def _embed(self, texts: list[str]) -> list[list[float]]:
        return self.model.encode(texts, batch_size=self.batch, normalize_embeddings=True).tolist()

    def embed_passages(self, texts: list[str]) -> list[list[float]]:
        return self._embed([self.passage_prefix + t for t in texts])

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return self._embed([self.query_prefix + t for t in texts])

    def count_tokens(self, text: str) -> int:
        return len(self.model.tokenizer(self.query_prefix + text, truncation=False)["input_ids"])


class HttpEmbedder:
    """A model behind a local embedding server, 32 texts a request."""

    max_tokens: int | None = None

    def __init__(self, model: str, url: str = "http://localhost:11434", batch: int = 32):
        self.model, self.url, self.batch, self.name = model, url.rstrip("/"), batch, f"ollama:{model}"
        self.dim = len(self.embed_passages(["dimension"])[0])

    def embed_passages(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            body = json.dumps({"model": self.model, "input": texts[i : i + self.batch]}).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"}), timeout=300) as r:
                for v in json.load(r)["embeddings"]:
                    n = math.sqrt(sum(x * x for x in v)) or 1.0
                    out.append([x / n for x in v])
        return out

    embed_queries = embed_passages

    def count_tokens(self, text: str) -> int:
        return len(text.split())


class CrossEncoderReranker:
    """A cross-encoder's raw logits; the library is imported when it is first used."""

    def __init__(self, model: str, max_length: int = 768, batch: int = 32):
        try:
            import torch
            from sentence_transformers import CrossEncoder
        except ImportError as e:
            raise RuntimeError("the backend ce needs the package sentence-transformers") from e
        self.torch, self.batch, self.name = torch, batch, f"ce:{model}"
        device = "cuda" if torch.cuda.is_available() else "mps" if torch.backends.mps.is_available() else "cpu"
        self.model = CrossEncoder(model, max_length=max_length, device=device)
        if device != "cpu":
            self.model.model.half()

    def score(self, query: str, texts: list[str]) -> list[float]:
        pairs, raw = [(query, t) for t in texts], self.torch.nn.Identity()
        try:
            out = self.model.predict(pairs, batch_size=self.batch, activation_fn=raw)
        except TypeError:
            # Older versions of the library have another name for it.
            out = self.model.predict(pairs, batch_size=self.batch, activation_fct=raw)
        return [float(x) for x in out]


EMBEDDERS: dict[str, Callable[[str], Embedder]] = {"hash": lambda m: HashEmbedder(int(m or 64)), "st": SentenceTransformerEmbedder, "ollama": HttpEmbedder}
RERANKERS: dict[str, Callable[[str], Reranker]] = {"hash": lambda m: HashReranker(int(m or 64)), "ce": CrossEncoderReranker}


def _get(spec, table: dict, what: str):
    if not isinstance(spec, str):
        return spec
    backend, _, model = spec.partition(":")
    if backend not in table:
        raise ValueError(f"unknown {what} backend: {backend}; there are {sorted(table)}")
    if not model and backend != "hash":
        raise ValueError(f"{what} {backend} needs a model: {backend}:MODEL")
    return table[backend](model)


def get_embedder(spec: str | Embedder) -> Embedder:
    """``backend:model``; an embedder passes through."""
    return _get(spec, EMBEDDERS, "embedder")


def get_reranker(spec: str | Reranker) -> Reranker:
    """``backend:model``; a reranker passes through."""
    return _get(spec, RERANKERS, "reranker")


def hash_counts(rows: DataFrame, keys: list[str], text: str, dim: int = 64) -> DataFrame:
    """(keys, bucket, n): how many words of a text fall into each bucket. Texts without words have no row."""
    each = rows.select(*keys, F.explode(vectors.tokens(F.col(text))).alias("token"))
    return each.groupBy(*keys, vectors.md5_bucket(F.col("token"), dim).alias("bucket")).agg(F.count("*").alias("n"))


def hash_embed(rows: DataFrame, keys: list[str], text: str, dim: int = 64) -> DataFrame:
    """(keys, vector): unit hash vectors, built in the JVM; all zero for NULL texts and those without words.

    One counter a dimension, combined before the shuffle; texts with equal keys are counted as one text.
    """
    # Buckets are exploded, not words, so that a bucket is computed once and not for each counter.
    each = rows.select(*keys, F.explode_outer(F.transform(vectors.tokens(F.col(text)), lambda t: vectors.md5_bucket(t, dim))).alias("b"))
    counted = each.groupBy(*keys).agg(*[F.count_if(F.col("b") == i).alias(f"n{i}") for i in range(dim)])
    return counted.select(*keys, vectors.normalize(F.array(*[F.col(f"n{i}") for i in range(dim)])).alias("vector"))


def model_embed(rows: DataFrame, keys: list[str], text: str, spec: str, queries: bool = True, batch: int = 64) -> DataFrame:
    """(keys, vector) by any embedder, over Arrow batches; a worker loads the model once. NULL counts as an empty text."""
    fields = [rows.schema[k] for k in keys]
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = get_embedder(spec)
        embed = e.embed_queries if queries else e.embed_passages
        for b in batches:
            texts = [t or "" for t in b.column(len(keys)).to_pylist()]
            out = [v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], schema=arrow)

    return rows.select(*keys, text).mapInArrow(run, schema)
