"""A second stage that judges the best candidates against the text, and how its verdict joins the first score."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import vectors
from treeline.operators import embed

FUSIONS = ("blend", "judge", "product")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fuse(score: Column, logit: Column, how: str = "blend") -> Column:
    """blend: the score times between a half and one; judge: the verdict alone; product: their product."""
    if how not in FUSIONS:
        raise ValueError(f"fusion must be one of {FUSIONS}, not {how}")
    s = sigmoid(logit)
    return {"blend": score * (0.5 + 0.5 * s), "judge": s, "product": score * s}[how]


def candidates(top_k: int, given: int | None = None, rerank: bool = True) -> int:
    """How many first-stage results a search needs; 0 counts as not given."""
    return (given or max(5 * top_k, 25)) if rerank else top_k


def hash_logits(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``logit`` from two hash vectors: 8 times their cosine less one half; all in the JVM."""
    return pairs.withColumn("logit", 8 * (vectors.dot(F.col(a), F.col(b)) - 0.5))


def model_logits(pairs: DataFrame, spec: str, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """``pairs`` (query_id, rank, query, text, ...) with a reranker's ``logit``, over Arrow batches; a worker loads the model once.

    Cut the candidates before this: Spark does not push a limit below it. Pairs of one query are scored together.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*pairs.schema.fields, T.StructField("logit", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    at = pairs.columns.index(query_col), pairs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = embed.get_reranker(spec)
        for b in batches:
            queries, texts = (b.column(i).to_pylist() for i in at)
            by: dict[str, list[int]] = {}
            for i, q in enumerate(queries):
                by.setdefault(q or "", []).append(i)
            out = [0.0] * b.num_rows
            for q, rows in by.items():
                for i, x in zip(rows, r.score(q, [texts[i] or "" for i in rows])):
                    out[i] = float(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], schema=arrow)

    return pairs.mapInArrow(run, schema)


def fused(judged: DataFrame, keys: list[str], how: str, top_k: int) -> DataFrame:
    """Judged candidates (keys, rank, score, logit) in their new order: rank, score and judge replaced, first_rank kept for ties.

    ``first`` keeps the order and scores of the first stage.
    """
    j = judged.withColumnRenamed("rank", "first_rank").withColumn("judge", sigmoid(F.col("logit")))
    if how != "first":
        j = j.withColumn("score", fuse(F.col("score"), F.col("logit"), how))
    w = Window.partitionBy(*keys).orderBy(*([] if how == "first" else [F.round("score", 9).desc()]), "first_rank")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
