"""Classification of streams: a stateless map of texts against a static index, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from treeline.operators import classify as c


def start(texts: DataFrame, index: c.Index, model: str, sink: Callable[[DataFrame, int], None], options: c.Options | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Classifies each micro-batch of a stream (query_id, text) and hands the results to ``sink`` with the batch's number.

    A batch that is delivered again has the same number and results, so that a sink that replaces by number is exactly-once.
    """

    def run(batch: DataFrame, n: int) -> None:
        sink(c.classify(batch, index, model, options or c.Options()), n)

    w = texts.writeStream.foreachBatch(run)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
