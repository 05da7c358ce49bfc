"""Running sums and running last values over ordered groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.session import cut


def scan(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with inclusive running sums and last non-NULL values per key, in the given order.

    Rows are range-partitioned by key and order, so that one key may fill many tasks: values inside a task, then over the
    tasks that hold a key, whose number is bounded by the partitions. NULL keys form a group; rows of equal order are taken in
    any order, so the order should be unique.
    """
    sums, lasts = sums or {}, lasts or {}
    d = df.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()})
    d = cut(d.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))
    own = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    totals = d.groupBy("_block", *keys).agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(F.struct(f"_l_{n}"), F.when(F.col(f"_l_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in lasts],
    )
    base = totals.select(
        F.col("_block").alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.sum(f"_t_{n}").over(before).alias(f"_base_{n}") for n in sums], *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_base_{n}") for n in lasts],
    )
    inside = d.withColumns({f"_i_{n}": F.sum(f"_s_{n}").over(own) for n in sums} | {f"_i_{n}": F.last(f"_l_{n}", ignorenulls=True).over(own) for n in lasts})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_block") == F.col("_b"))
    out = inside.join(base, on)
    done = {n: F.coalesce(f"_i_{n}", F.lit(0)) + F.coalesce(f"_base_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(F.col(f"_i_{n}"), F.col(f"_base_{n}")[f"_l_{n}"]) for n in lasts}
    return out.withColumns(done).select(*[c for c in df.columns if c not in done], *done)
