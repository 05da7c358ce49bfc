"""Vectors in array columns: norms, products, quantisation and a deterministic bag-of-words embedding, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; an all-zero vector stays."""
    # The norm is bound by an outer lambda, else each element would compute it again.
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n))), F.lit(0))


def int8_scale(v: Column) -> Column:
    """A row's scale: its largest absolute value over 127, or 1 for an all-zero row."""
    m = F.array_max(F.transform(doubles(v), F.abs)) / 127.0
    return F.when(m == 0, 1.0).otherwise(m)


def quantize(v: Column, scale: Column) -> Column:
    """Signed bytes, rounded half to even."""
    return F.transform(doubles(v), lambda x: F.greatest(F.least(F.rint(x / scale), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)


def tokens(c: Column) -> Column:
    """Runs of small ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def md5_bucket(token: Column, dim: int) -> Column:
    """The token's 128-bit MD5 modulo ``dim``, by four 32-bit limbs; dim must be below 2^31."""
    h = F.md5(token)
    out = F.lit(0).cast("long")
    for i in range(4):
        limb = F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
        out = F.pmod(out * F.lit(2**32 % dim) + limb, F.lit(dim))
    return out


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, mean): the unit mean of each key's vectors; NULL vectors do not count, vectors of several lengths are an error.

    Each batch of rows is summed by key before anything is shuffled, and sums of sums are taken, so that no group is collected.
    """
    import numpy as np
    import pyarrow as pa

    source = rows.where(F.col(vector).isNotNull()).select(*keys, doubles(F.col(vector)).alias("_sum"))
    fields = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c in keys)

    def partial(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat, lengths = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False), np.diff(b.column(len(keys)).offsets.to_numpy())
            if lengths.min() != lengths.max():
                raise ValueError(f"vectors of several lengths, from {lengths.min()} to {lengths.max()}")
            each = pa.table({**{k: b.column(i) for i, k in enumerate(keys)}, "_row": pa.array(range(b.num_rows))}).group_by(keys).aggregate([("_row", "list")])
            lists = each.column("_row_list").combine_chunks()
            at = lists.offsets.to_numpy()
            sums = np.add.reduceat(flat.reshape(b.num_rows, -1)[lists.flatten().to_numpy()], at[:-1], axis=0)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(each.column(k).combine_chunks() for k in keys), arrays], names=[*keys, "_sum"])

    def total(t: pa.Table) -> pa.Table:
        sums = t.column("_sum").combine_chunks()
        lengths = np.diff(sums.offsets.to_numpy())
        if lengths.min() != lengths.max():
            raise ValueError(f"vectors of several lengths, from {lengths.min()} to {lengths.max()}")
        m = sums.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1).sum(axis=0)
        n = np.linalg.norm(m)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "mean": pa.array([m / (n or 1.0)], pa.list_(pa.float64()))})

    return source.mapInArrow(partial, f"{fields}, _sum array<double>").groupBy(*keys).applyInArrow(total, f"{fields}, mean array<double>")
