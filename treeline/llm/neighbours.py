"""The most similar vectors of every vector, by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; its bucket in a table is the nearest signed
axis. A vector goes to the buckets of its two nearest axes (multiprobe), vectors that share a bucket are reranked exactly, and
the best of all tables are kept. A bucket of more than ``CAP`` vectors is split by the axes of a further rotation, until none
is or ``LEVELS`` are used up; what is then still larger (vectors that hardly differ) is compared whole, in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.session import cut

TABLES, PROBES, LEVELS = 3, 2, 3
CAP = 4096
#: The most full buckets, two numbers each, that are broadcast to be told from others; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.float32(np.sqrt(d))


class Hasher:
    """The rotations of all tables and levels, from a fixed seed."""

    def __init__(self, dim: int):
        self.dim = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(20).choice(np.float32([-1, 1]), (TABLES, LEVELS, 3, self.dim))

    def axes(self, unit: np.ndarray, table: int, level: int) -> np.ndarray:
        """(n, PROBES) numbers of the nearest signed axes, the nearest first."""
        x = np.zeros((len(unit), self.dim), np.float32)
        x[:, : unit.shape[1]] = unit
        for s in self.signs[table, level]:
            x = hadamard(x * s)
        a = np.abs(x)
        best = np.argpartition(-a, PROBES, axis=1)[:, :PROBES]
        order = np.argsort(-np.take_along_axis(a, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        return best * 2 + (np.take_along_axis(x, best, 1) < 0)

    def first(self, unit: np.ndarray) -> np.ndarray:
        """(n, TABLES * PROBES) buckets of the first level; the table is part of the number."""
        return np.concatenate([(t + 1) * 2 * self.dim + self.axes(unit, t, 0) for t in range(TABLES)], axis=1)

    def split(self, unit: np.ndarray, key: np.ndarray, level: int) -> np.ndarray:
        """(n, PROBES) buckets of a level (from 1) inside the buckets that the vectors are in."""
        out = np.empty((len(unit), PROBES), np.int64)
        table = key // (2 * self.dim) ** level
        for t in np.unique(table):
            here = table == t
            out[here] = key[here, None] * (2 * self.dim) + self.axes(unit[here], int(t) - 1, level)
        return out


@lru_cache(maxsize=4)
def hasher(dim: int) -> Hasher:
    return Hasher(dim)


def pack(unit: np.ndarray) -> list[bytes]:
    """Unit vectors as 16-bit numbers and a scale, half the size of floats; similarities change by about 1e-5."""
    scale = np.abs(unit).max(axis=1, keepdims=True).astype(np.float32) / np.float32(32767)
    q = np.rint(unit / scale).astype("<i2")
    return [a.tobytes() + b.tobytes() for a, b in zip(q, scale.astype("<f4"))]


def unpack(packed: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    q = np.ascontiguousarray(raw[:, :-4]).view("<i2").astype(np.float32)
    return q * np.ascontiguousarray(raw[:, -4:]).view("<f4")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        ids = b.column(0).to_numpy()
        # Vectors of one length at a time; that there is only one length is checked over all rows.
        for dim in np.unique(lengths):
            here = np.flatnonzero(lengths == dim)
            v = lists.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            norm = np.linalg.norm(v.astype(np.float64), axis=1)
            fine = np.isfinite(norm) & (norm > 0)
            v = (v[fine] / norm[fine, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[here][fine], pa.int64()), pa.array(pack(v), pa.binary())], names=["vec_id", "q"])


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, q): packed unit vectors; NULL, empty, all-zero and non-finite vectors and NULL ids are left out."""
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    return kept.mapInArrow(_units, "vec_id long, q binary")


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q = b.column(2)
        sizes = np.diff(np.array([0, *np.cumsum([len(x) for x in q.to_pylist()])]))
        keys = np.zeros((len(q), TABLES * PROBES), np.int64)
        for n in np.unique(sizes):
            here = np.flatnonzero(sizes == n)
            keys[here] = hasher((int(n) - 4) // 2).first(unpack(q.take(pa.array(here)).to_pylist()))
        offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * keys.shape[1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), q, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["rep", "first", "q", "keys"])


def hashed(groups: DataFrame) -> DataFrame:
    """(rep, first, q) with ``keys``, the buckets of the first level."""
    return groups.select("rep", "first", "q").mapInArrow(_first_keys, "rep long, first array<long>, q binary, keys array<long>")


def _known(small: DataFrame) -> DataFrame:
    """A table of few rows, computed once; broadcast if it is checked to be small."""
    small = cut(small)
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def buckets(groups: DataFrame, dim: int, cap: int) -> DataFrame:
    """(key, rep, q): each group in its buckets, of which none but pairs of blocks hold more than ``cap`` groups.

    Only vectors of full buckets are hashed again, level by level; the full ones are joined, never held by the driver.
    """
    base = 2 * hasher(dim).dim
    s = groups.select(F.explode("keys").alias("key"), "rep", "q")
    new = s
    for level in range(1, LEVELS + 1):
        full = new.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cap)
        if level == LEVELS:
            break
        full = _known(full.select("key", F.lit(True).alias("full")))
        if full.isEmpty():
            return s

        def run(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = hasher(dim).split(unpack(b.column(2).to_pylist()), b.column(0).to_numpy(), level) if b.num_rows else np.zeros((0, PROBES), np.int64)
                at = pa.array(np.repeat(np.arange(b.num_rows), PROBES))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel(), pa.int64()), b.column(1).take(at), b.column(2).take(at)], names=["key", "rep", "q"])

        known = s.join(full, "key", "left")
        new = known.where("full").select("key", "rep", "q").mapInArrow(run, "key long, rep long, q binary")
        s = known.where("full is null").select("key", "rep", "q").unionAll(new)
    # Buckets of the last level that are still too large meet in pairs of blocks.
    large = _known(full.where(F.col("key") >= base**LEVELS).select("key", F.ceil(F.col("n") / cap).cast("int").alias("blocks")))
    s = s.join(large, "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("rep"), "blocks")).cast("int"))
    s = s.select("key", "rep", "q", "own", F.explode(F.when(F.col("own").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other"))
    return s.select(F.xxhash64("key", F.least("own", "other"), F.greatest(F.coalesce("own", F.lit(-1)), "other")).alias("key"), "rep", "q")


def _best(ids: np.ndarray, v: np.ndarray, others: np.ndarray, w: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id its k best others of at least the similarity: exact, by blocks; ties go to the smaller id."""
    out = []
    for at in range(0, len(v), 1024):
        s = v[at : at + 1024] @ w.T
        hit = np.flatnonzero(s.ravel() >= least)
        if not len(hit):
            continue
        i, j = np.divmod(hit, len(w))
        sim = s.ravel()[hit]
        a, b = ids[at + i], others[j]
        i, a, b, sim = (x[a != b] for x in (i, a, b, sim))
        order = np.lexsort((b, -sim, i))
        i, a, b, sim = (x[order] for x in (i, a, b, sim))
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        out.append((a[top], b[top], sim[top]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.array([], np.int64), np.array([], np.int64), np.array([], np.float32))


def _rerank(k: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table.column("rep").to_numpy(), return_index=True)
        v = unpack(table.column("q").take(pa.array(at)).to_pylist())
        a, b, sim = _best(ids, v, ids, v, k, least)
        return pa.table({"rep": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float32())})

    return run


def similar_groups(groups: DataFrame, dim: int, k: int, least: float, cap: int = CAP) -> DataFrame:
    """(rep, near): near is an array of (sim, id), most similar first, of at most k other groups; groups without any are left out.

    ``groups`` has rep, q and keys, one row per different vector, all of one dimension.
    """
    found = buckets(groups, dim, cap).groupBy("key").applyInArrow(_rerank(k, least), "rep long, id long, sim float")
    # At most k rows come from each of a vector's buckets, so the lists are short.
    per = found.groupBy("rep", "id").agg(F.max("sim").alias("sim")).groupBy("rep").agg(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "id")).alias("all"))
    return per.select("rep", F.transform(F.slice(F.array_sort("all"), 1, k), lambda x: F.struct((-x["minus"]).alias("sim"), x["id"].alias("id"))).alias("near"))


def neighbours(rows: DataFrame, id_col: str, vector_col: str, k: int = 5, least: float = 0.85, cap: int = CAP) -> DataFrame:
    """(vec_id, rank, neighbour, similarity) of the k rows most similar to each row, of those with at least the cosine similarity.

    Equal vectors are hashed once, as one group, and their rows are neighbours with similarity 1; ties go to the smaller id.
    A row without vector or with an all-zero one has no neighbours and is none. A repeated row comes out again; other columns are
    not read. Vectors of several lengths are an error. Rows find their group by 128 bits of their packed vector's hashes: that two
    of a billion different vectors share them has a chance of 1e-21.
    """
    units = unit_vectors(rows, id_col, vector_col)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))
    # The first k + 1 rows of a group are all that can be among anyone's k best; the limit works before the shuffle.
    first = units.withColumn("n", rank).where(F.col("n") <= k + 1)
    groups = hashed(first.groupBy("q").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_set("vec_id")).alias("first"))).persist()
    try:
        lengths = groups.agg(F.min(F.length("q")).alias("a"), F.max(F.length("q")).alias("b")).first()
        if lengths["a"] != lengths["b"]:
            raise ValueError(f"vectors of several lengths, from {(lengths['a'] - 4) // 2} to {(lengths['b'] - 4) // 2}")
        dim = ((lengths["a"] or 8) - 4) // 2
        near = similar_groups(groups, dim, k, least, cap).select("rep", F.explode("near").alias("x")).select("rep", F.col("x.id").alias("id"), F.col("x.sim").alias("sim"))
        near = near.join(groups.select(F.col("rep").alias("id"), "first"), "id").select("rep", F.explode("first").alias("id"), "sim")
        own = groups.where(F.size("first") > 1).select("rep", F.explode("first").alias("id"), F.lit(1.0).cast("float").alias("sim"))
        lists = near.unionAll(own).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "id"))).alias("near"))
        # Of all of a row's group and of the k nearest groups, the first k others than itself.
        near = F.slice("near", 1, k + 1)
        lists = cut(lists.join(groups.select("rep", *_both("q")), "rep").select("h1", "h2", F.transform(near, lambda x: x["id"]).alias("ids"), F.transform(near, lambda x: -x["minus"]).alias("sims")))
    finally:
        groups.unpersist()
    each = units.select("vec_id", *_both("q")).join(lists, ["h1", "h2"])
    best = each.select("vec_id", F.slice(F.filter(F.arrays_zip("ids", "sims"), lambda x: x["ids"] != F.col("vec_id")), 1, k).alias("near"))
    out = best.select("vec_id", F.posexplode("near").alias("at", "x"))
    return out.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("neighbour"), F.col("x.sims").alias("similarity"))


def _both(c: str) -> list:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def similar_pairs(rows: DataFrame, id_col: str, vector_col: str, k: int = 5, least: float = 0.85, cap: int = CAP) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: the pairs of which one is among the k most similar of the other, at ``least`` or more."""
    n = neighbours(rows, id_col, vector_col, k, least, cap)
    return n.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
