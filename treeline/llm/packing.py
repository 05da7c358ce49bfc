"""Items of varying size into containers of fixed capacity, by bounded-space online best fit.

A packer keeps a fixed number of open containers, in a bitset keyed by free space. An item goes into the open container that
it fits best, the oldest among equals; where none has room, the fullest closes (again the oldest among equals) and a new one
opens. An item of exactly the capacity has a container of its own and closes none. Only an item above the capacity is split.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import cut

CAPACITY = 4096
OPEN = 64
#: Full containers that a packer fills at least, so that those left open at its end hardly count.
PER_PACKER = 4096
#: Items that a packer takes at most, about, so that many empty or small ones are dealt to several.
MOST_ITEMS = 2_000_000
#: Repeats of one item that stay together while they are dealt.
REPEATS = 65_536
_SCHEMA = pa.schema([("container_id", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("doc_start", pa.int64()), ("length", pa.int64()), ("container_start", pa.int64())])


class Packer:
    """Open containers by free space: bit f of ``free`` is set where the heap ``heaps[f]`` holds a container with f left."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free, self.open, self.next = 0, 0, 0
        self.heaps: dict[int, list[int]] = {}

    def take(self, space: int) -> int:
        """The oldest open container with so much space, which leaves the bitset."""
        h = self.heaps[space]
        c = heapq.heappop(h)
        if not h:
            self.free &= ~(1 << space)
        return c

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, size: int) -> tuple[int, int]:
        """(container, place in it) of an item of at most the capacity."""
        if size == self.capacity:
            return self.fresh(), 0
        above = self.free >> size
        if above:
            space = size + ((above & -above).bit_length() - 1)
            c = self.take(space)
        else:
            if self.open == self.most_open:
                self.take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            c, space = self.fresh(), self.capacity
            self.open += 1
        left = space - size
        if left:
            heapq.heappush(self.heaps.setdefault(left, []), c)
            self.free |= 1 << left
        else:
            self.open -= 1
        return c, self.capacity - space

    def put_split(self, size: int) -> list[tuple[int, int, int, int]]:
        """(container, start in the item, length, place) of each part: whole containers first, then the rest."""
        out = []
        start = 0
        while size - start > self.capacity:
            out.append((self.fresh(), start, self.capacity, 0))
            start += self.capacity
        c, at = self.put(size - start)
        out.append((c, start, size - start, at))
        return out


def deal(items: DataFrame, packers: int) -> DataFrame:
    """(doc_id, n, packer), by a hash of the item and, where it is repeated, of the number of the repeat.

    Equal items are counted first and numbered again afterwards, in stretches that are spread before they are numbered, so that
    no task holds all repeats of a frequent one and the deal depends on nothing but the items.
    """
    alike = items.groupBy("doc_id", "n").agg(F.count("*").alias("times"))
    runs = alike.select("doc_id", "n", "times", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("times") - 1).cast("long"), F.lit(REPEATS).cast("long"))).alias("first"))
    runs = runs.repartition("doc_id", "n", "first")
    each = runs.select("doc_id", "n", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + REPEATS, F.col("times")) - 1)).alias("i"))
    return each.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", "i"), F.lit(packers)).alias("packer"))


def pack(items: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, per_packer: int = PER_PACKER, most_items: int = MOST_ITEMS) -> DataFrame:
    """(container_id, doc_id, part, doc_start, length, container_start) from (doc_id, n).

    Items are dealt to packers by ``deal``, about ``per_packer`` containers or ``most_items`` items each, and come in the order of
    their ids, so that the result depends on nothing else. An item of size 0 or NULL takes part with length 0; repeated ids are
    packed each. Other columns are not read; an empty table gives none.
    """
    if capacity < 1 or most_open < 1:
        raise ValueError("capacity and most_open must be at least 1")
    items = cut(items.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    total = items.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    packers = max(1, (total["n"] or 0) // (capacity * per_packer), -(-total["rows"] // most_items))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, n = t.column("doc_id").to_numpy(zero_copy_only=False), t.column("n").to_numpy()
        order = np.lexsort((n, ids))
        p = Packer(capacity, most_open)
        base = int(key[0].as_py()) << 40
        rows = [(base + c, d, i, start, length, at) for d, size in zip(ids[order].tolist(), n[order].tolist()) for i, (c, start, length, at) in enumerate(p.put_split(size))]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return deal(items, packers).groupBy("packer").applyInArrow(run, "container_id long, doc_id long, part int, doc_start long, length long, container_start long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of all room that is used."""
    per = packed.groupBy("container_id").agg(F.sum("length").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("share"))


def faults(items: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of counts, all but ``items`` 0 where the packing keeps its rules.

    items (different ids), missing (ids without a part), wrong_total (ids whose parts do not add up to their sizes), overfull
    (containers beyond the capacity), gaps (containers whose parts do not join up from 0), split_small (parts of ids that had no need).
    """
    want = items.groupBy("doc_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("want"), F.max(F.coalesce("n", F.lit(0))).alias("largest"), F.count("*").alias("times"))
    got = packed.groupBy("doc_id").agg(F.sum("length").alias("got"), F.count("*").alias("parts"))
    d = want.join(got, want.doc_id.eqNullSafe(got.doc_id), "left").agg(
        F.count("*").alias("items"), F.count_if(F.col("got").isNull()).alias("missing"), F.count_if(F.col("got") != F.col("want")).alias("wrong_total"),
        F.count_if((F.col("largest") <= capacity) & (F.col("parts") > F.col("times"))).alias("split_small"),
    )
    # Parts that start at 0, do not overlap and end at their sum leave no gap: the end of the last is the sum of all.
    c = packed.where("length > 0").groupBy("container_id").agg(F.sum("length").alias("used"), F.max(F.col("container_start") + F.col("length")).alias("end"), F.min("container_start").alias("start"))
    c = c.agg(F.count_if(F.col("used") > capacity).alias("overfull"), F.count_if((F.col("end") != F.col("used")) | (F.col("start") != 0)).alias("gaps"))
    return d.join(F.broadcast(c)).select("items", "missing", "wrong_total", "overfull", "gaps", "split_small")
