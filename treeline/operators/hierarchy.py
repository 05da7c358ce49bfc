"""Parent links to whole hierarchies, as nested sets.

Sizes are summed upward by doubling steps: after k rounds a vertex knows the number of vertices fewer than 2^k steps below it,
and its ancestor 2^k steps above. Sibling ranges are laid out by prefix sums and carried downward along the paths, again by
doubling. All rounds follow the logarithm of the height, for bushes and for chains alike; a round only touches vertices as deep
as its step is long. What the sums upward never finish with is on closed chains or below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import symbols
from treeline.session import cut

NONE = "\x00"
#: Buckets of preorder numbers that one range is spread over at a time.
STRETCH = 65_536


def _canonical(c: Column) -> Column:
    return F.coalesce(symbols.try_normalize(c), symbols.strip(c))


def vertices(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, vertices): each row with its vertex, and one vertex per (version, lang, symbol) with its parent's.

    A vertex's id is the smallest node_id of its deliveries; pvid is NULL at a root and where the edition lacks the
    parent. A row without a symbol is a vertex of its own that nothing hangs below; NULL versions and languages form editions of their own.
    """
    rows = nodes.select(
        F.col("node_id"),
        F.coalesce("version", F.lit(NONE)).alias("v"),
        F.coalesce("lang", F.lit(NONE)).alias("l"),
        F.coalesce(_canonical(F.col("symbol")), F.concat(F.lit(NONE), F.col("node_id").cast("string"))).alias("sym"),
        F.nullif(_canonical(F.col("parent")), F.lit("")).alias("par"),
        F.coalesce(F.col("pos"), F.lit(0)).alias("pos"),
    )
    first = F.min(F.struct("node_id", "par", "pos")).alias("f")
    v = rows.groupBy("v", "l", "sym").agg(first).select("v", "l", "sym", F.col("f.node_id").alias("vid"), F.col("f.par").alias("par"), F.col("f.pos").alias("pos"))
    v = cut(v)
    up = v.select("v", "l", F.col("sym").alias("par"), F.col("vid").alias("pvid"))
    edges = cut(v.join(up, ["v", "l", "par"], "left").select("vid", "pvid", "sym", "pos", "v", "l"))
    return rows, edges


def upward(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, endless): vid and size of every vertex, and those from which following parents never ends, for ``name_cycles``.

    A vertex with an ancestor 2^k steps above gives it what it has summed so far, so that nothing is counted twice. If some
    vertex lies that deep in a tree, others lie half as deep; hence as long as there are any, each round leaves fewer, and a
    round that does not leaves the endless ones. Their sizes mean nothing.
    """
    one = F.lit(1).cast("long").alias("size")
    active = cut(edges.where("pvid is not null").select("vid", F.col("pvid").alias("end"), F.col("vid").alias("least"), one))
    n = active.count()
    sums = [edges.select("vid", one)]
    while n:
        given = active.groupBy(F.col("end").alias("vid")).agg(F.sum("size").alias("size"))
        sums.append(given)
        more = _double(active, "size").join(given.withColumnRenamed("size", "more"), "vid", "left")
        active = cut(more.select("vid", "end", "least", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        left = active.count()
        if left == n:
            break
        n = left
    return _union(sums).groupBy("vid").agg(F.sum("size").alias("size")), active.select("vid", "end", "least")


def _double(state: DataFrame, *more: str) -> DataFrame:
    """Steps twice as long: ``end`` is the vertex that they lead to, ``least`` the smallest id before it; what has no such end goes."""
    other = state.select(F.col("vid").alias("end"), F.col("end").alias("end2"), F.col("least").alias("least2"))
    return state.join(other, "end").select("vid", F.col("end2").alias("end"), F.least("least", "least2").alias("least"), *more)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def name_cycles(state: DataFrame) -> DataFrame:
    """(vid, cycle_id) of vertices (vid, end, least) from which following parents never ends: the smallest id on the closed chain.

    Steps are doubled until the vertices that they end in end in just as many: those are the closed chains. On these, steps are
    doubled further until that changes no least id, which proves that each has seen its whole chain.
    """
    while True:
        ends = cut(state.select(F.col("end").alias("vid")).distinct().join(state, "vid"))
        n = ends.agg(F.count("*").alias("all"), F.count_distinct("end").alias("different")).first()
        if n["all"] == n["different"]:
            break
        state = cut(_double(state))
    while True:
        far = cut(_double(ends.withColumn("was", F.col("least")), "was"))
        if far.where("least < was").isEmpty():
            return state.join(ends.select(F.col("vid").alias("end"), F.col("least").alias("cycle_id")), "end").select("vid", "cycle_id")
        ends = far.select("vid", "end", "least")


def trails(edges: DataFrame, *payload: str, sums: tuple[str, ...] = (), own: tuple[str, ...] = (), with_path: bool = True) -> DataFrame:
    """(vid, top, path, ...) of the vertices (vid, pvid, sym, ...) whose parents end at a root, ``top``.

    From the root down, symbols and the payload's arrays are joined and sums added; what is ``own`` stays. By doubling: a vertex
    takes over what the last vertex of its trail has collected. What is done is not written again. Each round leaves fewer open, as
    in ``upward``; one that does not leaves those on or below closed chains, which have no trail.
    """
    arrays = [*(["path"] if with_path else []), *payload]
    cols = ["top", *arrays, *sums]
    done: list[DataFrame] = []
    first = edges.withColumn("path", F.array("sym")) if with_path else edges
    state = cut(first.select("vid", F.col("pvid").alias("up"), F.col("vid").alias("top"), *arrays, *sums, *own))
    n = None
    while True:
        done.append(state.where("up is null").drop("up"))
        rest = state.where("up is not null")
        left = rest.count()
        if left in (0, n):
            return _union(done)
        n = left
        above = _union([*(d.select("vid", *cols, F.lit(None).cast("long").alias("up2")) for d in done), rest.select("vid", *cols, F.col("up").alias("up2"))])
        above = above.select(F.col("vid").alias("up"), "up2", *[F.col(c).alias(f"_{c}") for c in cols])
        joined = [F.concat(f"_{c}", c).alias(c) for c in arrays] + [(F.col(f"_{c}") + F.col(c)).alias(c) for c in sums]
        state = cut(rest.join(above, "up").select("vid", F.col("up2").alias("up"), F.col("_top").alias("top"), *joined, *own))


def sibling_offsets(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(vid, pvid, sym, size, off): off is 1 plus the sizes of the siblings before it; 0 at a root.

    The prefix sums run over range partitions of (parent, position), so that the children of one parent may fill many
    tasks: sums inside a task, then over the few tasks that hold children of the same parent.
    """
    e = edges.select("vid", "pvid", "sym", "pos").join(sizes, "vid").repartitionByRange("pvid", "pos", "vid").withColumn("block", F.spark_partition_id())
    e = cut(e)
    own = Window.partitionBy("block", "pvid").orderBy("pos", "vid").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("pvid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    kids = e.where("pvid is not null")
    blocks = kids.groupBy("pvid", "block").agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("pvid", "block", "base")
    inside = kids.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    offs = inside.join(blocks, ["pvid", "block"]).select("vid", "pvid", "sym", "size", (F.col("inside") + F.col("base") + 1).alias("off"))
    roots = e.where("pvid is null").select("vid", "pvid", "sym", "size", F.lit(0).cast("long").alias("off"))
    return offs.unionAll(roots)


def hierarchy(nodes: DataFrame, with_path: bool = True) -> DataFrame:
    """For every row its place in the forest of its (version, lang).

    Columns: node_id, vid, root_vid, root, depth (0 at a root), path (symbols joined by "|"), lft, rgt (the preorder range
    inside the root's tree; v's descendants are those of the same root with lft in (v.lft, v.rgt]), n_descendants, cycle_id.
    Rows on a closed chain or below one have cycle_id and NULL in the others; extra columns of ``nodes`` are not read. Order
    of siblings: pos, then id. A parent in any accepted form is resolved; NULL, empty and unknown parents make a root.
    """
    rows, edges = vertices(nodes)
    sizes, endless = upward(edges)
    circle = cut(name_cycles(endless))
    offs = sibling_offsets(edges.join(circle, "vid", "left_anti"), sizes)
    one = F.when(F.col("pvid").isNull(), 0).otherwise(1).cast("long")
    state = trails(offs.withColumn("hops", one), sums=("off", "hops"), own=("size",), with_path=with_path)
    state = state if with_path else state.withColumn("path", F.array().cast("array<string>"))
    tops = edges.where("pvid is null").select(F.col("vid").alias("top"), F.col("sym").alias("root"))
    placed = edges.select("vid", "v", "l", "sym").join(state.join(tops, "top"), "vid", "left").join(circle, "vid", "left")
    placed = placed.select(
        "v", "l", "sym", "vid", "cycle_id", F.col("top").alias("root_vid"), "root", F.col("hops").alias("depth"),
        F.array_join("path", "|").alias("path"), F.col("off").alias("lft"), (F.col("off") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"),
    )
    return rows.select("node_id", "v", "l", "sym").join(placed, ["v", "l", "sym"]).drop("v", "l", "sym")


def cyclic_rows(nodes: DataFrame) -> DataFrame:
    """node_id, cycle_id of the rows from which following parents never ends; no more is computed than that needs."""
    rows, edges = vertices(nodes)
    circle = name_cycles(upward(edges)[1]).join(edges.select("vid", "v", "l", "sym"), "vid")
    return rows.select("node_id", "v", "l", "sym").join(circle, ["v", "l", "sym"]).select("node_id", "cycle_id")


def descendants(placed: DataFrame, width: int = 16) -> DataFrame:
    """(root_vid, vid, descendant_vid) of all strict descendants, by nested-set ranges.

    A range join on buckets of ``width`` preorder numbers: a range goes to each bucket it overlaps, a vertex to its one bucket.
    A bucket of a tree holds ``width`` vertices and the ranges over them, at most width times the depth, so that no key is hot.
    A long range is cut into stretches of buckets, which are spread before each goes to its buckets.
    """
    v = placed.where("root_vid is not null").select("root_vid", "vid", "lft", "rgt").distinct()
    first, last = F.floor((F.col("lft") + 1) / width).cast("long"), F.floor(F.col("rgt") / width).cast("long")
    ranges = v.where("rgt > lft").select("root_vid", "vid", "lft", "rgt", last.alias("last"), F.explode(F.sequence(first, last, F.lit(STRETCH).cast("long"))).alias("start"))
    ranges = ranges.repartition("vid", "start").select("root_vid", "vid", "lft", "rgt", F.explode(F.sequence("start", F.least(F.col("start") + STRETCH - 1, "last"))).alias("bucket"))
    points = v.select("root_vid", F.col("vid").alias("descendant_vid"), F.col("lft").alias("at"), F.floor(F.col("lft") / width).alias("bucket"))
    return ranges.join(points, ["root_vid", "bucket"]).where("at > lft and at <= rgt").select("root_vid", "vid", "descendant_vid")
