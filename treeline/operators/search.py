"""Search over embedded hierarchies, for whole tables of queries: flat neighbours, supports, beam and automatic descent.

A tree is (ed, symbol, path), ``ed`` naming the edition. Scores are compared rounded to nine places, so that the order of
summation decides nothing, and ties go to the smaller symbol or id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import symbols
from treeline.functions.symbols import LEVELS
from treeline.session import cut

AUTO = "auto"
#: The most bytes of query vectors that are broadcast.
MOST_BROADCAST = 64 << 20
QE = ["query_id", "ed"]


@dataclass(frozen=True)
class Weights:
    """How own similarity, the mean of the ancestors' and the best below add up."""

    own: float = 1.0
    path: float = 0.0
    subtree: float = 0.0


@dataclass(frozen=True)
class Beam:
    """How many entries of each level are followed."""

    section: int = 5
    class_: int = 10
    subclass: int = 20
    group: int = 40

    def width(self, level: str) -> int:
        return getattr(self, "class_" if level == "class" else level)


@dataclass(frozen=True)
class Params:
    """Of a search; ``gap`` keeps what is within it of the best, ``roots`` is max(5, top_k) unless given."""

    level: str = "subgroup"
    top_k: int = 10
    gap: float | None = None
    dedupe: bool = True
    margin: float = 0.0
    roots: int | None = None
    weights: Weights = field(default_factory=Weights)
    beam: Beam = field(default_factory=Beam)

    def __post_init__(self) -> None:
        if self.level not in (*LEVELS, AUTO):
            raise ValueError(f"level must be one of {(*LEVELS, AUTO)}, not {self.level}")


def deliveries(index: DataFrame) -> DataFrame:
    """(vec_id, ed, symbol, path, vector): all rows of an index; vectors stay as they are."""
    return index.select("vec_id", F.concat_ws(":", "version", "lang").alias("ed"), "symbol", F.split("path", r"\|").alias("path"), F.col("vectors").alias("vector"))


def first(entries: DataFrame) -> DataFrame:
    """Of several deliveries of an (ed, symbol) the first: the least vec_id."""
    f = entries.withColumn("path", F.array_join("path", "|"))
    # Ids and paths are found apart, so that whoever only reads these moves no vector.
    f = f.groupBy("ed", "symbol").agg(F.min(F.struct("vec_id", "path")).alias("g"), F.min(F.struct("vec_id", "path", "vector")).alias("f"))
    return f.select("g.vec_id", "ed", "symbol", F.split("g.path", r"\|").alias("path"), "f.vector")


def first_vectors(index: DataFrame) -> DataFrame:
    """(vec_id, ed, symbol, path, vector): the first delivery of each (version, lang, symbol)."""
    return first(deliveries(index))


def tree(entries: DataFrame) -> DataFrame:
    """(ed, symbol, path, parent, level) of the entries and of all symbols on their paths; of several paths the least."""
    each = entries.select("ed", F.posexplode("path").alias("i", "symbol"), "path").select("ed", "symbol", F.array_join(F.slice("path", F.lit(1), F.col("i") + 1), "|").alias("path"))
    t = each.groupBy("ed", "symbol").agg(F.min("path").alias("path")).withColumn("path", F.split("path", r"\|"))
    return t.select("ed", "symbol", "path", F.try_element_at("path", F.lit(-2)).alias("parent"), symbols.level(F.col("symbol")).alias("level"))


def raw_rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors as they are) of the vectors that are not NULL and not empty. They must be of one length."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths)
    if not len(rows):
        return rows, np.zeros((0, 0))
    if len(np.unique(lengths[rows])) > 1:
        raise ValueError(f"vectors of several lengths, from {lengths[rows].min()} to {lengths[rows].max()}")
    return rows, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Unit vectors; NaN for those without a direction: all zero, or with something missing in them."""
    m = m.astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(np.isfinite(norm) & (norm > 0), norm, np.nan)


def unit_rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the vectors that have a direction: not NULL, not all zero, nothing missing in them. They must be of one length."""
    rows, m = raw_rows(lists)
    m = unit(m)
    fine = ~np.isnan(m).any(axis=1)
    return rows[fine], m[fine]


def _blocks(rows: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """Rows packed into blocks of about ``size`` unit vectors, one row a block: (ids, vectors, dim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                s = b.slice(at, size)
                where, m = unit_rows(s.column(1))
                if len(where):
                    ids = s.column(0).to_numpy(zero_copy_only=False)[where].astype("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([m.tobytes()]), pa.array([m.shape[1]], pa.int32())], names=["ids", "vectors", "dim"])

    return rows.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "ids binary, vectors binary, dim int")


def similarities(queries: DataFrame, rows: DataFrame, top: int | None = None, least: float | None = None, block: int = 1024) -> DataFrame:
    """(query_id, vec_id, similarity) of the stated queries (query_id, vector) against all rows (vec_id, vector), in blocks.

    Blocks of queries meet blocks of rows in one matrix product each. With ``top``, only each block's best leave it, ties to the
    smaller id and the query's own id left out, which is enough for the best over all blocks. NULL and all-zero vectors have no
    similarities. Vectors of several lengths are an error. The blocks of queries are broadcast if they are checked to be small, so
    that rows are read once and never moved; else both sides are written once and met block by block.
    """
    q = cut(_blocks(queries, "query_id", "vector", block).select(F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"), F.col("dim").alias("qdim")))
    r = _blocks(rows, "vec_id", "vector", block * 4)
    small = (q.agg(F.sum(F.length("qids") + F.length("qvectors"))).first()[0] or 0) <= MOST_BROADCAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, qdim, ri, rv, dim in zip(*(b.column(i).to_pylist() for i in range(6))):
                if dim != qdim:
                    raise ValueError(f"vectors of several lengths: {qdim} of a query, {dim} of a row")
                qids, rids = np.frombuffer(qi, "<i8"), np.frombuffer(ri, "<i8")
                s = np.frombuffer(qv, "<f8").reshape(-1, dim) @ np.frombuffer(rv, "<f8").reshape(-1, dim).T
                floor = -2.0 if least is None else least - 1e-9
                if top is not None and len(rids) > top + 1:
                    # The query itself may be among the rows, hence one more.
                    floor = np.maximum(floor, np.partition(s, -(top + 1), axis=1)[:, -(top + 1), None] - 1e-9)
                i, j = np.nonzero(s >= floor)
                sim = s[i, j]
                if least is not None:
                    keep = np.round(sim, 9) >= least
                    i, j, sim = i[keep], j[keep], sim[keep]
                if top is not None:
                    keep = qids[i] != rids[j]
                    i, j, sim = i[keep], j[keep], sim[keep]
                    order = np.lexsort((rids[j], -np.round(sim, 9), i))
                    i, j, sim = i[order], j[order], sim[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < top
                    i, j, sim = i[keep], j[keep], sim[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(rids[j]), pa.array(sim)], names=["query_id", "vec_id", "similarity"])

    pairs = r.crossJoin(F.broadcast(q)) if small else cut(r).crossJoin(q)
    return pairs.select("qids", "qvectors", "qdim", "ids", "vectors", "dim").mapInArrow(run, "query_id long, vec_id long, similarity double")


def flat(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, similarity): the k rows most similar to each query, the query's own id left out."""
    s = similarities(queries, rows, top=k)
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def max_over_chunks(s: DataFrame) -> DataFrame:
    """A row's similarity to a text of several chunks: the best chunk's. ``s`` has query_id, chunk, vec_id, similarity."""
    return s.groupBy("query_id", "vec_id").agg(F.max("similarity").alias("similarity"))


def node_similarities(queries: DataFrame, entries: DataFrame, t: DataFrame, reduce: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, ed, symbol, path, parent, level, similarity): all entries of all trees for each query; NULL where an entry has no vector.

    ``reduce`` may merge the queries first, as those of a text's chunks.
    """
    s = similarities(queries, entries.select("vec_id", "vector"))
    s = reduce(s) if reduce else s
    known = s.join(entries.select("vec_id", "ed", "symbol"), "vec_id").drop("vec_id")
    each = known.select(*QE).distinct().join(t, "ed")
    return each.join(known, [*QE, "symbol"], "left")


def path_support(s: DataFrame) -> DataFrame:
    """(query_id, ed, symbol, path_support): mean similarity of the strict ancestors that have one; NULL without any."""
    up = s.select(*QE, "symbol", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("ancestor"))
    own = s.select(*QE, F.col("symbol").alias("ancestor"), "similarity")
    return up.join(own, [*QE, "ancestor"]).groupBy(*QE, "symbol").agg(F.avg("similarity").alias("path_support"))


def best_below(s: DataFrame, value: str, name: str) -> DataFrame:
    """(query_id, ed, symbol, name): the largest value over an entry and everything below it, by materialised paths."""
    return s.select(*QE, F.explode("path").alias("symbol"), value).groupBy(*QE, "symbol").agg(F.max(value).alias(name))


def scored(s: DataFrame, weights: Weights = Weights(), supports: bool = True) -> DataFrame:
    """``s`` with path_support, subtree_support, score and best_below.

    Supports are only computed where the weights or the caller want them. An entry without a vector has no score, but what is
    below it counts for best_below. A root's path support is its own similarity.
    """
    out = s
    if supports or weights.path:
        out = out.join(path_support(s), [*QE, "symbol"], "left").withColumn("path_support", F.when(F.col("similarity").isNotNull(), F.coalesce("path_support", "similarity")))
    if supports or weights.subtree:
        out = out.join(best_below(s, "similarity", "subtree_support"), [*QE, "symbol"], "left")
    score = F.lit(weights.own) * F.col("similarity")
    if weights.path:
        score = score + F.lit(weights.path) * F.col("path_support")
    if weights.subtree:
        score = score + F.lit(weights.subtree) * F.col("subtree_support")
    out = out.withColumn("score", score)
    return out.join(best_below(out, "score", "best_below"), [*QE, "symbol"], "left")


def scores(queries: DataFrame, entries: DataFrame, weights: Weights = Weights(), digits: int | None = None) -> DataFrame:
    """(query_id, ed, symbol, similarity, path_support, subtree_support, score, best_below) of every entry for every query, as ``scored`` gives them.

    Where the trees can be packed, rows are streamed from the tasks and no pair is shuffled. Of an entry that was delivered several
    times the first counts. With ``digits``, numbers are rounded half up, as Spark's ``round`` does.
    """
    from treeline.operators import branches

    if packed := branches.packed_regular(entries):
        return branches.scores(queries, packed, weights, digits)
    t = cut(tree(first(entries)))
    if branches.fits(t):
        return branches.scores(queries, branches.packed(entries, t), weights, digits)
    s = scored(cut(node_similarities(queries, first(entries), t)), weights)
    number = lambda c: F.col(c) if digits is None else F.round(c, digits).alias(c)
    return s.select(*QE, "symbol", *map(number, ("similarity", "path_support", "subtree_support", "score", "best_below")))


def _order(value: str) -> list:
    return [F.round(value, 9).desc_nulls_last(), F.col("symbol")]


def beam(sc: DataFrame, target: str, widths: Beam = Beam()) -> DataFrame:
    """The entries of the target level that a beam from the sections reaches; the last step, to subgroups, takes all below the groups.

    At each level above the target the best by ``best_below`` are kept; the target level itself is not cut.
    """
    front = sc.where("level = 'section' and parent is null")
    for level, below in zip(LEVELS, LEVELS[1:]):
        if level == target:
            break
        w = Window.partitionBy(*QE).orderBy(*_order("best_below"))
        kept = front.withColumn("n", F.row_number().over(w)).where(F.col("n") <= widths.width(level)).select(*QE, F.col("symbol").alias("up"))
        if below == "subgroup":
            under = sc.select("*", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("up"))
        else:
            under = sc.withColumn("up", F.col("parent"))
        front = under.join(kept, [*QE, "up"], "left_semi").drop("up").dropDuplicates([*QE, "symbol"])
    return front


def auto_descend(sc: DataFrame, p: Params) -> DataFrame:
    """For the best subclasses: the entry with the highest own similarity on the walk down the best branch, the deepest on ties.

    The walk goes to the child with the best ``best_below`` while that is within the margin of the entry's score. Walks are
    followed by pointer doubling, so that their length only counts by its logarithm. Columns as in ``sc``, and root_rank.
    """
    roots = beam(sc, "subclass", p.beam)
    w = Window.partitionBy(*QE).orderBy(*_order("best_below"))
    n_roots = p.roots if p.roots is not None else max(5, p.top_k)
    roots = roots.withColumn("root_rank", F.row_number().over(w)).where(F.col("root_rank") <= n_roots).select(*QE, F.col("symbol").alias("node"), "root_rank")
    first = F.min(F.struct(F.coalesce(-F.round("best_below", 9), F.lit(9.0)).alias("minus"), "symbol"))
    best = sc.where("parent is not null").groupBy(*QE, F.col("parent").alias("symbol")).agg(first.alias("c"))
    step = sc.join(best, [*QE, "symbol"], "left")
    goes = F.col("c").isNotNull() & (F.col("score").isNull() | (-F.col("c.minus") >= F.round(F.col("score") - p.margin, 9)))
    own = F.struct(F.coalesce(F.round("similarity", 9), F.lit(-9.0)).alias("s"), F.size("path").alias("d"), F.col("symbol").alias("symbol"))
    state = cut(step.select(*QE, "symbol", F.when(goes, F.col("c.symbol")).alias("next"), own.alias("best")))
    while not state.where("next is not null").isEmpty():
        far = state.select(*QE, F.col("symbol").alias("next"), F.col("next").alias("next2"), F.col("best").alias("best2"))
        state = cut(state.join(far, [*QE, "next"], "left").select(*QE, "symbol", F.col("next2").alias("next"), F.greatest("best", F.coalesce("best2", "best")).alias("best")))
    ends = roots.join(state.withColumnRenamed("symbol", "node"), [*QE, "node"]).groupBy(*QE, F.col("best.symbol").alias("symbol")).agg(F.min("root_rank").alias("root_rank"))
    return sc.join(ends, [*QE, "symbol"])


def ranked(chosen: DataFrame, top_k: int, tie: list | None = None) -> DataFrame:
    """``chosen`` with ``rank`` by score, the first ``top_k``; entries without a score go."""
    w = Window.partitionBy(*QE).orderBy(F.round("score", 9).desc(), *(tie or [F.col("symbol")]))
    return chosen.where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def within_gap(r: DataFrame, gap: float) -> DataFrame:
    """What is within the gap of the first of its query."""
    first = F.first("score").over(Window.partitionBy(*QE).orderBy("rank"))
    return r.withColumn("_best", first).where(F.round("score", 9) >= F.round(F.col("_best") - gap, 9)).drop("_best")


def distinct_branches(r: DataFrame) -> DataFrame:
    """Keeps a row unless an accepted one before it is on its path or below it; lists are at most top_k long."""
    listed = r.groupBy(*QE).agg(F.array_sort(F.collect_list(F.struct("rank", "symbol", "path"))).alias("all"))
    related = lambda a, x: F.array_contains(x["path"], a["symbol"]) | F.array_contains(a["path"], x["symbol"])
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda a: related(a, x)), acc).otherwise(F.concat(acc, F.array(x))))
    keep = listed.select(*QE, F.explode(F.transform(kept, lambda x: x["rank"])).alias("rank"))
    return r.join(keep, [*QE, "rank"])


def search(queries: DataFrame, entries: DataFrame, p: Params = Params(), supports: bool = False, reduce: Callable[[DataFrame], DataFrame] | None = None, plan: str = "auto") -> DataFrame:
    """The best entries of every tree for every query: descent, cut to top_k, gap, then branches, in this order; nothing back-fills.

    Columns: query_id, ed, rank, symbol, level, path, similarity, score, and the supports if asked for. ``plan`` "branches" visits
    packed branches where the tree allows it, "rows" keeps a row for every query and entry, which has no bound on branches and
    is needed for supports; "auto" takes the first where it can. Of an entry that was delivered several times the first counts.
    """
    from treeline.operators import branches

    fast = plan == "branches" or plan == "auto" and not supports and reduce is None
    if fast and (packed := branches.packed_regular(entries)):
        return branches.search(queries, packed, p)
    t = cut(tree(first(entries)))
    # Descents start at sections, so that what hangs below other roots is never reached.
    if fast and branches.fits(t.where(branches.REACHED)):
        return branches.search(queries, branches.packed(entries, t, branches.REACHED), p)
    sc = cut(scored(node_similarities(queries, first(entries), t, reduce), p.weights, supports))
    out = ranked(auto_descend(sc, p), p.top_k, [F.col("root_rank")]) if p.level == AUTO else ranked(beam(sc, p.level, p.beam), p.top_k)
    if p.gap is not None:
        out = within_gap(out, p.gap)
    if p.dedupe:
        out = distinct_branches(out)
    more = [c for c in ("path_support", "subtree_support") if c in out.columns and supports]
    return out.select(*QE, "rank", "symbol", "level", F.array_join("path", "|").alias("path"), "similarity", "score", *more)
