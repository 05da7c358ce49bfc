"""Scheme tables: translated titles, parents and children, paths, rendered texts, headings, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import symbols, textnorm
from treeline.operators import hierarchy, running
from treeline.session import cut

EDITION = ["version", "lang"]


def entries(nodes: DataFrame) -> DataFrame:
    """One row per (version, lang, symbol): the first delivery by node_id, with canonical symbol and parent.

    ``parent`` is NULL at a root; NULL titles and headings count as empty.
    """
    n = nodes.select(
        "version", "lang", F.coalesce(symbols.try_normalize(F.col("symbol")), symbols.strip(F.col("symbol"))).alias("symbol"), "node_id", "pos", "level", "depth",
        F.nullif(F.coalesce(symbols.try_normalize(F.col("parent")), symbols.strip(F.col("parent"))), F.lit("")).alias("parent"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("heading", F.lit("")).alias("heading"),
    )
    first = F.min(F.struct("node_id", "pos", "level", "depth", "parent", "title", "heading")).alias("f")
    return n.groupBy("version", "lang", "symbol").agg(first).select("version", "lang", "symbol", "f.*")


def titles_table(rows: DataFrame, order: str | None = None) -> DataFrame:
    """(symbol, title) from a titles table: canonical symbols, white space collapsed, blank titles left out, the last of repeated symbols.

    A symbol in no accepted form stops the query. Without an order column, the greatest title is the last.
    """
    missing = {"symbol", "title"} - set(rows.columns)
    if missing:
        raise ValueError(f"a titles table needs the columns symbol and title, not {rows.columns}")
    t = rows.select(symbols.normalize(F.col("symbol")).alias("symbol"), textnorm.clean(F.col("title")).alias("title"), (F.col(order) if order else F.lit(0)).alias("o")).where("title <> ''")
    return t.groupBy("symbol").agg(F.max_by("title", F.struct("o", "title")).alias("title"))


def overlay(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """``nodes`` with the titles of ``titles`` (unique symbols) where it has one; Spark picks the join by its size."""
    t = titles.select("symbol", F.col("title").alias("_title"))
    return nodes.join(t, "symbol", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")


def resolve_parents(n: DataFrame) -> DataFrame:
    """entries with ``parent_pos``: the parent's pos in the edition, -1 at a root and where the edition lacks it."""
    up = n.select(*EDITION, F.col("symbol").alias("parent"), F.col("pos").alias("parent_pos"))
    return n.join(up, [*EDITION, "parent"], "left").withColumn("parent_pos", F.coalesce("parent_pos", F.lit(-1)))


def children(resolved: DataFrame) -> DataFrame:
    """(version, lang, parent_pos, child_pos): each parent's children, one row a child; child_pos is their order. Roots are left out."""
    return resolved.where("parent_pos >= 0").select(*EDITION, "parent_pos", F.col("pos").alias("child_pos"))


def paths(nodes: DataFrame) -> DataFrame:
    """(version, lang, symbol, path): the symbols from the root down to each entry; none for entries on closed chains or below them."""
    _, edges = hierarchy.vertices(nodes)
    placed = hierarchy.trails(edges).select(F.col("vid").alias("node_id"), "path")
    return entries(nodes).select("node_id", *EDITION, "symbol").join(placed, "node_id").drop("node_id")


def closure(p: DataFrame, strict: bool = False) -> DataFrame:
    """(version, lang, ancestor, symbol, distance) from materialised paths; an entry is its own ancestor unless ``strict``."""
    c = p.select(*EDITION, "symbol", F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor"))
    c = c.select(*EDITION, "ancestor", "symbol", (F.col("n") - 1 - F.col("i")).alias("distance"))
    return c.where("distance > 0") if strict else c


def render(n: DataFrame, p: DataFrame) -> DataFrame:
    """(version, lang, symbol, text): headings and titles of the path from the top, joined by " > ", empty parts left out."""
    c = closure(p).withColumnRenamed("symbol", "of").withColumnRenamed("ancestor", "symbol")
    parts = c.join(n.select(*EDITION, "symbol", "title", "heading"), [*EDITION, "symbol"])
    listed = parts.groupBy(*EDITION, F.col("of").alias("symbol")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "heading", "title"))).alias("l"))
    words = F.filter(F.flatten(F.transform("l", lambda x: F.array(x["heading"], x["title"]))), lambda w: w != "")
    return listed.select(*EDITION, "symbol", F.array_join(words, " > ").alias("text"))


def rendered(nodes: DataFrame) -> DataFrame:
    """(version, lang, symbol, path, text, text_hash) of every entry that has a path: headings and titles are collected along with the symbols."""
    n = entries(nodes)
    _, edges = hierarchy.vertices(nodes)
    parts = n.select(F.col("node_id").alias("vid"), F.array("heading", "title").alias("parts"), *EDITION, F.col("symbol").alias("entry"))
    trails = hierarchy.trails(edges.join(parts.select("vid", "parts"), "vid"), "parts")
    text = F.array_join(F.filter("parts", lambda w: w != ""), " > ").alias("text")
    out = trails.select("vid", "path", text).join(parts.drop("parts"), "vid")
    return out.select(*EDITION, F.col("entry").alias("symbol"), "path", "text", textnorm.text_hash(F.col("text")).alias("text_hash"))


def texts(nodes: DataFrame) -> DataFrame:
    """(version, lang, symbol, text, text_hash) of every entry that has a path."""
    return rendered(nodes).drop("path")


def guidance_headings(n: DataFrame) -> DataFrame:
    """``heading`` for rows (edition, parent, pos, kind, symbol, end_symbol, title) of siblings.

    A row of kind "g" gives its title to the later main groups ("m") of the same parent while their symbol is at most its
    end symbol (its own symbol without one), until the next "g". The rows of kind "g" and of unknown kinds go.
    """
    own = F.struct(F.col("title").alias("t"), F.coalesce(F.nullif("end_symbol", F.lit("")), "symbol").alias("e"))
    n = running.scan(n, [*EDITION, "parent"], ["pos"], lasts={"g": F.when(F.col("kind") == "g", own)})
    h = n.withColumn("level", symbols.level_of_kind(F.col("kind"))).where("level is not null")
    return h.withColumn("heading", F.when((F.col("level") == "group") & (F.col("symbol") <= F.col("g.e")), F.col("g.t")).otherwise("")).drop("g")


def postorder(placed: DataFrame) -> DataFrame:
    """``placed`` (of hierarchy) with the postorder number inside the root's tree: lft + descendants - depth."""
    return placed.withColumn("postorder", F.col("lft") + F.col("n_descendants") - F.col("depth"))


def walk_up(n: DataFrame, start: DataFrame) -> DataFrame:
    """(version, lang, symbol, path) of some entries alone, one step up a round: for few rows, where ``paths`` would place all. None on or below closed chains."""
    state = cut(start.select(*EDITION, "symbol", F.col("parent").alias("up"), F.array("symbol").alias("path")))
    above = n.select(*EDITION, F.col("symbol").alias("up"), F.col("parent").alias("next"), F.lit(True).alias("known"))
    while not state.where("up is not null").isEmpty():
        moved = state.where("up is not null").join(above, [*EDITION, "up"], "left").where("not array_contains(path, up)")
        moved = moved.select(*EDITION, "symbol", F.col("next").alias("up"), F.when(F.col("known"), F.concat(F.array("up"), "path")).otherwise(F.col("path")).alias("path"))
        state = cut(state.where("up is null").unionByName(moved))
    return state.drop("up")


def show(nodes: DataFrame, symbol: str) -> DataFrame:
    """The entries of a symbol in any accepted form, in all editions, with path and text; only what is on their paths is rendered."""
    n = cut(entries(nodes))
    found = n.where(F.col("symbol") == symbols.normalize(F.lit(symbol)))
    p = walk_up(n, found)
    return found.join(render(n, p), [*EDITION, "symbol"]).join(p, [*EDITION, "symbol"])
