"""Embedded editions: what changed against an earlier one, reuse of its vectors, the build and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import embed

#: An entry of an edition; of an earlier edition, ``version`` is that of the edition it is compared with.
KEY = ["version", "lang", "symbol"]


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(version, lang, symbol, status): reused, changed, added or removed, by symbol and text hash; both sides have unique keys."""
    a = new.select(*KEY, F.col("text_hash").alias("a"))
    b = old.select(*KEY, F.col("text_hash").alias("b"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "reused").otherwise("changed")
    return a.join(b, KEY, "full").select(*KEY, status.alias("status"))


def removed(new: DataFrame, old: DataFrame) -> DataFrame:
    """The entries of the earlier edition that the new one lacks."""
    return old.select(*KEY).join(new.select(*KEY), KEY, "left_anti")


def report(d: DataFrame) -> DataFrame:
    """One row an edition: entries of the new edition, how many vectors are reused and computed, and what changed."""
    n = {s: F.count_if(F.col("status") == s) for s in ("reused", "added", "changed", "removed")}
    return d.groupBy("version", "lang").agg(
        (n["reused"] + n["added"] + n["changed"]).alias("total"), n["reused"].alias("reused"), (n["added"] + n["changed"]).alias("computed"),
        n["added"].alias("added"), n["changed"].alias("changed"), n["removed"].alias("removed"),
    )


def reuse(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` (version, lang, symbol, text_hash) with the earlier vector of the same symbol and text, NULL where it must be computed."""
    return new.join(old.select(*KEY, "text_hash", "vector"), [*KEY, "text_hash"], "left")


def check_model(new: tuple[str, int, str], old: tuple[str, int, str]) -> None:
    """Vectors are only reused between editions of one (model, dimension, language)."""
    if new != old:
        raise ValueError(f"an index of {old} can't be reused for {new}")


def build(texts: DataFrame, old: DataFrame | None, spec: str, old_spec: str | None = None) -> DataFrame:
    """(version, lang, symbol, text_hash, vector): earlier vectors where symbol and text are the same, computed ones elsewhere.

    ``texts`` has version, lang, symbol, text, text_hash. Only what is missing goes through the embedder. Earlier vectors must
    be of the same model, dimension and language; they are found by the language, and the others are checked.
    """
    if old is not None:
        size = old.where("vector is not null").select(F.size("vector").alias("n")).limit(1).collect()
        dim = embed.get_embedder(spec).dim
        check_model((spec, dim, ""), (old_spec or spec, size[0].n if size else dim, ""))
    else:
        old = texts.select(*KEY, "text_hash", F.lit(None).cast("array<double>").alias("vector")).limit(0)
    hit = reuse(texts.select(*KEY, "text_hash", "text"), old)
    have = hit.where("vector is not null").select(*KEY, "text_hash", "vector")
    missing = hit.where("vector is null").select(*KEY, "text_hash", "text")
    backend, _, dim = spec.partition(":")
    keys = [*KEY, "text_hash"]
    made = embed.hash_embed(missing, keys, "text", int(dim or 64)) if backend == "hash" else embed.model_embed(missing, keys, "text", spec, queries=False)
    return have.unionByName(made)


def previous_edition(editions: DataFrame) -> DataFrame:
    """(version, lang, model, previous): for each edition the newest older version of the same language and model, or NULL.

    An as-of join without a window over the group: the greatest of the older versions, which are few for one language and model.
    """
    e = editions.select("version", "lang", "model").distinct()
    older = e.select("lang", "model", F.col("version").alias("older"))
    pairs = e.join(older, ["lang", "model"], "left").withColumn("older", F.when(F.col("older") < F.col("version"), F.col("older")))
    return pairs.groupBy("version", "lang", "model").agg(F.max("older").alias("previous"))


def against_previous(index: DataFrame, editions: DataFrame) -> DataFrame:
    """The index's rows under the version of the next edition of their language and model, which they are earlier rows of.

    Both sides join on the edition, of which there are few; rows without a later edition go.
    """
    later = previous_edition(editions).where("previous is not null").select(F.col("version").alias("_next"), "lang", F.col("previous").alias("version"))
    return index.join(later, ["version", "lang"]).withColumn("version", F.col("_next")).drop("_next")


def mismatches(index: DataFrame, scheme: DataFrame) -> DataFrame:
    """Rows where an index and its scheme (both pos, symbol) disagree; an index that fits has none."""
    a, b = index.select("pos", F.col("symbol").alias("index_symbol")), scheme.select("pos", F.col("symbol").alias("scheme_symbol"))
    return a.join(b, "pos", "full").where("not (index_symbol <=> scheme_symbol)")


def resolve_version(versions: DataFrame, spec: str, today: str) -> DataFrame:
    """One row with the version that ``latest``, ``current`` (in force on ``today``, YYYYMMDD) or YYYYMMDD names; NULL if there is none."""
    if len(spec) == 8 and spec.isdigit():
        return versions.sparkSession.createDataFrame([(spec,)], "version string")
    if spec not in ("latest", "current"):
        raise ValueError(f"unknown version: {spec}; use latest, current or YYYYMMDD")
    v = versions.where(F.col("version") <= today) if spec == "current" else versions
    return v.agg(F.max("version").alias("version"))


def find(catalog: DataFrame, version: str, lang: str, model: str) -> DataFrame:
    """The catalog's entries of one edition and model; on a partitioned layout the filter prunes folders."""
    return catalog.where((F.col("version") == version) & (F.upper("lang") == lang.upper()) & (F.col("model") == model))
