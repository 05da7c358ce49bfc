"""How often predictions hit: at every level of the hierarchy and every k, for all cases in one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import symbols
from treeline.functions.symbols import LEVELS
from treeline.operators import rerank
from treeline.session import cut


def _levels(level: str) -> tuple[str, ...]:
    return LEVELS[: LEVELS.index(level) + 1]


def _cut_to(level: str):
    return lambda s: symbols.truncate(s, level)


def distinct_ranks(predictions: DataFrame, level: str) -> DataFrame:
    """(case_id, level, symbol, rank): predictions (case_id, rank, symbol) cut to each level down to ``level``; ranks count distinct symbols in order of appearance."""
    each = reduce(
        DataFrame.unionByName,
        [predictions.select("case_id", "rank", F.lit(lv).alias("level"), symbols.truncate(F.col("symbol"), lv).alias("symbol")) for lv in _levels(level)],
    )
    first = each.groupBy("case_id", "level", "symbol").agg(F.min("rank").alias("at"))
    w = Window.partitionBy("case_id", "level").orderBy("at")
    return first.select("case_id", "level", "symbol", F.row_number().over(w).alias("rank"))


def outcomes(cases: DataFrame, predictions: DataFrame, level: str = "subgroup", top_k: int = 10) -> DataFrame:
    """(case_id, level, first_hit, main_hit): the rank of the first gold symbol and of the main one, NULL where there is none.

    ``cases`` has case_id and ipc (gold symbols, the main one first); every case counts, also without predictions or symbols.
    """
    got = distinct_ranks(predictions.where(F.col("rank") <= top_k), level)
    gold = reduce(
        DataFrame.unionByName,
        [cases.select("case_id", F.lit(lv).alias("level"), F.transform("ipc", _cut_to(lv)).alias("gold"), symbols.truncate(F.try_element_at("ipc", F.lit(1)), lv).alias("main")) for lv in _levels(level)],
    )
    j = gold.join(got, ["case_id", "level"], "left")
    hit = F.when(F.array_contains("gold", F.col("symbol")), F.col("rank"))
    return j.groupBy("case_id", "level").agg(F.min(hit).alias("first_hit"), F.min(F.when(F.col("symbol") == F.col("main"), F.col("rank"))).alias("main_hit"))


def hits(out: DataFrame, top_k: int = 10) -> DataFrame:
    """(level, k, n, hits, main_hits): at each k up to top_k, how many cases have a hit by then."""
    k = F.explode(F.sequence(F.lit(1), F.lit(top_k))).alias("k")
    each = out.select("level", "first_hit", "main_hit", k)
    return each.groupBy("level", "k").agg(F.count("*").alias("n"), F.count_if(F.col("first_hit") <= F.col("k")).alias("hits"), F.count_if(F.col("main_hit") <= F.col("k")).alias("main_hits"))


def mrr(out: DataFrame) -> DataFrame:
    """(level, n, mrr): the mean reciprocal rank of the first hit, 0 for a case without."""
    return out.groupBy("level").agg(F.count("*").alias("n"), F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))


def rows(out: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), top_k: int = 10) -> DataFrame:
    """One row a level: n, hit_K for each k up to top_k, main_1 and mrr."""
    rate = [F.avg((F.coalesce(F.col("first_hit"), F.lit(top_k + 1)) <= k).cast("double")).alias(f"hit_{k}") for k in ks if k <= top_k]
    main = F.avg((F.coalesce(F.col("main_hit"), F.lit(2)) <= 1).cast("double")).alias("main_1")
    return out.groupBy("level").agg(F.count("*").alias("n"), *rate, main, F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))


def table(r: DataFrame) -> str:
    """``rows`` as text, from the section down; there are at most five of them."""
    got = sorted(r.collect(), key=lambda x: LEVELS.index(x.level))
    names = [c for c in r.columns if c not in ("level", "n", "mrr")]
    lines = [f"{'level':<10}" + "".join(f"{c.replace('_', '@'):>9}" for c in names) + f"{'mrr':>8}"]
    return "\n".join([*lines, *(f"{x.level:<10}" + "".join(f"{x[c]:>9.1%}" for c in names) + f"{x.mrr:>8.3f}" for x in got)])


def misses(cases: DataFrame, predictions: DataFrame, out: DataFrame, level: str, top_k: int = 10, first: int | None = None) -> DataFrame:
    """(case_id, gold, predicted) of the cases without a hit at ``level``: distinct gold symbols in order, and the first five predictions.

    ``first`` keeps so many, by case_id.
    """
    lost = out.where((F.col("level") == level) & F.col("first_hit").isNull()).select("case_id")
    lost = lost if first is None else lost.orderBy("case_id").limit(first)
    got = distinct_ranks(predictions.where(F.col("rank") <= top_k), level).where((F.col("level") == level) & (F.col("rank") <= 5))
    listed = got.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]), ",").alias("predicted"))
    gold = cases.select("case_id", F.array_join(F.array_sort(F.array_distinct(F.transform("ipc", lambda s: symbols.truncate(s, level)))), ",").alias("gold"))
    return gold.join(lost, "case_id").join(listed, "case_id", "left").select("case_id", "gold", F.coalesce("predicted", F.lit("")).alias("predicted"))


def stratified_sample(rows: DataFrame, id_col: str, stratum: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows, half from each side of a boolean column as far as both have enough, the rest from the larger side.

    Rows are taken by the MD5 of seed and id, so that the choice is the same everywhere; all rows come if there are no more than
    ``size``. NULL counts as false. Only counts and the cut reach a single place.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    r = rows.withColumn("_h", h).withColumn("_s", F.coalesce(stratum, F.lit(False)))
    n = r.agg(F.count_if("_s").alias("a"), F.count("*").alias("all")).first()
    if size >= n["all"]:
        return rows
    a = min(n["a"], size // 2)
    b = min(n["all"] - n["a"], size - a)
    a = min(n["a"], size - b)
    pick = lambda flag, k: r.where(F.col("_s") if flag else ~F.col("_s")).orderBy("_h", id_col).limit(k)
    return pick(True, a).unionByName(pick(False, b)).drop("_h", "_s")


def measure(cases: DataFrame, classify: Callable[[DataFrame], DataFrame], level: str = "subgroup", top_k: int = 10) -> DataFrame:
    """``rows`` of any classifier: a function from texts (query_id, text) to predictions (query_id, rank, symbol). ``cases`` has case_id, text, ipc."""
    found = classify(cases.select(F.col("case_id").alias("query_id"), "text"))
    return rows(outcomes(cases, found.select(F.col("query_id").alias("case_id"), "rank", "symbol"), level, top_k), top_k=top_k)


def fusion_results(judged: DataFrame, cases: DataFrame, fusions: tuple[str, ...] = ("first", *rerank.FUSIONS), level: str = "subgroup", top_k: int = 10) -> DataFrame:
    """``rows`` with ``fusion``, for every way of joining first scores and verdicts, from one judged run.

    ``judged`` has case_id, rank, symbol, score, logit; cases (case_id, ipc) are found by their id, so that equal texts count one by one.
    """
    judged = cut(judged)
    each = [rerank.fused(judged, ["case_id"], f, top_k).select("case_id", "rank", "symbol", F.lit(f).alias("fusion")) for f in fusions]
    return reduce(DataFrame.unionByName, [rows(outcomes(cases, p.drop("fusion"), level, top_k), top_k=top_k).withColumn("fusion", F.lit(f)) for f, p in zip(fusions, each)])
