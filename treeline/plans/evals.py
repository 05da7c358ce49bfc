"""Queries of the second stage, of evaluation, and of whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import classify, embed, evaluate, rerank, search
from treeline.operators.search import Params
from treeline.plans import trees
from treeline.session import cut, table


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, symbol, score): flat candidates of every query vector."""
    i = table(spark, sf_dir, "ipc_index")
    f = search.flat(i.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vectors").alias("vector")), i.select("vec_id", F.col("vectors").alias("vector")), k)
    return f.join(i.select("vec_id", "symbol"), "vec_id").select("query_id", "rank", "vec_id", "symbol", F.col("similarity").alias("score"))


def _judged(spark: SparkSession, sf_dir: str, k: int = 25) -> DataFrame:
    """Candidates with the hash reranker's logit, of the query's and the candidate's path; judged once, for all fusions."""
    h = embed.hash_embed(table(spark, sf_dir, "ipc_index"), ["vec_id"], "path", 64)
    c = _candidates(spark, sf_dir, k)
    pairs = c.join(h.withColumnRenamed("vector", "b"), "vec_id").join(h.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("a")), "query_id")
    return cut(rerank.hash_logits(pairs, "a", "b").drop("a", "b"))


def hash_rerank_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("query_id", "vec_id", (F.round("logit", 6) + 0.0).alias("logit"))


def _fused(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rerank.fused(_judged(spark, sf_dir), ["query_id"], how, 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"), F.round("judge", 6).alias("judge"))

    run.__name__ = f"fuse_{how}"
    return run


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query row is a case; its gold symbols are its own and its parent's."""
    i = table(spark, sf_dir, "ipc_index").where("vec_id % 20 = 0")
    p = F.split("path", r"\|")
    return i.select(F.col("vec_id").alias("case_id"), F.filter(F.array("symbol", F.try_element_at(p, F.lit(-2))), lambda s: s.isNotNull()).alias("ipc"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, 10).select(F.col("query_id").alias("case_id"), "rank", "symbol")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(_cases(spark, sf_dir), _predictions(spark, sf_dir))


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hits(_outcomes(spark, sf_dir)).withColumn("k", F.col("k").cast("long"))


def mrr_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mrr(_outcomes(spark, sf_dir)).withColumn("mrr", F.round("mrr", 6))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.rows(_outcomes(spark, sf_dir))
    return r.select("level", "n", *[F.round(c, 6).alias(c) for c in r.columns[2:]])


def eval_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = _cases(spark, sf_dir), cut(_predictions(spark, sf_dir))
    return evaluate.misses(c, p, evaluate.outcomes(c, p), "subgroup")


def fusion_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of every fusion from one judged run."""
    j, c = _judged(spark, sf_dir), _cases(spark, sf_dir)
    out = None
    for how in ("first", *rerank.FUSIONS):
        p = rerank.fused(j, ["query_id"], how, 10).select(F.col("query_id").alias("case_id"), "rank", "symbol")
        r = evaluate.rows(evaluate.outcomes(c, p)).select(F.lit(how).alias("fusion"), "level", F.round("hit_1", 6).alias("hit_1"), F.round("hit_10", 6).alias("hit_10"), F.round("mrr", 6).alias("mrr"))
        out = r if out is None else out.unionByName(r)
    return out


def result_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = trees._index(spark, sf_dir)
    return classify.graph(search.search(q, e, Params(gap=0.1)))


def classify_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the stated cases (row_id divisible by 20) against every entry of every edition, embedded by hashing, judged and fused."""
    index = classify.build_index(table(spark, sf_dir, "nodes"))
    texts = table(spark, sf_dir, "eval_cases").where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "text")
    o = classify.Options(Params(level="group", top_k=5), rerank="hash:64")
    return classify.respond(classify.classify(texts, index, "hash:64", o))


_ALL = [hash_rerank_logit, *map(_fused, ("first", *rerank.FUSIONS)), hit_at_k, mrr_by_level, eval_rows, eval_misses, fusion_comparison, result_graph, classify_pipeline]
QUERIES = {f.__name__: f for f in _ALL}


def _cand(k: int) -> str:
    return f"""u AS (SELECT vec_id, symbol, path, vectors::DOUBLE[] v, sqrt(list_inner_product(vectors::DOUBLE[], vectors::DOUBLE[])) n FROM ipc_index WHERE vectors IS NOT NULL),
w AS (SELECT * FROM u WHERE n > 0),
ca AS MATERIALIZED (SELECT q.vec_id query_id, q.path qpath, r.vec_id, r.symbol, r.path, list_inner_product(q.v, r.v) / (q.n * r.n) score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, r.v) / (q.n * r.n), 9) DESC, r.vec_id) rank
 FROM w q JOIN w r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id QUALIFY rank <= {k})"""


_JUDGED = (
    _cand(25)
    + """,
tk AS (SELECT vec_id, unnest(regexp_extract_all(lower(path), '[a-z0-9]+')) t FROM ipc_index), hb AS (SELECT vec_id, ('0x' || md5(t)[31:32])::BIGINT % 64 b, count(*) n FROM tk GROUP BY ALL),
hl AS (SELECT vec_id, sqrt(sum(n * n)) l FROM hb GROUP BY ALL),
ct AS (SELECT ca.query_id, ca.vec_id, sum(a.n * b.n) s FROM ca JOIN hb a ON a.vec_id = ca.query_id JOIN hb b ON b.vec_id = ca.vec_id AND a.b = b.b GROUP BY ALL),
ju AS MATERIALIZED (SELECT ca.*, 8 * (coalesce(s, 0) / (x.l * y.l) - 0.5) logit FROM ca LEFT JOIN ct USING (query_id, vec_id) JOIN hl x ON x.vec_id = ca.query_id JOIN hl y ON y.vec_id = ca.vec_id)"""
)
_FUSE = {"first": "score", "blend": "score * (0.5 + 0.5 / (1 + exp(-logit)))", "judge": "1 / (1 + exp(-logit))", "product": "score / (1 + exp(-logit))"}


def _fused_sql(how: str, k: int, name: str = "fu") -> str:
    order = "rank" if how == "first" else f"round({_FUSE[how]}, 9) DESC, rank"
    return f"{name} AS (SELECT query_id, vec_id, symbol, {_FUSE[how]} fscore, 1 / (1 + exp(-logit)) judge, row_number() OVER (PARTITION BY query_id ORDER BY {order}) nrank FROM ju QUALIFY nrank <= {k})"


_CUT = "CASE lv WHEN 'section' THEN {s}[1:1] WHEN 'class' THEN {s}[1:3] WHEN 'subclass' THEN {s}[1:4] WHEN 'group' THEN CASE WHEN length({s}) = 14 THEN {s}[1:8] || '000000' ELSE {s} END ELSE {s} END"


def _outcome(preds: str, n: str = "") -> str:
    """Outcomes of predictions (case_id, rank, symbol); ``n`` keeps the names of several apart."""
    return f"""lv{n} AS (SELECT unnest(['section', 'class', 'subclass', 'group', 'subgroup']) lv),
cs{n} AS (SELECT vec_id case_id, CASE WHEN len(string_split(path, '|')) > 1 THEN [symbol, string_split(path, '|')[-2]] ELSE [symbol] END ipc FROM ipc_index WHERE vec_id % 20 = 0),
pr{n} AS (SELECT case_id, lv, {_CUT.format(s='symbol')} t, min(rank) at1 FROM {preds} p, lv{n} GROUP BY ALL),
dr{n} AS (SELECT case_id, lv, t, row_number() OVER (PARTITION BY case_id, lv ORDER BY at1) r FROM pr{n}),
go{n} AS (SELECT case_id, lv, list_transform(ipc, lambda s: {_CUT.format(s='s')}) gold FROM cs{n}, lv{n}),
oc{n} AS (SELECT g.case_id, g.lv AS level, min(CASE WHEN list_contains(gold, t) THEN r END) first_hit, min(CASE WHEN t = gold[1] THEN r END) main_hit FROM go{n} g LEFT JOIN dr{n} d ON d.case_id = g.case_id AND d.lv = g.lv GROUP BY g.case_id, g.lv)"""


_PREDS = _cand(10) + ",\nps AS (SELECT query_id case_id, rank, symbol FROM ca),\n" + _outcome("ps")


def _rate(k: int) -> str:
    return f"round(avg((coalesce(first_hit, 11) <= {k})::INT), 6) AS hit_{k}"


_MRR = "round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr"
SQL = {
    "hash_rerank_logit": f"WITH {_JUDGED} SELECT query_id, vec_id, round(logit, 6) + 0.0 AS logit FROM ju",
    **{f"fuse_{h}": f"WITH {_JUDGED}, {_fused_sql(h, 5)} SELECT query_id, nrank::INT AS rank, vec_id, round(fscore, 6) AS score, round(judge, 6) AS judge FROM fu" for h in _FUSE},
    "hit_at_k": f"WITH {_PREDS} SELECT level, k, count(*) AS n, count(*) FILTER (first_hit <= k) AS hits, count(*) FILTER (main_hit <= k) AS main_hits FROM oc, (SELECT unnest(range(1, 11)) k) GROUP BY ALL",
    "mrr_by_level": f"WITH {_PREDS} SELECT level, count(*) AS n, {_MRR} FROM oc GROUP BY level",
    "eval_rows": f"WITH {_PREDS} SELECT level, count(*) AS n, {_rate(1)}, {_rate(3)}, {_rate(5)}, {_rate(10)}, round(avg((coalesce(main_hit, 2) <= 1)::INT), 6) AS main_1, {_MRR} FROM oc GROUP BY level",
    "eval_misses": f"""WITH {_PREDS}, m AS (SELECT case_id FROM oc WHERE level = 'subgroup' AND first_hit IS NULL), p5 AS (SELECT case_id, string_agg(t, ',' ORDER BY r) predicted FROM dr WHERE lv = 'subgroup' AND r <= 5 GROUP BY case_id)
SELECT cs.case_id, array_to_string(list_sort(list_distinct(ipc)), ',') AS gold, coalesce(predicted, '') AS predicted FROM cs JOIN m USING (case_id) LEFT JOIN p5 USING (case_id)""",
    "fusion_comparison": f"WITH {_JUDGED}, "
    + ", ".join(f"{_fused_sql(h, 10, 'fu' + h)}, ps{h} AS (SELECT query_id case_id, nrank rank, symbol FROM fu{h}), {_outcome('ps' + h, h)}" for h in _FUSE)
    + " "
    + " UNION ALL ".join(f"SELECT '{h}' AS fusion, level, {_rate(1)}, {_rate(10)}, {_MRR} FROM oc{h} GROUP BY level" for h in _FUSE),
    "result_graph": trees.SQL["search_default"].rsplit("SELECT query_id, ed, rank::INT", 1)[0]
    + """, gp AS (SELECT dd.query_id, dd.ed, rank, tr.path p FROM dd JOIN tr ON tr.ed = dd.ed AND tr.symbol = dd.symbol),
gx AS (SELECT query_id, ed, rank, p, unnest(range(1, len(p) + 1)) i FROM gp)
SELECT query_id, ed, CASE WHEN i > 1 THEN p[i - 1] END AS parent, p[i] AS symbol, min(rank)::INT AS rank FROM gx GROUP BY ALL""",
}
