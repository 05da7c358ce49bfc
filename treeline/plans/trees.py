"""Queries over embedded hierarchies. The stated queries are the rows of ipc_index whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import vectors
from treeline.operators import search
from treeline.operators.search import Beam, Params, Weights
from treeline.session import cut, table

WEIGHTS = Weights(0.7, 0.2, 0.1)
BEAM = Beam(2, 3, 4, 6)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = table(spark, sf_dir, "ipc_index")
    return i.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vectors").alias("vector")), search.deliveries(i)


def knn_flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "ipc_index").select("vec_id", F.col("vectors").alias("vector"))
    return search.flat(i.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), i, 10).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def knn_flat_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search.flat(i.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), i, 5).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def knn_max_over_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consecutive query vectors are the chunks of one text."""
    i = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    s = search.similarities(i.where("vec_id % 20 < 2").withColumnRenamed("vec_id", "query_id"), i)
    s = s.select(F.floor(F.col("query_id") / 20).alias("query_id"), F.pmod("query_id", F.lit(20)).alias("chunk"), "vec_id", "similarity")
    return search.max_over_chunks(s).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


def chunk_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("text_id"), "embedding")
    return vectors.mean_vectors(e, ["text_id"], "embedding").select("text_id", F.posexplode("mean").alias("i", "x")).select("text_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def vector_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "ipc_index").where("vectors is not null")
    return i.select("vec_id", F.posexplode(vectors.normalize(F.col("vectors"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


def int8_quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "ipc_index").where("vectors is not null")
    q = i.select("vec_id", vectors.int8_scale(F.col("vectors")).alias("scale"), "vectors").withColumn("q", vectors.quantize(F.col("vectors"), F.col("scale")))
    out = q.select("vec_id", "scale", F.posexplode(F.arrays_zip("q", vectors.dequantize(F.col("q"), F.col("scale")).alias("d"))).alias("i", "z"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.col("z.q").cast("long").alias("q"), (F.round("z.d", 6) + 0.0).alias("x"))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = search.tree(search.first_vectors(table(spark, sf_dir, "ipc_index")))
    return t.select("ed", "symbol", F.array_join("path", "|").alias("path"), "parent", "level")


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own similarity, path and subtree support, their weighted sum and the best below, of every entry for every query."""
    return search.scores(*_index(spark, sf_dir), WEIGHTS, digits=6)


def _beam(level: str):
    return _search(f"beam_{level}", Params(level=level, weights=WEIGHTS, beam=BEAM, dedupe=False))


def _search(name: str, p: Params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, e = _index(spark, sf_dir)
        return search.search(q, e, p).select("query_id", "ed", "rank", "symbol", F.round("score", 6).alias("score"))

    run.__name__ = name
    return run


gap_filter = _search("gap_filter", Params(weights=WEIGHTS, beam=BEAM, gap=0.05, dedupe=False))
branch_dedupe = _search("branch_dedupe", Params(weights=WEIGHTS, beam=BEAM, top_k=8))
search_default = _search("search_default", Params(gap=0.1))
auto_descend = _search("auto_descend", Params(level="auto", weights=WEIGHTS, beam=BEAM, top_k=5, margin=0.02))

_ALL = [knn_flat_topk, knn_flat_embeddings, knn_max_over_chunks, chunk_mean_vector, vector_l2_normalize, int8_quantize_roundtrip, tree_nodes, composite_score, *map(_beam, search.LEVELS), gap_filter, branch_dedupe, search_default, auto_descend]
QUERIES = {f.__name__: f for f in _ALL}

_UNIT = "SELECT vec_id, {v}::DOUBLE[] v, sqrt(list_inner_product({v}::DOUBLE[], {v}::DOUBLE[])) n FROM {t} WHERE {v} IS NOT NULL"


def _flat(t: str, v: str, k: int) -> str:
    return f"""WITH u AS ({_UNIT.format(v=v, t=t)}), w AS (SELECT * FROM u WHERE n > 0),
s AS (SELECT q.vec_id query_id, r.vec_id, list_inner_product(q.v, r.v) / (q.n * r.n) sim FROM w q JOIN w r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(sim, 6) AS similarity FROM o WHERE rank <= {k}"""


_TREE = """x AS (SELECT vec_id, version || ':' || lang ed, symbol, path, vectors::DOUBLE[] v FROM ipc_index QUALIFY row_number() OVER (PARTITION BY ed, symbol ORDER BY vec_id) = 1),
ex AS (SELECT ed, string_split(path, '|') p, unnest(range(1, len(string_split(path, '|')) + 1)) i FROM x),
t AS (SELECT ed, p[i] symbol, string_split(min(array_to_string(p[1:i], '|')), '|') path FROM ex GROUP BY ed, p[i]),
tr AS (SELECT *, CASE WHEN len(path) > 1 THEN path[-2] END parent,
 CASE length(symbol) WHEN 1 THEN 'section' WHEN 3 THEN 'class' WHEN 4 THEN 'subclass' WHEN 14 THEN CASE WHEN symbol[9:] = '000000' THEN 'group' ELSE 'subgroup' END END level FROM t)"""


def _scored_sql(w: Weights) -> str:
    return f"""{_TREE},
qv AS (SELECT vec_id, vectors::DOUBLE[] v, sqrt(list_inner_product(vectors::DOUBLE[], vectors::DOUBLE[])) n FROM ipc_index WHERE vec_id % 20 = 0 AND vectors IS NOT NULL),
rv AS (SELECT *, sqrt(list_inner_product(v, v)) n FROM x WHERE v IS NOT NULL),
k AS (SELECT q.vec_id query_id, r.ed, r.symbol, list_inner_product(q.v, r.v) / (q.n * r.n) sim FROM qv q JOIN rv r ON q.n > 0 AND r.n > 0),
s AS MATERIALIZED (SELECT d.query_id, tr.*, k.sim FROM (SELECT DISTINCT query_id, ed FROM k) d JOIN tr USING (ed) LEFT JOIN k ON k.query_id = d.query_id AND k.ed = tr.ed AND k.symbol = tr.symbol),
up AS (SELECT query_id, ed, symbol, sim, unnest(path) anc FROM s),
ps AS (SELECT u.query_id, u.ed, u.symbol, avg(a.sim) ps FROM up u JOIN s a ON a.query_id = u.query_id AND a.ed = u.ed AND a.symbol = u.anc AND u.anc <> u.symbol GROUP BY ALL),
ss AS (SELECT query_id, ed, anc symbol, max(sim) ss FROM up GROUP BY ALL),
z AS (SELECT s.*, CASE WHEN s.sim IS NOT NULL THEN coalesce(ps, s.sim) END path_support, ss subtree_support FROM s LEFT JOIN ps USING (query_id, ed, symbol) LEFT JOIN ss USING (query_id, ed, symbol)),
sc0 AS (SELECT *, {w.own} * sim{f' + {w.path} * path_support' if w.path else ''}{f' + {w.subtree} * subtree_support' if w.subtree else ''} score FROM z),
bb AS (SELECT query_id, ed, anc symbol, max(score) bb FROM (SELECT query_id, ed, unnest(path) anc, score FROM sc0) GROUP BY ALL),
sc AS MATERIALIZED (SELECT sc0.*, bb FROM sc0 LEFT JOIN bb USING (query_id, ed, symbol))"""


def _beam_sql(target: str, b: Beam) -> str:
    out, front = "", "(SELECT * FROM sc WHERE level = 'section' AND parent IS NULL)"
    for n, (level, below) in enumerate(zip(search.LEVELS, search.LEVELS[1:])):
        if level == target:
            break
        out += f",\nk{n} AS (SELECT query_id, ed, symbol FROM {front} QUALIFY row_number() OVER (PARTITION BY query_id, ed ORDER BY round(bb, 9) DESC NULLS LAST, symbol) <= {b.width(level)})"
        if below == "subgroup":
            out += f",\nf{n} AS (SELECT DISTINCT sc.* FROM sc JOIN k{n} k ON k.query_id = sc.query_id AND k.ed = sc.ed AND list_contains(sc.path[:-2], k.symbol))"
        else:
            out += f",\nf{n} AS (SELECT sc.* FROM sc JOIN k{n} k ON k.query_id = sc.query_id AND k.ed = sc.ed AND sc.parent = k.symbol)"
        front = f"f{n}"
    return out + f",\nfront AS (SELECT * FROM {front})"


def _ranked(top_k: int, tie: str = "symbol", source: str = "front") -> str:
    return f",\nranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, ed ORDER BY round(score, 9) DESC, {tie}) rank FROM {source} WHERE score IS NOT NULL QUALIFY rank <= {top_k})"


_OUT = "SELECT query_id, ed, rank::INT AS rank, symbol, round(score, 6) AS score FROM "
# A fold over each list of at most top_k rows: a row stays unless an accepted one is related to it.
_DEDUPE = """,
li AS (SELECT query_id, ed, list({'rank': rank, 'symbol': symbol, 'path': path, 'score': score} ORDER BY rank) a FROM ranked GROUP BY ALL),
kept AS (SELECT query_id, ed, a, 1 i, [a[1]] acc FROM li UNION ALL
 SELECT query_id, ed, a, i + 1, CASE WHEN len(list_filter(acc, lambda y: list_contains(y.path, a[i + 1].symbol) OR list_contains(a[i + 1].path, y.symbol))) > 0 THEN acc ELSE list_append(acc, a[i + 1]) END FROM kept WHERE i < len(a)),
done AS (SELECT query_id, ed, unnest(acc) y FROM kept WHERE i = len(a)),
dd AS (SELECT query_id, ed, y.rank rank, y.symbol symbol, y.score score FROM done)"""
_AUTO = f""",
roots AS (SELECT query_id, ed, symbol, row_number() OVER (PARTITION BY query_id, ed ORDER BY round(bb, 9) DESC NULLS LAST, symbol) rr FROM front QUALIFY rr <= 5),
bc AS (SELECT query_id, ed, parent symbol, symbol child, bb cbb FROM sc WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, ed, parent ORDER BY round(bb, 9) DESC NULLS LAST, symbol) = 1),
st AS (SELECT sc.query_id, sc.ed, sc.symbol, child FROM sc JOIN bc USING (query_id, ed, symbol) WHERE sc.score IS NULL OR round(cbb, 9) >= round(sc.score - 0.02, 9)),
wk AS (SELECT query_id, ed, rr, symbol node FROM roots UNION ALL SELECT wk.query_id, wk.ed, rr, st.child FROM wk JOIN st ON st.query_id = wk.query_id AND st.ed = wk.ed AND st.symbol = wk.node),
be AS (SELECT wk.query_id, wk.ed, rr, node FROM wk JOIN sc ON sc.query_id = wk.query_id AND sc.ed = wk.ed AND sc.symbol = node
 QUALIFY row_number() OVER (PARTITION BY wk.query_id, wk.ed, rr ORDER BY coalesce(round(sim, 9), -9) DESC, len(path) DESC) = 1),
en AS (SELECT query_id, ed, node symbol, min(rr) rr FROM be GROUP BY ALL),
af AS (SELECT sc.*, rr FROM sc JOIN en USING (query_id, ed, symbol))"""
SQL = {
    "knn_flat_topk": _flat("ipc_index", "vectors", 10),
    "knn_flat_embeddings": _flat("embeddings", "embedding", 5),
    "knn_max_over_chunks": f"""WITH u AS ({_UNIT.format(v="embedding", t="embeddings")})
SELECT q.vec_id // 20 AS query_id, r.vec_id, round(max(list_inner_product(q.v, r.v) / (q.n * r.n)), 6) AS similarity FROM u q JOIN u r ON q.vec_id % 20 < 2 GROUP BY ALL""",
    "chunk_mean_vector": """WITH e AS (SELECT vec_id // 3 text_id, unnest(embedding::DOUBLE[]) x, unnest(range(0, len(embedding))) i FROM embeddings),
m AS (SELECT text_id, i, avg(x) x FROM e GROUP BY ALL), n AS (SELECT text_id, sqrt(sum(x * x)) n FROM m GROUP BY ALL)
SELECT text_id, i, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM m JOIN n USING (text_id)""",
    "vector_l2_normalize": """WITH u AS (SELECT vec_id, vectors::DOUBLE[] v, sqrt(list_inner_product(vectors::DOUBLE[], vectors::DOUBLE[])) n FROM ipc_index WHERE vectors IS NOT NULL),
e AS (SELECT vec_id, n, unnest(v) x, unnest(range(0, len(v))) i FROM u) SELECT vec_id, i, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0 AS x FROM e""",
    "int8_quantize_roundtrip": """WITH u AS (SELECT vec_id, vectors::DOUBLE[] v, list_max(list_transform(vectors::DOUBLE[], lambda y: abs(y))) / 127.0 m FROM ipc_index WHERE vectors IS NOT NULL),
e AS (SELECT vec_id, CASE WHEN m = 0 THEN 1.0 ELSE m END s, unnest(v) x, unnest(range(0, len(v))) i FROM u)
SELECT vec_id, i, greatest(least(round_even(x / s, 0), 127), -127)::BIGINT AS q, round(greatest(least(round_even(x / s, 0), 127), -127) * s, 6) + 0.0 AS x FROM e""",
    "tree_nodes": f"WITH {_TREE} SELECT ed, symbol, array_to_string(path, '|') AS path, parent, level FROM tr",
    "composite_score": f"""WITH {_scored_sql(WEIGHTS)} SELECT query_id, ed, symbol, round(sim, 6) AS similarity, round(path_support, 6) AS path_support,
round(subtree_support, 6) AS subtree_support, round(score, 6) AS score, round(bb, 6) AS best_below FROM sc""",
    **{f"beam_{x}": f"WITH {_scored_sql(WEIGHTS)}{_beam_sql(x, BEAM)}{_ranked(10)}\n{_OUT} ranked" for x in search.LEVELS},
    "gap_filter": f"WITH {_scored_sql(WEIGHTS)}{_beam_sql('subgroup', BEAM)}{_ranked(10)}\n{_OUT} ranked r WHERE round(score, 9) >= (SELECT round(b.score - 0.05, 9) FROM ranked b WHERE b.query_id = r.query_id AND b.ed = r.ed AND b.rank = 1)",
    "branch_dedupe": f"WITH RECURSIVE {_scored_sql(WEIGHTS)}{_beam_sql('subgroup', BEAM)}{_ranked(8)}{_DEDUPE}\n{_OUT} dd",
    "search_default": f"WITH RECURSIVE {_scored_sql(Weights())}{_beam_sql('subgroup', Beam())}{_ranked(10).replace('ranked AS', 'ranked0 AS')},\nranked AS (SELECT r.* FROM ranked0 r JOIN ranked0 b ON b.query_id = r.query_id AND b.ed = r.ed AND b.rank = 1 AND round(r.score, 9) >= round(b.score - 0.1, 9)){_DEDUPE}\n{_OUT} dd",
    "auto_descend": f"WITH RECURSIVE {_scored_sql(WEIGHTS)}{_beam_sql('subclass', BEAM)}{_AUTO}{_ranked(5, 'rr', 'af')}{_DEDUPE}\n{_OUT} dd",
}
