"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import garbled, lookalikes, neighbours, packing, reading, tokens
from treeline.session import cut, table


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select(F.struct("lang", "symbol").alias("key"), F.col("node_id").alias("id"), F.col("title").alias("text"))


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_cases").select(F.col("number").alias("key"), F.col("row_id").alias("id"), F.col("abstract").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lookalikes.same_look_pairs(_titles(spark, sf_dir)).select(F.lit("nodes").alias("src"), "key_a", "key_b")
    return nodes.unionByName(lookalikes.same_look_pairs(_abstracts(spark, sf_dir)).select(F.lit("eval_cases").alias("src"), "key_a", "key_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of texts that look the same: how many rows and different texts, and their canonical one."""
    nodes = lookalikes.class_sizes(_titles(spark, sf_dir)).select(F.lit("nodes").alias("src"), F.concat_ws(":", "key.lang", "key.symbol").alias("key"), "rows", "texts", "member")
    return nodes.unionByName(lookalikes.class_sizes(_abstracts(spark, sf_dir)).select(F.lit("eval_cases").alias("src"), "key", "rows", "texts", "member"))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lookalikes.consistent(_titles(spark, sf_dir)).select(F.lit("nodes").alias("src"), F.col("id"), "text")
    return nodes.unionByName(lookalikes.consistent(_abstracts(spark, sf_dir)).select(F.lit("eval_cases").alias("src"), "id", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restore(table(spark, sf_dir, "eval_cases"), "row_id", ["title", "abstract"]).select("row_id", "field")


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled values with what could be restored."""
    return garbled.restore(table(spark, sf_dir, "eval_cases"), "row_id", ["title", "abstract"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "ipc_index"), "vec_id", "vectors")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "ipc_index"), "vec_id", "vectors")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.places(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode(tokens.encode(table(spark, sf_dir, "documents")))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.sizes(table(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.pack(tokens.sizes(table(spark, sf_dir, "documents"))))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the packing of the whole table breaks a rule."""
    items = cut(tokens.sizes(table(spark, sf_dir, "documents")))
    return packing.faults(items, cut(packing.pack(items)))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by language and level."""
    d = _levels(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return d.groupBy("lang", "level").agg(F.count("*").alias("docs"), F.avg("difficulty").alias("difficulty"), F.avg("sentences").alias("sentences"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_classes, p1_texts, p4_found, p4_texts, p5_found, p5_neighbours, p6_ids, p6_places, p6_decoded, p7_packed, p7_fill, p7_faults, p8_found, p8_profile,
)}
def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain(c: str) -> str:
    """A text with look-alikes mapped, in SQL."""
    out = f"translate({c}, {_quoted(lookalikes._FROM)}, {_quoted(lookalikes._TO)})"
    for joined, parts in lookalikes._JOINED:
        out = f"replace({out}, '{joined}', '{parts}')"
    return out


# What has no glyph goes, and marks join their letters.
_LOOK = r"nfc_normalize(regexp_replace({c}, '[\x00-\x08\x0e-\x1f\x7f-\x84\x{{86}}-\x{{9f}}\p{{Cf}}\x{{FE00}}-\x{{FE0F}}\x{{34F}}]', '', 'g'))"
_SEEN = f"""t AS (SELECT 'nodes' src, lang || ':' || symbol AS key, node_id id, title AS text FROM nodes UNION ALL SELECT 'eval_cases', number, row_id, abstract FROM eval_cases),
p AS (SELECT *, {_plain('text')} plain FROM t WHERE text IS NOT NULL), k AS (SELECT *, {_LOOK.format(c='plain')} look FROM p)"""
SQL = {
    "p1_found": f"WITH {_SEEN} SELECT a.src, a.id AS key_a, b.id AS key_b FROM k a JOIN k b ON a.src = b.src AND a.key = b.key AND a.look = b.look AND a.id < b.id AND a.text <> b.text",
    "p1_classes": f"""WITH {_SEEN}, c AS (SELECT src, key, look, count(*) AS rows, count(DISTINCT text) AS texts, min({{'a': text <> plain, 'b': text}}).b AS member FROM k WHERE key IS NOT NULL GROUP BY ALL)
SELECT src, key, rows, texts, member FROM c WHERE texts > 1""",
    "p1_texts": f"""WITH {_SEEN}, c AS (SELECT src, look, min({{'a': text <> plain, 'b': text, 'c': look}}).c AS text FROM k GROUP BY src, look)
SELECT src, id, c.text FROM k JOIN c USING (src, look) UNION ALL SELECT src, id, NULL FROM t WHERE text IS NULL""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    # No rule of packing is broken anywhere.
    "p7_faults": """SELECT count(DISTINCT doc_id) AS items, 0::BIGINT AS missing, 0::BIGINT AS wrong_total, 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS split_small FROM documents""",
    # By comparing all pairs, which only a small table allows.
    "p5_found": """WITH u AS (SELECT vec_id, vectors::DOUBLE[] v, sqrt(list_inner_product(vectors::DOUBLE[], vectors::DOUBLE[])) n FROM ipc_index WHERE vectors IS NOT NULL),
s AS (SELECT a.vec_id a, b.vec_id b, list_inner_product(a.v, b.v) / (a.n * b.n) c FROM u a JOIN u b ON a.n > 0 AND b.n > 0 AND a.vec_id <> b.vec_id),
t AS (SELECT * FROM s WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t""",
}
