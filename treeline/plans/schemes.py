"""Queries over scheme tables, symbols and embedded editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import symbols, textnorm
from treeline.operators import index, scheme
from treeline.plans.records_and_trees import _norm
from treeline.session import table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.entries(table(spark, sf_dir, "nodes"))


def symbol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("node_id", symbols.try_normalize(F.col("parent")).alias("canonical"))


def symbol_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("node_id", symbols.pretty(F.col("symbol")).alias("pretty"), symbols.try_normalize(symbols.pretty(F.col("symbol"))).alias("again"))


def symbol_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("node_id", symbols.level(F.col("symbol")).alias("level"))


def symbol_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("node_id", *[symbols.truncate(F.col("symbol"), lv).alias(lv) for lv in symbols.LEVELS])


def kind_to_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("pos") % 11 == 0, "g").when(F.col("depth") > 0, F.col("depth").cast("string"))
    for k, lv in symbols.KIND_LEVEL.items():
        kind = kind.when(F.col("level") == lv, k)
    n = table(spark, sf_dir, "nodes").withColumn("kind", kind)
    return n.select("node_id", "kind", symbols.level_of_kind(F.col("kind")).alias("level")).where("level is not null")


def symbol_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All printed symbols inside the raw lines, canonical and distinct, in order of appearance."""
    found = F.array_distinct(F.transform(symbols.extract(F.col("line")), symbols.try_normalize))
    return table(spark, sf_dir, "raw_cases").select("line_id", F.array_join(found, "|").alias("symbols"))


def titles_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.titles_table(table(spark, sf_dir, "titles_overlay"))


def title_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _entries(spark, sf_dir).where("lang = 'PT'")
    return scheme.overlay(n, scheme.titles_table(table(spark, sf_dir, "titles_overlay"))).select("version", "symbol", "title")


def parent_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.resolve_parents(_entries(spark, sf_dir)).select("version", "lang", "symbol", "parent_pos")


def children_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.children(scheme.resolve_parents(_entries(spark, sf_dir)))


def path_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.paths(table(spark, sf_dir, "nodes")).withColumn("path", F.array_join("path", "|"))


def path_text_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheme.texts(table(spark, sf_dir, "nodes"))


def closure_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scheme.closure(scheme.paths(table(spark, sf_dir, "nodes")))
    return c.groupBy("version", "lang", "ancestor").agg(F.count("*").alias("n"), F.max("distance").cast("long").alias("height"))


def guidance_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth main group stands for a heading over the numbers up to 20 above its own."""
    e = _entries(spark, sf_dir).where("level = 'group' and parent is not null and length(symbol) = 14")
    kind = F.when(F.col("pos") % 4 == 0, "g").otherwise("m")
    end = F.concat(F.substring("symbol", 1, 4), F.lpad((F.substring("symbol", 5, 4).cast("int") + 20).cast("string"), 4, "0"), F.lit("000000"))
    return scheme.guidance_headings(e.withColumn("kind", kind).withColumn("end_symbol", F.when(F.col("pos") % 8 == 0, end))).select("version", "lang", "symbol", "heading")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, old, editions): the first deliveries, and those of the edition before each."""
    f = F.min(F.struct("vec_id", "text_hash")).alias("f")
    new = table(spark, sf_dir, "ipc_index").groupBy("version", "lang", "symbol").agg(f).select("version", "lang", "symbol", "f.*")
    editions = table(spark, sf_dir, "index_meta").select("version", "lang", "model")
    return new, index.against_previous(new, editions), editions


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old, _ = _index(spark, sf_dir)
    return index.diff(new, old)


def index_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old, _ = _index(spark, sf_dir)
    return index.report(index.diff(new, old))


def removed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old, _ = _index(spark, sf_dir)
    return index.removed(new, old)


def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old, _ = _index(spark, sf_dir)
    return index.reuse(new.drop("vec_id"), old.withColumnRenamed("vec_id", "vector")).select("version", "lang", "symbol", F.col("vector").alias("reused_from"))


def previous_version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.previous_edition(table(spark, sf_dir, "index_meta"))


def index_scheme_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows whose symbol is not that of their scheme entry."""
    i = table(spark, sf_dir, "ipc_index").select(F.col("node_id").alias("pos"), "symbol")
    n = table(spark, sf_dir, "nodes").select(F.col("node_id").alias("pos"), "symbol")
    return index.mismatches(i, n).groupBy(F.col("index_symbol").isNull().alias("not_embedded")).agg(F.count("*").alias("n"))


def version_list_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that a listing page names, real dates only, with the local ones."""
    from treeline.sources.catalog import versions_in_html

    page = table(spark, sf_dir, "nodes").groupBy("version").agg(F.concat(F.lit('<a href="/ipc/'), F.col("version"), F.lit('/">x</a><a href="/99999999/">y</a> /20230231/ /assets/')).alias("html"))
    return versions_in_html(page, "html").union(table(spark, sf_dir, "index_meta").select("version")).distinct()


def version_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "nodes").select("version").distinct()
    out = [index.resolve_version(v, s, "20251201").select(F.lit(s).alias("spec"), "version") for s in ("latest", "current", "20200101")]
    return out[0].union(out[1]).union(out[2])


def symbol_paths_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of embedded editions against what is really embedded."""
    n = table(spark, sf_dir, "ipc_index").groupBy("version", "lang").agg(F.count("*").alias("n"), F.count("vectors").alias("with_vector"))
    return table(spark, sf_dir, "index_meta").select("version", "lang", textnorm.model_slug(F.col("model")).alias("model"), "rows_built").join(n, ["version", "lang"], "left")


_ALL = [
    symbol_normalize, symbol_format, symbol_level, symbol_truncate, kind_to_level, symbol_extract, titles_table, title_overlay, parent_resolve, children_lists, path_materialize, path_text_render,
    closure_distances, guidance_heading, index_diff, index_diff_report, removed_entries, vector_reuse, previous_version_asof, index_scheme_mismatches, version_list_valid, version_resolve, symbol_paths_of_index,
]
QUERIES = {f.__name__: f for f in _ALL}


def _try_norm(c: str) -> str:
    n = _norm(c)
    return n[: n.rindex(" ELSE ")] + " END"


_E = f"""e AS (SELECT node_id, version, lang, {_norm('symbol')} symbol, pos, level, depth, nullif({_norm('parent')}, '') parent, coalesce(title, '') title, coalesce(heading, '') heading
 FROM nodes QUALIFY row_number() OVER (PARTITION BY version, lang, {_norm('symbol')} ORDER BY node_id) = 1)"""
_PATHS = (
    _E
    + """,
l AS (SELECT e.*, p.symbol up FROM e LEFT JOIN e p ON p.version = e.version AND p.lang = e.lang AND p.symbol = e.parent),
pa AS (SELECT version, lang, symbol, symbol path, [symbol] arr FROM l WHERE up IS NULL UNION ALL
 SELECT l.version, l.lang, l.symbol, pa.path || '|' || l.symbol, list_append(pa.arr, l.symbol) FROM pa JOIN l ON l.version = pa.version AND l.lang = pa.lang AND l.up = pa.symbol)"""
)
_NEW = """new AS (SELECT version, lang, symbol, vec_id, text_hash FROM ipc_index QUALIFY row_number() OVER (PARTITION BY version, lang, symbol ORDER BY vec_id) = 1),
pe AS (SELECT a.version, a.lang, a.model, max(b.version) previous FROM (SELECT DISTINCT version, lang, model FROM index_meta) a LEFT JOIN index_meta b ON a.lang = b.lang AND a.model = b.model AND b.version < a.version GROUP BY ALL),
old AS (SELECT pe.version, o.lang, o.symbol, o.vec_id, o.text_hash FROM new o JOIN pe ON pe.previous = o.version AND pe.lang = o.lang)"""
_DIFF = (
    _NEW
    + """,
d AS (SELECT coalesce(n.version, o.version) AS version, coalesce(n.lang, o.lang) lang, coalesce(n.symbol, o.symbol) symbol,
 CASE WHEN o.symbol IS NULL THEN 'added' WHEN n.symbol IS NULL THEN 'removed' WHEN n.text_hash = o.text_hash THEN 'reused' ELSE 'changed' END status
 FROM new n FULL JOIN old o ON n.version = o.version AND n.lang = o.lang AND n.symbol = o.symbol)"""
)
_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_PRETTY = "CASE WHEN length(symbol) = 14 THEN symbol[1:4] || ' ' || symbol[5:8]::INT || '/' || CASE WHEN length(rtrim(symbol[9:], '0')) < 2 THEN rpad(rtrim(symbol[9:], '0'), 2, '0') ELSE rtrim(symbol[9:], '0') END ELSE symbol END"
SQL = {
    "symbol_normalize": f"SELECT node_id, {_try_norm('parent')} AS canonical FROM nodes",
    "symbol_format": f"WITH p AS (SELECT node_id, {_PRETTY} pretty FROM nodes) SELECT node_id, pretty, {_try_norm('pretty')} AS again FROM p",
    "symbol_level": "SELECT node_id, CASE length(symbol) WHEN 1 THEN 'section' WHEN 3 THEN 'class' WHEN 4 THEN 'subclass' WHEN 14 THEN CASE WHEN symbol[9:] = '000000' THEN 'group' ELSE 'subgroup' END END AS level FROM nodes",
    "symbol_truncate": 'SELECT node_id, symbol[1:1] AS section, symbol[1:3] AS "class", symbol[1:4] AS subclass, CASE WHEN length(symbol) = 14 THEN symbol[1:8] || \'000000\' ELSE symbol END AS "group", symbol AS subgroup FROM nodes',
    "kind_to_level": """WITH k AS (SELECT node_id, CASE WHEN pos % 11 = 0 THEN 'g' WHEN depth > 0 THEN depth::VARCHAR WHEN level = 'section' THEN 's' WHEN level = 'class' THEN 'c' WHEN level = 'subclass' THEN 'u' WHEN level = 'group' THEN 'm' END kind FROM nodes)
SELECT node_id, kind, CASE WHEN kind = 's' THEN 'section' WHEN kind = 'c' THEN 'class' WHEN kind = 'u' THEN 'subclass' WHEN kind = 'm' THEN 'group' ELSE 'subgroup' END AS level FROM k WHERE kind <> 'g'""",
    "symbol_extract": rf"""WITH m AS (SELECT line_id, list_transform(regexp_extract_all(line, '[A-H]\d{{2}}[A-Z]\s?\d{{1,4}}/\d{{2,6}}'), lambda s: s[1:4] || lpad(regexp_extract(s, '(\d{{1,4}})/', 1), 4, '0') || rpad(regexp_extract(s, '/(\d+)', 1), 6, '0')) a FROM raw_cases)
SELECT line_id, array_to_string(list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda z: list_position(a, z[1]) = z[2]), lambda z: z[1]), '|') AS symbols FROM m""",
    "titles_table": f"WITH t AS (SELECT {_norm('symbol')} symbol, trim(regexp_replace(coalesce(title, ''), '{_WS}+', ' ', 'g')) title FROM titles_overlay) SELECT symbol, max(title) AS title FROM t WHERE title <> '' GROUP BY symbol",
    "title_overlay": f"""WITH {_E}, t AS (SELECT {_norm('symbol')} symbol, trim(regexp_replace(coalesce(title, ''), '{_WS}+', ' ', 'g')) title FROM titles_overlay), u AS (SELECT symbol, max(title) title FROM t WHERE title <> '' GROUP BY symbol)
SELECT e.version, e.symbol, coalesce(u.title, e.title) AS title FROM e LEFT JOIN u ON u.symbol = e.symbol WHERE lang = 'PT'""",
    "parent_resolve": f"WITH {_E} SELECT e.version, e.lang, e.symbol, coalesce(p.pos, -1) AS parent_pos FROM e LEFT JOIN e p ON p.version = e.version AND p.lang = e.lang AND p.symbol = e.parent",
    "children_lists": f"WITH {_E} SELECT e.version, e.lang, p.pos AS parent_pos, e.pos AS child_pos FROM e JOIN e p ON p.version = e.version AND p.lang = e.lang AND p.symbol = e.parent",
    "path_materialize": f"WITH RECURSIVE {_PATHS} SELECT version, lang, symbol, path FROM pa",
    "path_text_render": f"""WITH RECURSIVE {_PATHS}, x AS (SELECT version, lang, symbol, unnest(arr) s, unnest(range(0, len(arr))) i FROM pa),
y AS (SELECT x.version, x.lang, x.symbol, list(e.heading ORDER BY i) h, list(e.title ORDER BY i) t FROM x JOIN e ON e.version = x.version AND e.lang = x.lang AND e.symbol = x.s GROUP BY ALL),
z AS (SELECT version, lang, symbol, array_to_string(list_filter(flatten(list_transform(range(1, len(h) + 1), lambda i: [h[i], t[i]])), lambda w: w <> ''), ' > ') text FROM y)
SELECT version, lang, symbol, text, sha256(text)[1:16] AS text_hash FROM z""",
    "closure_distances": f"WITH RECURSIVE {_PATHS}, x AS (SELECT version, lang, unnest(arr) ancestor, unnest(range(len(arr) - 1, -1, -1)) d FROM pa) SELECT version, lang, ancestor, count(*) AS n, max(d)::BIGINT AS height FROM x GROUP BY ALL",
    "guidance_heading": f"""WITH {_E}, k AS (SELECT *, CASE WHEN pos % 4 = 0 THEN 'g' ELSE 'm' END kind, CASE WHEN pos % 8 = 0 THEN symbol[1:4] || lpad((symbol[5:8]::INT + 20)::VARCHAR, 4, '0') || '000000' END es FROM e WHERE level = 'group' AND parent IS NOT NULL AND length(symbol) = 14),
w AS (SELECT *, last_value(CASE WHEN kind = 'g' THEN {{'t': title, 'e': coalesce(es, symbol)}} END IGNORE NULLS) OVER (PARTITION BY version, lang, parent ORDER BY pos ROWS UNBOUNDED PRECEDING) g FROM k)
SELECT version, lang, symbol, CASE WHEN symbol <= g.e THEN g.t ELSE '' END AS heading FROM w WHERE kind = 'm'""",
    "index_diff": f"WITH {_DIFF} SELECT version, lang, symbol, status FROM d",
    "index_diff_report": f"""WITH {_DIFF} SELECT version, lang, count(*) FILTER (status <> 'removed') AS total, count(*) FILTER (status = 'reused') AS reused, count(*) FILTER (status IN ('added', 'changed')) AS computed,
count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed FROM d GROUP BY ALL""",
    "removed_entries": f"WITH {_DIFF} SELECT version, lang, symbol FROM d WHERE status = 'removed'",
    "vector_reuse": f"WITH {_NEW} SELECT n.version, n.lang, n.symbol, o.vec_id AS reused_from FROM new n LEFT JOIN old o ON n.version = o.version AND n.lang = o.lang AND n.symbol = o.symbol AND n.text_hash = o.text_hash",
    "previous_version_asof": f"WITH {_NEW} SELECT version, lang, model, previous FROM pe",
    "index_scheme_mismatches": "SELECT i.symbol IS NULL AS not_embedded, count(*) AS n FROM ipc_index i FULL JOIN nodes n ON i.node_id = n.node_id WHERE i.symbol IS DISTINCT FROM n.symbol GROUP BY ALL",
    "version_list_valid": "SELECT version FROM nodes WHERE try_strptime(version, '%Y%m%d') IS NOT NULL UNION SELECT version FROM index_meta",
    "version_resolve": "SELECT 'latest' AS spec, max(version) AS version FROM nodes UNION ALL SELECT 'current', max(version) FROM nodes WHERE version <= '20251201' UNION ALL SELECT '20200101', '20200101'",
    "symbol_paths_of_index": """SELECT m.version, m.lang, lower(trim(regexp_replace(model, '[^A-Za-z0-9.]+', '-', 'g'), '-')) AS model, rows_built, n, with_vector
FROM index_meta m LEFT JOIN (SELECT version, lang, count(*) n, count(vectors) with_vector FROM ipc_index GROUP BY ALL) c USING (version, lang)""",
}
